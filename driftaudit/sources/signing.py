"""Ed25519 signatures of manifests, with the JVM's own implementation."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import SparkSession

DOMAIN = b"driftaudit-manifest-v1\x00"
#: The DER prefixes of raw Ed25519 keys.
_PRIVATE, _PUBLIC = bytes.fromhex("302e020100300506032b657004220420"), bytes.fromhex("302a300506032b6570032100")


def _b64(b: bytes) -> str:
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def _unb64(s: str) -> bytes:
    return base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))


def fingerprint(public: bytes) -> str:
    return hashlib.sha256(public).hexdigest()


def generate(spark: SparkSession) -> tuple[bytes, bytes]:
    """Raw private and public key."""
    jvm = spark._jvm
    pair = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()

    def raw(key, spec: str) -> bytes:
        # through a key specification: the key's own class is not open to reflection
        return bytes(_factory(spark).getKeySpec(key, jvm.java.lang.Class.forName(f"java.security.spec.{spec}")).getEncoded())[-32:]

    return raw(pair.getPrivate(), "PKCS8EncodedKeySpec"), raw(pair.getPublic(), "X509EncodedKeySpec")


def _factory(spark: SparkSession):
    return spark._jvm.java.security.KeyFactory.getInstance("Ed25519")


def sign(spark: SparkSession, manifest_hash: str, private: bytes, public: bytes, issuer: str, signed_at: str) -> dict:
    key = _factory(spark).generatePrivate(spark._jvm.java.security.spec.PKCS8EncodedKeySpec(bytearray(_PRIVATE + private)))
    s = spark._jvm.java.security.Signature.getInstance("Ed25519")
    s.initSign(key)
    s.update(bytearray(DOMAIN + manifest_hash.encode()))
    return {"algorithm": "Ed25519", "key_fingerprint": fingerprint(public), "issuer": issuer, "signed_at": signed_at, "signature": _b64(bytes(s.sign()))}


def verify(spark: SparkSession, manifest_hash: str, signatures: list[dict], trusted: dict[str, bytes], complete: bool = True) -> tuple[str, list[str]]:
    """The overall state and that of each signature: VALID_TRUSTED, VALID_UNTRUSTED (no known key), INVALID or INCOMPLETE."""
    states = []
    for sig in signatures:
        public = trusted.get(sig["key_fingerprint"])
        if public is None:
            states.append("unknown_key")
            continue
        key = _factory(spark).generatePublic(spark._jvm.java.security.spec.X509EncodedKeySpec(bytearray(_PUBLIC + public)))
        v = spark._jvm.java.security.Signature.getInstance("Ed25519")
        v.initVerify(key)
        v.update(bytearray(DOMAIN + manifest_hash.encode()))
        try:
            states.append("valid" if v.verify(bytearray(_unb64(sig["signature"]))) else "invalid")
        except Exception:
            states.append("invalid")
    if not complete or not signatures:
        return "INCOMPLETE", states
    if "invalid" in states:
        return "INVALID", states
    return ("VALID_TRUSTED" if "valid" in states else "VALID_UNTRUSTED"), states
