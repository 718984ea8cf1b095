"""Personal data in free text: found, and replaced by typed placeholders.

Method: a linear-chain conditional random field over word-shape features, trained from a small labelled table, decoded by
Viterbi in numpy batches. Features are looked up as numbers for a whole batch of texts at once. An exact check follows: identity numbers need right check digits, addresses of mail a dotted
domain, names two parts; it drops or trims what the field found, and adds nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftaudit.llm.pii_training import labelled_rows, luhn_digit

TYPES = ["ADDRESS", "EMAIL", "ID_NUMBER", "NAME", "PHONE"]
TAGS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Inside an entity only after its beginning or inside.
_ALLOWED = np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])
_START = np.array([t[0] != "I" for t in TAGS])
_EAST = r"\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
#: Words of letters of one kind: kana, ideographs and syllables of Hangul end where others begin, as they have no spaces between.
_TOKEN = re.compile(rf"[^\W\d_{_EAST}]+(?:[’'][^\W\d_{_EAST}]+)?|[\u3040-\u30ff]+|[\u3400-\u9fff]+|[\uac00-\ud7af]+|\d+|[^\s]")
#: Runs of digits with what numbers are set apart by, and runs of the form of an account number.
_RUN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z\d]{2,4}){3,8}(?![A-Za-z\d])|\+?\(?\d[\d ()./-]*\d|\d")
REACH = 3  # words on either side that a word's own features speak for
EDGE = "\x00"


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def shape(w: str) -> str:
    if w.isdigit():
        return f"9{len(w)}"
    if w.isalpha() or "’" in w or "'" in w[1:]:
        script = "" if ord(w[0]) < 0x250 else f"{ord(w[0]) >> 8:x}"
        kind = "X" if w.isupper() else "x" if w.islower() else "Xx" if w[0].isupper() else "m"
        return f"{kind}{min(len(w), 4)}{script}"
    return w


def _own(w: str) -> list[str]:
    if w == EDGE:
        return [EDGE]
    low = w.lower()
    return [f"w{low}", f"s{shape(w)}", f"p{low[:2]}", f"e{low[-3:]}", f"e{low[-2:]}"] if not w.isdigit() else [f"s{shape(w)}", f"d{w[:1]}{len(w)}", f"w{w}" if len(w) < 5 else f"n{w[:2]}"]


def _runs(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """Per token: the form of the number it is in (lengths of its groups and what is between), and of the word around it: of mail, of a link."""
    out = [""] * len(spans)
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        form = "iban" if text[a].isalpha() else re.sub(r"\d+", lambda d: str(len(d[0])), m[0])[:24]
        while at < len(spans) and spans[at][0] < a:
            at += 1
        first = True
        while at < len(spans) and spans[at][0] < b:
            out[at] = f"{'b' if first else 'i'}{form}|{sum(c.isdigit() for c in m[0])}"
            first = False
            at += 1
    if "@" in text or "://" in text:
        at = 0
        for m in re.finditer(r"\S+", text):
            kind = "@." if re.search(r"@[^@]*\.", m[0]) else "@" if "@" in m[0] else "u" if "://" in m[0] else ""
            while at < len(spans) and spans[at][0] < m.end():
                if kind:
                    out[at] += f"|{kind}"
                at += 1
    return out


class Coded:
    """Texts as flat arrays: per token the numbers of its word, shape, lower-case form, gap before it and form of number.

    REACH edges stand before, between and after the texts. Numbers are those of the vocabularies; where these are closed,
    what they don't have is -1. Words are numbered for this batch only.
    """

    def __init__(self, texts: list[str], shapes: dict[str, int], lows: dict[str, int], runs: dict[str, int], grow: bool):
        def number(vocabulary: dict[str, int], key: str) -> int:
            return vocabulary.setdefault(key, len(vocabulary)) if grow else vocabulary.get(key, -1)

        self.words: dict[str, int] = {EDGE: 0}
        word, gap, run, self.spans, self.sizes = [0] * REACH, [0] * REACH, [-1] * REACH, [], []
        empty = number(runs, "")
        for text in texts:
            spans, end = [], -1
            for m in _TOKEN.finditer(text):
                a, b = m.span()
                word.append(self.words.setdefault(m[0], len(self.words)))
                gap.append(3 if end < 0 else 0 if a == end else 2 if "\n" in text[end:a] else 1)
                spans.append((a, b))
                end = b
            run += [number(runs, x) if x else empty for x in _runs(text, spans)]
            self.spans.append(spans)
            self.sizes.append(len(spans))
            for column, fill in ((word, 0), (gap, 0), (run, -1)):
                column += [fill] * REACH
        self.word = np.array(word)
        real, at = [], REACH
        for n in self.sizes:
            real.append(np.arange(at, at + n))
            at += n + REACH
        self.at = np.concatenate(real) if real else np.zeros(0, np.int64)
        of_word = [(number(shapes, shape(w) if w != EDGE else w), number(lows, "9" if w.isdigit() else w.lower())) for w in self.words]
        s, low = (np.array(x)[self.word] for x in zip(*of_word, strict=True))
        self.shape = np.where(s < 0, -1, s * 4 + np.array(gap))
        self.low, self.run = low, np.array(run)

    def joint(self) -> list[np.ndarray]:
        """A number per token and template for what its neighbourhood is; -1 where a part of it is unknown."""

        def key(*parts: np.ndarray) -> np.ndarray:
            out = np.zeros(len(self.at), np.int64)
            for p in parts:
                out = (out << 20) + p
            return np.where(np.minimum.reduce(parts) < 0, -1, out)

        s, low, r = ((lambda k, x=x: x[self.at + k]) for x in (self.shape, self.low, self.run))
        return [key(s(0)), key(s(-1), s(0)), key(s(0), s(1)), key(s(-1), s(0), s(1)), key(low(-1), s(0)), key(s(0), low(1)), key(low(-2), low(-1), s(0)), key(s(0), low(1), low(2)), key(r(0)), key(r(0), r(1)), key(low(-1), r(0))]


class _Groups:
    """Sums of rows that share a number 0..n-1, each of which occurs."""

    def __init__(self, number: np.ndarray, n: int):
        self.order = np.argsort(number, kind="stable")
        self.cuts = np.searchsorted(number[self.order], np.arange(n))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows[self.order], self.cuts, axis=0)


class Field:
    """The trained field: weights per feature and tag, and per pair of tags."""

    def __init__(self, vocabularies: tuple[dict, dict, dict], own: dict[str, int], own_weights: np.ndarray, keys: list[np.ndarray], joint_weights: list[np.ndarray], pairs: np.ndarray, start: np.ndarray):
        self.vocabularies, self.own, self.own_weights, self.keys, self.joint_weights, self.pairs, self.start = vocabularies, own, own_weights, keys, joint_weights, pairs, start
        self._types: dict[str, np.ndarray] = {}

    def _type(self, w: str) -> np.ndarray:
        """Score rows of a word at each offset; kept, as words repeat."""
        if (rows := self._types.get(w)) is None:
            ids = [i for f in _own(w) if (i := self.own.get(f)) is not None]
            rows = self.own_weights[:, ids].sum(1) if ids else np.zeros((2 * REACH + 1, len(TAGS)), np.float32)
            if len(self._types) > 200_000:
                self._types.clear()
            self._types[w] = rows
        return rows

    def emissions(self, coded: Coded) -> np.ndarray:
        rows = np.stack([self._type(w) for w in coded.words])
        e = np.zeros((len(coded.at), len(TAGS)), np.float32)
        for o in range(-REACH, REACH + 1):
            e += rows[coded.word[coded.at + o], o + REACH]
        for key, known, weights in zip(coded.joint(), self.keys, self.joint_weights, strict=True):
            i = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[i] == key
            e[hit] += weights[i[hit]]
        return e

    def viterbi(self, emissions: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        """The best tags of each sequence; sequences of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        order = sorted((i for i in range(len(sizes)) if sizes[i]), key=sizes.__getitem__)
        pairs = np.where(_ALLOWED, self.pairs, -1e9).astype(np.float32)
        first = np.where(_START, self.start, -1e9).astype(np.float32)
        while order:
            part = order[:256]
            while len(part) > 1 and sizes[part[-1]] > 2 * sizes[part[0]] + 16:  # little padding, and a very long text by itself
                part.pop()
            del order[: len(part)]
            size = np.array([sizes[i] for i in part])
            top, n = int(size.max()), np.arange(len(part))
            e = np.zeros((len(part), top, len(TAGS)), np.float32)
            for k, i in enumerate(part):
                e[k, : size[k]] = emissions[begin[i] : begin[i + 1]]
            score = first + e[:, 0]
            back = np.zeros((top, len(part), len(TAGS)), np.int8)
            for t in range(1, top):
                step = score[:, :, None] + pairs
                back[t] = best = step.argmax(1)
                moved = np.take_along_axis(step, best[:, None], 1)[:, 0] + e[:, t]
                score = moved if t < size[0] else np.where((t < size)[:, None], moved, score)
            path = np.empty((len(part), top), np.int8)
            tag = score.argmax(1)
            for t in range(top - 1, -1, -1):
                path[:, t] = tag
                if t:
                    tag = np.where(t < size, back[t, n, tag], tag)
            for k, i in enumerate(part):
                out[i] = path[k, : size[k]]
        return out

    def entities(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans and types per text, before any check."""
        coded = Coded(texts, *self.vocabularies, grow=False)
        paths = self.viterbi(self.emissions(coded), coded.sizes)
        out: list[list[tuple[int, int, str]]] = []
        for spans, path in zip(coded.spans, paths, strict=True):
            found: list[tuple[int, int, str]] = []
            for i in np.flatnonzero(path):
                a, b = spans[i]
                name = TAGS[path[i]]
                if name[0] == "B":
                    found.append((a, b, name[2:]))
                else:
                    found[-1] = (found[-1][0], b, found[-1][2])
            out.append(found)
        return out


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 90, rate: float = 0.12, l2: float = 1.5e-3, least: int = 2) -> Field:
    """Maximum likelihood with forward and backward sums over padded batches, by full-batch RMSprop from zero; deterministic.

    Features that occur fewer than `least` times are left out.
    """
    vocabularies: tuple[dict, dict, dict] = ({}, {}, {})
    coded = Coded([t for t, _ in rows], *vocabularies, grow=True)
    keep = [i for i, n in enumerate(coded.sizes) if n]
    size = np.array([coded.sizes[i] for i in keep])
    n, top, k = len(keep), int(size.max()), len(TAGS)
    real = np.arange(top) < size[:, None]
    gold = []
    for i in keep:
        tags = np.zeros(coded.sizes[i], np.int64)
        for a, b, kind in rows[i][1]:
            inside = [j for j, (x, y) in enumerate(coded.spans[i]) if x >= a and y <= b]
            tags[inside] = _TAG[f"I-{kind}"]
            tags[inside[0]] = _TAG[f"B-{kind}"]
        gold.append(tags)
    # a word's own features: (word, feature) pairs, summed either way
    word_of = coded.word[coded.at]
    often = np.bincount(word_of, minlength=len(coded.words))
    own: dict[str, int] = {}
    listed = [_own(w) for w in coded.words]
    seen: dict[str, int] = {}
    for features, c in zip(listed, often, strict=True):
        for f in features:
            seen[f] = seen.get(f, 0) + int(c)
    seen[EDGE] = least
    pair_word, pair_own = [], []
    for i, features in enumerate(listed):
        for f in features:
            if seen[f] >= least:
                pair_word.append(i)
                pair_own.append(own.setdefault(f, len(own)))
    pair_word_, pair_own_ = np.array(pair_word), np.array(pair_own)
    by_own = _Groups(pair_own_, len(own))
    offsets = range(-REACH, REACH + 1)
    at_offset = [coded.word[coded.at + o] for o in offsets]
    words_at = [np.unique(w, return_inverse=True) for w in at_offset]
    by_word = [(u, _Groups(inverse, len(u))) for u, inverse in words_at]
    # joint features: of each template the keys that are frequent enough
    keys, where, sums = [], [], []
    for key in coded.joint():
        u, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        fine = np.flatnonzero(counts >= least)
        new = np.full(len(u), len(fine))
        new[fine] = np.arange(len(fine))
        keys.append(u[fine])
        where.append(new[inverse])  # len(fine) stands for none
        sums.append(_Groups(np.concatenate([new[inverse], [len(fine)]]), len(fine) + 1))
    want = np.eye(k, dtype=np.float32)[np.concatenate(gold)]
    want_pairs = np.zeros((k, k))
    for g in gold:
        np.add.at(want_pairs, (g[:-1], g[1:]), 1)
    want_start = np.bincount([g[0] for g in gold], minlength=k).astype(float)
    params = [np.zeros((len(offsets), len(own), k), np.float32), *(np.zeros((len(x) + 1, k), np.float32) for x in keys), np.zeros((k, k)), np.zeros(k)]
    w, joint, (pairs, start) = params[0], params[1:-2], params[-2:]
    squares = [np.zeros_like(x) for x in params]
    word_rows = np.zeros((len(coded.words), k), np.float32)
    for no in range(rounds):
        flat = np.zeros((len(coded.at), k), np.float32)
        for i, seen_words in enumerate(at_offset):
            table = np.zeros_like(word_rows)
            np.add.at(table, pair_word_, w[i][pair_own_])
            flat += table[seen_words]
        for weights, i in zip(joint, where, strict=True):
            flat += weights[i]
        e = np.zeros((n, top, k), np.float32)
        e[real] = flat
        p = np.where(_ALLOWED, pairs, -1e9)
        m = np.exp(p - p.max())
        alpha, scale = np.zeros((n, top, k)), np.ones((n, top))
        emit = np.exp(e - e.max(2, keepdims=True))
        a = np.where(_START, np.exp(start), 0) * emit[:, 0]
        scale[:, 0] = a.sum(1)
        alpha[:, 0] = a / scale[:, :1]
        for t in range(1, top):
            a = (alpha[:, t - 1] @ m) * emit[:, t]
            s = a.sum(1)
            live = real[:, t]
            scale[live, t] = s[live]
            alpha[:, t] = np.where(live[:, None], a / np.where(live, s, 1)[:, None], alpha[:, t - 1])
        beta = np.ones((n, top, k))
        pair_sum = np.zeros((k, k))
        for t in range(top - 2, -1, -1):
            live = real[:, t + 1]
            nxt = emit[:, t + 1] * beta[:, t + 1] / scale[:, t + 1][:, None]
            pair_sum += m * (alpha[:, t].T @ np.where(live[:, None], nxt, 0))
            beta[:, t] = np.where(live[:, None], nxt @ m.T, 1)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        diff = (want - gamma[real].astype(np.float32)) / n
        grad_own = np.empty_like(w)
        for i, (u, group) in enumerate(by_word):
            rows_ = np.zeros_like(word_rows)
            rows_[u] = group(diff)
            grad_own[i] = by_own(rows_[pair_word_])
        grad_own -= l2 * w
        with_none = np.concatenate([diff, np.zeros((1, k), np.float32)])
        grads = [grad_own]
        for weights, group in zip(joint, sums, strict=True):
            g = group(with_none) - l2 * weights
            g[-1] = 0
            grads.append(g)
        grads += [(want_pairs - pair_sum) / n, (want_start - gamma[:, 0].sum(0)) / n]
        step = rate * (1 - no / rounds) + 0.01
        for x, g, q in zip(params, grads, squares, strict=True):
            q *= 0.9
            q += 0.1 * g * g
            x += step * g / (np.sqrt(q) + 1e-6)
    return Field(vocabularies, own, w, keys, [x[:-1] for x in joint], pairs, start)


#: Labelled rows that the field is trained from unless told otherwise: the bound on the size of its training.
TRAINING_ROWS = 2000


@lru_cache(maxsize=2)
def trained(rows: int = TRAINING_ROWS, seed: int = 7) -> Field:
    return train(labelled_rows(rows, seed))


def save(field: Field, path: str) -> None:
    """Writes a trained field to a file of a few megabytes, so that sessions need not train it again."""
    names = [np.frombuffer(json.dumps(list(v)).encode(), np.uint8) for v in (*field.vocabularies, field.own)]
    arrays = {f"names{i}": x for i, x in enumerate(names)} | {f"key{i}": x for i, x in enumerate(field.keys)} | {f"joint{i}": x for i, x in enumerate(field.joint_weights)}
    np.savez_compressed(path, own=field.own_weights, pairs=field.pairs, start=field.start, **arrays)


def load(path: str) -> Field:
    with np.load(path) as z:
        shapes, lows, runs, own = ({x: i for i, x in enumerate(json.loads(z[f"names{k}"].tobytes()))} for k in range(4))
        n = sum(x.startswith("key") for x in z.files)
        return Field((shapes, lows, runs), own, z["own"], [z[f"key{i}"] for i in range(n)], [z[f"joint{i}"] for i in range(n)], z["pairs"], z["start"])


_AT = r"(?:\s*[\(\[]\s*at\s*[\)\]]\s*|\s+AT\s+|[@＠])"
_DOT = r"(?:\s*[\(\[]\s*dot\s*[\)\]]\s*|\s+DOT\s+|\.)"
_SIGN = re.compile(_AT, re.IGNORECASE)
_HOST = re.compile(rf"(?:[\w-]+{_DOT})+[^\W\d_]{{2,}}", re.IGNORECASE)


def mail_spans(text: str) -> list[tuple[int, int]]:
    """The addresses of mail in a text, of any length: from each sign to the left as far as a local part goes, to the right as far as a host."""
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        a = m.start()
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+%'-"):
            a -= 1
        host = _HOST.match(text, m.end())
        if host and a < m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            out.append((a, host.end()))
    return out


def _iban_ok(s: str) -> bool:
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _tckn_ok(s: str) -> bool:
    d = list(map(int, s))
    return d[0] != 0 and (sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def id_number_ok(raw: str) -> bool:
    """A US social security number, Turkish identity number, IBAN or payment card number with right check digits."""
    if m := re.fullmatch(r"(\d{3})([- ]?)(\d{2})\2(\d{4})", raw):
        return m[1] not in ("000", "666") and m[1][0] != "9" and m[3] != "00" and m[4] != "0000"
    s = re.sub(r"[\s-]", "", raw).upper()
    if re.fullmatch(r"\d{11}", s):
        return _tckn_ok(s)
    if re.fullmatch(r"\d{13,19}", s):
        return luhn_digit(s[:-1]) == s[-1]
    return _iban_ok(s)


_EXTENSION = re.compile(r"\s*\(?\s*(?:ext|extension|x|poste|Durchwahl|dahili|int)\b\.?", re.IGNORECASE)
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Hr|Fr|Mme|M|Sr|Sra|Dra|user|Name)\b[.:]?\s+", re.IGNORECASE)


def checked(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What remains of the entities: trimmed of punctuation around them, and only those that pass the check of their type."""
    out, mails = [], None
    for a, b, kind in found:
        if kind == "ID_NUMBER":
            while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
                b += 1
            while a > 0 and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
        if kind == "PHONE" and (m := _EXTENSION.search(text, a, b)):
            b = m.start()
        opened = "" if kind != "PHONE" else "(+"
        while a < b and not (text[a].isalnum() or text[a] in opened):
            a += 1
        while b > a and not (text[b - 1].isalnum()):
            b -= 1
        part = text[a:b]
        if kind == "EMAIL":
            mails = mail_spans(text) if mails is None else mails
            hit = next(((x, y) for x, y in mails if x < b and y > a), None)
            if not hit:
                continue
            a, b = hit
            while not text[a].isalnum():
                a += 1
        elif kind == "ID_NUMBER" and not id_number_ok(part) or kind == "PHONE" and not 7 <= sum(c.isdigit() for c in part) <= 15:
            continue
        elif kind == "NAME":
            if m := _TITLE.match(part):
                a += m.end() if m.end() < len(part) else 0
                part = text[a:b]
            words = re.findall(r"[^\W\d_]+", part)
            if len(words) < 2 or not any(len(x) > 1 for x in words) or "." not in part and "," not in part and not re.search(r"[^\W\d_]\s+[^\W\d_]", part):
                continue
        elif kind == "ADDRESS" and not (any(c.isdigit() for c in part) and sum(c.isalpha() for c in part) > 3):
            continue
        if out and a < out[-1][1]:
            continue
        out.append((a, b, kind))
    return out


FIELDS = ("notes", "contact_email", "text")


def find(rows: DataFrame, key: str = "note_id", fields: tuple[str, ...] = FIELDS, training_rows: int = TRAINING_ROWS, field: Field | None = None) -> DataFrame:
    """(<key>, field_name, entity_type, start_pos, end_pos): every entity of the fields' texts.

    Positions are 0-based code points of the stored text, end exclusive, without punctuation around the entity. Null,
    empty and blank texts hold nothing; equal rows give equal results; very long texts are decoded whole. Unless a `field`
    is given (see `load`), it is trained on the driver from `training_rows` labelled rows, a bound on its size, once in a
    process; it is sent along with the function.
    """
    field = field or trained(training_rows)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo : lo + 2048]
                texts = part["text_"].tolist()
                hits = [(k, f, *e) for k, f, t, found in zip(part[key], part["field_name"], texts, field.entities(texts), strict=True) for e in checked(t, found)]
                yield pd.DataFrame(hits, columns=[key, "field_name", "start_pos", "end_pos", "entity_type"]).astype({"start_pos": "int32", "end_pos": "int32"})

    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text_")) for f in fields))).alias("x")).select(key, "x.*")
    long = long.where("trim(text_) <> ''")
    kind = dict(rows.dtypes)[key]
    # the key as text: pandas would make floats of integers beside a null
    found = long.withColumn(key, F.col(key).cast("string")).mapInPandas(scan, f"{key} string, field_name string, start_pos int, end_pos int, entity_type string")
    return found.select(F.col(key).cast(kind).alias(key), "field_name", "entity_type", "start_pos", "end_pos")


def redact(rows: DataFrame, fields: tuple[str, ...] = FIELDS, training_rows: int = TRAINING_ROWS, field: Field | None = None) -> DataFrame:
    """`rows` with each entity in the fields replaced by its type in brackets (`[EMAIL]`), and all else unchanged."""
    field = field or trained(training_rows)

    @F.pandas_udf("string")
    def placeholders(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        out = []
        for lo in range(0, len(texts), 2048):
            part = texts[lo : lo + 2048]
            for t, found in zip(part, field.entities(part), strict=True):
                for a, b, kind in reversed(checked(t, found)):
                    t = f"{t[:a]}[{kind}]{t[b:]}"
                out.append(t)
        return pd.Series(out, index=s.index).where(s.notna(), None)

    return rows.withColumns({f: placeholders(F.col(f)) for f in fields})
