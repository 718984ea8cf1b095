"""Deeply nested records as related flat tables.

Method: a merged schema is inferred over all bodies; along it, every array level is exploded recursively into rows of a
child table that carry the parent's surrogate key and the place in the array. All levels are exploded in one pass over
the bodies: one expression per array level, built from the merged schema, and a single generator at the end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftaudit.functions.ids import let
from driftaudit.functions.normalize import WHITE

ITEM = "[]"


@dataclass
class Shape:
    """What occurs at one place of the bodies: kinds of value, fields of its objects, and the items of its arrays."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Shape] = field(default_factory=dict)
    item: Shape | None = None

    def at(self, path: Iterable[str]) -> Shape:
        node = self
        for step in path:
            if step == ITEM:
                node.item = node.item or Shape()
                node = node.item
            else:
                node = node.fields.setdefault(step, Shape())
        return node

    def any(self, test: Callable[[Shape], bool]) -> bool:
        return test(self) or any(s.any(test) for s in self.fields.values()) or bool(self.item and self.item.any(test))


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def _read(body: str | None):
    """What a body says, out of as many JSON strings as it stands in; None if it can't be read as JSON."""
    while isinstance(body, str):
        try:
            body = json.loads(body.strip(WHITE), parse_constant=_no_number)
        except (ValueError, RecursionError):
            return None
    return body


def _paths(value, path: tuple[str, ...], seen: set) -> None:
    stack = [(value, path)]
    while stack:
        v, p = stack.pop()
        if isinstance(v, dict):
            seen.add((p, "object"))
            stack.extend((x, (*p, k)) for k, x in v.items())
        elif isinstance(v, list):
            seen.add((p, "array"))
            stack.extend((x, (*p, ITEM)) for x in v)
        else:
            seen.add((p, "null" if v is None else "string" if isinstance(v, str) else "other"))


def merged_schema(df: DataFrame, body: str, max_paths: int = 50_000) -> Shape:
    """The Shape of all readable bodies, of any depth. Each partition reports the places it has, once; they are united on the driver.

    What comes to the driver is as large as the schema, not as the data. Bodies that use data as field names would make
    it grow with the data; beyond `max_paths` places this raises instead of leaving any out.
    """

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for pdf in batches:
            for text in pdf[body]:
                _paths(_read(text), (), seen)
                if len(seen) > max_paths:
                    raise ValueError(f"more than {max_paths} places: field names seem to hold data")
        yield pd.DataFrame({"path": [json.dumps(p) for p, _ in seen], "kind": [k for _, k in seen]}, dtype=object)

    found = df.select(body).mapInPandas(places, "path string, kind string").distinct().limit(max_paths + 1).collect()
    if len(found) > max_paths:
        raise ValueError(f"more than {max_paths} places: field names seem to hold data")
    root = Shape()
    for row in sorted(found):
        root.at(json.loads(row.path)).kinds.add(row.kind)
    return root


@F.pandas_udf(T.StringType())
def _plain(s: pd.Series) -> pd.Series:
    """Bodies that a variant can't be made of as they stand, out of their strings and with the last of repeated members."""
    return s.map(lambda x: None if (v := _read(x)) is None else json.dumps(v), na_action="ignore")


def with_variant(df: DataFrame, body: str, name: str) -> DataFrame:
    """`df` with the body as a variant, null if it can't be read as JSON; a byte-order mark is dropped.

    Bodies in JSON strings, however many around each other, objects that repeat a member (the last counts) and bodies
    with something after a value go through Python; the others are parsed where they are.
    """
    text = F.btrim(F.col(body), F.lit(WHITE))
    hard = text.startswith('"') | text.rlike(r"[}\]]\s*[{\[]") | ~text.rlike(r"[}\]\w]\z")
    parsed = df.withColumn(name, F.when(~hard, F.try_parse_json(text)))
    opened = parsed.withColumn("plain_", _plain(F.when(F.col(name).isNull() & (text != ""), text)))
    return opened.withColumn(name, F.coalesce(F.col(name), F.try_parse_json("plain_"))).drop("plain_")


def _is_object(v: Column, shape: Shape) -> Column:
    """Looks only for what else occurs at the place: as a rule nothing or null."""
    if shape.kinds <= {"object", "null"}:
        return v.isNotNull() & ~F.is_variant_null(v) if "null" in shape.kinds else v.isNotNull()
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _string(v: Column) -> Column:
    """The string that a variant is; null for all else. Of the values that can be read as text only strings have the quote."""
    return F.when(F.to_json(v).startswith('"'), F.try_variant_get(v, "$", "string"))


def get(v: Column, *steps: str, to: str = "variant") -> Column:
    path = "$" + "".join("['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in steps)
    return F.try_variant_get(v, path, to)


def text_at(v: Column, *steps: str) -> Column:
    """The string at a place; null if what stands there is no string."""
    return _string(get(v, *steps))


#: What rows hand down to the rows inside them: name -> (object, shape, path, value so far) -> value. Strings.
Inherit = dict[str, Callable[[Column, Shape, tuple[str, ...], Column], Column]]


def explode_levels(df: DataFrame, key: list[str], body: str, schema: Shape, wanted: Callable[[Shape], bool] | None = None, inherit: Inherit | None = None) -> DataFrame:
    """(*key, level, node_id, parent_id, ordinal, node, *inherit): one row per object, of all levels.

    `level` is the place in the schema, as JSON, with `[]` for any element. Objects that stand in an array are rows, and
    so are objects that stand alone where other bodies have an array, and those whose shape is `wanted`; with `wanted`
    given, only those. `node_id` is a surrogate key, derived from the body's key, the level and the places on the way;
    `parent_id` is that of the nearest enclosing row. `ordinal` is the place in the innermost array, 0 outside any.
    Unreadable, null and empty bodies give no rows; equal bodies give rows with different keys.
    """
    inherit = inherit or {}

    def row(path, v, pos, parent, own, handed) -> Column:
        return F.struct(F.lit(json.dumps(path, ensure_ascii=False)).alias("level"), own.alias("node_id"), parent.alias("parent_id"), pos.cast("int").alias("ordinal"), v.alias("node"), *(c.alias(n) for n, c in handed.items()))

    def walk(shape: Shape, path: tuple[str, ...], v: Column, pos: Column, parent: Column, handed: dict[str, Column], listed: bool) -> Column:
        """The rows from v on. What is used more than once is bound to a variable, for lambdas have no common subexpressions."""
        out: list[Column] = []
        if "object" in shape.kinds:
            emit = wanted(shape) if wanted else listed or "array" in shape.kinds or not path
            inner = [(n, c) for n, c in sorted(shape.fields.items()) if c.kinds & {"object", "array"} and (not wanted or c.any(wanted))]

            def rows(x: Column) -> Column:
                own, given = x["own"], {n: x[n] for n in inherit}

                def below(name: str, child: Shape) -> Column:
                    return let(get(x["v"], name), lambda y: walk(child, (*path, name), y, F.lit(0), own, given, False))

                return union(([F.array(row(path, x["v"], pos, parent, own, given))] if emit else []) + [below(n, c) for n, c in inner])

            if emit or inner:
                own = F.xxhash64(parent, F.lit(json.dumps(path)), pos) if emit else parent
                bound = F.struct(v.alias("v"), own.alias("own"), *(f(v, shape, path, handed[n]).alias(n) for n, f in inherit.items()))
                out.append(F.when(_is_object(v, shape), let(bound, rows)))
        if "array" in shape.kinds and shape.item and shape.item.kinds & {"object", "array"} and (not wanted or shape.item.any(wanted)):
            items = F.try_variant_get(v, "$", "array<variant>")
            out.append(F.flatten(F.transform(items, lambda x, i: walk(shape.item, (*path, ITEM), x, i, parent, handed, True))))
        return union(out)

    kind = "array<struct<level:string,node_id:bigint,parent_id:bigint,ordinal:int,node:variant" + "".join(f",{n}:string" for n in inherit) + ">>"

    def union(parts: list[Column]) -> Column:
        none = F.array().cast(kind)
        return F.concat(*(F.coalesce(p, none) for p in parts)) if parts else none

    parsed = with_variant(df.select(*key, F.col(body).alias("body_")), "body_", "v")
    top = F.struct("v", F.xxhash64(*key).alias("id"))
    rows = let(top, lambda x: walk(schema, (), x["v"], F.lit(0), x["id"], {n: F.lit(None).cast("string") for n in inherit}, False))
    return parsed.select(*key, F.inline(rows))


def flat_table(levels: DataFrame, schema: Shape, path: tuple[str, ...], key: list[str]) -> DataFrame:
    """The flat table of one level: (*key, node_id, parent_id, ordinal, <a column per scalar field>).

    Fields of enclosed single objects become columns named with dots; a field that is not a scalar in some body is null there.
    """
    shape = schema.at(path)

    def scalars(s: Shape, at: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for name, child in sorted(s.fields.items()):
            if child.kinds & {"string", "other"}:
                yield (*at, name)
            if "object" in child.kinds and "array" not in child.kinds:
                yield from scalars(child, (*at, name))

    def scalar(c: Column) -> Column:
        return F.when(~F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(c, "$", "string"))

    rows = levels.where(F.col("level") == json.dumps(path, ensure_ascii=False))
    return rows.select(*key, "node_id", "parent_id", "ordinal", *(scalar(get(F.col("node"), *p)).alias(".".join(p)) for p in scalars(shape, ())))


def manifest_records(bodies: DataFrame) -> DataFrame:
    """(manifest_no, record_kind, record_id, parent_id, ordinal_pos), distinct, from all manifests at whatever depth.

    `artifact`: an object with a string artifact_id, under the build_id of its manifest. `chunk`: an object with an id
    beginning `chk_` and a locator that is not null, under its parse_run_id, else the parse run around it. `heading`: each
    entry of the locator's heading_path, a lone string being one entry, under the chunk. `tokenizer`: the name of the
    chunk's tokenizer, an object's name or a string up to `@`, under the chunk. A locator may be JSON text. The place is
    that in the list the record stands in, 0 if in none. Unreadable bodies, null entries and blank names give no records.
    """

    def has(s: Shape, *names: str) -> bool:
        return "object" in s.kinds and all(n in s.fields for n in names)

    def wanted(s: Shape) -> bool:
        return has(s, "artifact_id") and "string" in s.fields["artifact_id"].kinds or has(s, "id", "locator")

    def build(v, s, _, so_far):
        return F.coalesce(text_at(v, "build", "build_id"), so_far) if has(s, "build") and "build_id" in s.fields["build"].fields else so_far

    def run(v, s, path, so_far):
        if not has(s, "id"):
            return so_far
        own = text_at(v, "id")
        return F.coalesce(own if "parse_runs" in path[-2:] else F.when(own.startswith("prs_"), own), so_far)

    schema = merged_schema(bodies, "body")
    nodes = explode_levels(bodies, ["manifest_no"], "body", schema, wanted, {"build_id": build, "run_id": run})
    n = F.col("node")
    at = nodes.select(
        "manifest_no", "ordinal", "build_id", text_at(n, "artifact_id").alias("artifact_id"), text_at(n, "id").alias("chunk_id"), get(n, "locator").alias("loc"),
        F.coalesce(text_at(n, "parse_run_id"), F.col("run_id")).alias("run_id"), get(n, "tokenizer").alias("tok"),
    )
    is_chunk = F.col("chunk_id").startswith("chk_") & F.col("loc").isNotNull() & ~F.is_variant_null("loc")
    at = at.select(
        "manifest_no", "ordinal", "build_id", "artifact_id", "run_id", F.when(is_chunk, F.col("chunk_id")).alias("chunk_id"),
        "loc", "tok", _string(F.col("loc")).alias("loc_text"),
    )
    at = with_variant(at, "loc_text", "opened").withColumn("path", get(F.when(F.col("loc_text").isNull(), F.col("loc")).otherwise(F.col("opened")), "heading_path"))
    headings = F.coalesce(F.try_variant_get("path", "$", "array<string>"), F.array(_string(F.col("path"))))
    name = F.coalesce(text_at(F.col("tok"), "name"), F.substring_index(_string(F.col("tok")), "@", 1))

    def record(kind: str, rid: Column, parent: Column, pos: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_kind"), rid.alias("record_id"), parent.alias("parent_id"), pos.cast("int").alias("ordinal_pos"))

    zero, chunk = F.lit(0), F.col("chunk_id")
    records = F.concat(
        F.array(record("artifact", F.col("artifact_id"), F.col("build_id"), F.col("ordinal")), record("chunk", chunk, F.col("run_id"), F.col("ordinal")), record("tokenizer", F.when(chunk.isNotNull(), F.nullif(F.trim(name), F.lit(""))), chunk, zero)),
        F.coalesce(F.when(chunk.isNotNull(), F.transform(headings, lambda h, i: record("heading", h, chunk, i))), F.array().cast("array<struct<record_kind:string,record_id:string,parent_id:string,ordinal_pos:int>>")),
    )
    return at.select("manifest_no", F.inline(records)).where("record_id is not null").distinct()
