"""Documents to ordered elements, one parser per media type, in Arrow batches.

Every document gives one outcome: a status, what went wrong or looked odd, its front matter and its elements. A document
that can't be parsed, takes too long or says too much is a failed outcome, never a failed query.
"""

from __future__ import annotations

import csv
import io
import json
import re
import signal
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Element = tuple[str, str, list[str], str | None, str | None]  # kind, text, heading path, table caption, table header


@dataclass
class Parsed:
    elements: list[Element] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)  # code, message
    front_matter: dict | None = None


@dataclass(frozen=True)
class Limits:
    """Per document. The memory of a worker as a whole is Spark's to bound (spark.executor.pyspark.memory)."""

    max_input_bytes: int = 100 << 20
    max_output_bytes: int = 50 << 20
    timeout_seconds: float = 30.0


def _plain_ends(text: str) -> str:
    return text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


def parse_text(text: str) -> Parsed:
    return Parsed([("paragraph", p.strip(), [], None, None) for p in _plain_ends(text).split("\n\n") if p.strip()])


class Headings:
    """The headings above a place: a heading of a level ends those of its level and below."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = []

    def path(self) -> list[str]:
        return [t for _, t in self.open]

    def enter(self, level: int, text: str) -> Element:
        """The element of a heading, whose path is that of its ancestors, and from here on the heading is above what follows."""
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        element = ("title" if level == 1 else "heading", text, self.path(), None, None)
        self.open.append((level, text))
        return element


_FENCE, _HEADING, _ITEM = re.compile(r"```|~~~"), re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\s*(?:[-*+]|\d+\.)\s+(.*)$")
_ROW, _RULE, _CAPTION = re.compile(r"\s*\|.*\|\s*$"), re.compile(r"(?=.*-)\s*\|?[\s:|-]+\|?\s*$"), re.compile(r"table:\s*(.+)$", re.IGNORECASE)


def _front_matter(text: str, out: Parsed) -> str:
    m = re.match(r"---\n(.*?\n)---\n?", text, re.DOTALL)
    if not m:
        return text
    try:
        import yaml

        doc = yaml.safe_load(m[1])
    except ImportError:
        doc = dict(re.findall(r"^([\w.-]+):[ \t]*(.*?)[ \t]*$", m[1], re.MULTILINE))
    except yaml.YAMLError:
        doc, _ = None, out.warnings.append(("FRONTMATTER_YAML_INVALID", "the front matter is no YAML"))
    else:
        if not isinstance(doc, dict):
            doc, _ = None, out.warnings.append(("FRONTMATTER_NOT_A_MAPPING", "the front matter is no mapping"))
    out.front_matter = doc
    return text[m.end() :]


def _cells(line: str) -> str:
    return " | ".join(c.strip() for c in line.strip().strip("|").split("|"))


def parse_markdown(text: str) -> Parsed:
    """Front matter is kept apart; fences, headings, lists, pipe tables (a row, a rule, rows) and paragraphs become elements.

    A heading of level 1 is a title. The path of an element is that of the headings above it, a heading's that of its
    ancestors. A paragraph `Table: ...` right before a table is the table's caption.
    """
    out = Parsed()
    lines = _front_matter(_plain_ends(text), out).split("\n")
    above, held = Headings(), []

    def add(kind: str, body: str, caption: str | None = None, header: str | None = None) -> None:
        out.elements.append((kind, body, above.path(), caption, header))

    def close() -> None:
        if body := " ".join(x.strip() for x in held if x.strip()):
            add("paragraph", body)
        held.clear()

    at = 0
    while at < len(lines):
        line, at = lines[at], at + 1
        if m := _FENCE.match(line.strip()):
            close()
            end = next((i for i in range(at, len(lines)) if lines[i].strip().startswith(m[0])), len(lines))
            add("code", "\n".join(lines[at:end]))
            at = end + 1
        elif m := _HEADING.match(line):
            close()
            out.elements.append(above.enter(len(m[1]), m[2].strip()))
        elif _ROW.match(line) and at < len(lines) and _RULE.match(lines[at]):
            close()
            caption = None
            if out.elements and out.elements[-1][0] == "paragraph" and (m := _CAPTION.match(out.elements[-1][1])):
                caption = m[1].strip()
                out.elements.pop()
            end = next((i for i in range(at + 1, len(lines)) if not _ROW.match(lines[i])), len(lines))
            for row in [line, *lines[at + 1 : end]]:
                add("table", _cells(row), caption, _cells(line))
            at = end
        elif m := _ITEM.match(line):
            close()
            add("list_item", m[1].strip())
        elif line.strip():
            held.append(line)
        else:
            close()
    close()
    return out


class _Html(HTMLParser):
    """Blocks that are captured are headings, p, li and pre; text outside any is a paragraph of its own.

    As HTML lets authors leave out end tags, a block also ends where the next of its kind begins, and at the end of the text.
    """

    CAPTURED = {"p": "paragraph", "li": "list_item", "pre": "code"} | {f"h{i}": "heading" for i in range(1, 7)}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.above = Headings()
        self.loose: list[str] = []
        self.blocks: list[tuple[str, list[str]]] = []  # tag, texts
        self.tables: list[tuple[list[str], list[list[list[str]]]]] = []  # texts of the caption, cells of the rows
        self.quiet = 0
        self.captioning = False

    def settle(self) -> None:
        if text := _joined(self.loose):
            self.out.append(("paragraph", text, self.above.path(), None, None))
        self.loose = []

    def end_block(self) -> None:
        tag, texts = self.blocks.pop()
        text = "".join(texts).strip("\n") if tag == "pre" else _joined(texts)
        if text:
            self.out.append(self.above.enter(int(tag[1]), text) if tag[0] == "h" else (self.CAPTURED[tag], text, self.above.path(), None, None))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.quiet += 1
        elif self.tables:
            self.captioning = tag == "caption" or self.captioning and tag not in ("tr", "td", "th")
            rows = self.tables[-1][1]
            if tag == "tr" or tag in ("td", "th") and not rows:
                rows.append([])
            if tag in ("td", "th"):
                rows[-1].append([])
        elif tag == "table":
            self.settle()
            self.tables.append(([], []))
        elif tag in self.CAPTURED:
            self.settle()
            if self.blocks and self.blocks[-1][0] == tag and tag in ("p", "li"):
                self.end_block()
            self.blocks.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif self.tables:
            if tag == "caption":
                self.captioning = False
            elif tag == "table":
                self.end_table()
        elif tag in self.CAPTURED and any(t == tag for t, _ in self.blocks):
            while self.blocks[-1][0] != tag:
                self.end_block()
            self.end_block()

    def end_table(self) -> None:
        caption, rows = self.tables.pop()
        texts = [[("".join(cell)).strip() for cell in row] for row in rows]
        texts = [row for row in texts if any(row)]
        for row in texts:
            self.out.append(("table", " | ".join(row), self.above.path(), _joined(caption) or None, " | ".join(texts[0])))

    def handle_data(self, data: str) -> None:
        if self.quiet:
            return
        if self.tables:
            caption, rows = self.tables[-1]
            if self.captioning:
                caption.append(data)
            elif rows and rows[-1]:
                rows[-1][-1].append(data)
        else:
            (self.blocks[-1][1] if self.blocks else self.loose).append(data)

    def finish(self) -> list[Element]:
        while self.tables:
            self.end_table()
        while self.blocks:
            self.end_block()
        self.settle()
        return self.out


def _joined(texts: list[str]) -> str:
    return " ".join(t.strip() for t in texts if t.strip())


def parse_html(text: str) -> Parsed:
    p = _Html()
    p.feed(text.lstrip("﻿"))
    p.close()
    return Parsed(p.finish())


def parse_json(text: str) -> Parsed:
    """An element per item of an array, or per member of an object in order of name, or one."""
    v = json.loads(text.lstrip("﻿"))

    def shown(x) -> str:
        return x if isinstance(x, str) else json.dumps(x, indent=2, sort_keys=True, ensure_ascii=False)

    parts = [([f"item {i}"], x) for i, x in enumerate(v)] if isinstance(v, list) else [([k], v[k]) for k in sorted(v)] if isinstance(v, dict) else [([], v)]
    return Parsed([("paragraph", shown(x), path, None, None) for path, x in parts])


def parse_csv(text: str) -> Parsed:
    csv.field_size_limit(2**31 - 1)  # of the process, so set where it reads: a field may be as long as any text
    rows = [" | ".join(c.strip() for c in r) for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline="")) if any(c.strip() for c in r)]
    return Parsed([("table", r, [], None, rows[0]) for r in rows])


Parser = Callable[[str], Parsed]
PARSERS: dict[str, Parser] = {"text/plain": parse_text, "text/markdown": parse_markdown, "text/html": parse_html, "application/json": parse_json, "text/csv": parse_csv}
#: Media types that are known but whose library isn't here: documents of theirs fail with a reason of their own.
UNAVAILABLE = {"application/pdf": "PDF_READER_NOT_INSTALLED"}
VERSION = "1"
_ELEMENT = "struct<kind:string,text:string,heading_path:array<string>,table_caption:string,table_header:string>"
OUTCOME = f"status string, errors array<string>, warnings array<struct<code:string,message:string>>, front_matter string, elements array<{_ELEMENT}>"
SCHEMA = "status string, error string, ord int, kind string, text string, heading_path array<string>, table_caption string, table_header string"


def register_parser(media_type: str, parser: Parser) -> None:
    """Adds or replaces the parser of a media type: a function of the text that gives a Parsed, or raises."""
    PARSERS[media_type] = parser


def outcome(raw: bytes | str | None, media_type: str | None, parsers: dict[str, Parser], limits: Limits) -> tuple:
    """One document's outcome as a row of OUTCOME. Runs on a worker's main thread, so an alarm can stop a parser."""

    def failed(reason: str) -> tuple:
        return "fail", [reason], [], None, []

    parser = parsers.get(media_type or "")
    if parser is None:
        return failed(UNAVAILABLE.get(media_type or "", "NO_PARSER_AVAILABLE"))
    if raw is not None and (len(raw) if isinstance(raw, bytes) else len(raw.encode("utf-8", "surrogatepass"))) > limits.max_input_bytes:
        return failed("INPUT_TOO_LARGE")

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, limits.timeout_seconds)
    try:
        text = raw.decode("utf-8") if isinstance(raw, bytes) else raw or ""
        parsed = parser(text)
        size = sum(len(e[1].encode("utf-8", "surrogatepass")) for e in parsed.elements)
        front = None if parsed.front_matter is None else json.dumps(parsed.front_matter, ensure_ascii=False, default=str, sort_keys=True)
    except UnicodeDecodeError as e:
        return failed(f"DECODE_ERROR: {e}")
    except TimeoutError:
        return failed("TIMEOUT")
    except (MemoryError, RecursionError) as e:
        return failed(f"TOO_MUCH: {type(e).__name__}")
    except Exception as e:
        return failed(f"PARSE_ERROR: {type(e).__name__}: {e}")
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
    if size > limits.max_output_bytes:
        return failed("OUTPUT_TOO_LARGE")
    return "success", [], parsed.warnings, front, parsed.elements


def parse_documents(docs: DataFrame, key: str, content: str, media_type: str, limits: Limits = Limits()) -> DataFrame:
    """(<key>, OUTCOME): one row per document. `content` is text or bytes; null content is an empty document."""
    parsers = dict(PARSERS)
    columns = [key, "status", "errors", "warnings", "front_matter", "elements"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *outcome(c, m, parsers, limits)) for k, c, m in zip(pdf["k"], pdf["c"], pdf["m"], strict=True)], columns=columns)

    kind = dict(docs.dtypes)[key]
    # the key as text: pandas would make floats of integers beside a null
    slim = docs.select(F.col(key).cast("string").alias("k"), F.col(content).alias("c"), F.col(media_type).alias("m"))
    return slim.mapInPandas(run, f"{key} string, {OUTCOME}").withColumn(key, F.col(key).cast(kind))


def elements(outcomes: DataFrame, key: str) -> DataFrame:
    """(<key>, SCHEMA): the elements of every outcome, numbered; an outcome that failed is one row without element."""
    e = outcomes.select(key, "status", F.get("errors", F.lit(0)).alias("error"), F.posexplode_outer("elements").alias("ord", "e"))
    return e.where("status = 'fail' or ord is not null").select(key, "status", "error", "ord", *(F.col(f"e.{c}").alias(c) for c in ("kind", "text", "heading_path", "table_caption", "table_header")))


def parse(docs: DataFrame, key: str, content: str, media_type: str, limits: Limits = Limits()) -> DataFrame:
    return elements(parse_documents(docs, key, content, media_type, limits), key)
