r"""Sentence units of documents in many languages and scripts.

Method: dots that end nothing (decimals, URLs, initials, abbreviations) are masked with private-use placeholders, the
text is split by terminators of its scripts, and the placeholders are turned back; all in SQL expressions, without Python
and without a shuffle.

A text is cut three times, each time by inserting a separator and splitting at it, so the pieces always add up to the text
and their lengths give positions: (1) front matter, fenced code, tables and rules; (2) headings, list marks and blank
lines; (3) sentences. Pieces that are no units stay in the list as void, for their length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftaudit.functions.ids import let
from driftaudit.functions.text import starts

SEP, VOID, HEAD, KEEP, DOT, ASK = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"
#: Pairs of quotes and brackets, each mark with its placeholder while the pair is matched. Same marks on both sides: straight quotes.
_PAIRS = [("(", ")", "b"), ("[", "]", "b"), ("（", "）", "b"), ("「", "」", "q"), ("『", "』", "q"), ("„", "“", "q"), ("“", "”", "q"), ("‘", "’", "q"), ("«", "»", "q"), ('"', '"', "q"), ("'", "'", "q"), ("【", "】", "b"), ("[", "]", "b"), ("(", ")", "b")]
_OPEN = [chr(0xE010 + 2 * i) for i in range(len(_PAIRS))]
_CLOSE = [chr(0xE011 + 2 * i) for i in range(len(_PAIRS))]
_PRIVATE = [SEP, VOID, HEAD, KEEP, ASK, DOT, *_OPEN, *_CLOSE]
_ANY_PRIVATE = f"\ue000-{max(_PRIVATE)}"  # a range, and a little more than those: much faster than a class of single characters

#: Abbreviations that do not end a sentence, whatever follows. Inner dots are masked before, as DOT.
NEVER = """
Mr Mrs Ms Dr Prof St Mt Rev Hon Gen Col Sgt Capt Lt Jr Sr vs cf ca approx fig Fig figs sec Sec ch art Art no No nos vol pp p ed eds eq Eq ref e.g i.e viz resp
Nr Abs Abb Art Bd Hr Fr Frl Hrn bzw z d u o vgl Vgl sog Str evtl ggf inkl exkl zzgl s S Kap Tab Ziff
M MM Mme Mlle Mmes art fig chap vol env av boul réf cf p
Sra Srta Dra Dres Sres pág págs núm art cap fig EE Ud Uds Vd
Bkz bkz sf böl Böl Doç Av Sok Cad Mah No örn Örn yakl
См см рис Рис п пп ст стр гл табл т ул д им проф акад тыс млн млрд напр
κ κα κκ σελ αρ αριθ παρ κεφ εικ πίν π δρ Δρ βλ
डॉ श्री पृ सं प्रो अ
د أ ص م
นาย ดร พ ศ น
""".split()
#: Abbreviations that may also end a sentence; they do so before a capital letter or the end.
MAYBE = """
etc Inc Ltd Co Corp Ave Blvd Rd hrs hr min sec a.m p.m U.S U.K U.N E.U D.C Ph.D
usw usf etc Std Mio Mrd GmbH
UU etc
vb vs vd
г гг др д п руб
κ.λπ κ.ά κλπ μ.μ π.μ
""".split()
_WS = r"[\s\u0085   -   　﻿]"
#: Words of both lists, by what tells the two apart. д and п end a sentence only in «т. д.» and «т. п.»; vs only in Turkish, by
#: letters of the block; sec not before the number or letter of a section, unless it follows a number.
_TD = rf"т[.{DOT}]{_WS}{{0,3}}[дп]"
_BOTH = {*NEVER} & {*MAYBE}
_TURKISH_LETTERS = "[ğĞıİşŞ]"
_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Fassung Auflage Kapitel Absatz Tag Jahrhundert".split()
_TURKISH = "sürüm madde bölüm sayfa yıl gün ay hafta kez kat sıra yüzyıl".split()

_T = r"[.!?…。！？｡।॥؟۔;;]"
#: How a sentence may begin: a capital, a number, an opening mark, or a name in small letters with its version.
_START = rf"(?:[\p{{Lu}}\p{{N}}¿¡]|\p{{Ll}}[\p{{Ll}}-]*+ \d++[.{DOT}]\d)"
_END = r"[.!?。！？｡।॥؟۔;;]"  # those that end a sentence by themselves
_ASKS = ";\u037e"
_NOT_IN_WORD = r"(?<![\p{L}\p{M}\p{N}])"


def _any(words: list[str]) -> str:
    """One of the words, as a tree by their first letters: an engine that tries alternatives one by one has few to try."""

    def tree(tails: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for t in tails:
            if t:
                by.setdefault(t[0], []).append(t[1:])
        parts = [re.escape(c) + tree(rest) for c, rest in sorted(by.items())]
        inner = parts[0] if len(parts) == 1 and "" not in tails else f"(?:{'|'.join(parts)})" if parts else ""
        return f"(?:{inner})?" if parts and "" in tails else inner

    return tree(sorted({w.replace(".", DOT) for w in words}))


def _cls(chars: list[str]) -> str:
    return "".join("\\" + c if c in "[]()\\^-" else c for c in chars)


def _re(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def _re_if(c: Column, has: str, pattern: str, by: str) -> Column:
    return let(c, lambda x: F.when(F.contains(x, F.lit(has)), _re(x, pattern, by)).otherwise(x))


_OPENS, _CLOSES = _cls(_OPEN), _cls(_CLOSE)
_OPEN_Q, _CLOSE_Q = (_cls([m for m, (_, _, k) in zip(s, _PAIRS) if k == "q"]) for s in (_OPEN, _CLOSE))
_OPEN_B, _CLOSE_B = (_cls([m for m, (_, _, k) in zip(s, _PAIRS) if k == "b"]) for s in (_OPEN, _CLOSE))
_CASELESS = r"\p{IsHan}\p{IsKatakana}\p{IsDevanagari}\p{IsArabic}\p{IsThai}"
_THAI = r"[\p{IsThai}&&[^\p{Nd}]]"
_BLOCKS = (
    r"(?m)\A[\s﻿]*---[ \t]*\n(?s:.*?)^---[ \t]*$"  # front matter
    r"|^\x{FEFF}*[ \t]{0,3}(`{3,}|~{3,})(?s:.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\z)"  # fenced code, to the end if it isn't closed
    r"|^\x{FEFF}*[ \t]*\|[^\n]*$"  # a table line
    r"|^\x{FEFF}*[ \t]{0,3}(?:-{3,}|\*{3,}|_{3,})[ \t]*$"  # a rule
)


def _where(c: Column, has: str, f) -> Column:
    """f(c) where c has a character of `has`, else c."""
    return let(c, lambda x: F.when(_or([F.contains(x, F.lit(h)) for h in has]), f(x)).otherwise(x))


def _or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _dots(b: Column) -> Column:
    """DOT for each dot that ends nothing. All patterns begin at the dot, so that other characters cost next to nothing."""
    b = _re(b, r"\.(?<=[\p{L}\p{M}\p{N}]\.)(?=[\p{L}\p{N}])", DOT)
    b = _re(b, rf"\.(?<={_NOT_IN_WORD}\p{{Lu}}\.)(?={_WS}*(?:\p{{Lu}}[\p{{L}}\p{{M}}]|\p{{Lu}}\.))", DOT)
    b = _re(b, rf"\.(?<={_NOT_IN_WORD}(?:[zd]|[uo]|т)\.)(?={_WS}?[BhaÄек]\.)|\.(?<={_NOT_IN_WORD}(?:z[.{DOT}]{_WS}?B|d[.{DOT}]{_WS}?h|u[.{DOT}]{_WS}?a|o[.{DOT}]{_WS}?Ä|т[.{DOT}]{_WS}?[ек])\.)", DOT)
    b = let(b, lambda x: F.when(F.contains(x, F.lit("vs.")) & ~F.rlike(x, F.lit(_TURKISH_LETTERS)), _re(x, rf"\.(?<={_NOT_IN_WORD}vs\.)(?!\.)(?=[\s\S])", DOT)).otherwise(x))
    # one pass for all that is told by the word or number before and by what follows
    never = rf"(?<={_NOT_IN_WORD}(?:{_any([w for w in NEVER if w not in _BOTH])}|(?<!т[.{DOT}]{_WS}{{0,3}})[дп])\.)(?!\.)(?=[\s\S])"
    section = rf"(?<=(?<!\d{_WS}{{0,3}}){_NOT_IN_WORD}sec\.)(?={_WS}*(?:\p{{N}}|\p{{Lu}}(?:[.{DOT}\d)]|{_WS}*\z)))"
    maybe = rf"(?<={_NOT_IN_WORD}(?:{_any([w for w in MAYBE if w not in ('д', 'п')])}|{_TD})\.)(?=[^\s.]|{_WS}++(?!{_START})[^“„«\"'‘(\[])"
    day = rf"(?<=\d\.)(?:(?<=(?i:(?<!\p{{L}})(?:am|vom|zum|der|die|das|dem|den|des|im|ab|bis|seit)){_WS}{{1,2}}\d{{1,3}}\.)(?={_WS}+\p{{L}})|(?<={_NOT_IN_WORD}\d{{1,4}}\.)(?={_WS}+(?:{'|'.join(_MONTHS)}|{'|'.join(_TURKISH)})))"
    b = _re(b, rf"\.(?:{never}|{maybe}|{section}|{day})", DOT)
    return let(b, lambda x: F.when(F.contains(x, F.lit("…")) | F.contains(x, F.lit("...")), _re(x, rf"(\.\.\.|…)(?={_WS}*[\p{{Ll}},;])", f"$1{KEEP}")).otherwise(x))


def _masked(block: Column) -> Column:
    """The block with DOT for each dot that ends nothing, and KEEP after each mark that stands in quotes or brackets."""
    b = _where(block, ".…", _dots)
    for (left, right, _), o, c in zip(_PAIRS, _OPEN, _CLOSE, strict=True):
        lq, rq = _cls([left]), _cls([right])
        if left == right:
            pattern = rf"(?<![\p{{L}}\p{{N}}]){lq}([^{lq}]*){lq}(?![\p{{L}}\p{{N}}])"
        elif left == "„":
            pattern = r"„([^„“”]*)“"
        else:
            pattern = f"{lq}([^{lq}{rq}]*){rq}" + (r"(?!\p{L})" if right == "’" else "")

        def pair(x: Column, pattern=pattern, o=o, c=c) -> Column:
            inside = rf"(?!{KEEP})(?=[^{o}{c}]*{c})"

            def around(y: Column) -> Column:
                # a pair around pairs of its kind, which are placeholders by now: what is in it stands inside, their ends too
                deep = rf"(?!{KEEP})(?=[^{o}{c}]*+(?:{o}[^{o}{c}]*+{c}[^{o}{c}]*+)*+{c})"
                return _re(_re(y, pattern, f"{o}$1{c}"), rf"({c}|{_T}| (?<=\p{{IsThai}} ) *+){deep}", f"$1{KEEP}")

            # a mark, or a space after Thai, before a closing mark without an opening one between: it stands inside
            return _re(_where(_re(x, pattern, f"{o}$1{c}"), left, around), rf"({_T}| (?<=\p{{IsThai}} ) *+){inside}", f"$1{KEEP}")

        b = _where(b, left, pair)
    return b


def _sentences(block: Column) -> Column:
    """The pieces of a text block: its sentences, with the white space around them."""
    b = _masked(block)
    end = rf"[\"'”’»)\]{_CLOSES}]*"
    # marks before white space, marks of scripts without spaces wherever they stand, and [!?] after their letters
    b = _re(b, rf"[.!?…]++(?!{KEEP}){end}(?={_WS})|[。！？｡।॥؟۔]++(?!{KEEP})[」』）”’»{_CLOSES}]*|[!?](?<=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}][!?])[!?]*+(?!{KEEP})[」』）”’»{_CLOSES}]*", f"$0{SEP}")
    b = _where(b, _ASKS, lambda x: _greek(x, end))
    # a mark inside quotes or brackets that end here: bracketed sentences of their own, then quotes that end a sentence
    b = _where(b, KEEP, lambda x: _quoted(x))
    thai = rf" (?<={_THAI} ) *+(?=[{_OPENS}]|{_THAI})| (?<=[{_CLOSES}] ) *+(?={_THAI})"
    # Thai in UTF-8 is E0 B8 or E0 B9 and a byte more: a search of bytes, where a pattern would read every character
    has_thai = lambda x: F.contains(x.cast("binary"), F.lit(b"\xe0\xb8")) | F.contains(x.cast("binary"), F.lit(b"\xe0\xb9"))
    b = let(b, lambda x: F.when(has_thai(x), _re(x, f"({thai})", f"$1{SEP}")).otherwise(x))
    return F.split(b, SEP)


def _greek(b: Column, end: str) -> Column:
    """Ends at semicolons that follow a Greek letter of the same sentence, however far; the letter or the mark before leads on to the next."""
    b = _re(b, rf"((?:\G(?<=[{_ASKS}])|\p{{IsGreek}})[^{_ASKS}{SEP}]*+)([{_ASKS}])", f"$1{ASK}$2")
    b = _re(b, rf"{ASK}([{_ASKS}](?!{KEEP}){end})(?={_WS})", f"$1{SEP}")
    return F.replace(b, F.lit(ASK), F.lit(""))


def _quoted(b: Column) -> Column:
    b = _re(b, rf"({SEP}|\G)({_WS}*[{_OPEN_B}][^{_OPEN_B}{_CLOSE_B}{SEP}]*{_END}{KEEP}{_WS}*[{_CLOSE_B}](?!{KEEP}))(?={_WS}*\S)", f"$1$2{SEP}")
    b = _re(b, rf"({_END}{KEEP}{_WS}*[{_CLOSES}]+)(?={_WS}+[{_OPENS}]*{_START})", f"$1{SEP}")
    return _re(b, rf"((?<=[^{_WS[1:-1]}{SEP}])(?:{_WS}*)[{_OPEN_Q}][^{_OPEN_Q}{_CLOSE_Q}{SEP}]*{_END}{KEEP}{_WS}*[{_CLOSE_Q}](?!{KEEP}))(?={_WS}*[{_CASELESS}{_OPENS}])", f"$1{SEP}")


def _pieces(text: Column) -> Column:
    """All pieces of a text, in order; a void piece begins with VOID, a heading with HEAD."""
    own = f"[{_ANY_PRIVATE}\u2028\u2029]"
    t = F.when(F.rlike(text, F.lit(own)), F.translate(text, "".join(_PRIVATE) + "\u2028\u2029", "\ufffd" * len(_PRIVATE) + "\n\n")).otherwise(text)
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit(" \n")), F.lit("\r"), F.lit("\n"))
    top = F.split(_re(t, _BLOCKS, f"{SEP}{VOID}$0{SEP}"), SEP)

    def blocks(seg: Column) -> Column:
        b = _re_if(seg, "#", r"(?m)^([ \t﻿]{0,4}#{1,6}[ \t]+)([^\n]*?)((?:[ \t]+#+)?[ \t]*)$", f"{SEP}{VOID}$1{SEP}{HEAD}$2{SEP}{VOID}$3{SEP}")
        b = _re(b, r"(?m)^([ \t﻿]*(?:[-*+•]|\d{1,9}[.)])[ \t]+)", f"{SEP}{VOID}$1{SEP}")
        b = _re(b, r"(\n[ \t]*\n\s*)", f"{SEP}{VOID}$1{SEP}")
        return F.split(b, SEP)

    def is_text(x: Column) -> Column:
        return ~(x.startswith(VOID) | x.startswith(HEAD)) & (F.length(x) > 0)

    level2 = F.flatten(F.transform(top, lambda s: F.when(s.startswith(VOID), F.array(s)).otherwise(blocks(s))))
    return F.flatten(F.transform(level2, lambda b: F.when(is_text(b), _sentences(b)).otherwise(F.array(b))))


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(<key>, unit_no, start_pos, end_pos, unit): the sentence units of every document, in order.

    Positions are 0-based, count code points of the stored text, and end_pos is exclusive; a unit has no white space at
    either end. A heading is a unit without its marks; paragraphs and list items, without bullets and numbers, are divided
    into sentences with their closing marks, quotes and brackets. Front matter, fenced code, tables and rules are no units.
    Text within a pair of quotes or brackets is not divided, nor within a pair around pairs of its kind (two deep). Null, empty and blank texts have no units; equal texts have
    equal ones; other columns are ignored.
    """
    placeholders = "".join(_PRIVATE[5:])
    restored = "." + "".join(p[0] for p in _PAIRS) + "".join(p[1] for p in _PAIRS)
    marks = SEP + VOID + HEAD + KEEP
    whole = F.col("text_")

    def zipped(p: Column) -> Column:
        some = F.lit(f"[{_ANY_PRIVATE}]")
        bare = F.transform(p, lambda x: F.when(F.rlike(x, some), F.translate(x, placeholders + marks, restored)).otherwise(x))
        return let(bare, lambda b: let(starts(F.transform(b, lambda x: F.length(x))), lambda at: F.arrays_zip(
            F.transform(p, lambda x: x.startswith(VOID)).alias("void"), at.alias("at"),
            # a text with private-use characters of its own: the pieces are read from it by position
            F.when(F.rlike(whole, F.lit(f"[{_ANY_PRIVATE}]")), F.transform(b, lambda x, i: F.substring(whole, F.get(at, i) + 1, F.length(x)))).otherwise(b).alias("p"),
        )))

    white = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
    d = docs.select(F.col(key), F.col(text).alias("text_")).where("text_ is not null and text_ <> ''")
    # the outer form: for the inner one the optimizer repeats the whole expression in a filter
    rows = d.select(key, F.posexplode_outer(let(_pieces(whole), zipped)).alias("unit_no", "x")).where(~F.col("x.void"))
    left = F.ltrim(F.col("x.p"), F.lit(white))
    # trimming from the right looks at every character, so only where the last one is white
    unit = F.when(F.instr(F.lit(white), F.right(left, F.lit(1))) > 0, F.rtrim(left, F.lit(white))).otherwise(left)
    rows = rows.select(key, "unit_no", unit.alias("unit"), (F.col("x.at") + F.length("x.p") - F.length(left)).cast("int").alias("start_pos"))
    return rows.where("unit <> ''").select(key, "unit_no", "start_pos", (F.col("start_pos") + F.length("unit")).cast("int").alias("end_pos"), "unit")
