"""The text problems on small fixtures, against brute force, round trips and held-out rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftaudit.llm import mixing, packing, pii, pii_training, queries, sentences, splitting, tokens

TEXTS = {
    "Dr. A. B. Smith paid 3.5 % at 9 a.m. on Monday. He left, etc. The end.": ["Dr. A. B. Smith paid 3.5 % at 9 a.m. on Monday.", "He left, etc.", "The end."],
    '“It is wrong. Redo it!” wrote the reviewer. The words "nothing to do." Then more.': ["“It is wrong. Redo it!” wrote the reviewer.", 'The words "nothing to do."', "Then more."],
    "# Head. Line\n\n- one. two\n- three\n\n| a. b | c |\n|---|---|\n\n```\ncode. Here\n```\nlast line\ngoes on": ["Head. Line", "one.", "two", "three", "last line\ngoes on"],
    "---\nkey: v. x\n---\nBody.": ["Body."],
    "値が違います。担当者は「だめ。やり直し。」と書きました。（一覧です。）次です。": ["値が違います。", "担当者は「だめ。やり直し。」と書きました。", "（一覧です。）", "次です。"],
    "Ποιος υπέγραψε την 8.4.1; Το αρχείο· μένει.": ["Ποιος υπέγραψε την 8.4.1;", "Το αρχείο· μένει."],
    "ดัชนีเก่า มี 12 หน้า เอกสารใหม่": ["ดัชนีเก่า", "มี 12 หน้า", "เอกสารใหม่"],
    "यह है। वह था?": ["यह है।", "वह था?"],
    "Am 3. Juni wurde die 103. Fassung frei. Siehe z. B. Nr. 4.": ["Am 3. Juni wurde die 103. Fassung frei.", "Siehe z. B. Nr. 4."],
    "﻿Bom here.\r\n\r\nNext odd.": ["Bom here.", "Next odd."],
    "« Faux. Non. » Cela vaut.": ["« Faux. Non. »", "Cela vaut."],
    "": [], " \n ": [], None: [],
}


def units(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in sentences.sentence_units(df).orderBy("doc_id", "unit_no").collect():
        assert texts[r.doc_id][r.start_pos : r.end_pos] == r.unit
        got.setdefault(r.doc_id, []).append(r.unit)
    return [got.get(i, []) for i in range(len(texts))]


def test_abbreviations_that_may_end_a_sentence(spark):
    texts = {
        "Акты и т. д. Новый реестр.": ["Акты и т. д.", "Новый реестр."],
        "Акты и т.п. «Неверно.» Всё.": ["Акты и т.п.", "«Неверно.»", "Всё."],
        "Акты и т. д.\nНовый реестр, т. е. акты и т. д. в деле.": ["Акты и т. д.", "Новый реестр, т. е. акты и т. д. в деле."],
        "Дом на ул. Мира, д. 5, п. 6 акта, д. Ивановка.": ["Дом на ул. Мира, д. 5, п. 6 акта, д. Ивановка."],
        "Kayıtlar, dosyalar vs. Yeni kayıt.": ["Kayıtlar, dosyalar vs.", "Yeni kayıt."],
        "It is Smith vs. Jones here.": ["It is Smith vs. Jones here."],
        "It took 30 sec. The rest ran. See sec. 305.8 and sec. B.2 there.": ["It took 30 sec.", "The rest ran.", "See sec. 305.8 and sec. B.2 there."],
    }
    assert dict(zip(texts, units(spark, list(texts)))) == texts


def test_marks_far_from_their_script(spark):
    many = "Το κείμενο " + "12345 " * 60
    texts = {
        f"{many}; Άλλο; Τέλος.": [f"{many};", "Άλλο;", "Τέλος."],
        f"Ναι;{' ' * 20}Όχι: a;b; γ; x": ["Ναι;", "Όχι: a;b;", "γ;", "x"],
        "English; only one. Then more; here.": ["English; only one.", "Then more; here."],
        "本当" + "!" * 15 + "次です。": ["本当" + "!" * 15, "次です。"],
        "It ran (see A. (B is one.) C. Then (D.) E!) and ended. Next.": ["It ran (see A. (B is one.) C. Then (D.) E!) and ended.", "Next."],
        "ดัชนี" + " " * 15 + "เอกสาร": ["ดัชนี", "เอกสาร"],
    }
    assert dict(zip(texts, units(spark, list(texts)))) == texts


def test_blocks_after_a_byte_order_mark(spark):
    texts = {
        "\ufeff```\ncode. Here\n```\nText one. Text two.": ["Text one.", "Text two."],
        "\ufeff~~~ sh\ncode. Here\n~~~\n\nText.": ["Text."],
        "\ufeff| a. b | c |\n|---|---|\n\nText.": ["Text."],
        "\ufeff***\nText.": ["Text."],
        "\ufeffText.\n```\ncode\n```": ["Text."],
    }
    assert dict(zip(texts, units(spark, list(texts)))) == texts


def test_sentences(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, unit string, p string")
    got = {}
    for r in sentences.sentence_units(df).orderBy("doc_id", "unit_no").collect():
        assert rows[r.doc_id][1][r.start_pos : r.end_pos] == r.unit
        got.setdefault(r.doc_id, []).append(r.unit)
    for i, t in rows:
        assert got.get(i, []) == TEXTS[t], t


def test_long_text_positions(spark):
    text = "Eins zwei drei. " * 3000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = sentences.sentence_units(df).orderBy("start_pos").collect()
    assert len(rows) == 3000 and all(text[r.start_pos : r.end_pos] == "Eins zwei drei." for r in rows[::97])


@given(st.lists(st.integers(0, 3), min_size=1, max_size=900), st.integers(8, 80), st.integers(0, 7))
@settings(max_examples=60, deadline=None)
def test_plans_hold_the_limits(strength, limit, overlap):
    pieces = splitting.plan(np.array(strength), limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(strength)
    assert all(0 < b - a <= limit for a, b in pieces)
    assert all(a[1] - b[0] == overlap for a, b in zip(pieces, pieces[1:]))
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pieces, pieces[1:]))


def test_plans_of_long_texts_have_few_pieces_more_than_the_least():
    r = np.random.default_rng(5)
    for n in (10_000, 200_000):
        strength = r.choice([0, 1, 2, 3], size=n, p=[0.86, 0.08, 0.05, 0.01])
        pieces = splitting.plan(strength, 512, 48)
        assert len(pieces) <= 1.07 * -(-(n - 48) // (512 - 48)) + 1 and all(b - a <= 512 for a, b in pieces)
        assert all(strength[b - 1] >= splitting.SENTENCE for _, b in pieces[:-1])


def test_split_oversized(spark):
    loc = "struct<kind:string,page_start:int,page_end:int,heading_path:array<string>,element_ids:array<string>,character_start:int,character_end:int,ordinal:int>"
    words = " ".join(f"w{i}" for i in range(300)) + "."
    elements = spark.createDataFrame([("e1", words, 2, "k"), ("e1", words, 2, "k"), ("E2 ", words, None, "k"), ("e3", None, 1, "k"), ("e4", "short", 9, "k"), (None, words, 1, "k")], "id string, text string, page int, k1 string")
    lists = [("c1", ["e1", "e2", "e1"]), ("C1 ", ["e1", "e2", "e1"]), ("c2", ["e1", "e1"]), ("c3", ["e4", "lost"]), ("c4", []), ("c5", None), (None, ["e1", "e2"])]
    chunks = spark.createDataFrame([(c, ("k", 9, 7, None, e, None, None, 0), 1, "z") for c, e in lists], f"id string, locator {loc}, token_count int, k1 string")
    rows = splitting.split_oversized(chunks, elements, 512, 48).orderBy("piece_no").collect()
    assert splitting.split_oversized(chunks, elements, 512, 48, broadcast_rows=0).orderBy("piece_no").collect() == rows
    assert {r.chunk_id for r in rows} == {"c1"} and len(rows) == 2
    assert rows[0].boundary == splitting.ELEMENT and rows[0].token_end == 300 and rows[1].token_start == 252
    assert (rows[0].page_start, rows[0].page_end) == (2, 2) and (rows[1].page_start, rows[1].page_end) == (2, 2)
    assert splitting.split_oversized(chunks.limit(0), elements).count() == 0


def brute_fill(sizes, capacity):
    left, bins = sorted(sizes, reverse=True), 0
    while left:
        gap = capacity
        for x in list(left):
            if x <= gap:
                left.remove(x)
                gap -= x
        bins += 1
    return bins


@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_best_two_fit(sizes):
    where = packing.best_two_fit(np.array(sizes), 100)
    loads = np.bincount(where, weights=sizes)
    assert loads.max() <= 100 and len(where) == len(sizes)
    assert len(loads) >= -(-sum(sizes) // 100) and len(loads) <= brute_fill(sizes, 100) + 1


def test_pack_keeps_every_token(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(n)), "z") for i, n in enumerate([5, 900, 40, 41, 39, 0, 60, 60])] + [(8, None, "z"), (0, "alpha", "z")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, group string")
    sized = tokens.with_tokens(df, "text", {"doc_id": F.col("doc_id")}, queries.TOKENIZER).agg(F.sum("n_tokens").alias("n")).first().n
    rows = packing.pack(df, 100, queries.TOKENIZER).collect()
    loads = {}
    for x in rows:
        loads[x.container_id] = loads.get(x.container_id, 0) + x.n_tokens
    assert max(loads.values()) <= 100 and sum(loads.values()) == sized and {x.doc_id for x in rows} == set(range(9))
    assert packing.pack(df.limit(0), 100, queries.TOKENIZER).count() == 0


def test_containers_of_repeated_keys_have_names_of_their_own(spark):
    long = " ".join(["alpha"] * 900)
    df = spark.createDataFrame([(7, long), (7, long), (7, long)], "doc_id bigint, text string")
    loads = {}
    for x in packing.pack(df, 100, queries.TOKENIZER).collect():
        loads[x.container_id] = loads.get(x.container_id, 0) + x.n_tokens
    assert max(loads.values()) == 100


def test_rows_without_keys(spark):
    long = " ".join(["alpha"] * 250)
    df = spark.createDataFrame([(None, long, "big"), (None, "beta", "big"), (3, "gamma", "big"), (2**60 + 1, "delta", "big")], "doc_id bigint, text string, source string")
    rows = packing.pack(df, 100, queries.TOKENIZER).collect()
    assert sorted(str(x.doc_id) for x in rows) == sorted(["None"] * (len(rows) - 2) + ["3", str(2**60 + 1)]) and all(x.container_id for x in rows)
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert {x.doc_id for x in mixing.mix(df, targets, 1e6, queries.TOKENIZER)[0].collect()} == {3, 2**60 + 1}
    notes = spark.createDataFrame([(None, "write to a.b@example.org"), (2**60 + 1, "write to a.b@example.org")], "note_id bigint, text string")
    assert {(x.note_id, x.start_pos) for x in pii.find(notes, fields=("text",)).collect()} == {(None, 9), (2**60 + 1, 9)}
    assert {x.doc_id for x in sentences.sentence_units(df).collect()} == {None, 3, 2**60 + 1}


def test_fill_takes_what_fits_and_what_comes_nearest():
    sizes, taken = [50, 30, 9, 40, 8], mixing.filled
    assert taken(sizes, 48) == [1, 2, 4] and taken(sizes, 80) == [0, 1] and taken(sizes, 3) == []
    assert taken([60], 50) == [0] and taken([101], 50) == [] and taken([], 5) == []


def mixture(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(5, 40))), "Big " if i % 3 else "small-one") for i in range(600)] + [(600, None, "big"), (601, "x", None), (602, "y", "other"), (603, "alpha " * 900, "small_one")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, bucket int")
    return df, spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.45, 3), ("absent", 0.05, 2), ("nothing", 0.0, 1)], "source string, target_share double, max_repeats int")


def test_mix_reaches_shares(spark):
    df, targets = mixture(spark)
    supply = {s: n for s, n in tokens.with_tokens(df, "text", {"s": mixing.source_name(F.col("source"))}, queries.TOKENIZER).groupBy("s").sum("n_tokens").collect()}
    total = supply["big"] * 1.2
    for buckets in (4096, 3):
        chosen, report = mixing.mix(df, targets, total, queries.TOKENIZER, buckets=buckets)
        got = {x.source: x for x in report.collect()}
        assert abs(total * 0.5 - got["big"].chosen_tokens) < 20 and got["absent"].chosen_tokens == 0
        assert got["small_one"].most_times <= 3 and abs(total * 0.45 - got["small_one"].chosen_tokens) < 20
        assert sum(x.actual_share for x in got.values()) == pytest.approx(1)
        assert sum(x.n_tokens * x.n_times for x in chosen.collect()) == sum(x.chosen_tokens for x in got.values())
    one, two = ({tuple(x) for x in mixing.mix(d, targets, total, queries.TOKENIZER)[0].collect()} for d in (df, df.repartition(7)))
    assert one == two and len(one) == len({x[0] for x in one})
    assert mixing.mix(df.limit(0), targets, total, queries.TOKENIZER)[0].count() == 0


def test_mix_begins_with_the_smallest_keys(spark):
    df, targets = mixture(spark)
    chosen, _ = mixing.mix(df, targets, 4000, queries.TOKENIZER)
    draws = df.select("doc_id", mixing.source_name(F.col("source")).alias("source"), mixing.sampling_key(F.col("doc_id"), mixing.quality_weight(F.col("text")), 11).alias("draw")).where("source = 'big' and text is not null")
    taken = [x.doc_id for x in chosen.where("source = 'big'").collect()]
    order = [x.doc_id for x in draws.orderBy("draw").collect()]
    prefix = next(i for i, k in enumerate(order) if k not in taken)
    assert len(taken) - prefix <= 4  # the few that fill what the prefix leaves


def quality(field, rows):
    right = found = wanted = 0
    for (text, gold), got in zip(rows, field.entities([t for t, _ in rows]), strict=True):
        a, b = set(pii.checked(text, gold)), set(pii.checked(text, got))
        right, found, wanted = right + len(a & b), found + len(b), wanted + len(a)
    return right / found, right / wanted


def test_recognizer_on_frames_it_has_not_seen(tmp_path):
    frames = [*pii_training.FRAMES, *pii_training.PLAIN]
    random.Random(1).shuffle(frames)
    field = pii.train(pii_training.labelled_rows(1200, 7, [f for i, f in enumerate(frames) if i % 4]), rounds=70)
    precision, recall = quality(field, pii_training.labelled_rows(300, 99, frames[::4]))
    assert precision > 0.85 and recall > 0.8
    pii.save(field, str(tmp_path / "field.npz"))
    again = pii.load(str(tmp_path / "field.npz"))
    texts = [t for t, _ in pii_training.labelled_rows(50, 3)]
    assert again.entities(texts) == field.entities(texts)


def test_recognizer_on_held_out_rows():
    precision, recall = quality(pii.trained(), pii_training.labelled_rows(300, seed=1234))
    assert precision > 0.95 and recall > 0.93


def test_sequences_of_any_length():
    texts = ["", " ", "Call +1 202 555 0143 now.", "x " * 3000 + "write to a.b@example.org", "y"]
    got = [pii.checked(t, e) for t, e in zip(texts, pii.trained().entities(texts), strict=True)]
    assert got[0] == got[1] == got[4] == [] and [(2, 5, 20)] == [(2, a, b) for a, b, k in got[2] if k == "PHONE"]
    assert [(6009, len(texts[3]), "EMAIL")] == got[3]


def test_addresses_of_mail_of_any_length():
    local, host = "a" * 120 + "." + "b" * 90, ".".join(["part" * 10] * 5) + ".example.org"
    for sign in ("@", " (at) ", "＠"):
        text = f"Write to {local}{sign}{host}, please."
        assert pii.mail_spans(text) == [(9, len(text) - 9)]
        assert pii.checked(text, [(100, 300, "EMAIL")]) == [(9, len(text) - 9, "EMAIL")]
    assert pii.mail_spans("a @ b, user@localhost, @here, x" * 50) == []


def test_identity_numbers():
    assert all(map(pii.id_number_ok, ["123-45-6789", "10000000146", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111"]))
    assert not any(map(pii.id_number_ok, ["666-45-6789", "000 45 6789", "123-00-6789", "10000000147", "GB82WEST12345698765433", "4111-1111-1111-1112", "12"]))


def test_find_and_redact(spark):
    rows = [(1, "Call 020 7946 0951 (ext. 12) and ask for Anna Fairwick.", " a.b@example.com ", None, "k"), (2, None, "", "  ", "k"), (3, "No sensitive content in this record.", "n/a", "x" * 20000, "k")]
    df = spark.createDataFrame(rows, "note_id bigint, notes string, contact_email string, text string, text_ string")
    got = {(r.note_id, r.field_name, r.entity_type, r.start_pos, r.end_pos) for r in pii.find(df).collect()}
    assert got == {(1, "notes", "PHONE", 5, 18), (1, "notes", "NAME", 41, 54), (1, "contact_email", "EMAIL", 1, 16)}
    red = {r.note_id: r for r in pii.redact(df).collect()}
    assert red[1].notes == "Call [PHONE] (ext. 12) and ask for [NAME]." and red[1].contact_email == " [EMAIL] " and red[1].text is None and red[3].text == "x" * 20000
    assert pii.find(df.limit(0)).count() == 0
