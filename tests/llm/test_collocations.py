"""Phrase collocations against plain Python."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinproof.llm import collocations as C

BREAK, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, share=100, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in BREAK.split((text or "").translate(LOWER)):
            ws = WORD.findall(piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, *ws[i: i + k]) for i in range(len(ws) - k + 1))
    often = {p: c for p, c in f.items() if c >= least}
    out = collections.defaultdict(list)
    held = {}
    for (lang, *ws), c in often.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                held.setdefault((lang, *ws[i: i + k]), []).append(c)
    for p, a in often.items():
        lang, *ws = p
        if len(ws) < 2 or any(100 * c >= share * a for c in held.get(p, [])):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k, f[(lang, *ws[:k])], f[(lang, *ws[k:])]) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, r, ph.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, a, ph, x, y) in enumerate(sorted(rows)[:top], 1))


def got(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


def texts(rnd, n, vocabulary):
    marks = [" "] * 12 + ["\t", "  ", ", ", ".", "\n", "! ", " \t "]
    return ["".join(rnd.choice(vocabulary) + rnd.choice(marks) for _ in range(rnd.randrange(80))) for _ in range(n)]


def test_equals_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(C, "PER_PARTITION", 3000)  # several hash partitions
    monkeypatch.setattr(C, "BATCH", 2000)
    rnd = random.Random(5)
    vocabulary = ["a", "B", "the", "é", "Straße", "\x1cx", "x\xa0y", "don't", "😀", "of", "K", "W" * 300]
    rows = [(rnd.choice(["en", "en", "en", "de", None, "und"]), t) for t in texts(rnd, 400, vocabulary)]
    rows += [("en", None), ("en", ""), ("en", " .\n, "), ("fr", "un deux trois quatre cinq six " * 40), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)).withColumn("f", F.lit(3))
    want = plain(rows, 12)
    assert got(df.repartition(4), least=12) == want and len({w[0] for w in want}) == 4
    assert got(df, least=20, longest=3, share=60, top=7) == plain(rows, 20, 3, 60, 7)


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    rnd = random.Random(6)
    text = " ".join(rnd.choice("abcd") for _ in range(3000)) + "x" * 700 + ". " + " ".join(rnd.choice("abcd") for _ in range(500))
    parts = list(C.stretches(text.encode(), 5, 100))
    assert "".join(s.decode()[:own] for s, own in parts) == text and len(parts) > 20
    for s, own in parts:
        assert own == len(s) or len([w for w in re.split(rb"[ .]", s[own:]) if w]) <= 4
    monkeypatch.setattr(C, "STRETCH", 97)
    rows = [("en", text), (None, text[500:])]

    # The functions run in this process here: what Spark would give each task.
    import pyarrow as pa

    found, total = collections.Counter(), 0
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "und"]), pa.array([t for _, t in rows])], names=["lang", "text"])
    table = type("Table", (), {"value": np.full(1 << 17, 255, np.uint8)})
    for out in C._exact(2, 5, 20, table)(iter([batch])):
        for r in out.to_pylist():
            if r["phrase"] is None:
                total += r["f"]
            else:
                found[(r["lang"], r["phrase"])] += r["f"]
    want = collections.Counter()
    for lang, t in rows:
        for piece in BREAK.split(t):
            ws = WORD.findall(piece)
            for k in range(1, 6):
                want.update((lang or "und", " ".join(ws[i: i + k])) for i in range(len(ws) - k + 1))
    assert found == want and total == sum(c for (_, p), c in want.items() if " " not in p)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).isEmpty() and C.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert C.collocations(spark.createDataFrame([("en", None), (None, "one two three")], "lang string, text string")).isEmpty()


def test_scores_beyond_64_bits(spark, monkeypatch):
    huge = 3 * 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, huge), ("en", "a", 1, 2 * huge), ("en", "b", 1, huge + 7)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    monkeypatch.setattr(C, "frequent_phrases", lambda *a: (phrases, totals))
    assert [tuple(r) for r in C.collocations(phrases).collect()] == [
        ("en", 1, "a b", huge, 2 * huge, huge + 7, 10**15, 1000 * huge * 10**15 // (2 * huge * (huge + 7)))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), min_size=1, max_size=30), min_size=1, max_size=12), st.integers(2, 40))
def test_summaries_keep_what_is_frequent(blobs, least):
    true, counted = collections.Counter(), []
    for blob in blobs:
        own = collections.Counter()
        for k, c in blob:
            own[k] += c
        true.update(own)
        counted.append((np.array(sorted(own), np.uint32), np.array([own[k] for k in sorted(own)])))
    mass = sum(true.values())
    keys, counts, taken = C.misra_gries(iter(counted), mass, least, room=1)
    assert len(keys) <= mass // least + 1 and taken < least
    kept = dict(zip(keys.tolist(), counts.tolist()))
    assert all(kept[k] <= c <= kept[k] + taken for k, c in true.items() if c >= least)
    back = C._unpacked(C._packed(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()


@pytest.mark.parametrize("bits", [20, 27])
def test_filter_places_are_bits_of_the_filter(bits):
    keys = np.arange(1000, dtype=np.uint64)
    assert all(int(p.max()) < 1 << bits for p in C._places(keys, bits))
