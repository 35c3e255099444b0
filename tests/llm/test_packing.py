"""Packing, token files: ids against the tokenizer library, places, bounds."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from twinproof.llm import packing, tokens

ODD = [(1, None), (2, ""), (3, " \n\n  x"), (4, "a <|endoftext|> b"), (5, "日本語 テキスト 𝔘𝔫𝔦 ꟻ"), (6, "tab\tand  two   blanks\n"), (7, "word " * 5000), (8, "naïve café'll")]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_library(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + [t for _, t in ODD]
    encode = tokens.encoder(tokens.vocabulary_path())
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == library(texts)


def test_pieces_and_places(spark):
    docs = spark.createDataFrame(ODD + [ODD[-1]], "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("piece", F.lit(1))
    docs = docs.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack(docs).toPandas()
    want = []
    for r, ids in zip(rows, library([r["text"] for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        at, take, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want.append((r["doc_id"], k, at, take, zlib.crc32(ids[at: at + take].tobytes())))
            at, take, k = at + take, 1024, k + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want)
    ordered = got.sort_values(["sequence_id", "offset"])
    sums = ordered.groupby("sequence_id")["length"].cumsum()
    assert (ordered["offset"] == sums - ordered["length"]).all() and sums.max() <= 1024
    counts = got["length"].value_counts().to_dict()
    assert got["sequence_id"].nunique() <= packing.lower_bound(counts) * 1.02 + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    packed = packing.pack(docs, size=64, with_ids=True)
    whole = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= 64 for r in whole)
    total = sum(len(x) + 1 for x in library([t for _, t in ODD]))
    assert sum(r["n_tokens"] for r in whole) == total


def test_best_fit_and_bounds():
    rnd = random.Random(3)
    for _ in range(60):
        size = rnd.choice([10, 64])
        counts = {rnd.randrange(1, size + 1): rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 9))}
        bins = packing.best_fit(counts, size)
        placed = {}
        for b, n in bins:
            assert sum(b) <= size
            for x in b:
                placed[x] = placed.get(x, 0) + n
        assert placed == counts
        assert packing.lower_bound(counts, size) <= sum(n for _, n in bins)
    assert packing.lower_bound({6: 5}, 10) == 5  # no two sixes share a bin of ten
    assert packing.lower_bound({}, 10) == 0


def test_parts_certified_by_dual_feasible_functions_only(spark):
    """Forty lengths from 300 to 699 a part: the sum of lengths asks for fewer bins than any packing has."""
    rnd = random.Random(8)
    counts = [(part, length, rnd.randrange(1, 9)) for part in range(16) for length in rnd.sample(range(300, 700), 40)]
    by_part = [{k: n for p, k, n in counts if p == part} for part in range(16)]
    met = [sum(n for _, n in packing.best_fit(c)) == packing.lower_bound(c) for c in by_part]
    area = [sum(n for _, n in packing.best_fit(c)) == -(-sum(k * n for k, n in c.items()) // packing.SIZE) for c in by_part]
    assert sum(met) > sum(area) + 5
    df = spark.createDataFrame(counts, "part int, length int, n long")
    bins = [(tuple(r["bin"]), r["n"]) for r in packing.plan_bins(df, parts=16).collect()]
    placed = collections.Counter()
    for b, n in bins:
        assert sum(b) <= packing.SIZE
        for x in b:
            placed[x] += n
    want = collections.Counter()
    for _, k, n in counts:
        want[k] += n
    assert placed == want
    used, bound = sum(n for _, n in bins), packing.bound_of(df)
    apart = sum(sum(n for _, n in packing.best_fit(c)) for c in by_part)
    together = sum(n for _, n in packing.best_fit(dict(want)))
    assert bound <= used <= apart and used <= together + 1


def test_certificate(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 700)) for i in range(300)], "doc_id long, text string")
    r = packing.certificate(packing.pack(docs)).first()
    assert r["lower_bound"] <= r["n_sequences"] <= r["lower_bound"] + 2 and r["certified"] == (r["n_sequences"] == r["lower_bound"])
    none = packing.certificate(packing.pack(docs.limit(0))).first()
    assert (none["n_sequences"], none["lower_bound"], none["certified"]) == (0, 0, True)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).isEmpty() and tokens.token_counts(none).isEmpty()


@pytest.mark.parametrize("width, block", [(2, 64), (4, 32), (4, 1 << 20)])
def test_scan_finds_documents_across_blocks(spark, tmp_path, width, block):
    rnd = np.random.default_rng(4)
    files, want = [], []
    for f in range(3):
        lengths = [int(x) for x in rnd.integers(0, 90, 40)] + ([0, 0] if f else [500])
        data, at = [], 0
        for k, n in enumerate(lengths):
            want.append((f"{tmp_path}/{f}", k, at, n))
            data += [*rnd.integers(10, 60_000, n), 7]
            at += n + 1
        if f == 2:
            data += [9, 9]  # an unfinished document
        (tmp_path / str(f)).write_bytes(np.array(data, f"<u{width}").tobytes())
        files.append((f"{tmp_path}/{f}", len(data) * width))
    (tmp_path / "none").write_bytes(b"")
    df = spark.createDataFrame([*files, (f"{tmp_path}/none", 0)], "path string, n_bytes long")
    got = tokens.scan_documents(df, str(tmp_path), end=7, width=width, block_bytes=block).collect()
    assert sorted((r["path"], r["ordinal"], r["start"], r["n_tokens"]) for r in got) == sorted(want)


def test_token_counts(spark):
    docs = spark.createDataFrame(ODD + [ODD[-1]], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    want = sorted((i, len(x)) for (i, _), x in zip(ODD + [ODD[-1]], library([t for _, t in ODD + [ODD[-1]]])))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs).collect()) == want
