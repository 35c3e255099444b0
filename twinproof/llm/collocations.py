"""Phrases whose words attract each other, mined in two passes over whole texts (operator 13).

*First pass: which n-grams may be frequent.* Every n-gram gets a 64-bit hash; the leading bits name one of as many hash partitions as the
texts need, so that a partition's mass stays about the same at every size. Tasks count hashes exactly over a few million n-grams and
send each partition what is its own, sorted and packed. A partition merges these counts into a Misra-Gries summary: when it
outgrows its capacity, the largest count beyond the capacity is taken off all counts. The capacity exceeds mass / threshold, so
less than the threshold is ever taken off, and every n-gram that reaches the threshold is still there; what its count plus all
that was taken off leaves below the threshold is dropped.

*Second pass: exact counts.* The surviving hashes set bits of a Bloom filter of bounded size, which the tasks know; n-grams that hit it are
counted by hash and then by language and words. Where the filter is too small for very many survivors, more infrequent
n-grams are counted, never fewer.

Cuts, scores, containment and ranks are joins and aggregations over the frequent phrases.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.base import mix, slices, stored

LEAST, LONGEST, SHARE, TOP, NO_LANG = 100, 5, 100, 2000, "und"
#: Bytes of text that one hash partition is for, n-grams counted at once in a task, bytes of text looked at at once.
PER_PARTITION, BATCH, STRETCH = 16 << 20, 1 << 22, 1 << 20
#: Bits of the Bloom filter as powers of two, from small to 64 MB, and bits per survivor between them.
FILTER_BITS, BITS_EACH = (20, 29), 16
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 256
SALTS = 32
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_STEP = np.uint64(0xA0761D6478BD642F)


def _onward(n: int) -> re.Pattern:
    """What follows a cut until ``n`` more words are read."""
    return re.compile(rb"(?:[ \t.,;:!?\n\x0b\x0c\r]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % n)


def stretches(text: bytes, longest: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(stretch, own): a text in stretches of about ``size`` bytes; n-grams that start before ``own`` belong to the stretch, which
    goes on for as many words as these may need. Cuts are at blanks and breaks, so no word is divided."""
    at, onward = 0, _onward(longest - 1)
    while len(text) - at > size:
        cut = _BLANK.search(text, at + size)
        if cut is None:
            break
        stop = cut.start()
        yield text[at: onward.match(text, stop).end()], stop - at
        at = stop
    yield text[at:], len(text) - at


class Words:
    """Words of a byte array: where they start and stop, their pieces, and how many words of their piece follow."""

    def __init__(self, data: np.ndarray, longest: int):
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        self.data, self.starts, self.stops = data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        #: Whether the n-gram of n words that starts at word i lies within its piece, for n = 2 on.
        self.whole = [piece[n - 1:] == piece[: max(0, len(piece) - n + 1)] for n in range(2, longest + 1)]

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of every word."""
        base, long = _BASES[which], np.flatnonzero(self.stops - self.starts > LONG_WORD)
        with np.errstate(over="ignore"):
            n = len(self.data)
            up = np.full(n + 1, base, np.uint64)
            down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            h = mix((sums[self.stops] - sums[self.starts]) * down[self.starts] + (self.stops - self.starts).astype(np.uint64))
        for i in long:
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i]: self.stops[i]].tobytes(), which)
        return h

    def grams(self, h: np.ndarray, seeds: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 1 on: first words of n-grams that start in an ``own`` place and stay in their piece, and the n-grams' hashes."""
        first, g = np.flatnonzero(own), None
        with np.errstate(over="ignore"):
            g = mix(h[first] ^ seeds[first])
            yield first, g
            for n, whole in enumerate(self.whole, 2):
                ok = first + n - 1 < len(h)
                first, g = first[ok], g[ok]
                ok = whole[first]
                first, g = first[ok], g[ok]
                g = mix(g * _STEP + h[first + n - 1])
                yield first, g


def _batches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Words, np.ndarray, list[str], np.ndarray]]:
    """Rows (lang, text) as (words, place of each word's language, languages, whether n-grams start at the word)."""
    def joined(held):
        data, owns, langs = b"\n".join(s for s, _, _ in held), [], sorted({lang for _, _, lang in held})
        words = Words(_LOWER[np.frombuffer(data, np.uint8)], longest)
        begins = np.cumsum([0] + [len(s) + 1 for s, _, _ in held[:-1]])
        row = np.searchsorted(begins, words.starts, "right") - 1
        owns = (begins + [own for _, own, _ in held])[row]
        place = np.array([langs.index(lang) for _, _, lang in held])[row]
        return words, place, langs, words.starts < owns

    held, size = [], 0
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for stretch, own in stretches(text.as_buffer().to_pybytes() if text.is_valid else b"", longest, STRETCH):
                if not own:
                    continue
                held.append((stretch, own, lang))
                size += len(stretch)
                if size >= STRETCH:
                    yield joined(held)
                    held, size = [], 0
    if held:
        yield joined(held)


def _seeds(langs: list[str], which: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(lang.encode(), which) for lang in langs], np.uint64)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, and their counts, byte plane by byte plane."""
    both = np.concatenate((np.diff(keys, prepend=np.uint32(0)), np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T
    both = np.ascontiguousarray(both).view("<u4").ravel()
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.uint32), both[n:].astype(np.int64)


def _counted(bits: int, longest: int):
    """First pass: of every few million n-grams, what each of 2^``bits`` partitions has to know."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            part = keys >> np.uint64(32)
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))), len(keys))
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for s in range(0, len(cuts) - 1, 256):
                at = [(a, b) for a, b in zip(cuts[s: s + 256], cuts[s + 1: s + 257])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(part[a]) for a, _ in at], pa.int64()), pa.array([int(counts[a:b].sum()) for a, b in at], pa.int64()),
                    pa.array([_packed(low[a:b], counts[a:b]) for a, b in at], pa.binary())], names=["part", "mass", "blob"])

        held, size = [], 0
        for words, place, langs, own in _batches(batches, longest):
            for _, g in words.grams(words.hashes(0), _seeds(langs, 0)[place], own):
                held.append(g >> np.uint64(32 - bits))
                size += len(g)
            if size >= BATCH:
                yield from told(held)
                held, size = [], 0
        if size:
            yield from told(held)

    return run


def misra_gries(counted: Iterator[tuple[np.ndarray, np.ndarray]], mass: int, least: int, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, counts, taken) of a summary of (keys, counts) whose counts add up to ``mass``: a key's true count lies between its
    count and that plus ``taken``, which stays below ``least``."""
    capacity = mass // least + 1
    keys, counts, taken = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def merged(more):
        k = np.concatenate([keys, *[m[0] for m in more]])
        c = np.concatenate([counts, *[m[1] for m in more]])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        begins = np.flatnonzero(np.diff(k, prepend=k[:1] + np.uint32(1))) if len(k) else np.zeros(0, int)
        k, c = k[begins], np.add.reduceat(c, begins) if len(k) else c
        if len(k) <= capacity:
            return k, c, 0
        off = int(np.partition(c, len(c) - capacity - 1)[len(c) - capacity - 1])
        return k[c > off], c[c > off] - off, off

    held, size = [], 0
    for k, c in counted:
        held.append((k, c))
        size += len(k)
        if size >= max(room, capacity):
            keys, counts, off = merged(held)
            taken, held, size = taken + off, [], 0
    if held:
        keys, counts, off = merged(held)
        taken += off
    return keys, counts, taken


def _survivors(least: int):
    def run(group: pa.Table) -> pa.Table:
        part, mass = group["part"][0].as_py(), sum(group["mass"].to_pylist())
        keys, counts, taken = misra_gries((_unpacked(b.as_buffer()) for b in group["blob"]), mass, least)
        keys = keys[counts + taken >= least].astype(np.int64)
        return pa.table({"key": pa.array((part << 32) + keys, pa.int64())})

    return run


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits that a key sets in a filter of 2^``bits``."""
    with np.errstate(over="ignore"):
        return [mix(keys * np.uint64(c)) >> np.uint64(64 - bits) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _set_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 16):
            at = np.concatenate(_places(batch.column(0).to_numpy().astype(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], names=["bucket", "bit"])

    return run


def _exact(bits: int, longest: int, filter_bits: int, table):
    """Second pass: counts of the n-grams that hit the filter, by language and words; and all words by language, as phrase NULL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = table.value, {}

        def hits(keys):
            left = np.arange(len(keys))
            for where in _places(keys, filter_bits):
                at = where[left]
                left = left[(known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            return left

        for words, place, langs, own in _batches(batches, longest):
            for lang, n in zip(langs, np.bincount(place[own], minlength=len(langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            grams = zip(words.grams(words.hashes(0), _seeds(langs, 0)[place], own), words.grams(words.hashes(1), _seeds(langs, 1)[place], own))
            for n, ((first, g), (_, again)) in enumerate(grams, 1):
                hit = hits(g >> np.uint64(32 - bits))
                if not len(hit):
                    continue
                # Equal in both hashes: 128 bits.
                order = hit[np.lexsort((again[hit], g[hit]))]
                begins = np.flatnonzero(np.append(True, (np.diff(g[order]) != 0) | (np.diff(again[order]) != 0)))
                some = first[order[begins]]
                phrases = [" ".join(words.data[a:b].tobytes().decode() for a, b in zip(words.starts[i: i + n], words.stops[i: i + n])) for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([langs[k] for k in place[some].tolist()]), pa.array(phrases), pa.array([n] * len(some), pa.int32()),
                    pa.array(np.diff(np.append(begins, len(order))).astype(np.int64))], names=["lang", "phrase", "words", "f"])
        if totals:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(totals)), pa.array([None] * len(totals), pa.string()), pa.array([0] * len(totals), pa.int32()),
                pa.array(list(totals.values()), pa.int64())], names=["lang", "phrase", "words", "f"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words with f >= ``least``, and (lang, n), n counting words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, max(0, math.ceil(math.log2(max(1, size / PER_PARTITION)))))
    told = texts.mapInArrow(_counted(bits, longest), "part long, mass long, blob binary")
    keys = stored(told.groupBy("part").applyInArrow(_survivors(least), "key long"), "survivors")
    few, most = FILTER_BITS
    filter_bits = min(most, max(few, math.ceil(math.log2(BITS_EACH * max(1, keys.count())))))
    buckets = keys.mapInArrow(_set_bits(filter_bits), "bucket int, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    known = np.zeros(1 << (filter_bits - 3), np.uint8)
    for r in buckets.toLocalIterator():
        known[r["bucket"] << 12: (r["bucket"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    # At most 2^29 bits: 64 MB.
    table = spark.sparkContext.broadcast(known)
    found = texts.mapInArrow(_exact(bits, longest, filter_bits, table), "lang string, phrase string, words int, f long")
    found = stored(found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull()), "phrases")
    return found.filter("phrase IS NOT NULL"), found.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))


def _words_of(phrase: str, count):
    """The first ``count`` words of a phrase, or the last ones if it is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), count)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words per language.

    a, l and r count a phrase and the two parts of its lowest-scoring cut, n all words of the language;
    score = floor(1000 * a * n / (l * r)), exactly. A phrase goes if a longer one that reaches ``least`` holds its words and
    occurs at least ``share`` per cent as often. NULL languages are ``und``; NULL and empty texts have no words; repeated rows
    count each; an empty table gives an empty result.
    """
    phrases, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    many = phrases.filter("words > 1")
    # Each cut asks for its two parts; single words are asked for very often, so both sides are salted there.
    k = F.col("k")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    asked = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), _words_of("phrase", k).alias("part"), k.alias("size")),
        F.struct(F.lit(1).alias("side"), _words_of("phrase", k - F.col("words")).alias("part"), (F.col("words") - k).alias("size")))).alias("p"))
    asked = asked.select("lang", "phrase", "a", "k", "p.side", "p.part", F.when(
        F.col("p.size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"), F.explode(F.sequence(
        F.lit(0), F.when(F.col("words") == 1, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt"))
    met = asked.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "k").agg(
        F.first("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    # A language may own most phrases: its total is met by salt, too.
    deal = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scored = met.withColumn("salt", deal).join(totals, ["lang", "salt"]).withColumn("score", F.expr(
        f"({wide('1000')} * {wide('a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    # What holds a phrase and is longer by several words occurs no oftener than what is longer by one: looking at those is enough.
    inner = many.filter("words > 2").select("lang", "f", F.explode(F.array(
        _words_of("phrase", F.col("words") - 1), _words_of("phrase", F.lit(1) - F.col("words")))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer").cast("decimal(38,0)") < share * F.col("a").cast("decimal(38,0)"), F.lit(True)))
    rows = left.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(256)).alias("deal"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are ranked in 256 deals first, so that one task never sees them all.
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, over the view documents.
SQL = f"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
    SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS ({" UNION ALL ".join(f"SELECT lang, {n} AS words, array_to_string(ws[i:i + {n - 1}], ' ') AS phrase FROM s WHERE i + {n - 1} <= len(ws)" for n in range(1, LONGEST + 1))}),
f AS MATERIALIZED (SELECT lang, phrase, words, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
c AS (
  SELECT lang, phrase, words, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f)),
v AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = b.lang AND 100 * f.f >= {SHARE} * b.a AND f.phrase <> b.phrase AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d
QUALIFY rank <= {TOP}
"""
