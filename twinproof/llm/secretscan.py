"""Secrets in texts (operator 12), in DataFrame functions only: fixed patterns, and strings of high entropy.

The base kinds are patterns. The method adds kind ``entropy``: candidate strings are runs of token characters; each belongs to a
character class with its own least entropy. A window slides over the string; on every step the counts of the character
that leaves and of the one that enters change by one, and so does the window's entropy, kept as a sum of fixed-point terms.
A string whose best window reaches its class's entropy is a find, unless the allow-list knows it.

Everything happens within a row: no shuffle, and no cut of long texts. Positions are running sums over the pieces between
matches, in blocks, so that a text with very many matches costs little more than each of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEPARATOR = r"""["']?\x20*[:=]\x20*["']?"""


def _either(word: str) -> str:
    """A pattern of ``word`` in either case, for A to Z alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(?:" + "|".join(map(_either, ["password", "passwd", "secret", "token", "api_?key"])) + f"){_SEPARATOR}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Kinds in the order in which they are listed at equal starts.
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes, the first that fits counts: all characters, those it must hold, least entropy of its best window in bits a character.
CLASSES: dict[str, tuple[str, list[str], float]] = {
    "hex": ("[0-9a-f]", ["[0-9]", "[a-f]"], 3.0),
    "upper hex": ("[0-9A-F]", ["[0-9]", "[A-F]"], 3.0),
    "lower": ("[0-9a-z+/_=-]", ["[0-9]", "[a-z]"], 3.6),
    "upper": ("[0-9A-Z+/_=-]", ["[0-9]", "[A-Z]"], 3.6),
    "mixed": ("[0-9A-Za-z+/_=-]", ["[0-9]", "[A-Z]", "[a-z]"], 3.9),
}
#: Strings that are no secrets: identifiers, placeholders, runs of an alphabet.
ALLOWED: list[str] = [
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "|".join(map(_either, ["example", "sample", "dummy", "changeme", "placeholder", "redacted", "xxxx"])),
    "0123456789|9876543210|abcdefghij|ABCDEFGHIJ|qwertyuiop|QWERTYUIOP",
]
#: Names joined by marks are no secrets either: a mark, and digits only in short runs at the ends of names.
JOINED, NOT_JOINED = "[+/_=-]", "[0-9][A-Za-z]|[0-9]{5}"
_BLOCK = 64
_POINT = 1 << 20


def _terms(window: int) -> list[int]:
    """c * log2(c) in fixed point, for the counts 0 to ``window``."""
    return [round(c * math.log2(c) * _POINT) if c else 0 for c in range(window + 1)]


def _most(bits: float, window: int) -> int:
    """The largest sum of terms of a window whose entropy is ``bits`` or more."""
    return math.floor((math.log2(window) - bits) * window * _POINT)


def _total(longs: Column) -> Column:
    return F.aggregate(longs, F.lit(0).cast("long"), lambda a, x: a + x)


def _spans(df: DataFrame, text: str, kind: str, pattern: str) -> DataFrame:
    """Add ``_<kind>``: structs (s, e, hit) of the leftmost non-overlapping matches of ``pattern``; NULL where there are none."""
    hits, pieces, steps, sums, before = (f"_{kind}_{x}" for x in ("hits", "pieces", "steps", "sums", "before"))
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    if kind == "access":
        found = F.when(F.contains(F.col(text), F.lit("AKIA")), found)
    df = df.withColumn(hits, found).withColumn(hits, F.when(F.size(hits) > 0, F.col(hits)))
    df = df.withColumn(pieces, F.when(F.col(hits).isNotNull(), F.transform(F.split(F.col(text), pattern, -1), lambda p: F.length(p).cast("long"))))
    # Running sums of piece and match: within a block of steps, over the sums of whole blocks.
    df = df.withColumn(steps, F.transform(hits, lambda h, i: F.length(h) + F.get(F.col(pieces), i)))
    df = df.withColumn(sums, F.transform(F.sequence(F.lit(0), F.shiftright(F.size(steps) - 1, 6)), lambda b: _total(F.slice(steps, b * _BLOCK + 1, _BLOCK))))
    df = df.withColumn(before, F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))))

    def placed(hit, i):
        block = F.shiftright(i, 6)
        start = F.get(F.col(before), block) + _total(F.slice(steps, block * _BLOCK + 1, i - block * _BLOCK)) + F.get(F.col(pieces), i)
        return F.struct(start.alias("s"), (start + F.length(hit)).alias("e"), hit.alias("hit"))

    return df.withColumn(f"_{kind}", F.transform(hits, placed)).drop(hits, pieces, steps, sums, before)


def _entropy_is_high(candidate: Column, window: int, classes: dict[str, tuple[str, list[str], float]], allowed: list[str]) -> Column:
    """Whether the best window of ``candidate`` reaches the entropy of its class and the allow-list does not know it."""
    terms = _terms(window)
    gain = F.array(*[F.lit(b - a).cast("long") for a, b in zip(terms, terms[1:])])
    chars = F.split(candidate, "")

    def count(of: Column, c: Column) -> Column:
        return F.size(of) - F.size(F.array_remove(of, c))

    def slide(state: Column, i: Column) -> Column:
        own = state["chars"]
        # What stays in the window when the character before it leaves and character i enters.
        stays = F.slice(own, F.greatest(i - (window - 2), F.lit(1)), F.least(i, F.lit(window - 1)))
        leaves = F.when(i >= window, F.get(state["gain"], count(stays, F.get(own, i - window)))).otherwise(F.lit(0).cast("long"))
        now = state["sum"] - leaves + F.get(state["gain"], count(stays, F.get(own, i)))
        return F.struct(own.alias("chars"), state["gain"].alias("gain"), now.alias("sum"),
                        F.when(i >= window - 1, F.least(state["low"], now)).otherwise(state["low"]).alias("low"))

    start = F.struct(chars.alias("chars"), gain.alias("gain"), F.lit(0).cast("long").alias("sum"), F.lit((1 << 62)).cast("long").alias("low"))
    low = F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), start, slide, lambda state: state["low"])
    most = F.lit(None).cast("long")
    for every, holds, bits in reversed(list(classes.values())):
        fits = candidate.rlike(f"^{every}+$")
        for some in holds:
            fits = fits & candidate.rlike(some)
        most = F.when(fits, F.lit(_most(bits, window)).cast("long")).otherwise(most)
    known = candidate.rlike(JOINED) & ~candidate.rlike(NOT_JOINED)
    for pattern in allowed:
        known = known | candidate.rlike(pattern)
    return F.when(known, F.lit(False)).otherwise(F.coalesce(F.when(most.isNotNull(), low <= most), F.lit(False)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         classes: dict[str, tuple[str, list[str], float]] = CLASSES, allowed: list[str] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, finds of every row.

    ``spans`` is ``kind:start:end`` of all finds by start, then kind as in KINDS, in code points with exclusive ends; ``finds`` has
    the same with the string found. Base finds stay whatever the allow-list says, and entropy finds may overlap them. NULL and empty
    texts have no finds; repeated rows are scanned each; an empty table gives an empty result.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", f"[A-Za-z0-9+/_=-]{{{window},}}")):
        df = _spans(df, "_text", kind, pattern)
    df = df.drop("_text").withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 1)) >= LEAST_VALUE))
    df = df.withColumn("_entropy", F.filter("_entropy", lambda x: _entropy_is_high(x["hit"], window, classes, allowed)))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint,hit:string>>")

    def numbered(k: int) -> Column:
        return F.coalesce(F.transform(f"_{KINDS[k]}", lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["hit"].alias("hit"))), none)

    def number_of(k: int) -> Column:
        return F.size(F.filter("_all", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    df = df.withColumn("_base", F.array_sort(F.concat(*map(numbered, range(3))))).withColumn("_all", F.array_sort(F.concat(*map(numbered, range(4)))))
    names = F.array(*map(F.lit, KINDS))

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")

    finds = F.transform("_all", lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["hit"].alias("found")))
    return df.select("doc_id", *map(number_of, range(4)), F.sha2(written("_base"), 256).alias("base_sha256"), written("_all").alias("spans"), finds.alias("finds"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str, pattern: str) -> str:
    k = KINDS.index(kind)
    return f"""
{kind}_m AS (SELECT rid, regexp_extract_all(text, {_quoted(pattern)}) AS ms, string_split_regex(text, {_quoted(pattern)}) AS ps FROM d),
{kind} AS (
  SELECT rid, {k} AS k, ms[i] AS hit, CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {kind}_m))"""


def _any(patterns: list[str], how: str) -> str:
    return how.join(f"regexp_matches(hit, {_quoted(p)})" for p in patterns)


_HIGH = " ".join(f"WHEN {_any([f'^{every}+$', *holds], ' AND ')} THEN {_most(bits, WINDOW)}" for every, holds, bits in CLASSES.values())
_KNOWN = f"{_any(ALLOWED, ' OR ')} OR {_any([JOINED], '')} AND NOT {_any([NOT_JOINED], '')}"
#: The same in SQL, over the view documents: every window is counted anew.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{",".join(_found(k, p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)))},
c AS (SELECT DISTINCT hit, CASE {_HIGH} END AS most FROM entropy WHERE NOT ({_KNOWN})),
win AS (SELECT hit, most, i, unnest(string_split(hit[i:i + {WINDOW - 1}], '')) AS ch FROM (SELECT hit, most, unnest(range(1, length(hit) - {WINDOW - 2})) AS i FROM c WHERE most IS NOT NULL)),
term AS (SELECT unnest(range({WINDOW + 1})) AS n, unnest({_terms(WINDOW)}) AS t),
low AS (
  SELECT hit, most, min(t) AS low FROM (
    SELECT hit, most, i, sum(t) AS t FROM (SELECT hit, most, i, ch, count(*) AS n FROM win GROUP BY ALL) JOIN term USING (n) GROUP BY ALL) GROUP BY ALL),
f AS (
  SELECT rid, k, s, hit FROM assign WHERE length(regexp_extract(hit, {_quoted(ASSIGN)}, 1)) >= {LEAST_VALUE}
  UNION ALL SELECT rid, k, s, hit FROM access UNION ALL SELECT rid, k, s, hit FROM hex
  UNION ALL SELECT rid, k, s, hit FROM entropy JOIN (SELECT hit FROM low WHERE low <= most) USING (hit)),
g AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
    coalesce(string_agg(w, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(w, ',' ORDER BY s, k) AS spans,
    list({{'kind': kind, 'start': s, 'end': s + length(hit), 'found': hit}} ORDER BY s, k) AS finds
  FROM (SELECT *, ({KINDS})[k + 1] AS kind, concat_ws(':', ({KINDS})[k + 1], s, s + length(hit)) AS w FROM f) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
