"""URL filter by path templates (operator 2).

Per host, the paths of all urls form a tree of segments, kept as counts. Level by level, from the root, segments are generalised: one that varies
(digits, long identifiers, or too rare beneath its parent) becomes a wildcard, and so does a branch whose labelled
purity does not differ significantly from that of its siblings taken together; branches that are significantly purer merge with each other
into ``+``, those that are less pure stay. What is left are templates. A template is
rejected if its purity, smoothed towards that of its ancestors, is below a threshold. Large groups go down a level at a time, all together; what
is left of a group that has become small is finished at once, by the same rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import dealt, joined_by_salt, lower_ascii, slices, stored

# Fixed values: (verdict, host, path) of the rules.
RULES: list[tuple[str, str, str]] = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
#: A literal branch needs this many urls; a branch differs beyond this many standard errors;
#: a parent's purity weighs as this many labels; a template is rejected below this purity.
SUPPORT, DIFFERS, WEIGHT, PURE = 20, 2.58, 10.0, 0.5
#: Paths of a host under one template that a task finishes by itself.
FEW = 256


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, lower_ascii(host)).otherwise(""), F.when(has, path).otherwise("")


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL where none does. Rules are tried longest first, block before allow."""
    tries = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        tries = F.when(fits, one) if tries is None else tries.when(fits, one)
    return tries


def _segments(path: Column) -> Column:
    """Segments of a path, those that vary as ``*``."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda c: F.when(_varies(c), F.lit("*")).otherwise(c))


def _varies(segment: Column) -> Column:
    return segment.rlike(r"\d{2,}|^\d+$|^[0-9a-fA-F-]{8,}$") | (F.length(segment) > 40)


def _fates(children: dict[str, list[int]]) -> dict[str, str]:
    """What becomes of the children (segment: urls, good, bad) of a template: themselves, ``+`` or ``*``."""
    good, bad = sum(c[1] for c in children.values()), sum(c[2] for c in children.values())
    alone, out = len(children) == 1, {}
    for name, (n, g, b) in children.items():
        k, og, m = g + b, good - g, good + bad - g - b
        differs = False
        if k and m and good and bad:
            rate = good / (k + m)
            differs = abs(g / k - og / m) / math.sqrt(rate * (1 - rate) * (1 / k + 1 / m)) > DIFFERS
        literal = name != "*" and n >= SUPPORT and (alone or differs)
        out[name] = "*" if not literal else name if alone or g / k < og / m else "+"
    return out


def _finish(group: list[dict], level: int) -> None:
    """Set template and purity of the urls of one host and template from a level on, to their ends."""
    todo = [(group, level)]
    while todo:
        rows, at = todo.pop()
        children: dict[str, list[int]] = {}
        for r in rows:
            if len(r["_s"]) > at:
                c = children.setdefault(r["_s"][at], [0, 0, 0])
                for i, x in enumerate(("n", "good", "bad")):
                    c[i] += r[x]
        fates = _fates(children)
        merged: dict[str, list[dict]] = {}
        for r in rows:
            if len(r["_s"]) > at:
                merged.setdefault(fates[r["_s"][at]], []).append(r)
        for to, below in merged.items():
            g, b = sum(r["good"] for r in below), sum(r["bad"] for r in below)
            purity = (g + WEIGHT * below[0]["purity"]) / (g + b + WEIGHT)
            for r in below:
                r["purity"] = purity
                r["steps"].append(to)
            todo.append((below, at + 1))


def _finished(rows: DataFrame, level: int) -> DataFrame:
    """Rows whose groups of (host, template) are small, finished."""
    names = ["host", "path", "template", "purity", "good", "bad", "n", "_s"]
    out = pa.schema([("host", pa.string()), ("path", pa.string()), ("template", pa.string()), ("purity", pa.float64()),
                     ("good", pa.int64()), ("bad", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            _finish(held, level)
            for r in held:
                r["template"] = "/".join([r["template"], *r["steps"]])
            return pa.RecordBatch.from_pylist(held, schema=out)

        held: list[dict] = []
        for batch in slices(batches):
            for r in batch.to_pylist():
                if held and (r["host"], r["template"]) != key:
                    yield done()
                    held = []
                key = r["host"], r["template"]
                held.append(r | {"steps": []})
        if held:
            yield done()

    kinds = "host string, path string, template string, purity double, good long, bad long, n long"
    return dealt(rows.select(*names), "host", "template").sortWithinPartitions("host", "template").mapInArrow(run, kinds)


def templates(urls: DataFrame, few: int = FEW) -> DataFrame:
    """The template of each (host, path) of ``urls`` (host, path, good, bad, n): adds template, purity.

    Counts are aggregated by host and path prefix; the hosts' urls never meet in a group. Each level joins the urls' current
    prefix with what became of its children. A group of at most ``few`` paths is finished by a task, whatever its depth, so there are as
    many rounds as levels at which a group is larger.
    """
    slim = urls.select("host", "path", *[F.col(c).cast("long").alias(c) for c in ("good", "bad", "n")])
    rows = slim.withColumn("_s", _segments(F.col("path"))).withColumn("template", F.lit(""))
    overall = rows.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select(
        ((F.coalesce("g", F.lit(0)) + 1) / (F.coalesce("g", F.lit(0)) + F.coalesce("b", F.lit(0)) + 2)).alias("purity"))
    root = rows.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("_paths")).crossJoin(F.broadcast(overall)).select(
        F.col("host").alias("_h"), ((F.col("g") + WEIGHT * F.col("purity")) / (F.col("g") + F.col("b") + WEIGHT)).alias("purity"), "_paths")
    rows = stored(rows.join(root, F.col("host") == F.col("_h")).drop("_h"), "urls")
    out, level = None, 0
    while True:
        # Urls without a segment at this level are done.
        going = F.size("_s") > level
        ready = _finished(rows.filter(going & (F.col("_paths") <= few)), level).unionByName(rows.filter(~going).drop("_s", "_paths"))
        out = ready if out is None else out.unionByName(ready)
        named = rows.filter(going & (F.col("_paths") > few)).withColumn("_c", F.get("_s", F.lit(level)))
        if named.isEmpty():
            return stored(out, "urls")
        counted = named.groupBy("host", "template", "_c").agg(
            F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.first("purity").alias("above"),
            F.count_if(F.size("_s") > level + 1).alias("paths"))
        siblings = counted.groupBy("host", "template").agg(F.sum("g").alias("sg"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("children"))
        wide = joined_by_salt(counted, siblings, ["host", "template"]).withColumns({"og": F.col("sg") - F.col("g"), "ob": F.col("sb") - F.col("b")})
        k, m = F.col("g") + F.col("b"), F.col("og") + F.col("ob")
        rate = F.try_divide(F.col("g") + F.col("og"), k + m)
        spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), k) + F.try_divide(F.lit(1), m)))
        z = F.try_divide(F.abs(F.try_divide("g", k) - F.try_divide("og", m)), spread)
        differs = (k > 0) & (m > 0) & (rate > 0) & (rate < 1) & (z > DIFFERS)
        alone = F.col("children") == 1
        literal = (F.col("_c") != "*") & (F.col("n") >= SUPPORT) & (alone | F.coalesce(differs, F.lit(False)))
        worse = F.try_divide("g", k) < F.try_divide("og", m)
        fate = wide.withColumn("to", F.when(literal & (alone | worse), F.col("_c")).when(literal, "+").otherwise("*"))
        merged = fate.groupBy("host", "template", "to").agg(
            ((F.sum("g") + WEIGHT * F.first("above")) / (F.sum("g") + F.sum("b") + WEIGHT)).alias("p"), F.sum("paths").alias("_paths"))
        fate = joined_by_salt(fate.select("host", "template", "_c", "to"), merged, ["host", "template", "to"]).select(
            F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("_c").alias("_k"), "to", F.col("p").alias("purity"), "_paths")
        stepped = named.drop("purity", "_paths").join(
            fate, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("_c") == F.col("_k")))
        rows = stored(stepped.withColumn("template", F.concat("template", F.lit("/"), F.col("to"))).select(*rows.columns), "urls")
        level += 1


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               pure: float = PURE) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: allow or block of every url.

    A page's label is that of the document with its id (quality 1 good, 0 bad; NULL says nothing). NULL urls and urls without ``://`` have empty host and
    path. Repeated pages are judged each, repeated labels count once, the worst of them. Without labels all templates are as pure as
    the prior, one half, and pass. An empty table gives an empty result.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    marks = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("q"))
    labelled = rows.join(marks, "page_id", "left")
    by_path = labelled.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("q") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("q") == 0, 1).otherwise(0)).alias("bad"))
    known = templates(by_path).select("host", "path", "template", "purity")
    judged = rows.join(known, ["host", "path"]).withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(
        "_r.verdict", F.when(F.col("purity") < pure, "block").otherwise("allow")).alias("verdict"), "template", "purity")
