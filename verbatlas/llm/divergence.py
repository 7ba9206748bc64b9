"""How far the sources of a language differ in their words, and which words tell a source from its language.

Each language keeps the terms that enough of its documents hold. A group (language, source), and a language as a whole,
gives a kept term of n occurrences the scaled probability p = 1 + floor(SCALE (n + 1) / (N + V)); V terms are kept, N
is the sum of n over them. Two probabilities differ by f(p, q) = floor((p - q)^2 / q). All arithmetic is on integers.

* Texts are counted once. A task sums up terms for each group in a table of bounded size and hands on its sums; these
  meet by language and term, so neither a hot source nor a hot term gathers rows.
* The divergence of a pair sums f over all kept terms, but only terms that occur are looked at. If neither side has a
  term, f is that of the two baselines b = 1 + floor(SCALE / (N + V)): V f(b, b') corrected for the terms of one side (by a
  histogram of its probabilities) and once more for the terms of both (f(p, p') - f(p, b') - f(b, p') + f(b, b')). The last
  sums are made inside tasks, so a term of d sources gives no d^2 rows.
* The first ranks of each group are found by a radix select: histograms over the leading bits of the values give the
  bucket of the threshold, further bits and then pairs of UTF-8 bytes of the terms refine it until what is left in a
  bucket is few. No group is sorted whole.

Defined cases: null text, language or source counts as empty; groups without terms take part with N = 0; a language
without kept terms has pairs of value 0 and no terms; repeated rows are documents of their own; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verbatlas.llm.rows import named
from verbatlas.llm.words import release, slices
from verbatlas.session import ship, stash, table, written

LEAST_DOCS, TOP, SCALE = 3, 200, 10**9
#: Entries that a task's table of counts holds before it hands them on.
TABLE_ENTRIES = 300_000
#: Pairs that a task makes at once in memory.
PAIRS_AT_ONCE = 1 << 20
#: Groups up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Rows of a group that may lie in the threshold's bucket when it is ranked.
DIRECT_ROWS = 4_096
#: Bytes of a term in UTF-8: ASCII letters and all that is not ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


# -- counts ---------------------------------------------------------------------------------------
def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it): sums of parts of the table; for each group also a row whose term is null."""
    ship(docs.sparkSession)
    narrow = docs.select(*(F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    names = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def summed(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs_with) in found.items():
            terms = pa.array([None, *counts], pa.binary()).cast(pa.string())
            n, held = [0, *counts.values()], [0, *map(docs_with.__getitem__, counts)]
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), terms, pa.array(n, pa.int64()), pa.array(held, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lo, hi in slices(batch.column(2), 4_000_000):
                part = batch.slice(lo, hi - lo)
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    counts, docs_with = found.setdefault((lang, source), (Counter(), Counter()))
                    terms = _TERM.findall(text.lower())  # of bytes: A-Z only
                    counts.update(terms)
                    docs_with.update(set(terms))
                if sum(len(c) for c, _ in found.values()) > TABLE_ENTRIES:
                    yield from summed(found)
                    found = {}
        yield from summed(found)
        release()

    return narrow.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, **columns: str) -> DataFrame:
    """lang, term, n and by_source (array of source and n) of each kept term; and for each language a row without a term that lists its sources."""
    parts = term_counts(docs, **columns).repartition("lang", "term")
    of_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = of_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    return of_term.where((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs")


def _scaled(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE (n + 1) / whole), by decimals where the product is beyond 64 bits."""
    div = lambda a, b: F.call_function("div", a, b)
    wide = div((n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(19,0)"))
    return F.lit(1).cast("long") + F.when(n < 9 * 10**9, div((n + 1) * F.lit(SCALE).cast("long"), whole)).otherwise(wide.cast("long"))


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _small(df: DataFrame) -> DataFrame:
    """A stashed table, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


# -- ranks ----------------------------------------------------------------------------------------
def _bits(value: str) -> str:
    return f"if({value} = 0, 0, length(bin({value})))"


def first_ranks(rows: DataFrame, group: list[str], value: str, text: str, k: int, direct: int = DIRECT_ROWS) -> DataFrame:
    """rows (narrow) of the first k ranks of each group, with rank: largest non-negative value first, ties by the smaller text in UTF-8.

    Each round counts the open rows of a group by a digit of at most 16 bits, keeps the digits above the threshold's
    and opens the threshold's bucket for the next digit. The first digit is the number of bits of the value with ten
    bits behind the leading one, so that values of any size are told apart.
    """
    shift = f"greatest({_bits(value)} - 11, 0)"
    longest: int | None = None
    open_, sure, level = rows.withColumn("_need", F.lit(k).cast("long")), None, 0
    while True:
        if level <= 4:
            digit = F.expr(f"{shift} * 1024L + shiftright({value}, {shift})") if level == 0 else F.expr(f"shiftright({value}, greatest({shift} - {16 * level}, 0))")
        else:
            digit = -F.conv(F.rpad(F.hex(F.substring(F.col(text).cast("binary"), 2 * (level - 5) + 1, 2)), 4, "0"), 16, 10).cast("long")
        open_ = open_.withColumn("_digit", digit)
        down = W.partitionBy(*group).orderBy(F.col("_digit").desc())
        counts = open_.groupBy(*group, "_need", "_digit").agg(F.count("*").alias("_n")).withColumn("_above", F.sum("_n").over(down) - F.col("_n"))
        cut = counts.where("_above < _need").groupBy(*group).agg(F.min("_digit").alias("_cut"), F.max("_above").alias("_above"))
        kept = stash(open_.join(cut, group).where("_digit >= _cut"))
        above, bucket = kept.where("_digit > _cut").select(*rows.columns), kept.where("_digit = _cut")
        sure = above if sure is None else sure.union(above)
        fullest = bucket.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if level == 5 and longest is None:
            longest = bucket.agg(F.max(F.octet_length(text))).first()[0] or 0
        if fullest <= direct or (longest is not None and 2 * (level - 4) > longest):
            break
        open_ = bucket.withColumn("_need", F.col("_need") - F.col("_above")).select(*rows.columns, "_need")
        level += 1
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.col(value).desc(), F.col(text)))
    return sure.union(bucket.select(*rows.columns)).withColumn("rank", rank).where(F.col("rank") <= k)


# -- pairs ----------------------------------------------------------------------------------------
def _met_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and the sums of what terms of both correct, of lists of (gid, p, base)."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        gid, p, base = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        lengths = np.diff(ends, prepend=0)
        first, width = np.repeat(ends - lengths, lengths), np.repeat(lengths, lengths)
        upto, at = np.cumsum(width), 0
        while at < len(gid):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            w = width[at:to]
            left = np.repeat(np.arange(at, to), w)
            right = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[at:to], w)
            own = left != right
            left, right = left[own], right[own]
            more = f(p[left], p[right]) - f(p[left], base[right]) - f(base[left], p[right]) + f(base[left], base[right])
            ids = np.unique(np.concatenate([gid[left], gid[right]]))
            code = np.searchsorted(ids, gid[left]) * len(ids) + np.searchsorted(ids, gid[right])
            order = np.argsort(code, kind="stable")
            code, more = code[order], more[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            if len(starts):
                sums, code = np.add.reduceat(more, starts), code[starts]
                yield pa.RecordBatch.from_arrays([pa.array(ids[code // len(ids)]), pa.array(ids[code % len(ids)]), pa.array(sums)], ["a", "b", "met"])
            at = to


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, direct: int = DIRECT_ROWS, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: see the module's text.

    part `pair`: every other source of the language (item) with its divergence; part `term`: the terms that the group
    has above its language, up to rank `top`.
    """
    kept = written(kept_terms(docs, least_docs, **columns))
    terms = kept.where("term is not null")
    langs = stash(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n")))
    sums = terms.select("lang", F.explode("by_source").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    groups = kept.where("term is null").select("lang", F.explode("by_source.source").alias("source"))
    groups = groups.join(sums, ["lang", "source"], "left").join(_small(langs), "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("n", zero) + F.coalesce("v", zero)).alias("whole"))
    groups = stash(groups.withColumn("base", F.when(F.col("v") > 0, _scaled(zero, F.col("whole")))))
    small_groups = _small(groups)

    one = terms.select("lang", "term", F.col("n").alias("lang_term"), F.explode("by_source").alias("s")).select("lang", "term", "lang_term", "s.source", "s.n")
    one = one.join(small_groups.select("lang", "source", "gid", "whole", "base"), ["lang", "source"]).withColumn("p", _scaled(F.col("n"), F.col("whole")))

    above = one.join(_small(langs), "lang").withColumn("q", _scaled(F.col("lang_term"), F.col("lang_n") + F.col("v"))).where("n > 0 and p > q")
    ranked = first_ranks(above.select("gid", "term", _f("p", "q").alias("value")), ["gid"], "value", "term", top, direct)
    of_terms = ranked.join(small_groups, "gid").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    met = one.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "base")).alias("held")).where(F.size("held") > 1).select("held")
    met = met.mapInArrow(_met_pairs, "a long, b long, met long").groupBy("a", "b").agg(F.sum("met").alias("met"))
    other = groups.select(F.col("gid").alias("b"), "lang", F.col("base").alias("other"))
    histogram = one.groupBy("gid", "lang", "p", "base").agg(F.count("*").alias("n"))
    sided = histogram.join(_small(other), "lang").where("gid != b")
    none = _f("base", "other")
    sided = sided.groupBy(F.col("gid").alias("a"), "b").agg(
        F.sum((_f("p", "other") - none) * F.col("n")).alias("as_first"),  # what a's own terms correct in (a, b)
        F.sum((_f("other", "p") - _f("other", "base")) * F.col("n")).alias("as_second"),  # and in (b, a)
    )
    pairs = groups.alias("x").join(_small(groups).alias("y"), F.col("x.lang") == F.col("y.lang")).where("x.gid != y.gid")
    pairs = pairs.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"), "x.lang", "x.source", F.col("y.source").alias("item"), "x.v", F.col("x.base").alias("base"), F.col("y.base").alias("other"))
    sided = stash(sided)
    pairs = pairs.join(met, ["a", "b"], "left").join(sided.select("a", "b", "as_first"), ["a", "b"], "left")
    pairs = pairs.join(sided.select(F.col("a").alias("b"), F.col("b").alias("a"), "as_second"), ["a", "b"], "left")
    value = F.coalesce(F.col("v") * _f("base", "other"), zero) + F.coalesce("met", zero) + F.coalesce("as_first", zero) + F.coalesce("as_second", zero)
    pairs = pairs.withColumn("value", value)
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("value").desc(), "item"))
    of_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return of_pairs.union(of_terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS whole FROM k GROUP BY ALL),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g0 AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT g0.lang, g0.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS whole FROM g0 LEFT JOIN c ON c.lang = g0.lang AND c.source = g0.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.whole + l.v) AS p, 1 + ({SCALE}::HUGEINT * (k.n + 1)) // (l.whole + l.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank FROM p WHERE n > 0 AND p > q QUALIFY rank <= {TOP})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r
"""


QUERIES = {"op12_divergence": op12_divergence}
ORACLE_SQL = {"op12_divergence": _ORACLE}
