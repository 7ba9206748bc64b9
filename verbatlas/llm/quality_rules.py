"""Quality rules with adaptive limits from mergeable quantile sketches, in DataFrame functions only.

Measures of each text are turned into integers (tenths of a character, thousandths of a share). A
sketch is the histogram of such integers, one for each language, source and measure: at most BUCKETS
counters, merged by adding, with an error of one bucket at most for any quantile. The limits of a
group follow from its quartiles (three spans beyond the nearer one, and a fixed slack of the measure's
resolution); groups with little support use the merged sketch of their language, and that failing, of
all rows. The limits are joined to the measures, and a document is kept if it passes the base rules
and lies within all limits.

Defined cases: a null text counts as empty and fails the base rules; null language or source is a
group of its own; repeated rows are judged one by one, alike; an empty table gives an empty table;
other columns, whatever their names, are ignored (op8) or passed through (keep_good).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verbatlas.llm.rows import ROW, whole_row
from verbatlas.session import stash, table

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8
BUCKETS = 1001
#: Measures: the slack added to a limit, and whether there is a lower limit as well.
MEASURES = {"symbols": (40, False), "dup_lines": (350, False), "repeats": (200, False), "word_length": (20, True)}
#: Rows that a group needs for limits of its own.
SUPPORT = 100
#: Rows of the table of limits up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 20_000


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def count(win: Column) -> Column:
        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.get(at, k + 1) - p))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        def places(order: Column) -> Column:
            twice = F.filter(order, lambda s, k: F.coalesce(F.get(order, k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(order, k + 1)["h"] == s["h"], F.lit(False)))
            return _let(F.array_sort(F.transform(twice, lambda s: s["p"])), covered)

        pairs = F.transform(win, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(_let(F.array_sort(pairs), places))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))
        return _let(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))), count)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashes, windows))


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed and the measures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    core = F.btrim(text, F.lit(SPACE))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    both = lambda made: F.struct(F.size(made).alias("n"), F.length(F.array_join(made, "")).alias("c"), _repeated(made).alias("r"))
    lined = lambda made: F.struct(F.size(made).alias("n"), F.size(F.array_distinct(made)).alias("d"))
    p = prefix
    out = docs.withColumns({f"{p}_w": _let(words, both), f"{p}_l": _let(lines, lined)}).withColumns(
        {
            f"{p}n_words": F.col(f"{p}_w.n").cast("long"),
            f"{p}word_chars": F.col(f"{p}_w.c").cast("long"),
            f"{p}n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            f"{p}n_dup_lines": (F.col(f"{p}_l.n") - F.col(f"{p}_l.d")).cast("long"),
            f"{p}n_lines": F.col(f"{p}_l.n").cast("long"),
            f"{p}n_repeat_words": F.col(f"{p}_w.r").cast("long"),
        }
    )
    c = lambda name: F.col(f"{p}{name}")
    share = lambda scale, a, b: F.least(F.floor(F.lit(scale) * c(a) / F.greatest(c(b), F.lit(1))), F.lit(BUCKETS - 1)).cast("int")
    return out.withColumns(
        {
            f"{p}base_failed": (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words")),
            f"{p}m_symbols": share(1000, "n_symbols", "word_chars"),
            f"{p}m_dup_lines": share(1000, "n_dup_lines", "n_lines"),
            f"{p}m_repeats": share(1000, "n_repeat_words", "n_words"),
            f"{p}m_word_length": share(10, "word_chars", "n_words"),
        }
    ).drop(f"{p}_w", f"{p}_l")


def sketch(rows: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "") -> DataFrame:
    """Histograms of the measures of rows that pass the base rules: lang, source, measure, bucket, n."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"{prefix}m_{m}").alias("bucket")) for m in MEASURES))
    return (
        rows.where(~F.col(f"{prefix}base_failed"))
        .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(pairs).alias("x"))
        .groupBy("lang", "source", "x.measure", "x.bucket")
        .agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of larger groups: counters add up."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, rows and the quartiles (nearest rank) of each group."""
    by = W.partitionBy(*keys, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("rows", F.sum("n").over(by))
    least = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), least(1).alias("q1"), least(3).alias("q3"))


def limits(sketches: DataFrame) -> DataFrame:
    """lang, source and for each measure lo_<m> and hi_<m>, for each group that the sketches hold."""
    own = _quartiles(sketches, "lang", "source").alias("own")
    by_lang = _quartiles(merged(sketches, "lang"), "lang").alias("wide")
    of_all = _quartiles(merged(sketches)).alias("all")
    joined = own.join(by_lang, F.col("own.lang").eqNullSafe(F.col("wide.lang")) & (F.col("own.measure") == F.col("wide.measure"))).join(F.broadcast(of_all), F.col("own.measure") == F.col("all.measure"))
    pick = lambda q: F.when(F.col("own.rows") >= SUPPORT, F.col(f"own.{q}")).when(F.col("wide.rows") >= SUPPORT, F.col(f"wide.{q}")).otherwise(F.col(f"all.{q}"))
    chosen = joined.select("own.lang", "own.source", "own.measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    only = lambda m, value: F.max(F.when(F.col("measure") == m, value))
    span = 3 * (F.col("q3") - F.col("q1"))
    aggs = []
    for m, (slack, both) in MEASURES.items():
        aggs.append(only(m, F.col("q3") + span + slack).alias(f"hi_{m}"))
        aggs.append(only(m, (F.col("q1") - span - slack) if both else F.lit(0)).alias(f"lo_{m}"))
    return chosen.groupBy("lang", "source").agg(*aggs)


def judged(rows: DataFrame, lims: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "") -> DataFrame:
    """rows with <prefix>kept: the base rules passed, and all measures within the limits of the group."""
    lims = stash(lims)
    if lims.count() <= BROADCAST_ROWS:
        lims = F.broadcast(lims)
    lims = lims.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(F.col(c) for c in lims.columns if c[:3] in ("lo_", "hi_")))
    out = rows.join(lims, rows[lang_col].eqNullSafe(F.col("_lang")) & rows[source_col].eqNullSafe(F.col("_source")), "left")
    inside = ~F.col(f"{prefix}base_failed")
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(f"{prefix}m_{m}").between(F.col(f"lo_{m}"), F.col(f"hi_{m}")), F.lit(True))
    return out.withColumn(f"{prefix}kept", inside)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their measures and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = stash(measured(docs).drop("text"))
    return judged(rows, limits(sketch(rows))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns. The measures are computed once and written beside the rows, so that no text is shuffled."""
    rows = stash(measured(docs.select(whole_row(), "lang", "source", "text")).drop("text"))
    return judged(rows, limits(sketch(rows))).where("kept").select(f"{ROW}.*")


def _oracle() -> str:
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    def quart(name: str, keys: str) -> str:
        lead = f"{keys}, " if keys else ""
        return f"""
{name} AS (
  SELECT {lead}measure, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3
  FROM (SELECT {lead}measure, bucket, sum(n) OVER (PARTITION BY {lead}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {lead}measure) AS total
        FROM (SELECT {lead}measure, bucket, sum(n) AS n FROM sk GROUP BY {lead}measure, bucket))
  GROUP BY {lead}measure)"""
    cases = ", ".join(f"max(CASE WHEN measure = '{m}' THEN q3 + 3 * (q3 - q1) + {s} END) AS hi_{m}, max(CASE WHEN measure = '{m}' THEN {f'q1 - 3 * (q3 - q1) - {s}' if both else '0'} END) AS lo_{m}" for m, (s, both) in MEASURES.items())
    inside = " AND ".join(f"coalesce(m.m_{m} BETWEEN l.lo_{m} AND l.hi_{m}, true)" for m in MEASURES)
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, m_{m} AS bucket FROM m WHERE NOT base_failed" for m in MEASURES)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {space})) > 0) AS ls FROM d),
win AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM s WHERE len(ws) >= {WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid),
b AS (
  SELECT s.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {space}, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN rep ON s.rid = rep.rid),
m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    least(1000 * n_symbols // greatest(word_chars, 1), {BUCKETS - 1}) AS m_symbols, least(1000 * n_dup_lines // greatest(n_lines, 1), {BUCKETS - 1}) AS m_dup_lines,
    least(1000 * n_repeat_words // greatest(n_words, 1), {BUCKETS - 1}) AS m_repeats, least(10 * word_chars // greatest(n_words, 1), {BUCKETS - 1}) AS m_word_length
  FROM b),
sk AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({union}) GROUP BY ALL),{quart('own', 'lang, source')},{quart('wide', 'lang')},{quart('al', '')},
pick AS (
  SELECT own.lang, own.source, own.measure,
    CASE WHEN own.total >= {SUPPORT} THEN own.q1 WHEN wide.total >= {SUPPORT} THEN wide.q1 ELSE al.q1 END AS q1,
    CASE WHEN own.total >= {SUPPORT} THEN own.q3 WHEN wide.total >= {SUPPORT} THEN wide.q3 ELSE al.q3 END AS q3
  FROM own JOIN wide ON own.lang IS NOT DISTINCT FROM wide.lang AND own.measure = wide.measure JOIN al ON own.measure = al.measure),
l AS (SELECT lang, source, {cases} FROM pick GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed) AND {inside} AS kept
FROM m LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
"""


QUERIES = {"op8_rules": op8_rules}
ORACLE_SQL = {"op8_rules": _oracle()}
