"""Registered queries on readers, writers, records, streams and cell functions, and their SQL.

What is written goes into the shared folder and is read back by the readers, so that a row of the result
has passed both. Every query runs over whole tables.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.providers import AUXILIARIES, ArrowMaskedLM, ArrowPipeline, ArrowTagger, CarriedTokens, masked_lm_loader, verb_kinds
from verbatlas.functions.text import ROW_ORD, cell_for_sheet, listed_words, masked, number, printed_bytes, share, span, ten_digits, title_for_sheet
from verbatlas.operators import extract, frequency, groups, letters, naming, spelling
from verbatlas.session import local_scratch, scratch, ship, spread, table
from verbatlas.sources import blocks, grouptables, manifest, readers, sinks, xlsx
from verbatlas.streaming import files


#: Characters of the chunks of files, and of their overlap.
CHUNK, CHUNK_OVERLAP = 20_000, 500


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).withColumn(ROW_ORD, F.struct("conv_id", "turn", "role", "text"))


# -- delimited tables -----------------------------------------------------------------------------
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files in order, with line breaks and quotes in cells; read by byte ranges, with row numbers."""
    path = scratch(spark)
    sinks.write_delimited(_in_order(spark, sf_dir), path, order_col=ROW_ORD)
    return readers.numbered_rows(readers.delimited(spark, path, needed=["text"]), "text")


def csv_single_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_delimited(_in_order(spark, sf_dir), path, order_col=ROW_ORD)
    return frequency.counts(readers.single_column(spark, path, "role"), "role", ROW_ORD)


def csv_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each role, written by one job, read as one after their columns were compared."""
    paths = sinks.write_by_value(_conversations(spark, sf_dir), scratch(spark), "role")
    return readers.delimited(spark, paths).drop(ROW_ORD)


def tsv_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_delimited(_conversations(spark, sf_dir).select(F.col("role").alias("lemma"), F.col("text").alias("sentence_text")), path, sep="\t")
    return readers.clause_database(spark, path).select("lemma", "sentence_text")


def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file on the driver, a row at a time; spans written as start-end."""
    target = str(local_scratch(spark) / "parts.csv")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.struct(F.col("p_size").alias("start"), (F.col("p_size") + 2).alias("end")).alias("size"))
    n = sinks.write_local(rows, target, order_col="p_partkey")
    return readers.delimited(spark, target).select("*", F.lit(n).cast("long").alias("rows")).drop(ROW_ORD)


# -- text -----------------------------------------------------------------------------------------
def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_words(_conversations(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")), path, one_file=False)
    return readers.word_list(spark, path)


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight texts, of one file or more, each cut into overlapping chunks of characters by many tasks."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "documents").select(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(8)).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows = rows.repartitionByRange(max(8, rows.rdd.getNumPartitions()), "part", "doc_id").sortWithinPartitions("part", "doc_id", "value")  # files are named in this order
    rows.select("part", "value").write.partitionBy("part").text(path)
    out = blocks.char_chunks(spark, [path], CHUNK, CHUNK_OVERLAP, folders=True)
    return out.select(F.regexp_extract("doc_path", "part=([0-9]+)", 1).cast("int").alias("part"), "chunk_start", F.md5("chunk_text").alias("chunk_md5"), F.length("chunk_text").alias("chars"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_lines(_in_order(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), path, "text", one_file=False)
    return readers.lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each region, from paths given twice and one that is not there."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder, paths = scratch(spark), []
    for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect():
        paths.append(f"{folder}/{r.r_regionkey}")
        sinks.write_lines(rows.where(F.col("r_regionkey") == r.r_regionkey), paths[-1], "n_name", "n_name")
    full = [re.sub("^file:/*", "file:///", p) for p in paths]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        docs = readers.text_documents(spark, readers.path_list([*full, full[0], f"{full[0]}-missing"]))
    return docs.select(F.regexp_extract("doc_path", r"/(\d+)/part[^/]*$", 1).cast("int").alias("region"), "text")


# -- workbooks ------------------------------------------------------------------------------------
def workbook_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a workbook with a sheet of groups, read back cell by cell."""
    target = str(local_scratch(spark) / "parts.xlsx")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("\x02"), F.col("p_name"), F.lit("<&>")).alias("name"), "p_retailprice")
    xlsx.write_table(rows, target, "verb_group_counts", order_col="p_partkey")
    head, *body = xlsx.read_sheet(target, "verb_group_counts")
    return spark.createDataFrame([(int(a), b, c) for a, b, c in body], ", ".join(f"{h} {k}" for h, k in zip(head, ("long", "string", "double"), strict=True)))


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as groups of brands."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.col("p_type").alias("group"), F.ascii("p_type").alias("group_pos"))


def workbook_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of groups: sorted lemmas by column, unpivoted again."""
    target = str(local_scratch(spark) / "groups.xlsx")
    xlsx.write_table(table(spark, sf_dir, "region").select("r_name"), target, groups=_brands(spark, sf_dir))
    head, *body = xlsx.read_sheet(target, "Groups")
    cells = [(head[k], i + 1, x) for i, row in enumerate(body) for k, x in enumerate(row) if x is not None]
    return spark.createDataFrame(cells, "group string, place long, lemma string")


def members_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.members_of(_brands(spark, sf_dir)).select("group", F.concat_ws(" ", "lemmas").alias("lemmas"))


#: Words of part names as groups; `small` and `large` are in one group with `plate`.
_PART_GROUPS = {"tools": ["bolt", "gear", "rod", "Ring "], "looks": ["red", "blue", "small", "large", "plate"]}


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as wide predictions, written and read back: names are tokens, some probabilities are no numbers, some lemmas blank."""
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") < 6, " ").otherwise(F.concat("p_type", F.lit(" "))).alias("lemma"),
        F.concat(F.lit("Ġ"), F.upper(word(1))).alias("token_1"), F.concat(F.lit(" "), (F.col("p_retailprice") / 7000).cast("string")).alias("prob_1"),
        word(2).alias("token_2"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise((F.col("p_size") / 70).cast("string")).alias("prob_2"),
        F.col("p_brand").alias("group_prob_tools"),
    )
    path = scratch(spark)
    sinks.write_delimited(rows, path)
    return readers.delimited(spark, path).drop(ROW_ORD)


def _part_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.row_probabilities(groups.wide_to_array(_part_rows(spark, sf_dir)), grouptables.from_columns(spark, _PART_GROUPS))


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by group beside a column that has the name already."""
    return _part_probabilities(spark, sf_dir).select(F.col("p_partkey").cast("long").alias("p_partkey"), "lemma", "group_prob_tools", F.round("group_prob_tools_1", 9).alias("tools"), F.round("group_prob_looks", 9).alias("looks"))


def wide_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of token and probability as columns, as an array, as columns again; names checked on the way."""
    rows = _part_rows(spark, sf_dir)
    naming.require(rows.columns, ["lemma", "token_1"])
    k = naming.top_k_of(rows.columns)
    wide = groups.array_to_wide(groups.wide_to_array(rows), k)
    name = naming.bound_columns(["tools"], naming.group_columns(rows.columns))["tools"]
    return wide.select(F.col("p_partkey").cast("long").alias("p_partkey"), "token_1", "prob_1", "token_2", "prob_2", F.col(name).alias("brand"))


def wide_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by lemma over rows of which some have no lemma."""
    rows = _part_probabilities(spark, sf_dir).withColumn("ord", F.col("p_partkey").cast("long"))
    return groups.lemma_means(rows, ["group_prob_tools_1", "group_prob_looks"], order_col="ord").select("lemma", "group", F.round("mean", 6).alias("mean"), "n", "first_ord")


def fused_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by the fused profile, and their means by lemma."""
    rows = groups.wide_to_array(_part_rows(spark, sf_dir)).drop("group_prob_tools").withColumn("ord", F.col("p_partkey").cast("long"))
    out = groups.row_probabilities(rows, grouptables.from_columns(spark, {g: [x.strip().lower() for x in xs] for g, xs in _PART_GROUPS.items()}), "fused", count_active=True)
    means = groups.lemma_means(out, ["tools", "looks"], order_col="ord")
    active = out.groupBy(F.trim("lemma").alias("lemma")).agg(F.sum("group_count").alias("active"))
    return means.join(active, "lemma").select("lemma", "group", F.round("mean", 6).alias("mean"), "n", "active")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda test, odd: F.when(test, " 1").when(odd, "maybe").otherwise(F.lit("0"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(ROW_ORD), F.when(F.col("p_size") == 3, "").otherwise(F.concat_ws(" ", "p_name", "p_partkey")).alias("Lemma"), F.when(F.col("p_size") % 7 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("Freq"),
        flag(F.col("p_type") == "ECONOMY", F.col("p_size") == 20).alias("cheap"), flag(F.col("p_size") < 10, F.col("p_type") == "PROMO").alias("small"), F.lit("1").alias("SkipMe"),
    )


def tag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouptables.tags_to_columns(grouptables.tags_long(_matrix(spark, sf_dir), ["skipme"]), ["cheap", "small"])


def tag_odd_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouptables.odd_flags(_matrix(spark, sf_dir)).withColumnRenamed(ROW_ORD, "p_partkey")


# -- cells ----------------------------------------------------------------------------------------
def span_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells `start-end` and `start:end`; others, and ends before starts, are no spans."""
    sep = F.when(F.col("l_returnflag") == "A", "-").when(F.col("l_returnflag") == "N", " : ").otherwise("..")
    rows = table(spark, sf_dir, "lineitem").withColumn("s", span(F.concat(F.col("l_linenumber").cast("string"), sep, F.col("l_quantity").cast("int").cast("string")), "-:"))
    return rows.select("l_orderkey", "l_linenumber", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def ten_digit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ten_digits(F.col("l_extendedprice") / 7).alias("cell"))


def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_nationkey") % 4
    cell = F.when(kind == 0, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit("\t"))).when(kind == 1, F.col("c_name")).when(kind == 2, F.lit(None)).otherwise("1e3")
    return table(spark, sf_dir, "customer").select("c_custkey", number(cell).alias("value"))


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.md5(cell_for_sheet(F.concat(F.lit("\x01\x1f"), F.col("text"), F.lit("\x0b")))).alias("cell"))


def driver_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, shares, titles and word arguments of documents, as they are printed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), "lang", "source")
    size = F.col("n") * F.pow(F.lit(1024), F.pmod(F.col("doc_id"), F.lit(4))).cast("long")
    title = F.concat(F.lit("a/b:"), F.col("doc_id").cast("string"), F.lit("x" * 40))
    words = F.concat(F.lit("w, "), F.coalesce("lang", F.lit("")), F.lit("\nw,, "), F.coalesce("source", F.lit("")))
    return docs.select("doc_id", printed_bytes(size).alias("bytes"), share("n", F.lit(2000)).alias("share"), title_for_sheet(title).alias("title"), F.array_join(listed_words(words), " ").alias("words"))


def spell_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beside their corrected form: one word is known to be wrong."""
    rows = _conversations(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    known = spark.createDataFrame([("is",)], "word string")
    fixed = spelling.corrected(rows, "row", "text", spark.createDataFrame([("of", "OF")], "word string, replacement string"), known)
    return spelling.output_mode(rows.join(fixed.select("row", "corrected"), "row"), "text", "corrected", "two-column")


# -- models ---------------------------------------------------------------------------------------
def _tag(sentences: list[str]) -> list[list[tuple]]:
    """The rules of the built-in tagger, in Python."""
    out = []
    for s in sentences:
        tokens = []
        for i, m in enumerate(re.finditer("[A-Za-z]+", s)):
            w = m[0].lower()
            ends = w.endswith(("ed", "ing"))
            pos = "AUX" if w in AUXILIARIES else "VERB" if len(w) >= 4 and ends else "X"
            cut = w[:-3] if w.endswith("ing") and len(w) >= 5 else w[:-2] if w.endswith("ed") and len(w) >= 4 else w
            tokens.append((i, m.start(), m[0], pos, AUXILIARIES.get(w, cut)))
        out.append(tokens)
    return out


def tagger_of_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs of documents by a tagger that Python workers load."""
    ship(spark)
    return extract.verb_counts(spread(table(spark, sf_dir, "documents").select("text")), tagger=ArrowTagger(lambda: _tag))


class _ByCommas:
    """A made-up pipeline whose sentences end at commas, not where the built-in rule ends them."""

    @staticmethod
    def parse(texts: list[str]) -> list[list[tuple]]:
        cut = [[(m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in re.finditer("[^,]*,+|[^,]+", t)] for t in texts]
        return [[(s, t, tokens) for (s, t), tokens in zip(own, _tag([t for _, t in own]), strict=True)] for own in cut]


def pipeline_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs of documents with sentences and tokens from one pass of a pipeline that Python workers load."""
    ship(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("chunk_text"))).withColumn("chunk_start", F.lit(0).cast("long"))
    rows = extract.parsed_sentences(docs, ArrowPipeline(_ByCommas), kinds=verb_kinds(True))
    return extract.verbs(rows, CarriedTokens()).select("doc_id", "sent_start", "token_index", "lemma", F.col("span_text").alias("span"))


class _Tokens:
    """Words by number: 0 is the mask, others follow from their length."""

    mask_token_id = 0

    @staticmethod
    def encode(text: str) -> list[int]:
        return [0 if "<mask>" in w else len(w) % 6 + 1 for w in text.split()]

    @staticmethod
    def decode(i: int) -> str:
        return f" T{i}"


def _toy_pair() -> tuple:
    """A model that prefers the length of the text, modulo the vocabulary of seven."""
    return _Tokens, lambda rows: [[[-float((len(ids) - j) % 7) for j in range(7)]] * len(ids) for ids in rows]


def masked_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each text masked and predicted by a model that Python workers load; in every fifth turn the mask is lost."""
    ship(spark)
    rows = _conversations(spark, sf_dir).where("text is not null").withColumn("first", F.regexp_extract("text", "^[A-Za-z]+", 0))
    text = masked("text", F.lit(0), F.length("first"))
    rows = rows.withColumn("masked_text", F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(text))
    out = ArrowMaskedLM(masked_lm_loader(_toy_pair, batch_words=10_000)).predict(rows, 2)
    return out.select("conv_id", "turn", F.posexplode("preds").alias("at", "p")).select("conv_id", "turn", (F.col("at") + 1).alias("rank"), F.col("p.token").alias("token"), F.round("p.prob", 9).alias("prob"))


# -- records and streams --------------------------------------------------------------------------
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps with records: begun, finished, chained, checked, and found to be changed afterwards."""
    folder = local_scratch(spark)
    one, two = str(folder / "rows.csv"), str(folder / "counts.csv")
    defaults = {"field": "role", "least": None}
    first = manifest.Manifest.begin("extract", [], one, {"size": 5}, {"size": 1})
    began = manifest.load(first.write())["status"]
    n = sinks.write_local(_in_order(spark, sf_dir), one, order_col=ROW_ORD)
    first.finish({"rows_written": n})
    settings = manifest.resolved({"field": None, "least": 0}, {"settings": {"field": "role", "least": 3}}, defaults)
    second = manifest.Manifest.begin("count", [one], two, settings, defaults, manifest.parent_of(one))
    m = sinks.write_local(frequency.counts(readers.single_column(spark, one, "role"), "role", ROW_ORD), two)
    second.finish({"rows_written": m})
    kept = manifest.load(manifest.sidecar(two))
    fits = manifest.check_upstream(one, kept["source"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        before = len(manifest.changed_inputs(kept))
        with open(one, "a") as f:
            f.write("x")
        after = len(manifest.changed_inputs(kept))
    facts = {
        "began": began, "rows": n, "values": m, "status": kept["status"], "chained": kept["source"]["statistics"]["rows_written"], "fits": fits, "changed_before": before, "changed_after": after,
        "least": kept["settings"]["least"], "versions": len(manifest.version_changes(kept)), "inputs": len(manifest.inputs_of([], kept)), "command": re.sub(r"\S*/", "", kept["command"]),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, value string")


def stream_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, counted in four batches; a large table is written as more files."""
    source, target = scratch(spark), scratch(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    n = max(1, -(-docs.rdd.getNumPartitions() // 4))
    docs.repartition(4 * n, "doc_id").write.parquet(source)
    stream = files.document_stream(spark, source, "parquet", files_per_trigger=n)
    files.count_verbs_into(stream, target, scratch(spark)).awaitTermination()
    return files.counts_so_far(spark, target)


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of conversations that a step with these tests leaves out, with the first reason, and how many it read."""
    rows = _conversations(spark, sf_dir)
    text = F.trim(F.coalesce("text", F.lit("")))
    found = letters.Checked(rows, {"blank": text == "", "no_word": ~text.rlike("[A-Za-z]"), "too_long": F.length("text") > 700})
    return found.dead.select("conv_id", "turn", "reason", F.lit(found.counts["rows_read"]).cast("long").alias("rows_read"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("lemma"))
    rows.repartition(3, "event_id").write.parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


def _all_of(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """What a stream has put out when its input is over. Batches are numbered, so that a batch that runs again replaces itself."""
    target = scratch(spark)
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/{'last' if mode == 'complete' else f'batch={number}'}")
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target + "/last" if mode == "complete" else target)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted in windows of an hour of event time."""
    out = _all_of(files.windowed_counts(_event_stream(spark, sf_dir), "ts", "1 hour", "60 days"), spark, "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start_at"), "lemma", "freq")


def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and kinds of events without repeats; the horizon spans the table."""
    return _all_of(files.unique_stream(_event_stream(spark, sf_dir), ["user_id", "lemma"], "ts", "60 days"), spark, "append").select("user_id", "lemma")


QUERIES = {
    f.__name__: f
    for f in (
        csv_rows, csv_single_column, csv_many_files, tsv_clauses, local_rows, word_list, file_chunks, text_lines, text_files, workbook_table, workbook_groups, members_by_group, wide_predictions, wide_round_trip,
        wide_means, fused_means, tag_matrix, tag_odd_flags, span_parse, ten_digit_cells, number_cells, sheet_cells, driver_values, spell_two_columns, tagger_of_workers, pipeline_verbs, masked_model, run_records,
        stream_verbs, stream_windows, stream_unique, dead_letters,
    )
}

# -- the same in SQL ------------------------------------------------------------------------------
_PART = """
w AS (SELECT *, string_split(p_name, ' ') AS ws, CASE WHEN p_size < 6 THEN ' ' ELSE p_type || ' ' END AS lemma FROM part),
t AS (SELECT *, ws[1] AS t1, ws[2] AS t2, p_retailprice / 7000 AS p1, CASE WHEN p_size % 5 <> 0 THEN p_size / 70 END AS p2 FROM w)"""
_TOOLS, _LOOKS = ("('" + "', '".join(x.strip().lower() for x in xs) + "')" for xs in _PART_GROUPS.values())
_PART_SUMS = (
    _PART + ",\ng AS (SELECT *, "
    + ", ".join(f"round(CASE WHEN t1 IN {xs} THEN p1 ELSE 0 END + CASE WHEN t2 IN {xs} THEN coalesce(p2, 0) ELSE 0 END, 9) AS {name}" for name, xs in (("tools", _TOOLS), ("looks", _LOOKS)))
    + " FROM t WHERE trim(lemma) <> '')"
)
#: The fused profile leaves the subword mark at the token, so first words are in no group.
_FUSED_SUMS = _PART + f", g AS (SELECT *, round(CASE WHEN t2 IN {_TOOLS} THEN coalesce(p2, 0) ELSE 0 END, 9) AS tools, round(CASE WHEN t2 IN {_LOOKS} THEN coalesce(p2, 0) ELSE 0 END, 9) AS looks FROM t WHERE trim(lemma) <> '')"
_FLAGS = """
m AS (
  SELECT p_partkey, CASE WHEN p_size = 3 THEN '' ELSE p_name || ' ' || p_partkey END AS lemma, p_size % 7 <> 0 AS counted,
    CASE WHEN p_type = 'ECONOMY' THEN '1' WHEN p_size = 20 THEN 'maybe' ELSE '0' END AS cheap, CASE WHEN p_size < 10 THEN '1' WHEN p_type = 'PROMO' THEN 'maybe' ELSE '0' END AS small FROM part)"""

ORACLE_SQL = {
    "csv_rows": "SELECT CAST(row_number() OVER (ORDER BY conv_id, turn, role, text NULLS FIRST) AS BIGINT) AS csv_row_number, coalesce(text, '') AS text, CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role FROM conversations",
    "csv_single_column": "SELECT role, count(*) AS freq FROM conversations GROUP BY role",
    "csv_many_files": "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, coalesce(text, '') AS text FROM conversations",
    "tsv_clauses": "SELECT role AS lemma, coalesce(text, '') AS sentence_text FROM conversations",
    "local_rows": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_size || '-' || (p_size + 2) AS size, count(*) OVER () AS rows FROM part",
    "word_list": "SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations)",
    "text_lines": "SELECT value, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n?|\\n')) AS value FROM conversations) GROUP BY value",
    "file_chunks": f"""WITH t AS (SELECT CAST(((coalesce(doc_id, 0) % 8) + 8) % 8 AS INT) AS part, string_agg(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') || chr(10), '' ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS text FROM documents GROUP BY 1),
k AS (SELECT part, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - {CHUNK}) / {CHUNK - CHUNK_OVERLAP}.0) AS BIGINT)) + 1)) * {CHUNK - CHUNK_OVERLAP} AS chunk_start FROM t),
c AS (SELECT part, chunk_start, substring(text, chunk_start + 1, {CHUNK}) AS x FROM k)
SELECT part, chunk_start, md5(x) AS chunk_md5, CAST(length(x) AS INT) AS chars FROM c""",
    "text_files": "SELECT n_regionkey AS region, string_agg(n_name || chr(10), '' ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey",
    "workbook_table": "SELECT p_partkey, p_name || '<&>' AS name, p_retailprice FROM part",
    "workbook_groups": "SELECT p_type AS \"group\", row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS place, p_brand AS lemma FROM (SELECT DISTINCT p_type, p_brand FROM part)",
    "members_by_group": "SELECT p_type AS \"group\", string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS lemmas FROM part GROUP BY p_type",
    "wide_predictions": f"WITH {_PART_SUMS} SELECT p_partkey, lemma, p_brand AS group_prob_tools, tools, looks FROM g",
    "wide_round_trip": f"WITH {_PART} SELECT p_partkey, 'Ġ' || upper(t1) AS token_1, p1 AS prob_1, t2 AS token_2, p2 AS prob_2, p_brand AS brand FROM t",
    "wide_means": f"WITH {_PART_SUMS} " + " UNION ALL ".join(f"SELECT trim(lemma) AS lemma, '{name}' AS \"group\", round(avg({x}), 6) AS mean, count(*) AS n, min(p_partkey) AS first_ord FROM g GROUP BY 1" for x, name in (("tools", "group_prob_tools_1"), ("looks", "group_prob_looks"))),
    "fused_means": f"WITH {_FUSED_SUMS}, a AS (SELECT trim(lemma) AS lemma, sum(CAST(tools > 0 AS INT) + CAST(looks > 0 AS INT)) AS active FROM g GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT a.lemma, '{x}' AS \"group\", round(avg({x}), 6) AS mean, count(*) AS n, CAST(any_value(active) AS BIGINT) AS active FROM g JOIN a ON trim(g.lemma) = a.lemma GROUP BY a.lemma" for x in ("tools", "looks")),
    "tag_matrix": f"""WITH {_FLAGS}, u AS (SELECT p_partkey, lemma, CASE WHEN cheap = '1' THEN 'cheap' ELSE 'small' END AS grp FROM m WHERE lemma <> '' AND counted AND (cheap = '1') <> (small = '1')),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY p_partkey) AS INT) AS rank FROM u)
SELECT rank, coalesce(max(CASE WHEN grp = 'cheap' THEN lemma END), '') AS cheap, coalesce(max(CASE WHEN grp = 'small' THEN lemma END), '') AS small FROM n GROUP BY rank""",
    "tag_odd_flags": f"WITH {_FLAGS} SELECT p_partkey, 'cheap' AS \"group\", cheap AS flag FROM m WHERE cheap = 'maybe' UNION ALL SELECT p_partkey, 'small', small FROM m WHERE small = 'maybe'",
    "span_parse": "SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN l_linenumber END AS start_at, CASE WHEN ok THEN CAST(trunc(l_quantity) AS INT) END AS end_at FROM (SELECT *, l_returnflag IN ('A', 'N') AND trunc(l_quantity) >= l_linenumber AS ok FROM lineitem)",
    "ten_digit_cells": "SELECT l_orderkey, l_linenumber, format('{:.10g}', l_extendedprice / 7) AS cell FROM lineitem",
    "number_cells": "SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN c_acctbal WHEN 3 THEN 1000.0 END AS value FROM customer",
    "sheet_cells": "SELECT conv_id, turn, md5(coalesce(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '')) AS cell FROM conversations",
    "driver_values": """WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, CAST(octet_length(encode(coalesce(text, ''))) * pow(1024, doc_id % 4) AS BIGINT) AS size, lang, source FROM documents)
SELECT doc_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:.1f} KB', size / 1024) WHEN size < 1073741824 THEN format('{:.1f} MB', size / 1048576) WHEN size < 1099511627776 THEN format('{:.1f} GB', size / 1073741824) ELSE format('{:.1f} TB', size / 1099511627776) END AS bytes,
  least(100.0, 100.0 * n / 2000) AS share, left('a_b_' || doc_id || repeat('x', 40), 31) AS title, array_to_string(list_filter(['w', lang, source], lambda x: x <> ''), ' ') AS words FROM d""",
    "spell_two_columns": """WITH c AS (SELECT conv_id || '/' || turn AS row, coalesce(text, '') AS text FROM conversations),
k AS (SELECT row, unnest(p) AS token, generate_subscripts(p, 1) AS ofs FROM (SELECT row, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS p FROM c)),
x AS (SELECT *, regexp_replace(regexp_replace(token, '^[.,!?;:"''()\\[\\]{}]+', ''), '[.,!?;:"''()\\[\\]{}]+$', '') AS core FROM k),
f AS (SELECT row, string_agg(CASE WHEN lower(core) = 'of' THEN replace(token, core, 'OF') ELSE token END, ' ' ORDER BY ofs) AS fixed FROM x GROUP BY row)
SELECT text, coalesce(fixed, '') AS text_corrected FROM c LEFT JOIN f ON c.row = f.row""",
    "masked_model": r"""WITH c AS (SELECT conv_id, turn, turn % 5 = 4 AS lost, len(list_filter(regexp_split_to_array(CASE WHEN turn % 5 = 4 THEN text ELSE regexp_replace(text, '^[A-Za-z]*', '<mask>') END, '\s+'), lambda x: x <> '')) AS n FROM conversations WHERE text IS NOT NULL),
v AS (SELECT *, unnest(range(7)) AS j FROM c),
z AS (SELECT *, exp(-CAST((((n - j) % 7) + 7) % 7 AS DOUBLE)) AS e FROM v),
r AS (SELECT *, e / sum(e) OVER (PARTITION BY conv_id, turn) AS p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY e DESC, j) AS rank FROM z)
SELECT conv_id, turn, CAST(rank AS INT) AS rank, CASE WHEN lost THEN '' ELSE 't' || j END AS token, CASE WHEN lost THEN 0.0 ELSE round(p, 9) END AS prob FROM r WHERE rank <= 2""",
    "run_records": "WITH c AS (SELECT CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT role) AS VARCHAR) AS roles FROM conversations) "
    + " UNION ALL ".join(f"SELECT '{k}' AS fact, {v} AS value FROM c" for k, v in {"began": "'incomplete'", "rows": "n", "values": "roles", "status": "'complete'", "chained": "n", "fits": "'True'", "changed_before": "'0'", "changed_after": "'1'", "least": "'0'", "versions": "'0'", "inputs": "'1'", "command": "'python -m verbatlas.cli count rows.csv --output counts.csv --least 0'"}.items()),
    "dead_letters": "SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no_word' ELSE 'too_long' END AS reason, (SELECT count(*) FROM conversations) AS rows_read FROM conversations WHERE trim(coalesce(text, '')) = '' OR NOT regexp_matches(text, '[A-Za-z]') OR length(text) > 700",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start_at, event_type AS lemma, count(*) AS freq FROM events GROUP BY ALL",
    "stream_unique": "SELECT DISTINCT user_id, event_type AS lemma FROM events",
}
