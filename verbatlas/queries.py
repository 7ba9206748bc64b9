"""Registered queries over the given tables, and the SQL that gives the same rows.

Every query runs over whole tables and whole texts. The language side is rule-based (see
functions.providers), so that both sides can say what a word, a verb and a lemma is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas import stream_queries, table_queries
from verbatlas.functions.providers import AUXILIARIES, RuleLemmatizer, RuleTagger, TextCountLM, wanted_verbs
from verbatlas.functions.text import masked
from verbatlas.operators import extract, frequency, groups, spelling, textgroups
from verbatlas.session import scratch, spread, stash, table
from verbatlas.sources import grouptables, sinks

SIZE, OVERLAP = 1_000, 100
TOP = 5
#: Groups of the queries; `er` and `th` are in two groups.
GROUPS = {
    "being": ["be", "have", "is"],
    "doing": ["do", "will", "can", "er"],
    "endings": ["er", "on", "re", "th", "an"],
    "others": ["th", "in", "at", "or", "en", "nt", "st"],
}
#: The same for the fused profile: keys are words as they stand.
FUSED_GROUPS = {"being": ["be", "is", "are", "was"], "of": ["of", "in", "on", "by"], "small": ["a", "to", "in"]}
LOOKED_UP = [" Be ", "have", "er", "missing"]
THRESHOLD = 0.5
WHERE = '{{ role }} in ["user", "system"] and not {{ nothing }} and {{ text }} != ""'


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of whole documents."""
    return extract.sentences(_docs(spark, sf_dir).withColumn("chunk_start", F.lit(0).cast("long")), "text").drop("chunk_start")


def _verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.verbs(_sentences(spark, sf_dir))


def verb_lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.verb_counts(_docs(spark, sf_dir), "lemma")


def verb_surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.verb_counts(_docs(spark, sf_dir), "surface_lower")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.sentences(extract.char_chunks(_docs(spark, sf_dir), "text", SIZE, OVERLAP))
    return extract.unique_sentences(found, ["doc_id"])


def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.char_chunks(_docs(spark, sf_dir), "text", SIZE, OVERLAP)


def sentence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("doc_id", "chunk_start", "sent_start", "sent_index", "sentence")


def verb_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "chunk_start", "sent_start", "sent_index", "token_index", "lemma", "surface_lower", F.col("span_text").alias("span"), "sentence"]
    return extract.verbs(_chunked(spark, sf_dir)).select(*cols)


def verb_occurrences_no_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.verbs(_sentences(spark, sf_dir), include_aux=False).groupBy("doc_id").agg(F.count("*").alias("verbs"))


def row_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs of a table's text column: rows of conversations."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row"), "role", "text")
    return extract.verbs_of_rows(rows, "row", "text").select("row", "role", "sent_index", "token_index", "lemma", F.col("span_text").alias("span"))


def freq_filter_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return frequency.filter_by_count(rows, "l_partkey", least=30)


def freq_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return frequency.filter_by_count(rows, "l_partkey", least=20, most=28)


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.distinct_values(table(spark, sf_dir, "lineitem"), "l_partkey")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.counts(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")


def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), 100, "doc_id", seed=7)


def mask_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verbs(spark, sf_dir)
    return rows.select("doc_id", "sent_start", "token_index", masked("sentence", "span.start", "span.end").alias("masked_text"))


def _predicted(spark: SparkSession, sf_dir: str, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, sent_start, token_index, lemma, preds (or what is derived of them) of each verb of the documents."""
    docs = _docs(spark, sf_dir)
    return TextCountLM(docs).predict_own(extract.verbs_in_context(docs, ["doc_id"]), TOP, wanted_verbs(), derive).drop("left", "right")


def masked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir).select("doc_id", "sent_start", "token_index", F.posexplode("preds").alias("at", "p"))
    return rows.select("doc_id", "sent_start", "token_index", (F.col("at") + 1).alias("rank"), F.col("p.token").alias("token"), F.round("p.prob", 9).alias("prob"))


def groups_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ragged group table of parts, with a blank label in the middle, written as a file and read in both profiles."""
    part = table(spark, sf_dir, "part")
    some = lambda test, x: F.when(F.expr(test), x).otherwise("")
    cells = part.select(
        some("p_size % 2 = 0", F.col("p_brand")).alias("a"), some("p_size % 3 = 0", F.concat(F.lit(" "), "p_type")).alias(" "),
        some("p_size % 5 = 0", F.concat_ws(", ", "p_brand", "p_type")).alias("b "), some("p_size > 45", F.col("p_name")).alias("c"),
    )
    path = scratch(spark)
    sinks.write_delimited(cells, path)
    std = grouptables.read(spark, path).withColumn("profile", F.lit("standard"))
    return std.union(grouptables.read(spark, path, "fused").withColumn("profile", F.lit("fused")))


def tag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag matrix of customers with odd frequencies and flags, and a column that is skipped."""
    rows = table(spark, sf_dir, "customer")
    flag = lambda test: F.when(F.expr(test), "1").otherwise("")
    matrix = rows.select(
        F.col("c_custkey").alias("row_ord"), F.when(F.expr("c_nationkey = 7"), "").otherwise(F.col("c_name")).alias("Lemma"), F.when(F.expr("c_nationkey = 8"), "x").otherwise(F.col("c_custkey").cast("string")).alias("Freq"),
        flag("c_nationkey % 2 = 0").alias("g1"), flag("c_nationkey % 3 = 0").alias("g2"), F.when(F.expr("c_nationkey % 5 = 0"), "#N/A").otherwise("1").alias("skipme"),
    )
    return grouptables.tags_to_columns(grouptables.tags_long(matrix, ["skipme"]), ["g1", "g2"])


def _group_names() -> list[str]:
    return [f"group_prob_{g}" for g in GROUPS]


def _grouped(spark: SparkSession, sf_dir: str, table_: DataFrame, profile: str = "standard", **options) -> DataFrame:
    """Verbs of the documents with the probabilities of groups, which are summed once for each context."""

    def derive(lists: DataFrame) -> DataFrame:
        return groups.row_probabilities(lists, table_, profile, lemma_col=None, **options).drop("preds")

    return _predicted(spark, sf_dir, derive).where(groups.row_lemma("lemma", profile) != "")


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, grouptables.from_columns(spark, GROUPS))


def _rounded(names: list[str]) -> list:
    return [F.round(f"`{c}`", 9).alias(c) for c in names]


def group_prob_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).select("doc_id", "sent_start", "token_index", "lemma", *_rounded(_group_names()))


def _ordered(df: DataFrame) -> DataFrame:
    """row_ord, in the order of document, sentence and token."""
    return df.withColumn("row_ord", F.struct("doc_id", "sent_start", "token_index"))


def group_prob_short_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered(_probabilities(spark, sf_dir))
    return groups.short_form(rows, _group_names(), "row_ord").select("row_ord.*", "lemma", "lemma_count", *_rounded(_group_names()))


def group_prob_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir, grouptables.from_columns(spark, FUSED_GROUPS), "fused", count_active=True)
    return rows.select("doc_id", "sent_start", "token_index", *_rounded(list(FUSED_GROUPS)), "group_count")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the verbs of the documents, from counts of verbs in their contexts; first_ord says nothing."""
    own = TextCountLM(_docs(spark, sf_dir)).own_contexts(TOP, wanted_verbs(), RuleTagger.is_verb_column)
    rows = groups.row_probabilities(own.withColumn("lemma", RuleLemmatizer().lemma(F.col("word"))), grouptables.from_columns(spark, GROUPS))
    means = groups.lemma_means(rows.select("lemma", "c", *_rounded(_group_names())), _group_names(), times_col="c")
    return means.withColumn("mean", F.round("mean", 6))


def _means_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_means with the lemma's first place as first_ord."""
    verbs = extract.verbs_in_context(_docs(spark, sf_dir), ["doc_id"])
    first = _ordered(verbs).groupBy("lemma").agg(F.min("row_ord").alias("first_ord"))
    return _means(spark, sf_dir).drop("first_ord").join(first, "lemma")


def lemma_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("lemma", "group", "mean", "n")


def lemma_best_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.best_groups(_means(spark, sf_dir), THRESHOLD).select("lemma", "best", "mean", "second", "n")


def lemma_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.best_groups(_means(spark, sf_dir), THRESHOLD).where("is_ambiguous").select("lemma", "best")


def groups_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.groups_ranked(_means_in_order(spark, sf_dir), THRESHOLD).select("group", "rank", "lemma", "mean", "is_ambiguous")


def groups_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _group_names()
    rows = groups.groups_ranked(_means_in_order(spark, sf_dir), THRESHOLD)
    return groups.ragged(rows, names, "group", "lemma", "rank")


def text_verb_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return textgroups.verb_group_counts(rows, grouptables.from_columns(spark, GROUPS)).drop("text")


def where_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return textgroups.verb_group_counts(rows, grouptables.from_columns(spark, GROUPS), where=WHERE).drop("text")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgroups.run_statistics(text_verb_group_counts(spark, sf_dir))


def lemma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    lemmas = [x.strip().lower() for x in LOOKED_UP]  # others are left out before the prediction, as they are not shown
    rows = TextCountLM(docs).predict_own(extract.verbs_in_context(docs, ["doc_id"], lemmas=lemmas), TOP, wanted_verbs(lemmas))
    hits = textgroups.lookup(_ordered(rows), LOOKED_UP, "row_ord", top_k=2)
    return hits.select("row_ord.*", "lemma", "sentence", F.concat_ws(" ", F.transform("preds", lambda p: p["token"])).alias("tokens"))


def lookup_by_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = textgroups.lookup(_ordered(_verbs(spark, sf_dir)), LOOKED_UP, "row_ord", in_order=False)
    return textgroups.first_by_lemma(hits, "row_ord")


def lookup_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the lemmas looked up, numbered within its lemma."""
    hits = textgroups.lookup(_ordered(_verbs(spark, sf_dir)), LOOKED_UP, "row_ord", in_order=False)
    return textgroups.ranked_hits(hits, "row_ord")


def lookup_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 hits in input order."""
    return textgroups.lookup(_ordered(_verbs(spark, sf_dir)), LOOKED_UP, "row_ord", limit=50).select("row_ord.*", "lemma", "sentence")


def verb_rows_no_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.verbs(_sentences(spark, sf_dir), include_aux=False).select("doc_id", "sent_start", "token_index", "lemma", F.col("span_text").alias("span"))


def bounded_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences without repeats as a memory of one sentence sees them."""
    found = extract.sentences(extract.char_chunks(_docs(spark, sf_dir), "text", SIZE, OVERLAP))
    return extract.bounded_unique_sentences(found, ["doc_id"], 1)


def masked_back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs of the conversations predicted from the documents: contexts that no document has fall back to the word on the left, then to all words."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row"), "role", "text")
    verbs = extract.with_context(extract.verbs_of_rows(rows, "row", "text"), sentence_col="sentence")
    out = TextCountLM(_docs(spark, sf_dir)).predict(verbs, TOP)
    out = out.select("row", "sent_index", "token_index", F.posexplode("preds").alias("at", "p"))
    return out.select("row", "sent_index", "token_index", (F.col("at") + 1).alias("rank"), F.col("p.token").alias("token"), F.round("p.prob", 9).alias("prob"))


def _many_groups(spark: SparkSession) -> DataFrame:
    """All strings of two and three letters in two groups: more rows than are written into a plan."""
    letter = lambda x: F.char(F.lit(97) + x % 26)
    n = F.col("id")
    m = n - 676
    two, three = F.concat(letter(n), letter(F.floor(n / 26))), F.concat(letter(m), letter(F.floor(m / 26)), letter(F.floor(m / 676)))
    rows = spark.range(676 + 17_576).select(F.when(n < 676, two).otherwise(three).alias("lemma"))
    late = F.col("lemma") >= "n"
    return rows.select("lemma", F.when(late, "n_z").otherwise("a_m").alias("group"), late.cast("int").alias("group_pos"))


def verb_group_counts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return textgroups.verb_group_counts(rows, _many_groups(spark)).drop("text")


def group_prob_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir, _many_groups(spark))
    return rows.select("doc_id", "sent_start", "token_index", "lemma", *_rounded(["group_prob_a_m", "group_prob_n_z"]))


def inflection_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = _verbs(spark, sf_dir)
    clauses = verbs.select("doc_id", "sent_start", "lemma", F.col("sentence").alias("sentence_text")).distinct()
    lemmas = textgroups.qualifying_lemmas(frequency.counts(verbs.select("lemma"), "lemma"), 10)
    return textgroups.inflection_matches(clauses, lemmas).select("doc_id", "sent_start", "lemma", "inflected_form")


def context_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.context_patterns(_verbs(spark, sf_dir), 1)


def _known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents: the list that the spelling queries hold right."""
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def spell_unknown(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Words of the conversations that no document has."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row"), "text")
    tokens = spelling.checked_tokens(rows, "row", "text").where("word rlike '^[a-z]+$'")
    return spelling.unknown_words(tokens, _known_words(spark, sf_dir) if known is None else known)


_FIXES = [("the", "THE", "replace"), ("thea", "these", "replace"), ("and", "", "ignore"), ("reth", "", "add")]


def spell_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row"), "text")
    fixes = spark.createDataFrame(_FIXES, "word string, replacement string, action string")
    known = _known_words(spark, sf_dir).where("word not in ('the', 'thea')").select("word")
    out, _, _ = spelling.apply_decisions(rows, "row", "text", fixes, known)
    return out


def _answers(tokens: DataFrame) -> DataFrame:
    """Decisions as someone who is asked for unknown words one by one may give them: by how often a word has come and its length."""
    asked = tokens.withColumn("n", F.row_number().over(W.partitionBy("word").orderBy("row", "at"))).where("n <= 4")
    at_second = F.when(F.length("word") % 3 == 0, "ignore_all").when(F.length("word") % 3 == 1, "add").otherwise("replace_all")
    action = F.when(F.col("n") == 1, F.when(F.length("word") % 2 == 0, "replace")).when(F.col("n") == 2, at_second).when(F.col("n") == 3, "replace_all").otherwise("ignore_once")
    out = asked.select("row", "at", "word", action.alias("action"), F.when(F.col("n") == 1, F.upper("word")).otherwise(F.concat("word", F.col("n").cast("string"))).alias("replacement"))
    return out.where("action is not null")


def spell_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations corrected by decisions that each hold from their place on."""
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("row"), "text")
    known = stash(_known_words(spark, sf_dir))
    tokens = spelling.checked_tokens(rows, "row", "text").where("word rlike '^[a-z]+$'")
    unknown = tokens.join(spelling.unknown_words(tokens, known), "word")
    out = spelling.corrected_in_order(rows, "row", "text", _answers(unknown), known)
    return out.withColumn("row", F.concat_ws("/", "row.conv_id", "row.turn"))


def spell_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(w,) for w in ("thng", "iss", "wass", "blee", "zzzzzz")], "word string")
    return spelling.suggestions(rows, _known_words(spark, sf_dir), most_edits=1, n=3).select("word", F.concat_ws(" ", "suggestions").alias("suggestions"))


def _spell_nearest(spark: SparkSession, sf_dir: str, known: DataFrame) -> DataFrame:
    """The suggestions for every unknown word of the conversations."""
    return spelling.suggestions(spell_unknown(spark, sf_dir, known), known)


def spell_suggestions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unknown word of the conversations that has known words near, with the nearest of them."""
    return _spell_nearest(spark, sf_dir, stash(_known_words(spark, sf_dir))).select("word", F.concat_ws(" ", "suggestions").alias("suggestions"))


def spell_auto_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with every unknown word replaced by its first suggestion."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row"), "text")
    known = stash(_known_words(spark, sf_dir))
    first = stash(_spell_nearest(spark, sf_dir, known)).select("word", F.get("suggestions", F.lit(0)).alias("replacement"))
    return spelling.corrected(rows, "row", "text", first, known.select("word"))


QUERIES = {
    f.__name__: f
    for f in (
        verb_lemma_counts, verb_surface_counts, char_chunks, sentence_dedupe, verb_occurrences, verb_occurrences_no_aux, row_verbs, freq_filter_min, freq_filter_range,
        distinct_values, value_counts, sample_exact_n, mask_sentences, masked_topk, groups_long, tag_pivot, group_prob_rows, group_prob_short_running,
        group_prob_fused, lemma_group_means, lemma_best_group, lemma_ambiguous, groups_ranked, groups_ragged, text_verb_group_counts, where_filtered_counts,
        lookup_sentences, lookup_limited, verb_rows_no_aux, bounded_dedupe, masked_back_off, verb_group_counts_joined, group_prob_joined,
        run_stats, lemma_lookup, lookup_by_lemma, inflection_match, context_patterns, spell_unknown, spell_auto, spell_suggestions, spell_in_order, spell_suggestions_all, spell_auto_all,
    )
}
QUERIES |= table_queries.QUERIES | stream_queries.QUERIES
#: Queries that tests also hold against brute force.
WITHOUT_SQL = {f.__name__: f for f in (spell_suggestions_all, spell_auto_all)}

# -- the same in SQL ------------------------------------------------------------------------------
_AUX_CASE = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AUXILIARIES.items()) + " END"
_AUX_LIST = ", ".join(f"'{k}'" for k in AUXILIARIES)


def _lemma_sql(w: str = "w") -> str:
    case = _AUX_CASE.replace("CASE w", f"CASE {w}")
    return f"coalesce({case}, CASE WHEN {w} LIKE '%ing' AND length({w}) >= 5 THEN left({w}, length({w}) - 3) WHEN {w} LIKE '%ed' AND length({w}) >= 4 THEN left({w}, length({w}) - 2) ELSE {w} END)"


def _sentence_sql(source: str, keys: str, text: str, out: str) -> str:
    """CTEs that cut `text` of `source` into sentences with their starts, and these into words with spans."""
    return f"""
{out}_p AS (SELECT {keys}, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT {keys}, regexp_extract_all({text}, '[^.!?]*[.!?]+|[^.!?]+') AS p FROM {source})),
{out}_o AS (SELECT {keys}, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM {out}_p),
{out} AS (
  SELECT {keys}, CAST(ofs + length(piece) - length(regexp_replace(piece, '^[\\s\\p{{Z}}]+', '')) AS BIGINT) AS rel, regexp_replace(regexp_replace(piece, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') AS sentence
  FROM {out}_o WHERE regexp_replace(piece, '[\\s\\p{{Z}}]+', '', 'g') <> '')"""


def _word_sql(source: str, keys: str, out: str) -> str:
    """CTE `out`: keys, i (from 0), start, surface w of each word of `sentence`."""
    return f"""
{out}_p AS (SELECT {keys}, sentence, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT {keys}, sentence, regexp_extract_all(sentence, '[A-Za-z]+|[^A-Za-z]+') AS p FROM {source})),
{out}_o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY {keys}, sentence ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {out}_p),
{out} AS (SELECT {keys}, sentence, CAST(row_number() OVER (PARTITION BY {keys}, sentence ORDER BY k) - 1 AS INT) AS i, CAST(start AS INT) AS start, lower(piece) AS w FROM {out}_o WHERE regexp_matches(piece, '^[A-Za-z]'))"""


_IS_AUX = f"w IN ({_AUX_LIST})"
_IS_VERB = f"({_IS_AUX} OR (length(w) >= 4 AND (w LIKE '%ed' OR w LIKE '%ing')))"
_DOC_SENTENCES = "d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM documents)," + _sentence_sql("(SELECT doc_id, coalesce(text, '') AS text FROM documents)", "doc_id", "text", "s0") + ", s AS (SELECT doc_id, rel AS sent_start, sentence FROM s0)"
_DOC_WORDS = _DOC_SENTENCES + "," + _word_sql("s", "doc_id, sent_start", "t")
_DOC_VERBS = _DOC_WORDS + f", v AS (SELECT *, {_lemma_sql()} AS lemma FROM t WHERE {_IS_VERB})"
_CHUNKS = f"""
d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM documents),
c AS (
  SELECT doc_id, k * {SIZE - OVERLAP} AS chunk_start, substring(text, CAST(k * {SIZE - OVERLAP} + 1 AS BIGINT), {SIZE}) AS chunk_text
  FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - {SIZE}) / {SIZE - OVERLAP}.0) AS BIGINT)) + 1)) AS k FROM d WHERE length(text) > 0))"""
_UNIQUE = (
    _CHUNKS + "," + _sentence_sql("c", "doc_id, chunk_start", "chunk_text", "s0")
    + """, f AS (SELECT doc_id, CAST(chunk_start + rel AS BIGINT) AS sent_start, sentence, min(chunk_start) AS chunk_start FROM s0 GROUP BY ALL),
s AS (SELECT doc_id, chunk_start, sent_start, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_start, sent_start, sentence) - 1 AS BIGINT) AS sent_index, sentence FROM f)"""
)
_LM = (
    _DOC_VERBS
    + f""", n AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id, sent_start ORDER BY i), '') AS l, coalesce(lead(w) OVER (PARTITION BY doc_id, sent_start ORDER BY i), '') AS r FROM t),
cnt AS (SELECT l, r, w AS token, count(*) AS c FROM n GROUP BY ALL),
top AS (SELECT l, r, token, c, row_number() OVER (PARTITION BY l, r ORDER BY c DESC, token) AS rank, sum(c) OVER (PARTITION BY l, r) AS total FROM cnt),
p AS (
  SELECT n.doc_id, n.sent_start, n.sentence, n.i AS token_index, {_lemma_sql('n.w')} AS lemma, CAST(top.rank AS INT) AS rank, top.token, top.c / top.total AS prob
  FROM n JOIN top ON n.l = top.l AND n.r = top.r WHERE top.rank <= {TOP} AND {_IS_VERB.replace('w IN', 'n.w IN').replace('length(w)', 'length(n.w)').replace('(w LIKE', '(n.w LIKE').replace('OR w LIKE', 'OR n.w LIKE')})"""
)


def _values(table_: dict[str, list[str]]) -> str:
    return ", ".join(f"('{x}', '{g}')" for g, xs in table_.items() for x in xs)


_KEYS = "doc_id, sent_start, token_index"
_GROUPED = (
    _LM
    + f""", g AS (SELECT DISTINCT {_lemma_sql('x')} AS k, grp FROM (VALUES {_values(GROUPS)}) AS q(x, grp)),
h AS (SELECT {_KEYS}, lemma, token, prob, {_lemma_sql('token')} AS k FROM p),
gp AS (
  SELECT {_KEYS}, lemma, {', '.join(f"round(coalesce(sum(CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.k = h.k AND g.grp = '{x}') THEN prob END), 0), 9) AS group_prob_{x}" for x in GROUPS)}
  FROM h GROUP BY {_KEYS}, lemma),
ord AS (SELECT *, {{'d': doc_id, 's': sent_start, 't': token_index}} AS row_ord FROM gp)"""
)
_MEANS = (
    _GROUPED
    + f""", lm AS (SELECT lemma, count(*) AS n, min(row_ord) AS first_ord, {', '.join(f'sum(group_prob_{x}) AS s{k}' for k, x in enumerate(GROUPS))} FROM ord GROUP BY lemma),
m AS ({' UNION ALL '.join(f"SELECT lemma, 'group_prob_{x}' AS grp, {k} AS pos, round(s{k} / n, 6) AS mean, n, first_ord FROM lm" for k, x in enumerate(GROUPS))}),
b AS (
  SELECT lemma, max(n) AS n, min(first_ord) AS first_ord, arg_min(grp, (-mean, pos)) AS best, max(mean) AS mean, (list(mean ORDER BY mean DESC))[2] AS second FROM m GROUP BY lemma),
r AS (
  SELECT best AS grp, CAST(row_number() OVER (PARTITION BY best ORDER BY mean DESC, first_ord, lemma) AS INT) AS rank, lemma, mean, mean > 0 AND second >= {THRESHOLD} * mean AS is_ambiguous FROM b)"""
)
_CONV_COUNTS = (
    "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS sentence FROM conversations)," + _word_sql("(SELECT DISTINCT * FROM c)", "conv_id, turn, role", "t")
    + f""", v AS (SELECT *, {_lemma_sql()} AS k FROM t WHERE {_IS_VERB}),
g AS (SELECT DISTINCT {_lemma_sql('x')} AS k, grp FROM (VALUES {_values(GROUPS)}) AS q(x, grp)),
vg AS (SELECT conv_id, turn, role, sentence, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE EXISTS (SELECT 1 FROM g WHERE g.k = v.k AND g.grp = '{x}')) AS n_{x}" for x in GROUPS)} FROM v GROUP BY ALL),
counted AS (
  SELECT c.conv_id, c.turn, c.role, c.sentence AS text, coalesce(total, 0) AS total_verb_count, {', '.join(f'coalesce(n_{x}, 0) AS group_count_{x}' for x in GROUPS)}
  FROM c LEFT JOIN vg ON c.conv_id = vg.conv_id AND c.turn = vg.turn AND c.role = vg.role AND c.sentence = vg.sentence)"""
)
_NAMES = ", ".join(f"group_prob_{x}" for x in GROUPS)
_FUSED = (
    _LM
    + f""", g AS (SELECT DISTINCT x AS k, grp FROM (VALUES {_values(FUSED_GROUPS)}) AS q(x, grp)),
h AS (SELECT {_KEYS}, prob, token AS k FROM p),
gp AS (SELECT {_KEYS}, {', '.join(f"round(coalesce(sum(CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.k = h.k AND g.grp = '{x}') THEN prob END), 0), 9) AS {x}" for x in FUSED_GROUPS)} FROM h GROUP BY {_KEYS})"""
)
_FREQ = "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE n "
_TOKENS = """
c AS (SELECT conv_id || '/' || turn AS row, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS text FROM conversations),
k AS (SELECT row, unnest(p) AS token, generate_subscripts(p, 1) AS ofs FROM (SELECT row, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS p FROM c)),
x AS (SELECT *, regexp_replace(regexp_replace(token, '^[.,!?;:"''()\\[\\]{}]+', ''), '[.,!?;:"''()\\[\\]{}]+$', '') AS core FROM k),
known AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1)"""
#: Regular forms by the rules of the built-in inflector, for lemmas that end in no `e` or `y`, or in them.
_FORMS = """
f0 AS (
  SELECT lemma AS w, regexp_matches(lemma, '^[^aeiou]*[aeiou][bdgklmnprt]$') AS dbl, lemma LIKE '%e' AND NOT lemma LIKE '%ee' AS fe, regexp_matches(lemma, '[^aeiou]y$') AS y FROM q),
f1 AS (SELECT *, CASE WHEN dbl THEN w || right(w, 1) WHEN fe THEN left(w, length(w) - 1) ELSE w END AS stem FROM f0),
f2 AS (
  SELECT w, list_distinct([w, CASE WHEN y THEN left(w, length(w) - 1) || 'ies' WHEN regexp_matches(w, '(s|x|z|ch|sh|o)$') THEN w || 'es' ELSE w || 's' END, stem || 'ing', CASE WHEN y THEN left(w, length(w) - 1) || 'ied' ELSE stem || 'ed' END]) AS forms FROM f1)"""

ORACLE_SQL = {
    "verb_lemma_counts": f"WITH {_DOC_VERBS} SELECT lemma, count(*) AS freq FROM v GROUP BY lemma",
    "verb_surface_counts": f"WITH {_DOC_VERBS} SELECT w AS surface_lower, count(*) AS freq FROM v GROUP BY w",
    "char_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_start, chunk_text FROM c",
    "sentence_dedupe": f"WITH {_UNIQUE} SELECT * FROM s",
    "verb_occurrences": f"WITH {_UNIQUE}," + _word_sql("s", "doc_id, chunk_start, sent_start, sent_index", "t")
    + f" SELECT doc_id, chunk_start, sent_start, sent_index, i AS token_index, {_lemma_sql()} AS lemma, w AS surface_lower, start || '-' || (start + length(w)) AS span, sentence FROM t WHERE {_IS_VERB}",
    "verb_occurrences_no_aux": f"WITH {_DOC_VERBS} SELECT doc_id, count(*) AS verbs FROM v WHERE NOT {_IS_AUX} GROUP BY doc_id",
    "row_verbs": "WITH c AS (SELECT conv_id || '/' || turn AS row, role, text FROM conversations WHERE trim(text) <> '')," + _sentence_sql("c", "row, role", "text", "s0")
    + ", f AS (SELECT row, role, sentence, min(rel) AS ofs FROM s0 GROUP BY ALL), s AS (SELECT row, role, sentence, CAST(row_number() OVER (PARTITION BY row ORDER BY ofs) - 1 AS BIGINT) AS sent_index FROM f),"
    + _word_sql("s", "row, role, sent_index", "t") + f" SELECT row, role, sent_index, i AS token_index, {_lemma_sql()} AS lemma, start || '-' || (start + length(w)) AS span FROM t WHERE {_IS_VERB}",
    "freq_filter_min": _FREQ + ">= 30",
    "freq_filter_range": _FREQ + "BETWEEN 20 AND 28",
    "distinct_values": "SELECT count(DISTINCT l_partkey) AS unique_values, count(*) AS rows FROM lineitem",
    "value_counts": "SELECT event_type, count(*) AS freq FROM events GROUP BY event_type",
    "sample_exact_n": "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100",
    "mask_sentences": f"WITH {_DOC_VERBS} SELECT doc_id, sent_start, i AS token_index, ' ' || regexp_replace(regexp_replace(left(sentence, start) || '<mask>' || substring(sentence, start + length(w) + 1), '^\\s+', ''), '\\s+$', '') AS masked_text FROM v",
    "masked_topk": f"WITH {_LM} SELECT {_KEYS}, rank, token, round(prob, 9) AS prob FROM p",
    "groups_long": """WITH c AS (
  SELECT CASE WHEN p_size % 2 = 0 THEN p_brand END AS c0, CASE WHEN p_size % 3 = 0 THEN p_type END AS c1, CASE WHEN p_size % 5 = 0 THEN p_brand || ', ' || p_type END AS c2, CASE WHEN p_size > 45 THEN p_name END AS c3 FROM part),
l AS (SELECT c0 AS x, 0 AS k FROM c UNION ALL SELECT c1, 1 FROM c UNION ALL SELECT c2, 2 FROM c UNION ALL SELECT c3, 3 FROM c)
SELECT DISTINCT trim(x) AS lemma, ['a', 'b', 'c'][k + 1] AS "group", k AS group_pos, 'standard' AS profile FROM l WHERE trim(x) <> '' AND k < 3
UNION ALL SELECT DISTINCT trim(y), ['a', ' ', 'b ', 'c'][k + 1], k, 'fused' FROM (SELECT unnest(string_split(x, ',')) AS y, k FROM l) WHERE trim(y) <> ''""",
    "tag_pivot": """WITH u AS (SELECT c_custkey AS ord, c_name AS lemma, CASE WHEN c_nationkey % 2 = 0 THEN 'g1' ELSE 'g2' END AS grp FROM customer WHERE c_nationkey NOT IN (7, 8) AND (c_nationkey % 2 = 0) <> (c_nationkey % 3 = 0)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY ord) AS INT) AS rank FROM u)
SELECT rank, coalesce(max(CASE WHEN grp = 'g1' THEN lemma END), '') AS g1, coalesce(max(CASE WHEN grp = 'g2' THEN lemma END), '') AS g2 FROM n GROUP BY rank""",
    "group_prob_rows": f"WITH {_GROUPED} SELECT {_KEYS}, lemma, {_NAMES} FROM ord",
    "group_prob_short_running": f"WITH {_GROUPED} SELECT doc_id, sent_start, token_index, lemma, CAST(row_number() OVER (PARTITION BY lemma ORDER BY row_ord) AS BIGINT) AS lemma_count, {_NAMES} FROM ord",
    "group_prob_fused": f"WITH {_FUSED} SELECT {_KEYS}, {', '.join(FUSED_GROUPS)}, CAST({' + '.join(f'CAST({x} > 0 AS INT)' for x in FUSED_GROUPS)} AS INT) AS group_count FROM gp",
    "lemma_group_means": f"WITH {_MEANS} SELECT lemma, grp AS \"group\", mean, n FROM m",
    "lemma_best_group": f"WITH {_MEANS} SELECT lemma, best, mean, second, n FROM b",
    "lemma_ambiguous": f"WITH {_MEANS} SELECT lemma, best FROM b WHERE mean > 0 AND second >= {THRESHOLD} * mean",
    "groups_ranked": f"WITH {_MEANS} SELECT grp AS \"group\", rank, lemma, mean, is_ambiguous FROM r",
    "groups_ragged": f"WITH {_MEANS} SELECT rank, {', '.join(f'''coalesce(max(CASE WHEN grp = 'group_prob_{x}' THEN lemma END), '') AS group_prob_{x}''' for x in GROUPS)} FROM r GROUP BY rank",
    "text_verb_group_counts": f"WITH {_CONV_COUNTS} SELECT * EXCLUDE (text) FROM counted",
    "where_filtered_counts": f"WITH {_CONV_COUNTS} SELECT * EXCLUDE (text) FROM counted WHERE role IN ('user', 'system') AND text <> ''",
    "run_stats": f"WITH {_CONV_COUNTS}, z AS (SELECT *, {' + '.join(f'group_count_{x}' for x in GROUPS)} AS hits FROM counted) SELECT count(*) AS rows_written, CAST(count(*) FILTER (WHERE total_verb_count > 0) AS BIGINT) AS rows_with_verbs, CAST(count(*) FILTER (WHERE hits > 0) AS BIGINT) AS rows_with_hits, CAST(sum(total_verb_count) AS BIGINT) AS verbs, CAST(sum(hits) AS BIGINT) AS group_verbs FROM z",
    "lemma_lookup": f"WITH {_LM} SELECT doc_id, sent_start, token_index, lemma, sentence, string_agg(token, ' ' ORDER BY rank) AS tokens FROM p WHERE lemma IN ('be', 'have', 'er', 'missing') AND rank <= 2 GROUP BY ALL",
    "lookup_by_lemma": f"WITH {_DOC_VERBS} SELECT upper(lemma) AS lemma, count(*) AS n, arg_min(sentence, doc_id * 1000000000 + sent_start * 1000 + i) AS first_sentence FROM v WHERE lemma IN ('be', 'have', 'er', 'missing') GROUP BY 1",
    "inflection_match": f"WITH {_DOC_VERBS}, q AS (SELECT lemma FROM v WHERE lemma <> 'be' GROUP BY lemma HAVING count(*) >= 10)," + _FORMS + """,
cl AS (SELECT DISTINCT doc_id, sent_start, lemma, sentence FROM v WHERE lemma IN (SELECT lemma FROM q)),
hit AS (SELECT cl.doc_id, cl.sent_start, cl.lemma, fm FROM cl JOIN (SELECT w, unnest(forms) AS fm FROM f2) AS e ON e.w = cl.lemma WHERE regexp_matches(lower(sentence), '(^|[^\\p{L}\\p{N}\\p{M}_])' || fm || '($|[^\\p{L}\\p{N}\\p{M}_])'))
SELECT doc_id, sent_start, lemma, min(fm) AS inflected_form FROM hit GROUP BY doc_id, sent_start, lemma HAVING count(*) = 1""",
    "context_patterns": f"WITH {_DOC_WORDS}, n AS (SELECT w, lag(w) OVER z AS l, lead(w) OVER z AS r FROM t WINDOW z AS (PARTITION BY doc_id, sent_start ORDER BY i)) SELECT concat_ws(' ', l, w, r) AS pattern, count(*) AS freq FROM n WHERE {_IS_VERB} GROUP BY 1",
    "spell_unknown": f"WITH {_TOKENS} SELECT DISTINCT lower(core) AS word FROM x WHERE regexp_matches(lower(core), '^[a-z]+$') AND lower(core) NOT IN (SELECT word FROM known)",
    "spell_auto": f"""WITH {_TOKENS},
fix AS (SELECT *, CASE WHEN lower(core) = 'the' THEN replace(token, core, 'THE') WHEN lower(core) = 'thea' THEN replace(token, core, 'these') ELSE token END AS fixed FROM x)
SELECT c.row, coalesce(string_agg(fixed, ' ' ORDER BY ofs), '') AS corrected, CAST(count(*) FILTER (WHERE fixed <> token) AS BIGINT) AS corrections, CAST(count(*) FILTER (WHERE core <> '') AS BIGINT) AS words_checked
FROM c LEFT JOIN fix ON c.row = fix.row GROUP BY c.row""",
    "spell_suggestions": f"""WITH {_TOKENS}, w AS (SELECT unnest(['thng', 'iss', 'wass', 'blee', 'zzzzzz']) AS word),
n AS (SELECT w.word, known.word AS k, row_number() OVER (PARTITION BY w.word ORDER BY freq DESC, known.word) AS rank FROM w JOIN known ON levenshtein(w.word, known.word) = 1)
SELECT word, string_agg(k, ' ' ORDER BY rank) AS suggestions FROM n WHERE rank <= 3 GROUP BY word""",
}
#: Pairs of words within two edits share what is left of them without two letters at most.
_NEAREST = (
    _TOKENS
    + """, u AS (SELECT DISTINCT lower(core) AS word FROM x WHERE regexp_matches(lower(core), '^[a-z]+$') AND lower(core) NOT IN (SELECT word FROM known)),
b AS (SELECT word, true AS mine FROM u UNION ALL SELECT word, false FROM known),
b1 AS (SELECT word, mine, word AS part FROM b UNION SELECT word, mine, left(word, i - 1) || substring(word, i + 1) FROM b, unnest(range(1, 100)) AS t(i) WHERE i <= length(word)),
b2 AS (SELECT * FROM b1 UNION SELECT word, mine, left(part, i - 1) || substring(part, i + 1) FROM b1, unnest(range(1, 100)) AS t(i) WHERE i <= length(part)),
m AS (SELECT DISTINCT l.word, r.word AS k FROM b2 l JOIN b2 r ON l.part = r.part WHERE l.mine AND NOT r.mine),
e AS (SELECT m.word, k, freq, levenshtein(m.word, k) AS edits FROM m JOIN known ON known.word = k),
s AS (SELECT word, k, row_number() OVER (PARTITION BY word ORDER BY edits, freq DESC, k) AS rank FROM e WHERE edits BETWEEN 1 AND 2)"""
)
ORACLE_SQL |= {
    "spell_suggestions_all": f"WITH {_NEAREST} SELECT word, string_agg(k, ' ' ORDER BY rank) AS suggestions FROM s WHERE rank <= 5 GROUP BY word",
    "spell_auto_all": f"""WITH {_NEAREST},
fix AS (SELECT x.*, CASE WHEN s.k IS NOT NULL THEN replace(token, core, s.k) ELSE token END AS fixed FROM x LEFT JOIN s ON s.word = lower(core) AND s.rank = 1)
SELECT c.row, coalesce(string_agg(fixed, ' ' ORDER BY ofs), '') AS corrected, CAST(count(*) FILTER (WHERE fixed <> token) AS BIGINT) AS corrections, CAST(count(*) FILTER (WHERE core <> '') AS BIGINT) AS words_checked
FROM c LEFT JOIN fix ON c.row = fix.row GROUP BY c.row""",
    "spell_in_order": f"""WITH {_TOKENS},
o AS (SELECT x.*, lower(core) AS word, row_number() OVER (ORDER BY conv_id, turn, ofs) AS place FROM x JOIN (SELECT conv_id, turn, conv_id || '/' || turn AS row FROM conversations) AS y ON y.row = x.row),
a AS (SELECT word, place, row_number() OVER (PARTITION BY word ORDER BY place) AS n FROM o WHERE regexp_matches(word, '^[a-z]+$') AND word NOT IN (SELECT word FROM known)),
d AS (
  SELECT word, place, CASE n WHEN 1 THEN CASE WHEN length(word) % 2 = 0 THEN 'replace' END WHEN 2 THEN ['ignore_all', 'add', 'replace_all'][length(word) % 3 + 1] WHEN 3 THEN 'replace_all' ELSE 'ignore_once' END AS action,
    CASE WHEN n = 1 THEN upper(word) ELSE word || n END AS new
  FROM a WHERE n <= 4),
r AS (SELECT word, min(place) AS right_at FROM d WHERE action IN ('ignore_all', 'add') GROUP BY word),
l AS (SELECT d.* FROM d LEFT JOIN r ON r.word = d.word WHERE action IN ('replace_all', 'ignore_all', 'add') AND (right_at IS NULL OR place <= right_at)),
j AS (
  SELECT o.*, coalesce(o.place > r.right_at, false) AS done, q.action AS once, q.new AS once_new, l.action AS held, l.new AS held_new
  FROM o ASOF LEFT JOIN l ON o.word = l.word AND o.place >= l.place LEFT JOIN r ON r.word = o.word LEFT JOIN d q ON q.place = o.place AND q.action IN ('replace', 'ignore_once')),
f AS (SELECT *, CASE WHEN done THEN NULL WHEN once = 'replace' THEN once_new WHEN once IS NULL AND held = 'replace_all' THEN held_new END AS new FROM j)
SELECT c.row, coalesce(string_agg(CASE WHEN new IS NULL THEN token ELSE replace(token, core, new) END, ' ' ORDER BY ofs), '') AS corrected, CAST(count(new) AS BIGINT) AS corrections, CAST(count(*) FILTER (WHERE core <> '') AS BIGINT) AS words_checked
FROM c LEFT JOIN f ON c.row = f.row GROUP BY c.row""",
}
_LETTERS = "(SELECT chr(CAST(97 + range AS INT)) AS c FROM range(26))"
_MANY = f"""g AS (SELECT DISTINCT {_lemma_sql('x')} AS k, CASE WHEN x >= 'n' THEN 'n_z' ELSE 'a_m' END AS grp
  FROM (SELECT a.c || b.c AS x FROM {_LETTERS} a, {_LETTERS} b UNION ALL SELECT a.c || b.c || d.c FROM {_LETTERS} a, {_LETTERS} b, {_LETTERS} d))"""
_HITS = f"WITH {_DOC_VERBS}, h AS (SELECT doc_id, sent_start, i AS token_index, lemma, sentence FROM v WHERE lemma IN ('be', 'have', 'er', 'missing')) "
_BACK_OFF = (
    _DOC_WORDS
    + """, n AS (SELECT w, coalesce(lag(w) OVER z, '') AS l, coalesce(lead(w) OVER z, '') AS r FROM t WINDOW z AS (PARTITION BY doc_id, sent_start ORDER BY i)),
c2 AS (SELECT l, r, w AS token, count(*) AS c FROM n GROUP BY ALL), c1 AS (SELECT l, token, sum(c) AS c FROM c2 GROUP BY ALL), c0 AS (SELECT token, sum(c) AS c FROM c1 GROUP BY ALL),
"""
    + ", ".join(f"top{k} AS (SELECT *, row_number() OVER ({by} ORDER BY c DESC, token) AS rank, c / sum(c) OVER ({by}) AS prob FROM c{k})" for k, by in ((2, "PARTITION BY l, r"), (1, "PARTITION BY l"), (0, "")))
    + ", cc AS (SELECT conv_id || '/' || turn AS row, role, text FROM conversations WHERE trim(text) <> '')," + _sentence_sql("cc", "row, role", "text", "q0")
    + ", f AS (SELECT row, role, sentence, min(rel) AS ofs FROM q0 GROUP BY ALL), q AS (SELECT row, role, sentence, CAST(row_number() OVER (PARTITION BY row ORDER BY ofs) - 1 AS INT) AS sent_index FROM f),"
    + _word_sql("q", "row, role, sent_index", "u")
    + f""", x AS (SELECT row, sent_index, i, w, coalesce(lag(w) OVER z, '') AS l, coalesce(lead(w) OVER z, '') AS r FROM u WINDOW z AS (PARTITION BY row, sent_index ORDER BY i)),
y AS (SELECT * FROM x WHERE {_IS_VERB}),
lev AS (SELECT *, EXISTS (SELECT 1 FROM c2 WHERE c2.l = y.l AND c2.r = y.r) AS has2, EXISTS (SELECT 1 FROM c1 WHERE c1.l = y.l) AS has1 FROM y),
b AS (
  SELECT row, sent_index, i, rank, token, prob FROM lev JOIN top2 ON lev.l = top2.l AND lev.r = top2.r WHERE has2
  UNION ALL SELECT row, sent_index, i, rank, token, prob FROM lev JOIN top1 ON lev.l = top1.l WHERE NOT has2 AND has1
  UNION ALL SELECT row, sent_index, i, rank, token, prob FROM lev, (SELECT * FROM top0 WHERE rank <= {TOP}) AS top0 WHERE NOT has2 AND NOT has1)"""
)
ORACLE_SQL |= {
    "lookup_sentences": _HITS + "SELECT upper(lemma) AS lemma, CAST(row_number() OVER (PARTITION BY lemma ORDER BY doc_id, sent_start, token_index) AS BIGINT) AS place, sentence FROM h",
    "lookup_limited": _HITS + "SELECT * FROM h ORDER BY doc_id, sent_start, token_index LIMIT 50",
    "verb_rows_no_aux": f"WITH {_DOC_VERBS} SELECT doc_id, sent_start, i AS token_index, lemma, start || '-' || (start + length(w)) AS span FROM v WHERE NOT {_IS_AUX}",
    "bounded_dedupe": f"WITH {_CHUNKS}," + _sentence_sql("c", "doc_id, chunk_start", "chunk_text", "s0") + """,
o AS (SELECT doc_id, chunk_start, CAST(chunk_start + rel AS BIGINT) AS sent_start, sentence FROM s0),
k AS (SELECT *, lag(sent_start) OVER z AS before, lag(sentence) OVER z AS last FROM o WINDOW z AS (PARTITION BY doc_id ORDER BY chunk_start, sent_start))
SELECT doc_id, chunk_start, sent_start, sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_start, sent_start) - 1 AS BIGINT) AS sent_index
FROM k WHERE before IS NULL OR before <> sent_start OR last <> sentence""",
    "masked_back_off": f"WITH {_BACK_OFF} SELECT row, sent_index, i AS token_index, CAST(rank AS INT) AS rank, token, round(prob, 9) AS prob FROM b WHERE rank <= {TOP}",
    "verb_group_counts_joined": "WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS sentence FROM conversations)," + _word_sql("(SELECT DISTINCT * FROM c)", "conv_id, turn, role", "t")
    + f", v AS (SELECT *, {_lemma_sql()} AS k FROM t WHERE {_IS_VERB}), {_MANY}, vg AS (SELECT conv_id, turn, role, sentence, count(DISTINCT i) AS total, count(*) FILTER (WHERE grp = 'a_m') AS am, count(*) FILTER (WHERE grp = 'n_z') AS nz FROM v LEFT JOIN g ON v.k = g.k GROUP BY ALL)"
    + " SELECT c.conv_id, c.turn, c.role, coalesce(total, 0) AS total_verb_count, coalesce(am, 0) AS group_count_a_m, coalesce(nz, 0) AS group_count_n_z FROM c LEFT JOIN vg ON c.conv_id = vg.conv_id AND c.turn = vg.turn AND c.role = vg.role AND c.sentence = vg.sentence",
    "group_prob_joined": f"WITH {_LM}, {_MANY}, h AS (SELECT {_KEYS}, lemma, prob, {_lemma_sql('token')} AS k FROM p) SELECT {_KEYS}, lemma, round(coalesce(sum(prob) FILTER (WHERE grp = 'a_m'), 0), 9) AS group_prob_a_m, round(coalesce(sum(prob) FILTER (WHERE grp = 'n_z'), 0), 9) AS group_prob_n_z FROM h LEFT JOIN g ON h.k = g.k GROUP BY {_KEYS}, lemma",
}
ORACLE_SQL |= table_queries.ORACLE_SQL | stream_queries.ORACLE_SQL
ORACLE_SQL |= {"tagger_of_workers": ORACLE_SQL["verb_lemma_counts"], "stream_verbs": ORACLE_SQL["verb_lemma_counts"]}
#: Sentences end at commas there.
ORACLE_SQL["pipeline_verbs"] = f"WITH {_DOC_VERBS.replace('[^.!?]*[.!?]+|[^.!?]+', '[^,]*,+|[^,]+')} SELECT doc_id, sent_start, i AS token_index, lemma, start || '-' || (start + length(w)) AS span FROM v"
