"""Verbs of each row counted by group, lookups by lemma, inflected forms in sentences."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.automata import WholeWords
from verbatlas.functions.providers import Lemmatizer, RuleInflector, RuleLemmatizer, Tagger, lemmatized, verbs_of
from verbatlas.functions.text import canonical_token, filled, holds_word, strip
from verbatlas.operators.frequency import running_count
from verbatlas.operators.groups import labels_of, small
from verbatlas.operators.naming import free_name, free_names
from verbatlas.plans.rowpred import compile_predicate
from verbatlas.session import ship, stash

#: Groups' lemmas up to which counting takes no join.
INLINE_LEMMAS = 5_000


def verb_group_counts(rows: DataFrame, groups: DataFrame, text_col: str = "text", where: str | None = None, tagger: Tagger | None = None, lemmatizer: Lemmatizer | None = None, include_aux: bool = True) -> DataFrame:
    """rows (those that pass `where`) with total_verb_count and group_count_<group> columns.

    The total counts all verbs, also those of no group; a lemma in two groups counts in both. The predicate
    stands below the tagger, so rows that fail it are never tagged. Counting is done inside each row.
    """
    if where:
        rows = rows.where(compile_predicate(where, rows.columns))
    labels = labels_of(groups)
    total = free_name("total_verb_count", rows.columns)
    names = free_names("group_count_", labels, [*rows.columns, total])
    lem = lemmatizer or RuleLemmatizer()
    table = lemmatized(groups, "lemma", lem, "_key").where("_key != ''").select("_key", "group").distinct()
    lemmas = F.transform(verbs_of(tagger, filled(text_col), include_aux), lambda t: canonical_token(t["lemma"]))
    out = rows.withColumn("_v", lemmas)
    if table.count() <= INLINE_LEMMAS:
        members: dict[str, list[str]] = {}
        for r in table.collect():
            members.setdefault(r.group, []).append(r._key)
        counted = [F.size(F.filter("_v", _one_of(sorted(members.get(g, []))))).cast("long").alias(names[g]) for g in labels]
        return out.select(*rows.columns, F.size("_v").cast("long").alias(total), *counted)
    out = stash(out.withColumn("_row", F.monotonically_increasing_id()))  # both sides of the join must see the same numbers
    hits = out.select("_row", F.explode("_v").alias("_key")).join(small(table), "_key").groupBy("_row").pivot("group", labels).agg(F.count(F.lit(1)))
    hits = hits.select(F.col("_row").alias("_r"), *(F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(labels)))
    joined = out.join(hits, F.col("_row") == F.col("_r"), "left")
    return joined.select(*rows.columns, F.size("_v").cast("long").alias(total), *(F.coalesce(f"_g{i}", F.lit(0)).cast("long").alias(names[g]) for i, g in enumerate(labels)))


def _one_of(keys: list[str]):
    return lambda x: x.isin(keys) if keys else F.lit(False)


def run_statistics(counted: DataFrame, total_col: str = "total_verb_count", group_cols: list[str] | None = None) -> DataFrame:
    """One row: rows, rows with verbs, rows with a group's verb, verbs and verbs of groups."""
    cols = group_cols if group_cols is not None else [c for c in counted.columns if c.startswith("group_count_")]
    hits = sum((F.col(f"`{c}`") for c in cols), F.lit(0).cast("long"))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return counted.agg(
        F.count("*").alias("rows_written"), n(F.col(total_col) > 0).alias("rows_with_verbs"), n(hits > 0).alias("rows_with_hits"),
        F.sum(total_col).cast("long").alias("verbs"), F.sum(hits).cast("long").alias("group_verbs"),
    )


def lookup(rows: DataFrame, lemmas: list[str], order_col: str, lemma_col: str = "lemma", sentence_col: str = "sentence", limit: int = 0, top_k: int = 0, preds_col: str = "preds", in_order: bool = True) -> DataFrame:
    """lemma, sentence, preds of the rows with one of the lemmas (case and blanks aside), in input order.

    limit 0: all. in_order False: in any order, without a sort (which passes the input twice). preds has the first top_k pairs whose token and probability are both there.
    """
    wanted = sorted({x.strip().lower() for x in lemmas if x.strip()})
    key = F.lower(strip(lemma_col))
    out = rows.where(key.isin(wanted) if wanted else F.lit(False))
    shown = [F.filter(F.slice(preds_col, 1, top_k), lambda p: (filled(p["token"]) != "") & p["prob"].isNotNull()).alias("preds")] if top_k else []
    out = out.select(order_col, key.alias("lemma"), F.col(sentence_col).alias("sentence"), *shown)
    out = out.orderBy(order_col) if in_order or limit else out
    return out.limit(limit) if limit else out


def by_lemma(hits: DataFrame, order_col: str) -> DataFrame:
    """lemma (upper case), n, sentences in input order; lemmas sorted. For a lookup's result."""
    return hits.groupBy(F.upper("lemma").alias("lemma")).agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct(order_col, "sentence"))), lambda x: x["sentence"]).alias("sentences")).orderBy("lemma")


def first_by_lemma(hits: DataFrame, order_col: str) -> DataFrame:
    """lemma (upper case), n, first_sentence (in input order): by_lemma for lemmas with any number of hits, of which one stays."""
    return hits.groupBy(F.upper("lemma").alias("lemma")).agg(F.count("*").alias("n"), F.min_by("sentence", order_col).alias("first_sentence")).orderBy("lemma")


def ranked_hits(hits: DataFrame, order_col: str, most: int = 0) -> DataFrame:
    """lemma (upper case), place (from 1, in input order), sentence: by_lemma as rows, for lemmas with any number of hits.

    Places are numbered in blocks of the order, so that no lemma is gathered in a row or numbered by one
    task. most: places beyond it are left out; 0: none.
    """
    rows = running_count(hits.select(F.upper("lemma").alias("lemma"), "sentence", order_col), "lemma", order_col, "place")
    rows = rows.select("lemma", "place", "sentence")
    return rows.where(F.col("place") <= most) if most else rows


def qualifying_lemmas(freqs: DataFrame, least: int = 10, excluded: tuple[str, ...] = ("be",), lemma_col: str = "lemma", freq_col: str = "freq") -> DataFrame:
    """Lemmas with at least that frequency, without the excluded ones."""
    return freqs.where((F.col(freq_col).try_cast("bigint") >= least) & ~F.col(lemma_col).isin(*excluded)).select(F.col(lemma_col).alias("lemma")).distinct()


#: Bytes of all forms up to which every worker holds them as an automaton.
FORMS_BYTES = 64_000_000
_AUTOMATA: dict[str, WholeWords] = {}


def inflection_matches(clauses: DataFrame, lemmas: DataFrame, inflector: RuleInflector | None = None, lemma_col: str = "lemma", text_col: str = "sentence_text") -> DataFrame:
    """clauses with inflected_form: those whose text holds, as a whole word, exactly one form of their lemma.

    Forms of all lemmas are one automaton, and each text is passed once, however many forms there are. More than
    FORMS_BYTES of them are tested lemma by lemma instead. Both give the same rows.
    """
    listed = lemmas.select(F.col("lemma").alias("_l")).distinct()
    forms = (inflector or RuleInflector()).forms(F.col("_l"))
    listed = stash(listed.select("_l", forms.alias("_forms")))
    if (listed.agg(F.sum(F.octet_length(F.array_join("_forms", " ")) + F.octet_length("_l"))).first()[0] or 0) > FORMS_BYTES:
        return _matches_by_lemma(clauses, listed, lemma_col, text_col)
    spark = clauses.sparkSession
    ship(spark)
    sent, key = spark.sparkContext.broadcast({r._l: r._forms for r in listed.collect()}), uuid.uuid4().hex  # bounded by FORMS_BYTES
    names = clauses.columns
    plain = [f"c{i}" for i in range(len(names))]  # mapInArrow takes no dots in names
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, clauses.schema, strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms_of = sent.value
        if key not in _AUTOMATA:  # one for each worker, for the list in use
            _AUTOMATA.clear()
            _AUTOMATA[key] = WholeWords(f for forms in forms_of.values() for f in forms)
        held, before, words = _AUTOMATA[key], None, set()
        for batch in batches:
            keep, found = [], []
            for at, (lemma, text) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if lemma in forms_of:
                    if text != before:
                        before, words = text, held(text)
                    own = [f for f in forms_of[lemma] if f in words]
                    if len(own) == 1:
                        keep.append(at)
                        found.append(own[0])
            part = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(found, pa.string())], [*plain, "inflected_form"])

    rows = clauses.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(names, plain, strict=True)), F.col(lemma_col).alias("_lemma"), F.lower(filled(text_col)).alias("_low"))
    return rows.mapInArrow(work, f"{kinds}, inflected_form string").toDF(*names, "inflected_form")


def _matches_by_lemma(clauses: DataFrame, listed: DataFrame, lemma_col: str, text_col: str) -> DataFrame:
    kept = clauses.join(listed, clauses[lemma_col] == F.col("_l"))
    text = F.lower(filled(text_col))
    found = F.filter("_forms", lambda f: F.contains(text, f) & holds_word(text, f))
    # as a generator, as Spark cannot bind a filter with a lambda that it moves into the join
    return kept.select(*clauses.columns, F.explode(F.transform(F.array(found), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))).alias("inflected_form")).where("inflected_form is not null")
