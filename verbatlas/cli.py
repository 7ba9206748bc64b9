"""Command line: each step reads and writes delimited files and leaves a record beside its output.

    python -m verbatlas.cli extract a.txt b.txt --output verbs.csv
    python -m verbatlas.cli count verbs.csv --output freqs.csv --field lemma

`--model` names a trained tagger (extract, textcount) or a masked model (predict) that the workers load; without
it the built-in rules and counts are used. Rows that cannot be used are left out one by one, counted in the
record, warned of, and written with their reason where `--dead-letters` says so. A record of an earlier step given by
`--load-record` makes its output the input.
"""

from __future__ import annotations

import argparse
import logging
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.text import ROW_ORD, masked, span, ten_digits, word_arguments
from verbatlas.functions.providers import ArrowMaskedLM, ArrowPipeline, ArrowTagger, ContextCountLM, RuleTagger, Tagger, masked_lm_loader, spacy_loader, transformers_pair
from verbatlas.session import ship
from verbatlas.operators import extract, frequency, groups, letters, naming, spelling, textgroups
from verbatlas.plans.rowpred import compile_predicate
from verbatlas.sources import grouptables, manifest, readers, sinks, xlsx

log = logging.getLogger("verbatlas")

#: For each step its options with their defaults.
STEPS: dict[str, dict] = {
    "extract": {"size": 2_000_000, "overlap": 5_000, "include_aux": False, "encoding": "utf-8", "text_column": None, "paths_file": None, "tsv": False, "model": None},
    "count": {"field": "lemma"},
    "filter": {"field": "lemma", "least": None, "most": None},
    "sample": {"n": 100, "seed": 0},
    "predict": {"top_k": 10, "mask": "<mask>", "limit_rows": 0, "model": None, "dead_letters": None},
    "tags": {"ignore": []},
    "aggregate": {"groups": None, "profile": "standard", "short": False, "lemma_count": False, "lemma_column": "lemma", "dead_letters": None, "csv_only": False, "keep_csv": False},
    "means": {"lemma_column": "lemma", "threshold": 0.5, "profile": "standard", "group_columns": [], "csv_only": False, "keep_csv": False},
    "lookup": {"lemmas": "", "limit": 0, "top_k": 0, "lemma_column": "lemma", "sentence_column": "sentence", "print": False, "table": False},
    "textcount": {"groups": None, "text_column": "text", "where": None, "include_aux": False, "model": None, "dead_letters": None, "csv_only": False, "keep_csv": False},
    "inflect": {"clauses": None, "least": 10},
    "spell": {"words": None, "custom": None, "ignore": None, "decisions": None, "column": "text", "mode": "complete", "patch": None, "save_words": None},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbatlas")
    sub = p.add_subparsers(dest="step", required=True)
    for step, options in STEPS.items():
        q = sub.add_parser(step)
        q.add_argument("inputs", nargs="*")
        q.add_argument("-o", "--output")
        q.add_argument("--load-record", help="repeat the run of a record; options given here come first")
        q.add_argument("--strict-checksum", action="store_true")
        q.add_argument("--log-file", help="messages go there too")
        for name, default in options.items():
            flag = "--" + name.replace("_", "-")
            if isinstance(default, bool):
                q.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
            elif isinstance(default, list):
                q.add_argument(flag, action="append", default=None)
            else:
                q.add_argument(flag, type=type(default) if default is not None and not isinstance(default, str) else int if name in ("least", "most") else str, default=None)
    return p


def _table(spark: SparkSession, paths: list[str]) -> DataFrame:
    return readers.delimited(spark, paths, sep="\t" if paths[0].endswith(".tsv") else ",")


def _wide(df: DataFrame, k: int) -> DataFrame:
    wide = groups.array_to_wide(df, k)
    return wide.withColumns({f"prob_{i}": ten_digits(f"prob_{i}") for i in range(1, k + 1)})


def _tagger(spark: SparkSession, s: dict) -> Tagger | None:
    """The trained tagger that is named, or None for the built-in one."""
    if not s.get("model"):
        return None
    ship(spark)
    return ArrowTagger(spacy_loader(s["model"]))


def _pipeline(spark: SparkSession, s: dict) -> ArrowPipeline | None:
    """The trained pipeline that is named, for sentences and tokens in one pass, or None for the built-in rules."""
    if not s.get("model"):
        return None
    ship(spark)
    return ArrowPipeline(spacy_loader(s["model"]))


def _extract(spark: SparkSession, inputs: list[str], s: dict) -> DataFrame:
    if s["text_column"]:
        rows = readers.numbered_rows(readers.delimited(spark, inputs, encoding=s["encoding"], needed=[s["text_column"]]), s["text_column"])
        found = extract.verbs_of_rows(rows, "csv_row_number", "text", pipeline=_pipeline(spark, s), include_aux=s["include_aux"])
        return found.orderBy("csv_row_number", "sent_index", "token_index").drop("span").withColumnRenamed("span_text", "span_in_sentence_char")
    docs = readers.text_documents(spark, readers.path_list(inputs, s["paths_file"]), s["encoding"])
    found = extract.verbs_of_documents(docs, "doc_path", "text", s["size"], s["overlap"], pipeline=_pipeline(spark, s), include_aux=s["include_aux"])
    return found.orderBy("doc_path", "sent_index", "token_index").select(
        "doc_path", F.col("chunk_start").alias("chunk_start_char"), F.col("sent_start").alias("sent_start_char_in_doc"), F.col("sent_index").alias("sent_index_in_doc_approx"),
        F.col("token_index").alias("token_index_in_sent"), "lemma", "surface_lower", F.col("span_text").alias("span_in_sentence_char"), "sentence",
    )


def _spanned(spark: SparkSession, inputs: list[str], s: dict) -> DataFrame:
    """The rows to predict, with their span and masked text; both are null where the span is none."""
    rows = readers.delimited(spark, inputs, needed=["sentence", "span_in_sentence_char"])
    if s["limit_rows"]:
        rows = rows.orderBy(ROW_ORD).limit(s["limit_rows"])
    return rows.withColumn("_span", span("span_in_sentence_char", "-:")).withColumn("masked_text", masked("sentence", F.col("_span.start"), F.col("_span.end"), s["mask"]))


def _predict(rows: DataFrame, s: dict) -> DataFrame:
    spark = rows.sparkSession
    if s["model"]:
        ship(spark)
        out = ArrowMaskedLM(masked_lm_loader(transformers_pair(s["model"]))).predict(rows, s["top_k"])
        return _wide(out.drop("_span", "masked_text"), s["top_k"]).orderBy(ROW_ORD)
    sents = rows.select("sentence").distinct()
    words = RuleTagger().tokens(F.col("sentence"))
    index = F.filter(words, lambda t: t["start"] == F.col("_span.start"))
    rows = rows.withColumn("token_index", F.get(index, F.lit(0))["i"])
    out = ContextCountLM(extract.trigrams(sents)).predict(extract.with_context(rows, index_col="token_index"), s["top_k"])
    return _wide(out.drop("_span", "masked_text", "left", "right", "token_index"), s["top_k"]).orderBy(ROW_ORD)


def _aggregate(rows: DataFrame, s: dict) -> DataFrame:
    columns, rows = rows.columns, groups.wide_to_array(rows)
    table = grouptables.read(rows.sparkSession, s["groups"], s["profile"])
    out = groups.row_probabilities(rows, table, s["profile"], lemma_col=s["lemma_column"], count_active=s["lemma_count"] and s["profile"] == "fused")
    names = [c for c in out.columns if c not in rows.columns and c != "group_count"]
    written = {c: ten_digits(f"`{c}`") for c in names}
    if s["short"]:
        return groups.short_form(out, names, ROW_ORD if s["lemma_count"] else None, s["lemma_column"]).withColumns(written)
    k = naming.top_k_of(columns)
    own = [c for c in rows.columns if c != "preds"]
    wide = groups.array_to_wide(out.select(*own, "preds", *out.columns[len(rows.columns) :]), k)
    return wide.withColumns(written | {f"prob_{i}": ten_digits(f"prob_{i}") for i in range(1, k + 1)}).orderBy(ROW_ORD)


def _means(spark: SparkSession, inputs: list[str], s: dict) -> DataFrame:
    rows = _table(spark, inputs)
    names = list(naming.bound_columns(s["group_columns"], rows.columns).values()) if s["group_columns"] else [c for c in naming.group_columns(rows.columns) if c != ROW_ORD]
    return groups.lemma_means(rows, names, s["lemma_column"], ROW_ORD)


def _means_table(means: DataFrame) -> DataFrame:
    labels = groups.labels_of(means)
    wide = means.groupBy("lemma", "n").pivot("group", labels).agg(F.first("mean"))
    return wide.select("lemma", *(ten_digits(f"`{g}`").alias(g) for g in labels), F.col("n").alias("count")).orderBy("lemma")


def _spell(spark: SparkSession, inputs: list[str], s: dict) -> DataFrame:
    rows = readers.delimited(spark, inputs, needed=[s["column"]])
    known = readers.word_list(spark, s["words"])
    if s["custom"]:
        known = known.union(readers.word_list(spark, s["custom"]))
    ignored = readers.word_list(spark, s["ignore"]) if s["ignore"] else None
    if s["decisions"]:
        fixed, _, _ = spelling.apply_decisions(rows, ROW_ORD, s["column"], readers.delimited(spark, s["decisions"], needed=["word", "action", "replacement"], order=False), known, ignored)
    else:
        wrong = spelling.unknown_words(spelling.checked_tokens(rows, ROW_ORD, s["column"]), known, ignored)
        first = spelling.suggestions(wrong, known.withColumn("freq", F.lit(1)), ignored, n=1).select("word", F.get("suggestions", F.lit(0)).alias("replacement"))
        fixed = spelling.corrected(rows, ROW_ORD, s["column"], first, known, ignored)
    out = rows.join(fixed.select(ROW_ORD, "corrected"), ROW_ORD).orderBy(ROW_ORD)
    return spelling.output_mode(out, s["column"], "corrected", s["mode"])


def checked(spark: SparkSession, step: str, inputs: list[str], s: dict) -> letters.Checked | None:
    """The rows of the steps that may leave some out, with those that they leave out."""
    if step == "predict":
        rows = _spanned(spark, inputs, s)
        return letters.Checked(rows, {"no_span": F.col("_span").isNull(), "span_outside": F.col("masked_text").isNull()})
    if step == "aggregate":
        return letters.Checked(_table(spark, inputs), {"no_lemma": groups.row_lemma(F.col(s["lemma_column"]), s["profile"]) == ""})
    if step == "textcount" and s["where"]:
        rows = _table(spark, inputs)
        return letters.Checked(rows, {"filtered": ~F.coalesce(compile_predicate(s["where"], rows.columns), F.lit(False))})
    return None


def counters(found: letters.Checked | None) -> dict[str, int]:
    """What a record says of the rows read: rows_skipped cannot be used, rows_filtered are not wanted."""
    if found is None:
        return {}
    read, wanted = found.counts["rows_read"], sum(n for k, n in found.counts.items() if k != "rows_read")
    if "filtered" in found.counts:
        return {"rows_read": read, "rows_filtered": wanted}
    if wanted:
        log.warning("%d of %d rows cannot be used and are left out", wanted, read)
    return {"rows_read": read, "rows_skipped": wanted}


def _save_spelling(spark: SparkSession, inputs: list[str], s: dict) -> None:
    """The patch from the texts to the corrected ones, and the word list with the decisions' additions, where they are asked for."""
    if s["patch"]:
        fixed = _spell(spark, inputs, s | {"mode": "complete"})
        sinks.write_patch(fixed, s["column"], f"{s['column']}_corrected", s["patch"], Path(inputs[0]).name)
    if s["save_words"]:
        known = readers.word_list(spark, s["words"])
        if s["decisions"]:
            known = known.union(readers.delimited(spark, s["decisions"], order=False).where("action = 'add'").select(F.lower("word").alias("word")))
        sinks.write_words(known, s["save_words"])


def build(spark: SparkSession, step: str, inputs: list[str], s: dict, found: letters.Checked | None = None) -> DataFrame:
    """The DataFrame that a step writes. found: its rows, if they were checked already."""
    found = found or checked(spark, step, inputs, s)
    simple: dict[str, Callable[[], DataFrame]] = {
        "extract": lambda: _extract(spark, inputs, s),
        "count": lambda: frequency.counts(_table(spark, inputs), s["field"], ROW_ORD),
        "filter": lambda: frequency.filter_by_count(_table(spark, inputs), s["field"], s["least"], s["most"]).orderBy(ROW_ORD),
        "sample": lambda: frequency.sample(_table(spark, inputs), s["n"], ROW_ORD, s["seed"]).orderBy(ROW_ORD),
        "predict": lambda: _predict(found.usable, s),
        "aggregate": lambda: _aggregate(found.usable, s),
        "means": lambda: _means_table(_means(spark, inputs, s)),
        "lookup": lambda: textgroups.lookup(groups.wide_to_array(_table(spark, inputs)) if s["top_k"] else _table(spark, inputs), word_arguments(s["lemmas"]), ROW_ORD, s["lemma_column"], s["sentence_column"], s["limit"], s["top_k"]),
        "textcount": lambda: textgroups.verb_group_counts(found.usable if found else _table(spark, inputs), grouptables.read(spark, s["groups"]), s["text_column"], None, _tagger(spark, s), include_aux=s["include_aux"]).orderBy(ROW_ORD),
        "inflect": lambda: textgroups.inflection_matches(readers.clause_database(spark, s["clauses"]), textgroups.qualifying_lemmas(_table(spark, inputs), s["least"])).orderBy(ROW_ORD),
        "spell": lambda: _spell(spark, inputs, s),
    }
    if step == "tags":
        matrix = _table(spark, inputs)
        tags = grouptables.tags_long(matrix, s["ignore"])
        labels = [r.group for r in tags.groupBy("group").agg(F.min("group_pos").alias("p")).orderBy("p").collect()]
        return grouptables.tags_to_columns(tags, labels).drop("rank")
    return simple[step]()


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    step, defaults = args["step"], STEPS[args["step"]]
    record = manifest.load(args["load_record"]) if args["load_record"] else None
    own = record if (record or {}).get("tool") == step else None  # that of another step names the input only
    s = manifest.resolved({k: args[k] for k in defaults}, own, defaults)
    inputs = manifest.inputs_of(args["inputs"], record, step)
    output = args["output"] or (own or {}).get("output", {}).get("path")
    if not output or not (inputs or s.get("paths_file")):
        log.error("inputs and --output are needed")
        return 2
    if record:
        manifest.version_changes(record)
        if own:
            manifest.changed_inputs(record, strict=args["strict_checksum"])
    upstream = manifest.parent_of(inputs[0]) if inputs else None
    if upstream and Path(inputs[0]).exists():
        manifest.check_upstream(inputs[0], upstream, args["strict_checksum"])
    run = manifest.Manifest.begin(step, inputs, output, s, defaults, upstream)
    if args["log_file"]:
        logging.getLogger().addHandler(handler := logging.FileHandler(args["log_file"], encoding="utf-8"))
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    run.write()
    spark = SparkSession.builder.appName(f"verbatlas {step}").getOrCreate()
    tag = f"verbatlas-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    found, stats = None, {}
    try:
        found = checked(spark, step, inputs, s)
        left_out = counters(found)
        run.left_out = {k: n for k, n in found.counts.items() if k != "rows_read"} if found else None
        if found and s["dead_letters"]:
            sinks.write_local(found.dead.drop("_span", "masked_text"), s["dead_letters"], order_col=ROW_ORD)
        if step in ("aggregate", "textcount"):
            table = grouptables.read(spark, s["groups"], s.get("profile", "standard"))
            run.groups = {r.group: r.lemmas for r in groups.members_of(table).orderBy("group_pos").collect()}  # made by hand, and read by the driver before
        between = sinks.intermediate_path(output, bool(s.get("csv_only")), bool(s.get("keep_csv"))) if output.endswith(".xlsx") else None
        if between:  # the table behind a workbook
            sinks.write_local(build(spark, step, inputs, s, found), between, tally=stats)
        if between and s["csv_only"]:
            pass
        elif step == "means" and output.endswith(".xlsx"):
            xlsx.write_report(_means(spark, inputs, s), output, s["threshold"], s["profile"])
        elif output.endswith(".xlsx"):
            table = build(spark, step, inputs, s, found)
            xlsx.write_table(table, output, "verb_group_counts" if step == "textcount" else "Aggregated", grouptables.read(spark, s["groups"], s.get("profile", "standard")) if step == "aggregate" else None)
        else:
            sinks.write_local(build(spark, step, inputs, s, found), output, "\t" if output.endswith(".tsv") or s.get("tsv") else ",", tally=stats)
        if step == "lookup" and s["print"]:
            print(*sinks.hit_lines(build(spark, step, inputs, s), ROW_ORD, s["table"]), sep="\n")
        if step == "spell":
            _save_spelling(spark, inputs, s)
    except KeyboardInterrupt:
        spark.sparkContext.cancelJobsWithTag(tag)  # other work of the session goes on
        run.finish(counters(found) | stats, "stopped")
        return 130
    finally:
        spark.sparkContext.removeJobTag(tag)
    run.finish(left_out | stats)
    log.info("%s: %s", output, stats)
    return 0


if __name__ == "__main__":
    sys.exit(main())
