"""From documents to verb occurrences: chunks, sentences without repeats, tagged words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.functions import scan
from verbatlas.functions.providers import ArrowPipeline, CarriedTokens, RuleLemmatizer, RuleSplitter, RuleTagger, Tagger, verb_kinds, verbs_of, wanted_verbs, words_of
from verbatlas.functions.text import filled, span_text, strip, unix_lines
from verbatlas.operators.frequency import counts


def char_chunks(docs: DataFrame, text_col: str = "text", size: int = 2_000_000, overlap: int = 5_000) -> DataFrame:
    """docs with chunk_start and chunk_text in place of the text: overlapping slices, counted in characters.

    Chunk i starts at i * (size - overlap); the last one is the first that reaches the end. Empty texts
    have no chunk. An overlap of 0 is honoured.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be 0 or more and less than the size")
    step = size - overlap
    rows = docs.withColumn("_text", unix_lines(text_col)).where(F.length("_text") > 0)
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.length("_text") - size) / F.lit(float(step)))).cast("int")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    rest = [c for c in docs.columns if c != text_col]
    start = (F.col("_i") * step).cast("long")
    return rows.select(*rest, start.alias("chunk_start"), F.substring("_text", start.cast("int") + 1, F.lit(size)).alias("chunk_text"))


def sentences(chunks: DataFrame, text_col: str = "chunk_text", start_col: str = "chunk_start", splitter: RuleSplitter | None = None) -> DataFrame:
    """chunks with sent_start (in the document) and sentence in place of the text, a row for each sentence."""
    found = F.explode((splitter or RuleSplitter()).sentences(text_col))
    rest = [c for c in chunks.columns if c != text_col]
    return chunks.withColumn("_s", found).select(*rest, (F.col(start_col) + F.col("_s.start")).cast("long").alias("sent_start"), F.col("_s.text").alias("sentence"))


def parsed_sentences(chunks: DataFrame, pipeline: ArrowPipeline, text_col: str = "chunk_text", start_col: str = "chunk_start", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """sentences() by a model, with the tokens that its pass gave: `tokens` is for CarriedTokens. kinds: the tags of those that are wanted; None: all."""
    rest = [c for c in chunks.columns if c != text_col]
    rows = chunks.withColumn("_found", pipeline.sentences(text_col, kinds)).select(*rest, F.explode("_found").alias("_s"))
    return rows.select(*rest, (F.col(start_col) + F.col("_s.start")).cast("long").alias("sent_start"), F.col("_s.text").alias("sentence"), F.col("_s.tokens").alias("tokens"))


def unique_sentences(rows: DataFrame, keys: list[str], size: int | None = None, overlap: int | None = None, drop_edge_fragments: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (keys, sent_start, sentence), that of the first chunk, with its number in the document.

    Chunks overlap, so a sentence may be found twice. A sentence cut off at a chunk's edge differs from the
    whole one and stays, unless drop_edge_fragments is set: then a row is dropped that another row of the
    same keys and start extends. carried: columns of the first chunk's row that stay.
    """
    first = rows.groupBy(*keys, "sent_start", "sentence").agg(F.min("chunk_start").alias("chunk_start"), *(F.min_by(c, "chunk_start").alias(c) for c in carried))
    if drop_edge_fragments:
        longest = F.max(F.length("sentence")).over(W.partitionBy(*keys, "sent_start"))
        first = first.withColumn("_n", longest).where(F.length("sentence") == F.col("_n")).drop("_n")
        # what starts inside a chunk's overlap in the middle of a sentence is the tail of an earlier row
        ends = F.max(F.col("sent_start") + F.length("sentence")).over(W.partitionBy(*keys).orderBy("sent_start").rowsBetween(W.unboundedPreceding, -1))
        first = first.withColumn("_e", ends).where(F.col("_e").isNull() | (F.col("sent_start") >= F.col("_e"))).drop("_e")
    number = F.row_number().over(W.partitionBy(*keys).orderBy("chunk_start", "sent_start", "sentence")) - 1
    return first.withColumn("sent_index", number.cast("long"))


def bounded_unique_sentences(rows: DataFrame, keys: list[str], window: int) -> DataFrame:
    """unique_sentences as a bounded memory sees it: of more than `window` keys held, the oldest tenth goes.

    Repeats that lie far apart are then found anew. Order matters, so a document's rows are in one task, sorted, and pass one by one.
    """
    if window < 1:
        raise ValueError("the window must be 1 or more")
    columns = [*keys, "chunk_start", "sent_start", "sentence"]
    plain = [f"c{i}" for i in range(len(columns))]  # mapInArrow takes no dots in names
    given = rows.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    n = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, None] = {}
        before, number = None, 0
        for batch in batches:
            keep, index = [], []
            cells = [c.to_pylist() for c in batch.columns]
            for at, (own, key) in enumerate(zip(zip(*cells[:n], strict=True), zip(*cells[n + 1 :], strict=True), strict=True)):
                if own != before:
                    held, before, number = {}, own, 0
                if key in held:
                    continue
                held[key] = None
                if len(held) > window:
                    for old in list(islice(held, max(1, window // 10))):
                        del held[old]
                keep.append(at)
                index.append(number)
                number += 1
            part = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(index, pa.int64())], [*plain, "sent_index"])

    ordered = given.repartition(*plain[:n]).sortWithinPartitions(*plain)
    return ordered.mapInArrow(work, f"{kinds}, sent_index long").toDF(*columns, "sent_index")


def verbs(rows: DataFrame, tagger: Tagger | None = None, include_aux: bool = True, sentence_col: str = "sentence") -> DataFrame:
    """A row for each verb of each sentence: token_index, lemma, surface_lower, span (start, end) and its text form."""
    kept = rows.withColumn("_t", F.explode(verbs_of(tagger, sentence_col, include_aux)))
    end = F.col("_t.start") + F.length("_t.text")
    return kept.select(
        *rows.columns,
        F.col("_t.i").alias("token_index"),
        F.lower("_t.lemma").alias("lemma"),
        F.lower("_t.text").alias("surface_lower"),
        F.struct(F.col("_t.start").alias("start"), end.alias("end")).alias("span"),
        span_text("_t.start", end).alias("span_text"),
    )


def verbs_of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2_000_000, overlap: int = 5_000, **options) -> DataFrame:
    """Chunks, sentences, their numbers and verbs of plain documents. pipeline: sentences and tokens come from its pass."""
    chunks, pipeline = char_chunks(docs.select(id_col, text_col), text_col, size, overlap), options.pop("pipeline", None)
    if pipeline is None:
        return verbs(unique_sentences(sentences(chunks), [id_col]), **options)
    found = unique_sentences(parsed_sentences(chunks, pipeline, kinds=verb_kinds(options.get("include_aux", True))), [id_col], carried=("tokens",))
    return verbs(found, **(options | {"tagger": CarriedTokens()})).drop("tokens")


def verbs_of_rows(rows: DataFrame, row_col: str, text_col: str, **options) -> DataFrame:
    """Verbs of a table's text column. Rows with blank text are left out; repeats within one row collapse.

    The table's other columns stay beside their row's verbs, by name.
    """
    splitter, pipeline = options.pop("splitter", None) or RuleSplitter(), options.pop("pipeline", None)
    carried = [c for c in rows.columns if c not in (row_col, text_col)]
    rows = rows.where(strip(text_col) != "")
    if pipeline is None:
        found = F.array_distinct(F.transform(splitter.sentences(text_col), lambda x: x["text"]))
        numbered = rows.select(row_col, *carried, F.posexplode(found).alias("sent_index", "sentence"))
    else:
        rows = rows.withColumn("_p", pipeline.sentences(text_col, verb_kinds(options.get("include_aux", True)))).withColumn("_x", F.transform("_p", lambda x: x["text"]))
        first = F.filter("_p", lambda x, i: F.array_position(F.col("_x"), x["text"]) == i + 1)
        numbered = rows.select(row_col, *carried, F.posexplode(first).alias("sent_index", "_s")).select(row_col, *carried, "sent_index", F.col("_s.text").alias("sentence"), F.col("_s.tokens").alias("tokens"))
        options["tagger"] = CarriedTokens()
    nothing = F.lit(0).cast("long")
    numbered = numbered.withColumns({"sent_index": F.col("sent_index").cast("long"), "chunk_start": nothing, "sent_start": nothing})
    return verbs(numbered, **options).drop("tokens")


def verb_counts(docs: DataFrame, field: str = "lemma", text_col: str = "text", tagger: Tagger | None = None, include_aux: bool = True) -> DataFrame:
    """field (lemma or surface_lower), freq: how often each occurs among the verbs of the texts, most frequent first.

    A tagger that looks at single words tells verbs among the distinct words, which are counted first: texts
    are not cut into sentences, and no word is tagged twice. Any other tagger sees all sentences.
    """
    tagger = tagger or RuleTagger()
    if not getattr(tagger, "by_word", False):
        found = docs.select(F.explode(RuleSplitter().texts(text_col)).alias("sentence"))
        return counts(verbs(found, tagger, include_aux).select(field), field)
    words = docs.select(F.explode(tagger.words(text_col)).alias("surface_lower")).groupBy("surface_lower").agg(F.count("*").alias("n"))
    verb = words.withColumn("_t", F.get(tagger.verbs("surface_lower", include_aux), F.lit(0))).where("_t is not null").withColumn("lemma", F.lower("_t.lemma"))
    return verb.groupBy(field).agg(F.sum("n").alias("freq")).orderBy(F.desc("freq"), field)


def trigrams(rows: DataFrame, tagger: Tagger | None = None, sentence_col: str = "sentence") -> DataFrame:
    """left, word, right of each word of each sentence, in lower case; edges are empty words."""
    words = words_of(tagger, sentence_col)
    near = lambda w: F.transform(w, lambda x, i: F.struct(F.coalesce(F.get(w, i - 1), F.lit("")).alias("left"), x.alias("word"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("right")))
    made = F.transform(F.array(words), near)[0]
    return rows.select(F.explode(made).alias("x")).select("x.left", "x.right", "x.word")


def word_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """trigrams of the sentences of whole texts, for the built-in splitter and tagger: words and sentence ends are found in one pass."""
    parts = F.regexp_extract_all(filled(text_col), F.lit("[A-Za-z]+|[.!?]+"), F.lit(0))
    low = F.transform(parts, lambda p: F.when(p.rlike("^[A-Za-z]"), F.lower(p)).otherwise(""))
    near = lambda w: F.transform(w, lambda x, i: F.struct(F.coalesce(F.get(w, i - 1), F.lit("")).alias("left"), x.alias("word"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("right")))
    rows = docs.select(F.explode(F.transform(F.array(low), near)[0]).alias("x"))
    return rows.where("x.word != ''").select("x.left", "x.right", "x.word")


def _neighbours(words: str, at: Column) -> list[Column]:
    return [F.coalesce(F.get(words, at - 1), F.lit("")).alias("left"), F.coalesce(F.get(words, at + 1), F.lit("")).alias("right")]


def with_context(rows: DataFrame, tagger: Tagger | None = None, sentence_col: str = "sentence", index_col: str = "token_index") -> DataFrame:
    """rows with the words left and right of their token."""
    words = words_of(tagger, sentence_col)
    return rows.withColumn("_w", words).select(*rows.columns, *_neighbours("_w", F.col(index_col)))


def verbs_in_context(docs: DataFrame, keys: list[str], text_col: str = "text", lemmas: list[str] | None = None) -> DataFrame:
    """keys, sent_start, token_index, lemma, left, right of the verbs of whole texts, for the built-in splitter, tagger and lemmatizer.

    lemmas: only these (in lower case), with their sentence.
    """
    rows = scan.word_rows(docs, keys, text_col, wanted_verbs(lemmas), sentence=lemmas is not None)
    shown = ["left", "right"] if lemmas is None else ["left", "right", "sentence"]
    return rows.select(*keys, "sent_start", "token_index", RuleLemmatizer().lemma(F.col("surface_lower")).alias("lemma"), *shown)


def context_patterns(rows: DataFrame, width: int = 1, tagger: Tagger | None = None, sentence_col: str = "sentence", index_col: str = "token_index") -> DataFrame:
    """pattern, freq: the words up to `width` places around each verb, counted."""
    words = words_of(tagger, sentence_col)
    i = F.col(index_col)
    first = F.greatest(F.lit(0), i - width)
    window = F.slice("_w", first + 1, i + width + 1 - first)
    return rows.withColumn("_w", words).select(F.array_join(window, " ").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("freq"))


def blank_filled(df: DataFrame) -> DataFrame:
    """String columns with empty cells for nulls, as a reader of delimited files wants them."""
    return df.select(*(filled(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema))
