"""Spelling correction by a word list: automatic, or by a table of decisions.

A decision on a word is a row. `apply_decisions` applies rows (word, action, replacement) to a whole table at once;
`corrected_in_order` applies decisions at the places where they were made, as a run that asks for each word in turn does.
Words are compared in lower case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.functions.automata import NearWords
from verbatlas.functions.text import core_of_token, filled, strip
from verbatlas.session import may_match, ship, stash


def _tokens(text_col: str) -> Column:
    return F.filter(F.split(strip(text_col), r"(?U)\s+"), lambda t: t != "")


def checked_tokens(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at, token, core, word (lower case): the tokens between white space; core is empty where nothing is to check."""
    out = rows.select(F.col(id_col), F.posexplode(_tokens(text_col)).alias("at", "token"))
    core = core_of_token("token")
    return out.withColumn("core", core).withColumn("word", F.lower("core"))


def unknown_words(tokens: DataFrame, known: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """The distinct words that neither list holds. known and ignored: word, in lower case."""
    words = tokens.where("word != ''").select("word").distinct()
    out = words.join(known.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    if ignored is not None:
        out = out.join(ignored.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    return out


#: Bytes of a list of known words up to which every worker holds it as an automaton, and words that a task looks up.
KNOWN_BYTES, TASK_WORDS = 8_000_000, 512
#: Words that are sent to all tasks with their deletions, so that the known ones stay where they are.
FEW_WORDS = 1_000
_AUTOMATA: dict[str, tuple[NearWords, np.ndarray]] = {}


def suggestions(words: DataFrame, known: DataFrame, ignored: DataFrame | None = None, most_edits: int = 2, n: int = 5) -> DataFrame:
    """word, suggestions: known words within most_edits edits, nearest first, ties by frequency, then word.

    known: word, freq. A list of up to KNOWN_BYTES goes to the workers as a trie that the words' Levenshtein automata
    walk; a longer one, FEW_WORDS words or less, and words too long for the automaton, meet through a join. All give the same rows.
    """
    have = known.where("word is not null").groupBy(F.lower("word").alias("known")).agg(F.max("freq").alias("freq"))
    if ignored is not None:
        have = have.join(ignored.select(F.lower("word").alias("known")).distinct(), "known", "left_anti")
    words = stash(words.where("word is not null").select("word").distinct())
    if words.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        return _by_deletions(words, have, most_edits, n, few=True)
    have = stash(have)
    if (have.agg(F.sum(F.octet_length("known") + 16)).first()[0] or 0) > KNOWN_BYTES:
        return _by_deletions(words, have, most_edits, n)
    long = words.where(F.length("word") > NearWords.LONGEST)
    out = _by_automaton(words.where(F.length("word") <= NearWords.LONGEST), have, most_edits, n)
    return out if long.isEmpty() else out.union(_by_deletions(long, have, most_edits, n))


def _by_automaton(words: DataFrame, have: DataFrame, most_edits: int, n: int) -> DataFrame:
    spark = words.sparkSession
    ship(spark)
    have = have.where(F.length("known") <= NearWords.LONGEST + most_edits)  # a longer one is near no word given
    rows = sorted((r.known, r.freq) for r in have.collect())  # bounded by KNOWN_BYTES
    sent, key = spark.sparkContext.broadcast(([w for w, _ in rows], np.array([f for _, f in rows], np.int64))), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _AUTOMATA:  # one for each worker, for the list in use
            _AUTOMATA.clear()
            listed, freq = sent.value
            _AUTOMATA[key] = NearWords(listed), freq
        near, freq = _AUTOMATA[key]
        for batch in batches:
            given = batch.column(0).to_pylist()
            made = [(w, x) for w, x in zip(given, near.nearest(given, most_edits, n, freq), strict=True) if x]
            columns = [pa.array([w for w, _ in made], pa.string()), pa.array([x for _, x in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "suggestions"])

    dealt = words.repartition(max(1, -(-words.count() // TASK_WORDS)))
    return dealt.mapInArrow(work, "word string, suggestions array<string>")


def _by_deletions(words: DataFrame, have: DataFrame, most_edits: int, n: int, few: bool = False) -> DataFrame:
    """Candidates meet through deletions of up to most_edits letters: two words within so many edits share one.

    few: the words' deletions are broadcast. Else the known words' ones travel only if a word may have them.
    """
    sizes = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    have = have.where(F.length("known").between((sizes[0] or 0) - most_edits, (sizes[1] or 0) + most_edits))
    left = words.select("word", F.explode(_deletions(F.col("word"), most_edits)).alias("part"))
    right = have.select("known", "freq", F.explode(_deletions(F.col("known"), most_edits)).alias("part"))
    if few:
        left = F.broadcast(left)
    else:
        left = stash(left)
        right = may_match(right, left, ["part"])
    near = left.join(right, "part").select("word", "known", "freq").distinct()
    near = near.withColumn("edits", F.levenshtein("word", "known")).where((F.col("edits") <= most_edits) & (F.col("word") != F.col("known")))
    rank = F.row_number().over(W.partitionBy("word").orderBy("edits", F.desc("freq"), "known"))
    top = near.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "known"))), lambda x: x["known"]).alias("suggestions"))


def _deletions(word: Column, most: int) -> Column:
    """The word, and what is left of it without up to `most` letters."""
    out = F.array(word)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, _shorter))))
    return out


def _shorter(word: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def corrected(rows: DataFrame, id_col: str, text_col: str, replacements: DataFrame, known: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """id, corrected, corrections, words_checked for each row.

    replacements: word, replacement. A token's unknown core is replaced wherever it stands in the token;
    tokens are joined by single blanks.
    """
    tokens = checked_tokens(rows, id_col, text_col)
    wrong = unknown_words(tokens, known, ignored).join(replacements.select(F.lower("word").alias("word"), "replacement").dropDuplicates(["word"]), "word")
    # rows are told apart by id and text, so that a repeated or null id mixes nothing; equal rows are counted and given back
    keyed = rows.select(F.col(id_col).alias("id"), F.md5(filled(text_col)).alias("key"), filled(text_col).alias("text"))
    tokens = keyed.select("id", "key", F.posexplode_outer(_tokens("text")).alias("at", "token")).withColumn("core", filled(core_of_token("token"))).withColumn("word", F.lower("core"))
    joined = tokens.join(wrong, "word", "left")
    fixed = F.when(F.col("replacement").isNotNull(), F.replace("token", "core", "replacement")).otherwise(F.col("token"))
    count = lambda test: F.size(F.filter("x", test)).cast("long")
    made = joined.groupBy("id", "key").agg(
        F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", fixed.alias("fixed"), (F.col("replacement").isNotNull() & (fixed != F.col("token"))).alias("changed"), (F.col("core") != "").alias("checked"))))).alias("x"),
        F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0)).alias("times"),
    )
    out = made.select("id", "x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(F.col("id").alias(id_col), F.array_join(F.transform("x", lambda x: x["fixed"]), " ").alias("corrected"), count(lambda x: x["changed"]).alias("corrections"), count(lambda x: x["checked"]).alias("words_checked"))


def apply_decisions(rows: DataFrame, id_col: str, text_col: str, decisions: DataFrame, known: DataFrame, ignored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corrected rows, and the lists of known and ignored words with the decisions' additions."""
    low = decisions.withColumn("word", F.lower("word"))
    more_known = known.select(F.lower("word").alias("word")).union(low.where("action = 'add'").select("word")).distinct()
    first = ignored.select(F.lower("word").alias("word")) if ignored is not None else low.select("word").limit(0)
    more_ignored = first.union(low.where("action = 'ignore'").select("word")).distinct()
    replaced = low.where("action = 'replace'").select("word", "replacement")
    return corrected(rows, id_col, text_col, replaced, more_known, more_ignored), more_known, more_ignored


#: Decisions that hold from their place on; the first that makes a word right ends all others on it.
_LASTING, _RIGHT = ("replace_all", "ignore_all", "add"), ("ignore_all", "add")


def corrected_in_order(rows: DataFrame, id_col: str, text_col: str, decisions: DataFrame, known: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """id, corrected, corrections, words_checked as a run that asks for each unknown word in turn leaves them.

    decisions: id (of id_col's type), at (place of the token), word, action, replacement; places come in the order of id and
    at. `replace` and `ignore_once` decide for their own token; `replace_all` holds from its place on until the next lasting
    decision; from an `ignore_all` or `add` on its word is right, so it is never asked for again. A decision on a word that a
    list holds is void. Of several decisions of a kind at one place the smallest (action, replacement) counts.
    Ids must be different.

    An as-of join: lasting decisions are a short ordered list for each word, of which a token takes the last one before it.
    """
    low = decisions.select(F.col(id_col).alias("_id"), F.col("at").cast("int").alias("_at"), F.lower("word").alias("word"), "action", "replacement")
    low = unknown_words(low, known, ignored).join(low, "word")
    lasting = low.where(F.col("action").isin(*_LASTING)).groupBy("word", "_id", "_at").agg(F.min(F.struct("action", "replacement")).alias("d"))
    place = F.struct(F.col("_id"), F.col("_at"))
    lists = lasting.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "d"))).alias("ds"))
    # what comes after the word is right is never asked for
    right = F.array_min(F.transform(F.filter("ds", lambda x: x["d"]["action"].isin(*_RIGHT)), lambda x: x["p"]))
    lists = lists.withColumn("_right", right).select("word", F.filter("ds", lambda x: F.col("_right").isNull() | (x["p"] <= F.col("_right"))).alias("ds"), "_right")
    once = low.where(~F.col("action").isin(*_LASTING)).groupBy("word", "_id", "_at").agg(F.min(F.struct("action", "replacement")).alias("once"))
    keyed = rows.select(F.col(id_col).alias("_id"), filled(text_col).alias("_text"))
    tokens = keyed.select("_id", F.posexplode_outer(_tokens("_text")).alias("_at", "token")).withColumn("core", filled(core_of_token("token"))).withColumn("word", F.lower("core"))
    tokens = tokens.join(lists, "word", "left").join(once, ["word", "_id", "_at"], "left")
    tokens = tokens.withColumn("_so_far", F.filter("ds", lambda x: x["p"] <= place)).withColumn("_last", F.get("_so_far", F.size("_so_far") - 1)["d"])
    done = F.coalesce(F.col("_right") < place, F.lit(False))  # right by an earlier token
    single = ~done & F.col("once").isNotNull()
    new = F.when(single & (F.col("once.action") == "replace"), F.col("once.replacement")).when(~single & ~done & (F.col("_last.action") == "replace_all"), F.col("_last.replacement"))
    fixed = F.when(new.isNotNull(), F.replace("token", "core", new)).otherwise(F.col("token"))
    made = tokens.groupBy("_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", fixed.alias("fixed"), new.isNotNull().alias("changed"), (F.col("core") != "").alias("checked"))))).alias("x")
    )
    count = lambda test: F.size(F.filter("x", test)).cast("long")
    return made.select(F.col("_id").alias(id_col), F.array_join(F.transform("x", lambda x: x["fixed"]), " ").alias("corrected"), count(lambda x: x["changed"]).alias("corrections"), count(lambda x: x["checked"]).alias("words_checked"))


def output_mode(rows: DataFrame, text_col: str, corrected_col: str, mode: str) -> DataFrame:
    """complete: all columns and <text>_corrected; two-column: both texts; single-column: the corrected text."""
    name = f"{text_col}_corrected"
    if mode == "complete":
        return rows.withColumnRenamed(corrected_col, name)
    if mode == "two-column":
        return rows.select(text_col, F.col(corrected_col).alias(name))
    if mode == "single-column":
        return rows.select(F.col(corrected_col).alias(name))
    raise ValueError(f"no mode {mode!r}")

