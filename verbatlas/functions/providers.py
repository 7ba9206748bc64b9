"""Language providers: what the operators ask of a language model, with rule-based built-ins.

The built-ins are stand-ins. They are expressions that SQL can repeat, so that the relational operators
around them can be checked, and they make no claim to the quality of a trained model. A trained tagger,
lemmatizer or language model is plugged in with the same methods (see `ArrowTagger`, `ArrowMaskedLM`).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.functions import scan
from verbatlas.functions.text import as_column, canonical_token, filled, strip, tiles
from verbatlas.session import may_match, stash

#: Auxiliary verbs: each form with its lemma.
AUXILIARIES = {
    **dict.fromkeys(["am", "is", "are", "was", "were", "be", "been", "being"], "be"),
    **dict.fromkeys(["have", "has", "had", "having"], "have"),
    **dict.fromkeys(["do", "does", "did", "done", "doing"], "do"),
    **{m: m for m in ["can", "could", "will", "would", "shall", "should", "may", "might", "must"]},
}
#: Irregular verbs: lemma, past, participle.
IRREGULAR = {
    "run": ("ran", "run"), "think": ("thought", "thought"), "know": ("knew", "known"), "go": ("went", "gone"), "see": ("saw", "seen"),
    "take": ("took", "taken"), "come": ("came", "come"), "give": ("gave", "given"), "find": ("found", "found"), "tell": ("told", "told"),
    "say": ("said", "said"), "get": ("got", "got"), "make": ("made", "made"), "keep": ("kept", "kept"), "feel": ("felt", "felt"),
    "write": ("wrote", "written"), "speak": ("spoke", "spoken"), "begin": ("began", "begun"), "sing": ("sang", "sung"), "eat": ("ate", "eaten"),
}
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"
WORD = r"[A-Za-z]+|[^A-Za-z]+"
#: What stands before a verb (from the last one on: \G), and the verb: RuleTagger's auxiliaries, and other verbs. Each word is passed once.
_AUX = f"(?:{'|'.join(sorted(AUXILIARIES))})(?![a-z])"
_BY_ENDING = "[a-z]{4,}+(?<=ed|ing)"
_UP_TO_AUX = f"(?is)\\G.*?(?<![a-z])(?:{_AUX}|{_BY_ENDING})"
_UP_TO_VERB = f"(?is)\\G.*?(?<![a-z])(?!{_AUX}){_BY_ENDING}"


def _lookup(word: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), word)


class Tagger(Protocol):
    def tokens(self, sentence: Column) -> Column:
        """array<struct<i:int, start:int, text:string, pos:string, lemma:string>> of a sentence."""


class Lemmatizer(Protocol):
    def lemma(self, word: Column) -> Column:
        """The lemma of a lower-case verb form."""


class RuleSplitter:
    """Sentences end after `.`, `!` or `?`; starts are kept, white space around a sentence is not."""

    def sentences(self, text: Column | str) -> Column:
        def trimmed(x: Column) -> Column:
            left = F.regexp_extract(x["text"], r"(?U)^\s*", 0)
            return F.struct((x["start"] + F.length(left)).alias("start"), strip(x["text"]).alias("text"))

        return F.filter(F.transform(tiles(text, SENTENCE), trimmed), lambda x: x["text"] != "")

    def texts(self, text: Column | str) -> Column:
        """The texts of sentences() alone."""
        return F.filter(F.transform(F.regexp_extract_all(filled(text), F.lit(SENTENCE), F.lit(0)), strip), lambda x: x != "")


class RuleLemmatizer:
    """Auxiliaries and irregular verbs by table; else `ing` (of five letters or more) or `ed` (of four) goes."""

    def __init__(self, irregular: bool = False):
        self.table = dict(AUXILIARIES)
        if irregular:
            self.table |= {form: lemma for lemma, forms in IRREGULAR.items() for form in forms}

    def lemma(self, word: Column) -> Column:
        n = F.length(word)
        cut = F.when(word.endswith("ing") & (n >= 5), F.substring(word, F.lit(1), n - 3)).when(word.endswith("ed") & (n >= 4), F.substring(word, F.lit(1), n - 2)).otherwise(word)
        return F.coalesce(_lookup(word, self.table), cut)

    def lemma_of(self, word: str) -> str:
        """lemma() of one word, for code that runs on workers."""
        cut = 3 if word.endswith("ing") and len(word) >= 5 else 2 if word.endswith("ed") and len(word) >= 4 else 0
        return self.table.get(word) or word[: len(word) - cut]


class TableLemmatizer:
    """Lemmas from a table given as a dictionary; other words stay as they are."""

    def __init__(self, table: dict[str, str]):
        self.table = table

    def lemma(self, word: Column) -> Column:
        return F.coalesce(_lookup(word, self.table), word) if self.table else word


class RuleTagger:
    """AUX by table; VERB by the endings `ed` and `ing` of words of four letters or more; else X."""

    #: A word's tag does not depend on the words around it.
    by_word = True

    def __init__(self, lemmatizer: Lemmatizer | None = None):
        self.lemmatizer = lemmatizer or RuleLemmatizer()

    @staticmethod
    def _pos(low: Column) -> Column:
        return F.when(low.isin(*AUXILIARIES), "AUX").when((F.length(low) >= 4) & (low.endswith("ed") | low.endswith("ing")), "VERB").otherwise("X")

    @staticmethod
    def is_verb(low: str) -> bool:
        """Whether a lower-case word is AUX or VERB, for code that runs on workers."""
        return low in AUXILIARIES or len(low) >= 4 and low.endswith(("ed", "ing"))

    @staticmethod
    def is_verb_column(low: Column) -> Column:
        """is_verb() as an expression."""
        return RuleTagger._pos(low) != "X"

    def tokens(self, sentence: Column | str) -> Column:
        words = F.filter(tiles(sentence, WORD), lambda x: x["text"].rlike("^[A-Za-z]"))

        def tagged(x: Column, i: Column) -> Column:
            low = F.lower(x["text"])
            return F.struct(i.alias("i"), x["start"].alias("start"), x["text"].alias("text"), self._pos(low).alias("pos"), self.lemmatizer.lemma(low).alias("lemma"))

        return F.transform(words, tagged)

    def words(self, sentence: Column | str) -> Column:
        """The words alone, in lower case."""
        return F.transform(F.regexp_extract_all(filled(sentence), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))

    def verbs(self, sentence: Column | str, include_aux: bool) -> Column:
        """The verbs among tokens(). One pattern finds them, so that nothing is done for other words."""
        parts = F.regexp_extract_all(filled(sentence), F.lit(_UP_TO_AUX if include_aux else _UP_TO_VERB), F.lit(0))
        none = F.expr("cast(array() as array<struct<i: int, start: int, text: string>>)")
        first = F.struct(F.lit(0).alias("words"), F.lit(0).alias("chars"), none.alias("done"))

        def step(held: Column, part: Column) -> Column:
            # a part ends with its verb
            words, chars = held["words"] + F.regexp_count(part, F.lit("[A-Za-z]+")), held["chars"] + F.length(part)
            text = F.regexp_extract(part, "[A-Za-z]++$", 0)
            made = F.struct((words - 1).alias("i"), (chars - F.length(text)).cast("int").alias("start"), text.alias("text"))
            return F.struct(words.alias("words"), chars.alias("chars"), F.concat(held["done"], F.array(made)).alias("done"))

        def tagged(x: Column) -> Column:
            low = F.lower(x["text"])
            return F.struct(x["i"].alias("i"), x["start"].alias("start"), x["text"].alias("text"), self._pos(low).alias("pos"), self.lemmatizer.lemma(low).alias("lemma"))

        return F.transform(F.aggregate(parts, first, step, lambda held: held["done"]), tagged)


def wanted_verbs(lemmas: list[str] | None = None) -> Callable[[str], bool]:
    """Whether a lower-case word is a verb (of one of the lemmas), for code that runs on workers."""
    if lemmas is None:
        return RuleTagger.is_verb
    lem, wanted = RuleLemmatizer(), frozenset(lemmas)
    return lambda w: RuleTagger.is_verb(w) and lem.lemma_of(w) in wanted


def words_of(tagger: Tagger | None, sentence: Column | str) -> Column:
    """The words of a sentence in lower case, as the tagger sees them."""
    tagger = tagger or RuleTagger()
    if hasattr(tagger, "words"):
        return tagger.words(sentence)
    return F.transform(tagger.tokens(sentence), lambda t: F.lower(t["text"]))


def verbs_of(tagger: Tagger | None, sentence: Column | str, include_aux: bool) -> Column:
    """The tokens of a sentence that are verbs."""
    tagger = tagger or RuleTagger()
    if hasattr(tagger, "verbs"):
        return tagger.verbs(sentence, include_aux)
    return F.filter(tagger.tokens(sentence), lambda t: (t["pos"] == "VERB") | (F.lit(include_aux) & (t["pos"] == "AUX")))


#: What loaders gave on this worker, by the tagger or model that they belong to.
_LOADED: dict[str, object] = {}


def _loaded(key: str, loader: Callable[[], object]) -> object:
    """What the loader gives, called once for each worker, however many tasks it runs; the last two are kept."""
    if key not in _LOADED:
        while len(_LOADED) > 1:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[key] = loader()
    return _LOADED[key]


#: Characters of texts that a model is given at once, if one text is not longer: a token takes some hundred bytes in Python.
PIECE_CHARS = 262_144
_TOKEN = (("i", pa.int32()), ("start", pa.int32()), ("text", pa.string()), ("pos", pa.string()), ("lemma", pa.string()))


def _pieces(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order (null: empty), PIECE_CHARS characters at once or one text."""
    piece, held = [], 0
    for x in texts:
        text = x.as_py() or ""
        if piece and held + len(text) > PIECE_CHARS:
            yield piece
            piece, held = [], 0
        piece.append(text)
        held += len(text)
    if piece:
        yield piece


def _lists(rows: list[list[tuple]], fields: tuple, last: pa.Array | None = None) -> pa.ListArray:
    """rows as an Arrow list of structs, made column by column; last: the values of the last field, if they are an array already."""
    flat = [x for own in rows for x in own]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
    if last is not None:
        arrays[-1] = last
    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, [name for name, _ in fields]))


def _of_kinds(tokens: list[tuple], kinds: tuple[str, ...] | None) -> list[tuple]:
    return tokens if kinds is None else [t for t in tokens if t[3] in kinds]


def _once(udf):
    """A model that Spark does not run a second time, below a filter that it infers from an explode of the result."""
    return udf.asNondeterministic()


def verb_kinds(include_aux: bool) -> tuple[str, ...]:
    """The tags of verbs."""
    return ("VERB", "AUX") if include_aux else ("VERB",)


class ArrowTagger:
    """A tagger from a loader that each Python worker calls once: loader() -> (list of sentences -> tokens of each).

    A token is (i, start, text, pos, lemma). Batches go through Arrow; the model sees PIECE_CHARS of a batch at once, so that
    the tokens of a whole batch are never held.
    """

    KIND = "array<struct<i:int,start:int,text:string,pos:string,lemma:string>>"

    def __init__(self, loader: Callable[[], Callable[[list[str]], list[list[tuple]]]]):
        self.loader, self.key = loader, uuid.uuid4().hex

    def tokens(self, sentence: Column | str) -> Column:
        return self._tagged(sentence, None)

    def verbs(self, sentence: Column | str, include_aux: bool) -> Column:
        """The verbs among tokens(); the other tokens stay on the worker."""
        return self._tagged(sentence, verb_kinds(include_aux))

    def _tagged(self, sentence: Column | str, kinds: tuple[str, ...] | None) -> Column:
        loader, key = self.loader, self.key

        @F.arrow_udf(self.KIND)
        def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = _loaded(key, loader)
            for batch in batches:
                for texts in _pieces(batch):
                    yield _lists([_of_kinds(ts, kinds) for ts in model(texts)], _TOKEN)

        return _once(tag)(as_column(sentence))


class ArrowPipeline:
    """Sentences with their tokens from one pass of a model over whole texts; the loader is called once for each worker.

    loader() -> a model with parse(list of texts) -> for each text its sentences (start, text, tokens), tokens as ArrowTagger
    has them. A model without `parse` is a tagger of sentences: texts are then cut by the built-in rule on the worker.
    """

    KIND = f"array<struct<start:int,text:string,tokens:{ArrowTagger.KIND}>>"

    def __init__(self, loader: Callable[[], object]):
        self.loader, self.key = loader, uuid.uuid4().hex

    def sentences(self, text: Column | str, kinds: tuple[str, ...] | None = None) -> Column:
        """KIND of a text; sentences without any text are left out. kinds: tags of the tokens that leave the worker; None: all."""
        loader, key = self.loader, self.key
        token = pa.list_(pa.struct([pa.field(n, k) for n, k in _TOKEN]))
        fields = (("start", pa.int32()), ("text", pa.string()), ("tokens", token))

        @F.arrow_udf(self.KIND)
        def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = _loaded(key, loader)
            for batch in batches:
                for texts in _pieces(batch):
                    found = model.parse(texts) if hasattr(model, "parse") else _cut_and_tagged(texts, model)
                    found = [[x for x in own if x[1].strip()] for own in found]
                    tokens = _lists([_of_kinds(ts, kinds) for own in found for _, _, ts in own], _TOKEN)
                    yield _lists([[(start, t, None) for start, t, _ in own] for own in found], fields, tokens)

        return _once(parse)(as_column(text))


def _cut_and_tagged(texts: list[str], tagger: Callable[[list[str]], list[list[tuple]]]) -> list[list[tuple]]:
    """RuleSplitter's sentences with the tokens of a tagger."""
    cut = []
    for text in texts:
        found = [(m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in re.finditer(SENTENCE, text)]
        cut.append([x for x in found if x[1]])
    tagged = iter(tagger([t for own in cut for _, t in own]))
    return [[(s, t, next(tagged)) for s, t in own] for own in cut]


class CarriedTokens:
    """A tagger for rows that have their tokens in a column, as ArrowPipeline leaves them."""

    def __init__(self, column: str = "tokens"):
        self.column = column

    def tokens(self, sentence: Column | str) -> Column:
        return F.col(self.column)


def device() -> str:
    """Where a model should run on this worker: cuda, mps or cpu, by what torch finds; cpu without torch."""
    try:
        import torch
    except ImportError:
        return "cpu"
    if torch.cuda.is_available():
        return "cuda"
    return "mps" if torch.backends.mps.is_available() else "cpu"


#: Components that verbs, lemmas and sentences need, by the names that trained pipelines give them.
_COMPONENTS = ("transformer", "tok2vec", "tagger", "morphologizer", "parser", "senter", "attribute_ruler", "lemmatizer")


class SpacyModel:
    """A spaCy pipeline as a tagger of sentences and as a parser of whole texts."""

    def __init__(self, nlp):
        wanted = [c for c in _COMPONENTS if c in nlp.pipe_names]
        if wanted:
            nlp.select_pipes(enable=wanted)
        if not {"parser", "senter", "sentencizer"} & set(nlp.pipe_names):
            nlp.add_pipe("sentencizer")  # a pipeline that does not know sentences
        self._nlp = nlp

    def __call__(self, texts: list[str]) -> list[list[tuple]]:
        return [[(t.i, t.idx, t.text, t.pos_, t.lemma_.lower()) for t in doc] for doc in self._nlp.pipe(texts)]

    def parse(self, texts: list[str]) -> list[list[tuple]]:
        out = []
        for doc in self._nlp.pipe(texts):
            own = []
            for sent in doc.sents:
                tokens = [(k, t.idx - sent.start_char, t.text, t.pos_, t.lemma_.lower()) for k, t in enumerate(sent)]
                own.append((sent.start_char, sent.text, tokens))
            out.append(own)
        return out


def spacy_loader(model: str = "en_core_web_sm") -> Callable[[], SpacyModel]:
    """A loader for ArrowTagger and ArrowPipeline; needs spaCy and the model on the workers, and never downloads."""

    def load() -> SpacyModel:
        try:
            import spacy
        except ImportError as e:
            raise RuntimeError("spaCy is not installed on the workers") from e
        if device() != "cpu":
            spacy.prefer_gpu()
        return SpacyModel(spacy.load(model, disable=["ner"]))

    return load


class RuleInflector:
    """Forms of a lemma: -s, -ed, -ing by spelling rules, and the irregular table."""

    def forms(self, lemma: Column | str) -> Column:
        w = as_column(lemma)
        final_e = w.endswith("e") & ~w.endswith("ee")
        doubled = w.rlike("^[^aeiou]*[aeiou][bdgklmnprt]$")
        last = F.substring(w, -1, 1)
        stem = F.when(doubled, F.concat(w, last)).when(final_e, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        y = w.rlike("[^aeiou]y$")
        short = F.substring(w, F.lit(1), F.length(w) - 1)
        s = F.when(y, F.concat(short, F.lit("ies"))).when(w.rlike("(s|x|z|ch|sh|o)$"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))
        ed = F.when(y, F.concat(short, F.lit("ied"))).otherwise(F.concat(stem, F.lit("ed")))
        past, part = (_lookup(w, {k: v[n] for k, v in IRREGULAR.items()}) for n in (0, 1))
        return F.array_distinct(F.filter(F.array(w, s, F.concat(stem, F.lit("ing")), F.coalesce(past, ed), F.coalesce(part, ed)), lambda x: x.isNotNull()))


def lemmatized(df: DataFrame, token_col: str, lemmatizer: Lemmatizer, out_col: str) -> DataFrame:
    """df with the lemma of each token's canonical form.

    An expression is used in place. A lemmatizer that runs Python (`by_distinct = True`) sees each distinct
    token once: the distinct tokens are lemmatized and joined back.
    """
    key = canonical_token(token_col)
    if not getattr(lemmatizer, "by_distinct", False):
        return df.withColumn(out_col, F.lower(lemmatizer.lemma(key)))
    words = df.select(key.alias("_word")).distinct()
    words = words.select("_word", F.lower(lemmatizer.lemma(F.col("_word"))).alias(out_col))
    return df.withColumn("_word", key).join(words, "_word", "left").drop("_word")


def _key_window(keys: list[str]) -> WindowSpec:
    """Rows of the same keys. A number of theirs comes first, as numbers are sorted much faster than words that begin alike."""
    return W.partitionBy(F.xxhash64(*keys), *keys)


class ContextCountLM:
    """Masked predictions from counts: P(word | left, right), else P(word | left), else P(word).

    Ties go to the smaller word. Text edges count as the empty word.
    """

    def __init__(self, trigrams: DataFrame):
        """trigrams: left, word, right of every word of a corpus."""
        self.trigrams = trigrams

    @staticmethod
    def _ranked(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
        """For each value of the keys its k commonest words. counts: keys, word, c; rows may repeat, their c is added up."""
        best = F.struct("rank", F.col("word").alias("token"), (F.col("c") / F.col("total")).alias("prob"))
        listed = F.transform(F.sort_array(F.collect_list(best)), lambda x: F.struct(x["token"].alias("token"), x["prob"].alias("prob"))).alias("preds")
        if not keys:  # one list for the whole corpus: a top-k, not a window over all words
            counts = counts.groupBy("word").agg(F.sum("c").alias("c"))
            total = counts.agg(F.sum("c").alias("total"))
            top = counts.orderBy(F.desc("c"), "word").limit(k).crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(W.partitionBy("total").orderBy(F.desc("c"), "word")))
            return top.groupBy().agg(listed)
        # one shuffle, by the keys alone: lists are made where it leads, too
        return ContextCountLM._by_rank(counts, keys).where(F.col("rank") <= k).groupBy(*keys).agg(listed)

    @staticmethod
    def _by_rank(counts: DataFrame, keys: list[str]) -> DataFrame:
        """keys, word, c, rank (commonest first), total (c of all words with the keys): a row for each word of each value of the keys.

        One shuffle, by the keys alone: sums, totals and ranks are made where it leads.
        """
        # a number given keeps Spark from joining its parts into hardly more than there are cores
        parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = counts.repartition(parts, *keys).groupBy(*keys, "word").agg(F.sum("c").alias("c"))
        order = _key_window(keys).orderBy(F.desc("c"), "word")
        total = F.sum("c").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return rows.withColumns({"rank": F.row_number().over(order), "total": total})

    def _counted(self, wanted: DataFrame | None, keys: list[str]) -> DataFrame:
        """keys, word, c of the corpus, at least for the keys that are wanted (None: for all)."""
        rows = self.trigrams if wanted is None else _semi(self.trigrams, wanted, keys)
        return rows.groupBy(*keys, "word").agg(F.count("*").alias("c"))

    def _lists(self, context: DataFrame, k: int) -> DataFrame:
        """left, right, preds of each context (a stashed table); others may be there too.

        The corpus is passed once for the contexts, once more for the left words of those that it does not have, and once
        more for all words if it does not have one of these either.
        """
        lists = stash(self._ranked(self._counted(context, ["left", "right"]), ["left", "right"], k))
        unknown = stash(context.join(lists, ["left", "right"], "left_anti"))
        if not unknown.isEmpty():
            lefts = stash(unknown.where("left is not null").select("left").distinct())
            one = stash(self._ranked(self._counted(lefts, ["left"]), ["left"], k))
            found = unknown.join(one, "left")
            lists = lists.union(found.select("left", "right", "preds"))
            rest = stash(unknown.join(one.select("left"), "left", "left_anti"))
            if not rest.isEmpty():
                none = self._ranked(self._counted(None, []), [], k)
                lists = lists.union(rest.select("left", "right").crossJoin(F.broadcast(none)))  # one row
        return lists

    def predict(self, rows: DataFrame, k: int, left_col: str = "left", right_col: str = "right", derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """rows with preds: array<struct<token, prob>>, at most k, best first.

        Only contexts that occur in rows are counted and ranked, each once; the rows meet their context's list in one
        join. derive: what is made of a table with preds, once for each context and not for each row; its columns come
        in place of preds.
        """
        context = stash(rows.select(F.col(left_col).alias("left"), F.col(right_col).alias("right")).distinct())
        lists = self._lists(context, k).withColumnsRenamed({"left": "_l", "right": "_r"})
        lists = derive(lists) if derive else lists
        return rows.join(lists, F.col(left_col).eqNullSafe(F.col("_l")) & F.col(right_col).eqNullSafe(F.col("_r")), "left").drop("_l", "_r")


class TextCountLM(ContextCountLM):
    """ContextCountLM over the words of whole texts, for the built-in splitter and tagger: counted in the bytes of a batch."""

    def __init__(self, docs: DataFrame, text_col: str = "text"):
        self.docs, self.text_col = docs, text_col

    def predict_own(self, rows: DataFrame, k: int, is_wanted: Callable[[str], bool], derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """predict() for rows that are words of the same texts, all that are wanted: the corpus has their contexts, so nothing backs off or is looked for first."""
        keys = ["left", "right"]
        lists = self._ranked(scan.trigram_counts(self.docs, self.text_col, keys, scan.marked_in_texts(self.docs, self.text_col, is_wanted)), keys, k)
        return rows.join(derive(lists) if derive else lists, keys)

    def own_contexts(self, k: int, is_wanted: Callable[[str], bool], wanted: Callable[[Column], Column]) -> DataFrame:
        """left, right, word, c (how often it stands there), preds of the texts' own words that are wanted: predict_own() for all who need no places.

        The counts that give a context its list tell its words as well, so nothing is joined. wanted: is_wanted as an expression.
        """
        keys = ["left", "right"]
        rows = self._by_rank(scan.trigram_counts(self.docs, self.text_col, keys, scan.marked_in_texts(self.docs, self.text_col, is_wanted)), keys)
        best = F.when(F.col("rank") <= k, F.struct(F.col("word").alias("token"), (F.col("c") / F.col("total")).alias("prob")))
        whole = _key_window(keys).orderBy(F.desc("c"), "word").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return rows.withColumn("preds", F.collect_list(best).over(whole)).where(wanted(F.col("word"))).drop("rank", "total")

    def _counted(self, wanted: DataFrame | None, keys: list[str]) -> DataFrame:
        return scan.trigram_counts(self.docs, self.text_col, keys, None if wanted is None else scan.marked(wanted, keys))


#: Bytes of contexts up to which they are sent to all tasks that count.
CONTEXT_BYTES = 32_000_000


def _semi(trigrams: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The trigrams whose keys are wanted; wanted (a stashed table) is broadcast if it has few bytes, else marks of its keys are."""
    size = wanted.agg(F.sum(sum((F.octet_length(F.coalesce(k, F.lit(""))) for k in keys), F.lit(64)))).first()[0] or 0
    if size <= CONTEXT_BYTES:
        return trigrams.join(F.broadcast(wanted), keys, "left_semi")
    return may_match(trigrams, wanted, keys).join(wanted, keys, "left_semi")


class ArrowMaskedLM:
    """A masked language model from a loader that each Python worker calls once.

    loader() -> (list of masked texts, k -> for each a list of (token, prob), best first, or None where the
    mask was lost). A lost mask gives k empty predictions of probability 0. Tokens are lower-cased after
    the choice, so variants of case stay apart.
    """

    KIND = "array<struct<token:string,prob:double>>"

    def __init__(self, loader: Callable[[], Callable[[list[str], int], list]], batch: int = 16):
        self.loader, self.batch, self.key = loader, batch, uuid.uuid4().hex

    def predict(self, rows: DataFrame, k: int, text_col: str = "masked_text") -> DataFrame:
        loader, size, key = self.loader, self.batch, self.key

        @F.pandas_udf(self.KIND)
        def top(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _loaded(key, loader)
            for batch in batches:
                texts, out = batch.fillna("").tolist(), []
                for i in range(0, len(texts), size):
                    for found in model(texts[i : i + size], k):
                        pairs = [("", 0.0)] * k if found is None else [(t.lower(), float(p)) for t, p in found[:k]]
                        out.append([{"token": t, "prob": p} for t, p in pairs])
                yield pd.Series(out)

        return rows.withColumn("preds", _once(top)(F.col(text_col)))


def masked_lm_loader(pair: Callable[[], tuple], batch_words: int = 512) -> Callable[[], Callable[[list[str], int], list]]:
    """A loader for ArrowMaskedLM from pair() -> (tokenizer, model), called once for each Python worker.

    tokenizer: mask_token_id, encode(text) -> ids (cut to batch_words), decode(id) -> the token's text.
    model(list of ids) -> for each text its logits, a row over the vocabulary for each place. The first mask
    counts; a text whose mask was lost (cut off, or never there) gives None. Probabilities are a softmax over
    the whole vocabulary; equal ones go to the smaller id.
    """

    def load() -> Callable[[list[str], int], list]:
        import numpy as np

        tokenizer, model = pair()

        def predict(texts: list[str], k: int) -> list:
            ids = [list(tokenizer.encode(t))[:batch_words] for t in texts]
            at = [x.index(tokenizer.mask_token_id) if tokenizer.mask_token_id in x else None for x in ids]
            out: list = [None] * len(texts)
            there = [i for i, a in enumerate(at) if a is not None]
            for i, logits in zip(there, model([ids[i] for i in there]) if there else [], strict=True):
                z = np.asarray(logits[at[i]], np.float64)
                p = np.exp(z - z.max())
                p /= p.sum()
                out[i] = [(tokenizer.decode(int(j)).strip(), float(p[j])) for j in np.argsort(-p, kind="stable")[:k]]
            return out

        return predict

    return load


def transformers_pair(name: str) -> Callable[[], tuple]:
    """The tokenizer and model of a folder (or of the workers' cache) for masked_lm_loader; never downloads."""

    def pair() -> tuple:
        try:
            import torch
            from transformers import AutoModelForMaskedLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("transformers and torch are not installed on the workers") from e
        tokens = AutoTokenizer.from_pretrained(name, local_files_only=True)
        net = AutoModelForMaskedLM.from_pretrained(name, local_files_only=True).to(device()).eval()

        class Tokenizer:
            mask_token_id = tokens.mask_token_id

            @staticmethod
            def encode(text: str) -> list[int]:
                return tokens.encode(text, truncation=True)

            @staticmethod
            def decode(i: int) -> str:
                return tokens.convert_tokens_to_string([tokens.convert_ids_to_tokens(i)])

        def logits(rows: list[list[int]]) -> list:
            with torch.no_grad():
                made = tokens.pad({"input_ids": rows}, return_tensors="pt").to(device())
                return list(net(**made).logits.float().cpu().numpy())

        return Tokenizer, logits

    return pair
