"""Language identification by cross-parsing entropy.

A reference text for each language is taken from labelled rows (a bounded sample: REFERENCE_DOCS texts, an
equal slice of the first REFERENCE_LONGEST characters of each, REFERENCE_CHARS characters together) and becomes a suffix automaton, which accepts exactly the substrings of the
reference. A text is cross-parsed against a reference: cut into phrases, each the longest match that the
automaton can follow. A word (a run of letters, lower-cased, with a blank on either side) is parsed by
itself, so that a word's phrases are counted once for each Python worker and added up afterwards. The
entropy estimate of a language is phrases * log2(characters of the reference) for each letter of the
text; the language with the smallest wins, ties by name.

Defined cases: a text that is null or has no letter gets `und` and score 0, as does every text where
nothing was learned; rows with null language teach nothing; very long words are parsed but not kept;
repeated rows get equal results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.session import ship, table

REFERENCE_DOCS = 64
REFERENCE_CHARS = 40_000
#: Characters of a text from which its slice is taken, so that what the driver gathers is bounded.
REFERENCE_LONGEST = 200_000
#: Words that a worker keeps counted.
KEPT_WORDS, KEPT_LENGTH = 300_000, 48
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")
_FIELD = 40


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return [w for w in _RUN.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text; state 0 is the empty match."""

    def __init__(self, text: str):
        to: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for ch in text:
            cur = len(to)
            to.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in to[p]:
                to[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = to[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(to)
                    to.append(dict(to[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and to[p].get(ch) == q:
                        to[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.to, self.size = to, len(text)

    def phrases(self, text: str) -> int:
        """Phrases of the cross-parsing of text: longest matches, and a phrase for each unseen character."""
        to, root = self.to, self.to[0]
        state, count = root, 0
        for ch in text:
            nxt = state.get(ch)
            if nxt is None:
                count += state is not root
                nxt = root.get(ch)
                if nxt is None:
                    count += 1
                    state = root
                    continue
            state = to[nxt]
        return count + (state is not root)


class _Counted(dict):
    """For each word the phrases in all languages, packed into one number."""

    def __init__(self, automata: list[SuffixAutomaton]):
        self.automata = automata

    def __missing__(self, word: str) -> int:
        padded = f" {word} "
        value = sum(a.phrases(padded) << (_FIELD * k) for k, a in enumerate(self.automata))
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


class Identifier:
    def __init__(self, references: dict[str, str]):
        self.langs = sorted(references)
        self.weights = [math.log2(max(2, len(references[k]))) for k in self.langs]
        self._counted = _Counted([SuffixAutomaton(references[k]) for k in self.langs])

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text and self.langs else []
        if not found:
            return UNKNOWN, 0.0
        total = sum(map(self._counted.__getitem__, found))
        mask = (1 << _FIELD) - 1
        ranked = sorted((((total >> (_FIELD * k)) & mask) * w, lang) for k, (lang, w) in enumerate(zip(self.langs, self.weights, strict=True)))
        best = ranked[0][0]
        return ranked[0][1], 1.0 if len(ranked) == 1 else 1.0 - best / ranked[1][0]


_BUILT: dict[int, Identifier] = {}


def _identifier(references: dict[str, str]) -> Identifier:
    """One for each Python worker and model."""
    key = hash(tuple(sorted(references.items())))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Identifier(references)
    return _BUILT[key]


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sliced(texts: list[str], chars: int) -> list[str]:
    """The beginnings of all texts, equally long but for shorter texts, with `chars` characters together at most, blanks between them counted."""
    left, out = chars + 1, {}
    for k, at in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        out[at] = texts[at][: max(0, left // (len(texts) - k) - 1)]
        left -= len(out[at]) + 1
    return [out[i] for i in range(len(texts)) if out[i]]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = REFERENCE_CHARS) -> dict[str, str]:
    """A reference text for each language: the texts with the smallest hash of the id in each of REFERENCE_DOCS classes, an equal slice of each."""
    h = F.xxhash64(F.col(id_col), F.lit("reference"))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    picked = rows.groupBy(F.col(lang_col).alias("lang"), F.pmod(h, F.lit(REFERENCE_DOCS)).alias("class")).agg(F.min(F.struct(h.alias("h"), F.col(id_col).alias("id"))).alias("x"))
    ids = [r.id for r in picked.select("x.id").distinct().collect()]
    texts: dict[str, dict[str, None]] = {}
    found = rows.where(F.col(id_col).isin(ids)).select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, REFERENCE_LONGEST).alias("text")).groupBy("lang", "text").agg(F.lit(1)) if ids else None
    for r in found.orderBy(F.xxhash64("text"), "text").toLocalIterator() if found is not None else ():
        texts.setdefault(r.lang, {}).setdefault(" ".join(words_of(r.text)))
    out = {}
    for lang, own in texts.items():
        whole = " ".join(sliced([t for t in own if t], chars))
        if whole:
            out[lang] = f" {whole} "
    return out


def identify(docs: DataFrame, references: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score for each row; only the text is used for the prediction."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(references)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _identifier(model.value)
        for batch in batches:
            got = [own(x.as_py()) for x in batch.column(2)]
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(work, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs, learn(docs.where(~held_out("doc_id"))))


QUERIES = {"op9_language": op9_language}
ORACLE_SQL: dict[str, str] = {}
