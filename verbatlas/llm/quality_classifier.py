"""Quality classifier by weak labels: heuristic labellers, EM over their votes, a hashed linear scorer.

1. A lexicon of hashed words and word beginnings that mark abuse is taken from labelled rows: a bounded
   sample, LEXICON_ROWS.
2. Overlapping heuristic labellers vote good, bad or nothing on each text. The patterns of votes are
   counted over all documents; there are at most 3 ** len(LABELLERS) of them.
3. Expectation-maximisation over the counted patterns estimates how accurate each labeller is, and the
   posterior of each pattern.
4. The posteriors of a bounded sample, TRAIN_ROWS, train a linear scorer over hashed features (words,
   word beginnings, classes of shape measures and of lexicon hits), which scores every document. Half of
   the sample is drawn from all documents alike, half from the patterns of votes alike, so that rare
   patterns are in it at any size; its rows are weighted by what they stand for.

Defined cases: a text without words (null and empty ones too) has no sign of poor quality: its score is
the scorer's bias, and at most a vote of no labeller; very long texts are read whole; repeated rows get
equal scores; without labels, or with an empty table of them, the lexicon is empty; an empty table of
documents gives an empty table. Columns with clashing names are passed through by keep_good and ignored
elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from verbatlas.llm.rows import ROW, whole_row
from verbatlas.llm.words import LOWER, SPACE, Hasher, flat, release, runs, slices
from verbatlas.session import ship, stash, table

#: Bounds of the samples that fit the model.
LEXICON_ROWS = 20_000
TRAIN_ROWS = 12_000
BITS = 18
#: Beginnings of words, in bytes, that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Words (of five letters) by which a text counts as longer, where shares are taken.
DAMPING = 6
#: A word or beginning of the lexicon: in so many abusive texts at least, and so many times as common there.
LEXICON_LEAST, LEXICON_ODDS = 6, 30.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_WORDY = _LETTER.copy()
_WORDY[48:58] = True
_WORDY[128:] = True


class Texts:
    """Words, hashed features and shape measures of a column of texts."""

    def __init__(self, texts: pa.Array):
        b, offsets = flat(texts)
        low = LOWER[b]
        second = np.zeros(len(b), bool)  # capital letters of the Latin-1 supplement, by their second byte
        second[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        low = np.where(second, low + 32, low).astype(np.uint8)
        s, e, self.first = runs(_WORDY[b], offsets)
        self.n = len(offsets) - 1
        hasher = Hasher(b, low)
        whole = hasher(s, e)
        self.words = (whole >> np.uint64(64 - BITS)).astype(np.int32)
        parts = [self.words]
        for k in PREFIXES:
            longer = (e - s) > k
            h = (hasher(s, np.minimum(s + k, e)) * np.uint64(2 * k + 1)) >> np.uint64(64 - BITS)
            parts.append(np.where(longer, h.astype(np.int32), np.int32(-1)))
        self.features = np.stack(parts)
        per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(np.float64)
        us, ue, ufirst = runs(~SPACE[b], offsets)
        units = np.diff(ufirst) + DAMPING  # so that a few words alone give no strong measure
        wordy = np.concatenate([[0], np.cumsum(_WORDY[b])])
        bare = np.concatenate([[0], np.cumsum(wordy[ue] == wordy[us])])
        signs = np.concatenate([[0], np.cumsum(_SYMBOL[b])])
        tagged = np.concatenate([[0], np.cumsum(signs[ue] > signs[us])])
        bang = np.zeros(len(b), bool)
        bang[1:] = (b[1:] == 33) & (b[:-1] == 33)
        same = np.zeros(len(self.words), bool)
        same[1:] = whole[1:] == whole[:-1]
        if len(same):
            same[self.first[:-1][self.first[:-1] < len(same)]] = False
        count = np.diff(self.first)
        letters = per(_LETTER[b]) + per(second)
        distinct = np.array([len(np.unique(self.words[i:j])) for i, j in zip(self.first[:-1], self.first[1:], strict=True)], np.float64)
        run = np.concatenate([[0], np.cumsum(same)])
        self.count = count
        safe = np.maximum(count, 1)
        self.shape = {
            "symbols": per(_SYMBOL[b]) / units,
            "tagged": np.diff(tagged[ufirst]) / units,
            "noise": per(~_WORDY[b] & ~SPACE[b]) / (per(_WORDY[b]) + 5 * DAMPING),
            "bare": np.diff(bare[ufirst]) / units,
            "upper": per(_UPPER[b]) / (letters + 5 * DAMPING),
            "bangs": per(bang) / units,
            "doubled": np.diff(run[self.first]) / (count + DAMPING),
            # beyond some length new words become rare in any text, so the measure is the share of a text of that length
            "distinct": np.where(count < 20, 1.0, distinct / np.minimum(safe, 400)),
        }

    def hits(self, lexicon: np.ndarray) -> np.ndarray:
        """For each text, the words that the lexicon (a flag for each bucket) holds, whole or by their beginning."""
        if not len(self.words):
            return np.zeros(self.n)
        found = lexicon[self.features].astype(bool) & (self.features >= 0)
        return np.diff(np.concatenate([[0], np.cumsum(found.any(axis=0))])[self.first]).astype(np.float64)


#: Labellers: the measure, from where it votes bad, up to where it votes good (between: no vote).
#: A measure under a negative bound votes bad from there downwards.
LABELLERS = {
    "symbols": ("symbols", 0.10, 0.03),
    "words with symbols": ("tagged", 0.10, 0.03),
    "punctuation": ("noise", 0.20, 0.10),
    "bare words": ("bare", 0.10, 0.03),
    "capitals": ("upper", 0.40, 0.20),
    "exclamations": ("bangs", 0.10, 0.03),
    "doubled words": ("doubled", 0.10, 0.05),
    "few words": ("distinct", -0.15, -0.30),
    "abuse": ("abuse", 2.0, 0.5),
    "dense abuse": ("abuse_share", 0.004, 0.001),
}


_BASE = 3 ** np.arange(len(LABELLERS))


def measured(texts: Texts, lexicon: np.ndarray) -> dict[str, np.ndarray]:
    """The shape measures, and the lexicon's hits by count and density."""
    hits = texts.hits(lexicon)
    return texts.shape | {"abuse": hits, "abuse_share": np.maximum(hits - 1, 0) / np.maximum(texts.count, 1)}


def votes(texts: Texts, measures: dict[str, np.ndarray] | np.ndarray) -> np.ndarray:
    """A row for each text: for each labeller 0 nothing, 1 good, 2 bad. The measures may be given as the lexicon."""
    if not isinstance(measures, dict):
        measures = measured(texts, measures)
    out = np.zeros((texts.n, len(LABELLERS)), np.int8)
    for k, (name, bad, good) in enumerate(LABELLERS.values()):
        m = measures[name] if bad > 0 else -measures[name]
        out[:, k] = np.where(m >= bad, 2, np.where(m <= good, 1, 0))
    out[texts.count == 0] = 0
    return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of `good` for each pattern; the chances of each vote [class, labeller, vote]; the share of good.

    Defects are of different kinds, so a poor text has votes against it from few labellers. The chances
    start accordingly: a vote against a good text is rare, a vote for a poor one is not. A prior of a
    fiftieth of the votes for the good class keeps the classes from trading places.
    """
    m = patterns.shape[1]
    start = np.array([[0.05, 0.947, 0.003], [0.05, 0.70, 0.25]])  # good, bad: nothing, good, bad
    chances = np.repeat(start[:, None, :], m, axis=1)
    share = 0.8
    weight = (0.02 * counts.sum() + 1.0, 0.001 * counts.sum() + 1.0)
    one_hot = patterns[:, :, None] == np.arange(3)
    for _ in range(rounds):
        posterior = posterior_of(patterns, chances, share)
        before = chances.copy()
        for c, p in enumerate((posterior, 1 - posterior)):
            seen = np.einsum("p,pmv->mv", counts * p, one_hot) + weight[c] * start[c]
            chances[c] = seen / seen.sum(axis=1, keepdims=True)
        share = float((counts * posterior).sum() + 8.0) / (counts.sum() + 10.0)
        if np.abs(chances - before).max() < 1e-7:
            break
    return posterior_of(patterns, chances, share), chances, share


def posterior_of(patterns: np.ndarray, chances: np.ndarray, share: float) -> np.ndarray:
    at = np.arange(patterns.shape[1])
    logs = [np.log(chances[c][at, patterns]).sum(axis=1) for c in (0, 1)]
    odds = logs[1] - logs[0] + np.log((1 - share) / share)
    return 1 / (1 + np.exp(np.clip(odds, -60, 60)))


#: Shape measures and lexicon hits become features by classes: their bounds.
_CLASSES = {"symbols": (0.03, 0.1, 0.3), "tagged": (0.03, 0.1, 0.3), "noise": (0.1, 0.2, 0.4), "bare": (0.03, 0.1, 0.3), "upper": (0.2, 0.4, 0.7), "bangs": (0.03, 0.1, 0.3), "doubled": (0.05, 0.1, 0.3), "distinct": (0.15, 0.3), "abuse": (1, 2, 4), "abuse_share": (0.001, 0.004, 0.02)}
_SHAPES = [(name, k) for name, bounds in _CLASSES.items() for k in range(len(bounds) + 1)]


def feature_rows(texts: Texts, measures: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """For each text its distinct features: buckets of words and beginnings, then of the classes of its measures."""
    classes = {name: np.searchsorted(bounds, measures[name], "right") for name, bounds in _CLASSES.items() if name in measures}
    for i in range(texts.n):
        own = np.unique(texts.features[:, texts.first[i] : texts.first[i + 1]])
        shape = [2**BITS + _SHAPES.index((name, int(c[i]))) for name, c in classes.items()]
        yield np.concatenate([own[own >= 0], np.array(shape, own.dtype)])


def train_linear(rows: list[np.ndarray], good: np.ndarray, epochs: int = 10, rate: float = 0.3, least: int = 12, counts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights of a logistic scorer by adaptive gradient steps, with an absolute shrinkage; the bias. Soft labels.

    Words and beginnings of fewer than `least` rows get no weight. counts: how many rows each row stands for.
    """
    size = 2**BITS + len(_SHAPES)
    weights, grads, bias = np.zeros(size), np.full(size, 1e-6), 2.0
    if not rows:
        return weights.astype(np.float32), bias
    seen = np.zeros(size, np.int64)
    for r in rows:
        seen[r] += 1
    usable = ((seen >= least) & (seen < 0.98 * len(rows))) | (np.arange(size) >= 2**BITS)
    shares = np.ones(len(rows)) if counts is None else counts / counts.mean()
    rows = [r[usable[r]] for r in rows]
    order = np.random.default_rng(11)
    bias_grad = 1e-6
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            at = np.concatenate([rows[i] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            z = bias + np.bincount(of, weights[at], minlength=len(part))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[part]
            err = err * shares[part]
            step = np.bincount(at, err[of], minlength=size) / len(part)
            hit = np.flatnonzero(step)
            grads[hit] += step[hit] ** 2
            weights[hit] -= rate * step[hit] / np.sqrt(grads[hit])
            weights[hit] = np.sign(weights[hit]) * np.maximum(np.abs(weights[hit]) - rate * 0.001 / np.sqrt(grads[hit]), 0)
            b = err.mean()
            bias_grad += b * b
            bias -= rate * b / np.sqrt(bias_grad)
    weights[np.abs(weights) < 0.05] = 0
    return weights.astype(np.float32), float(bias)


def scores(texts: Texts, weights: np.ndarray, bias: float, lexicon: np.ndarray) -> np.ndarray:
    return np.array([1 / (1 + np.exp(-np.clip(bias + weights[r].sum(dtype=np.float64), -30, 30))) for r in feature_rows(texts, measured(texts, lexicon))], np.float64)


# -- over tables ----------------------------------------------------------------------------------
#: A row's place in the sample follows from a hash of its key, so that equal keys are chosen alike.
_PLACES = 1 << 40


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(_PLACES))


def sample_rates(counts: np.ndarray, rows: int) -> np.ndarray:
    """The share of each pattern to take, for about `rows` rows at most: half of them from all rows alike, half from the patterns alike."""
    if counts.sum() <= rows:
        return np.ones(len(counts))
    even = rows / 2 / counts.sum()
    low, high = 0.0, float(rows)
    for _ in range(60):  # the number of rows that each pattern gets beside its even share, as far as it has them
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(counts, even * counts + mid).sum() <= rows else (low, mid)
    return np.minimum(1.0, even + low / counts)


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "toxic") -> np.ndarray:
    """A flag for each bucket: common in labelled texts with the flag, rare in those without."""
    marked = labels.where(F.col(flag_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(flag_col) > 0).cast("int")).alias("flag"))
    n = marked.count()
    if not n:
        return np.zeros(2**BITS, bool)
    picked = lambda c: F.pmod(F.xxhash64(c, F.lit("sample")), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, LEXICON_ROWS / n)))
    rows = docs.where(picked(F.col(id_col).cast("long"))).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(marked.where(picked(F.col("id").cast("long"))).select(F.col("id").cast("long").alias("id"), "flag"), "id").select("flag", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((2, 2**BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts, flags = Texts(batch.column(1).slice(lo, hi - lo)), batch.column(0).slice(lo, hi - lo).to_numpy()
                for r, f in zip(feature_rows(texts, {}), flags, strict=True):
                    counts[f][r[r < 2**BITS]] += 1
                    total[f] += 1
        at = np.flatnonzero(counts.any(axis=0))
        cols = [np.concatenate([at, [-1]]), np.concatenate([counts[1][at], total[1:]]), np.concatenate([counts[0][at], total[:1]])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["bucket", "yes", "no"])
        release()

    sums = rows.mapInArrow(work, "bucket long, yes long, no long").groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    sums = stash(sums)
    total = sums.where("bucket < 0").first()
    out = np.zeros(2**BITS, bool)
    if total is not None:
        odds = F.col("yes") / max(total.yes, 1) / ((F.col("no") + 0.5) / max(total.no, 1))
        # no more than 2 ** BITS rows
        out[[r.bucket for r in sums.where((F.col("bucket") >= 0) & (F.col("yes") >= LEXICON_LEAST) & (odds >= LEXICON_ODDS)).select("bucket").toLocalIterator()]] = True
    return out


def voted(docs: DataFrame, lexicon: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place, code: the place in the sample and the pattern of votes of each document."""
    packed = np.packbits(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(packed).astype(bool)
        for batch in batches:
            codes = [votes(Texts(batch.column(1).slice(lo, hi - lo)), flags) @ _BASE for lo, hi in slices(batch.column(1))]
            made = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.astype(np.int64))], ["place", "code"])
        release()

    return docs.select(_place(id_col).alias("place"), F.col(text_col).alias("text")).mapInArrow(work, "place long, code long")


def vote_counts(voted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes and patterns of votes and how many documents have each, over all documents."""
    rows = voted.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes = np.array([r.code for r in rows], np.int64)
    return codes, (codes[:, None] // _BASE % 3).astype(np.int8), np.array([r.n for r in rows], np.float64)


class Model:
    """What scoring needs: the linear scorer and the lexicon. The labellers' chances are kept for reports."""

    def __init__(self, weights: np.ndarray, bias: float, lexicon: np.ndarray, chances: np.ndarray, share: float):
        self.weights, self.bias, self.lexicon, self.chances, self.share = weights, bias, lexicon, chances, share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    ship(docs.sparkSession)
    lexicon = learn_lexicon(docs, labels, id_col, text_col)
    pairs = stash(voted(docs, lexicon, id_col, text_col))
    codes, patterns, counts = vote_counts(pairs)
    if not len(counts):
        codes, patterns, counts = np.zeros(1, np.int64), np.zeros((1, len(LABELLERS)), np.int8), np.ones(1)
    posterior, chances, share = expectation_maximisation(patterns, counts)
    limits = (sample_rates(counts, TRAIN_ROWS) * _PLACES).astype(np.int64)
    packed = np.packbits(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts, places = Texts(batch.column(1).slice(lo, hi - lo)), batch.column(0).slice(lo, hi - lo).to_numpy()
                measures = measured(texts, flags)
                at = np.minimum(np.searchsorted(codes, votes(texts, measures) @ _BASE), len(codes) - 1)
                rows = [r.astype(np.int32).tobytes() for r in feature_rows(texts, measures)]
                # rows of one key may have several patterns
                made = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(rows, pa.binary())], ["pattern", "features"])
                yield made.filter(pa.array(places < limits[at]))
        release()

    # very long texts make large rows: the sample's features are bounded by rows, and fetched by partition
    sample = docs.select(_place(id_col).alias("place"), F.col(text_col).alias("text"))
    if (limits < _PLACES).any():
        bounds = docs.sparkSession.createDataFrame([(int(c), int(x)) for c, x in zip(codes, limits, strict=True)], "code long, bound long")
        chosen = pairs.join(F.broadcast(bounds), "code").where("place < bound").select("place").distinct()
        sample = sample.join(F.broadcast(chosen), "place", "left_semi")
    got = sample.mapInArrow(work, "pattern long, features binary").orderBy(F.xxhash64("features")).toLocalIterator()
    rows, found = [], []
    for r in got:
        rows.append(np.frombuffer(bytes(r.features), np.int32))
        found.append(r.pattern)
    found = np.array(found, np.int64)
    taken = np.maximum(np.bincount(found, minlength=len(codes)), 1)
    weights, bias = train_linear(rows, posterior[found], counts=(counts / taken)[found])
    rows.clear()  # the driver goes on to other work
    release()
    return Model(weights, bias, lexicon, chances, share)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (0 poor to 1 good) of each text, as the last column."""
    ship(docs.sparkSession)
    names, at = [*docs.columns, score_col], docs.columns.index(text_col)
    weights, bias, packed = model.weights.tobytes(), model.bias, np.packbits(model.lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flags = np.frombuffer(weights, np.float32), np.unpackbits(packed).astype(bool)
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(Texts(part.column(at)), own, bias, flags))], names)
        release()

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


#: Documents with a lower score are rejected.
THRESHOLD = 0.5


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier, fitted on them, doesn't reject."""
    rows = docs.select(whole_row(), "text")
    return scored(rows, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select(f"{ROW}.*")


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score and kept of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("kept"))


QUERIES = {"op10_classifier": op10_classifier}
ORACLE_SQL: dict[str, str] = {}
