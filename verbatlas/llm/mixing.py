"""Mixing sources to target weights by soft membership, in DataFrame functions only.

1. A naive Bayes classifier over hashed words is counted from a table of labelled rows (a bounded sample,
   TRAIN_ROWS) and gives each text a posterior over the domains, evened out for long texts, in steps of
   1 / STEPS.
2. The expected tokens of a domain are the sum over documents of rate * words * posterior. Projected
   gradient descent with momentum fits rates, zero or more, whose expected totals match the targets, in
   the least-squares sense. A document's gradient depends on its posterior alone, so documents are first
   summed up by posterior; each step is one distributed aggregation of a number for each domain, and the
   rates follow from the steps taken so far.
3. A rate becomes whole copies: its whole part, and one more with the chance of the rest, drawn by a hash
   of the doc_id.

Defined cases: a text without words (null too) has equal posteriors and no weight; with no labelled rows
every rate is 1; repeated rows get equal rates and copies; ties of posteriors go to the first domain by
name; an empty table gives an empty table; mix passes columns through whatever their names are; of more
than MOST_DOMAINS domains the rarer ones are taken together; texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm.rows import ROW, named, whole_row
from verbatlas.session import stash, table

SPACE = " \t\n\x0b\x0c\r"
TRAIN_ROWS = 20_000
BUCKETS = 4_096
#: Domains at most; with more of them, all but the most frequent are one domain, OTHERS.
MOST_DOMAINS, OTHERS = 64, "(others)"
#: Log-odds are whole multiples of 1 / SCALE. Two domains share a 64-bit sum, over SUMMED words at most, so
#: that neither half runs over: a word has fewer than 2 ** 12 multiples, as 64 is beyond any log-odds here.
SCALE, LARGEST, SUMMED = 64, 4_095, 1 << 20
#: Different posteriors up to which their rates are a broadcast table; beyond, each row computes its own.
BROADCAST_ROWS = 100_000
#: Posteriors that one task takes through the descent; more of them are dealt to more tasks. With one task a round has no shuffle.
ROUND_ROWS = 20_000
#: Words that count fully; the log-odds of longer texts are scaled down to as many.
EVIDENCE = 20
STEPS = 1_000
#: Targets that follow from the data: shares of the domains to this power.
TEMPER = 0.7
MOST_ROUNDS, TOLERANCE = 80, 1e-6
#: Rounds after which the rates so far are written, so that no round computes many earlier ones again.
STASHED_ROUNDS = 10
#: The descent ends when that many steps together lower the squared error by less than a thousandth.
PATIENCE = 6


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text_col: str) -> Column:
    core = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS))


@dataclass
class Classifier:
    """Domains by name, and for each pair of them the packed log-odds of each bucket."""

    domains: list[str]
    packed: list[list[int]]


def train(labelled: DataFrame, id_col: str, text_col: str, domain_col: str) -> Classifier:
    """Counts words by domain over labelled rows; about TRAIN_ROWS of them at most, by a hash of the id."""
    rows = labelled.where(F.col(domain_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > TRAIN_ROWS:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    rows = rows.select(F.col(domain_col).cast("string").alias("domain"), text_col)
    most = [r.domain for r in rows.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MOST_DOMAINS + 1).collect()]
    if len(most) > MOST_DOMAINS:
        rows = rows.withColumn("domain", F.when(F.col("domain").isin(most[: MOST_DOMAINS - 1]), F.col("domain")).otherwise(OTHERS))
    sums = stash(rows.select("domain", F.explode(words(text_col)).alias("w")).groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")))
    names = [r.domain for r in sums.select("domain").distinct().orderBy("domain").collect()]  # MOST_DOMAINS at most
    counts = np.full((len(names), BUCKETS), 0.5)
    for r in sums.collect():  # MOST_DOMAINS * BUCKETS rows at most
        counts[names.index(r.domain), r.b] += r.n
    if not names:
        return Classifier([], [])
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    whole = np.minimum(np.rint((logs - logs.min(axis=0)) * SCALE), LARGEST).astype(np.int64)
    if len(whole) % 2:
        whole = np.vstack([whole, np.zeros((1, BUCKETS), np.int64)])
    return Classifier(names, [(whole[k] + (whole[k + 1] << 32)).tolist() for k in range(0, len(whole), 2)])


def _looked_up(at: Column, values: Column) -> Column:
    """The sums of both halves of the values at the places given, in an array of two."""
    packed = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + F.element_at(values, i))
    low = lambda s: s.bitwiseAND(F.lit(2**32 - 1))
    halves = lambda s: F.array(low(s), F.shiftrightunsigned(s, 32))
    cuts = F.sequence(F.lit(0), F.floor((F.size(at) - 1) / F.lit(SUMMED)).cast("int"))
    long = F.aggregate(
        F.transform(cuts, lambda k: packed(F.slice(at, k * SUMMED + 1, SUMMED))),
        F.array(F.lit(0).cast("long"), F.lit(0).cast("long")),
        lambda a, s: F.array(a[0] + low(s), a[1] + F.shiftrightunsigned(s, 32)),
    )
    return F.when(F.size(at) <= SUMMED, _let(packed(at), halves)).otherwise(long)


def with_membership(docs: DataFrame, model: Classifier, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with <prefix>n_words and <prefix>part: for each domain its share of STEPS, about."""
    size = len(model.domains)

    def parts(at: Column) -> Column:
        # one literal for Spark's planner, not one for each bucket
        sums = [_looked_up(at, F.expr(f"cast(split('{','.join(map(str, packed))}', ',') as array<bigint>)")) for packed in model.packed]
        # both halves of each sum, as log-odds for EVIDENCE words at most
        damp = F.greatest(F.lit(1.0), F.size(at) / F.lit(float(EVIDENCE))) * float(SCALE)
        logits = F.transform(F.slice(F.flatten(F.array(*sums)), 1, size), lambda x: x / damp)
        weights = _let(logits, lambda x: _let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return _let(weights, lambda x: _let(total(x), lambda t: F.transform(x, lambda v: F.rint(v / t * STEPS).cast("int"))))

    made = words(text_col)
    if not size:
        return docs.withColumns({f"{prefix}n_words": F.size(made).cast("long"), f"{prefix}part": F.array().cast("array<int>")})
    both = lambda w: F.struct(F.size(w).alias("n"), _let(F.transform(w, lambda x: (_bucket(x) + 1).cast("int")), parts).alias("part"))
    out = docs.withColumn(f"{prefix}_m", _let(made, both))
    return out.withColumns({f"{prefix}n_words": F.col(f"{prefix}_m.n").cast("long"), f"{prefix}part": F.col(f"{prefix}_m.part")}).drop(f"{prefix}_m")


def _posterior(part: str) -> str:
    return f"transform({part}, x -> x / cast(aggregate({part}, 0, (a, v) -> a + v) as double))"


@dataclass
class Plan:
    """The steps of the descent: from them follows the rate of any posterior."""

    domains: list[str]
    start: np.ndarray
    targets: np.ndarray
    reached: np.ndarray
    steps: list[tuple[float, np.ndarray]]
    least: float
    #: Each posterior that occurs.
    parts: DataFrame | None = None

    def rated(self, members: DataFrame) -> DataFrame:
        """members (with part) with rate: computed once for each posterior, as long as there are few."""
        if self.parts is None or not self.steps or self.parts.count() > BROADCAST_ROWS:
            return members.withColumn("rate", self.rate("part"))
        return members.join(F.broadcast(stash(self.parts.select("part", self.rate("part").alias("rate")))), "part", "left")

    def rate(self, part: str) -> Column:
        if not self.steps:
            return F.greatest(F.lit(1.0), F.lit(self.least))
        num = lambda v: f"{float(v)!r}D"
        steps = ", ".join(f"named_struct('b', {num(b)}, 'g', array({', '.join(map(num, g))}))" for b, g in self.steps)
        return F.expr(
            f"transform(array({_posterior(part)}), p -> aggregate(array({steps}), named_struct('r', {num(max(1.0, self.least))}, 'q', {num(max(1.0, self.least))}), "
            f"(s, x) -> named_struct('r', greatest({num(self.least)}, s.r + x.b * (s.r - s.q) - aggregate(zip_with(p, x.g, (u, v) -> u * v), 0D, (a, v) -> a + v)), 'q', s.r), "
            "s -> round(s.r, 6)))[0]"
        )


def _dealt(groups: DataFrame) -> DataFrame:
    """A written table in no more pieces than a round of the descent needs tasks: the shuffle that made it may have left many."""
    pieces = 1 + groups.count() // ROUND_ROWS
    return stash(groups.coalesce(pieces)) if pieces < groups.rdd.getNumPartitions() else groups


def solve(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, least: float = 0.0) -> Plan:
    """Fits rates of `least` or more to (n_words, part) rows.

    targets: a weight for each domain; without them, the domains' own shares to the power TEMPER. The
    weights are scaled so that no domain needs to be thinned out on the whole.
    """
    size = len(domains)
    if not size:
        return Plan([], *(np.zeros(0),) * 3, [], least)
    groups = members.groupBy("part").agg(F.sum("n_words").cast("double").alias("t"))
    groups = _dealt(stash(groups.select("part", "t", F.expr(_posterior("part")).alias("p"))))
    # most posteriors hold few domains, so moments are summed over what is there: once for each pair
    first = groups.select("t", F.posexplode("p").alias("i", "x")).where("x > 0").groupBy("i").agg(F.sum(F.col("t") * F.col("x")).alias("s")).collect()
    pairs = groups.select("t", "p", F.posexplode("p").alias("i", "x")).where("x > 0").select("t", "i", "x", F.posexplode("p").alias("j", "y")).where("y > 0 and j >= i")
    start, second = np.zeros(size), np.zeros((size, size))
    for r in first:
        start[r.i] = r.s
    for r in pairs.groupBy("i", "j").agg(F.sum(F.col("t") * F.col("x") * F.col("y")).alias("s")).collect():  # size * size numbers at most
        second[r.i, r.j] = second[r.j, r.i] = r.s
    if targets is None:
        weights = np.where(start > 0, np.maximum(start, 1e-300) ** TEMPER, 0.0)
    else:
        weights = np.array([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    if not weights.sum() or not start.sum():
        return Plan(domains, start, start, start, [], least)
    weights = weights / weights.sum()
    at = weights > 0
    goal = weights * (start[at] / weights[at]).max()
    # each domain is measured by its own second moment; the step is safe for the largest eigenvalue
    scale = 1.0 / np.maximum(np.diag(second), 1e-9 * second.max())
    root = np.sqrt(scale)
    pace = 1.0 / np.linalg.eigvalsh(root[:, None] * second * root[None, :]).max()
    plan = Plan(domains, start, goal, start * max(1.0, least), [], least, groups.select("part"))
    before, moment, errors = plan.reached, 1.0, []
    # the rate of each posterior after the last two steps; one step is added in each round
    begin = F.lit(max(1.0, least))
    state = groups.select("t", "p", begin.alias("r"), begin.alias("q"))
    for turn in range(1, MOST_ROUNDS + 1):
        if np.abs(plan.reached - goal).max() <= TOLERANCE * goal.max():
            break
        after = (1 + math.sqrt(1 + 4 * moment * moment)) / 2
        push = (moment - 1) / after
        ahead = plan.reached + push * (plan.reached - before)  # totals are linear in the rates
        plan.steps.append((push, pace * scale * (ahead - goal)))
        slope = F.array(*(F.lit(float(x)) for x in plan.steps[-1][1]))
        down = F.aggregate(F.zip_with("p", slope, lambda u, v: u * v), F.lit(0.0), lambda x, v: x + v)
        state = state.select("t", "p", F.greatest(F.lit(float(least)), F.col("r") + push * (F.col("r") - F.col("q")) - down).alias("r"), F.col("r").alias("q"))
        if turn % STASHED_ROUNDS == 0:
            state = stash(state)
        weight = F.col("t") * F.round("r", 6)
        now = np.array([x or 0.0 for x in state.select(weight.alias("t"), "p").agg(*(F.sum(F.col("t") * F.col("p")[i]) for i in range(size))).first()])
        # momentum that leads away from the targets is dropped
        errors.append((scale * (now - goal) ** 2).sum())
        worse = errors[-1] > (scale * (plan.reached - goal) ** 2).sum()
        before, plan.reached, moment = plan.reached, now, 1.0 if worse else after
        if len(errors) > PATIENCE and min(errors[-PATIENCE:]) > 0.999 * min(errors[:-PATIENCE]):
            break
    return plan


def _copies(rate: Column, id_col: str) -> Column:
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1_000_000)) / 1_000_000.0
    return _let(rate, lambda r: (F.floor(r) + F.when(draw < r - F.floor(r), 1).otherwise(0)).cast("long"))


def labelled_by(docs: DataFrame, labels: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the table of labels holds, with their domain. Only a hashed sample of both sides meets.

    The share to take follows from the number of labels, so that the join is small at any size.
    """
    n = labels.count()
    share = max(1, int(1_000_000 * min(1.0, 2 * TRAIN_ROWS / max(n, 1))))
    picked = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("labelled")), F.lit(1_000_000)) < share
    ids = labels.where(picked & F.col(id_col).isNotNull()).select(F.col(id_col)).distinct()
    return docs.where(picked).select(id_col, text_col, domain_col).join(ids, id_col, "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with words, likeliest domain, its share, the fitted rate and the copies to take."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = train(labelled_by(docs, table(spark, sf_dir, "labels"), "lang"), "doc_id", "text", "lang")
    members = stash(with_membership(docs.select("doc_id", "text"), model).drop("text"))
    plan = solve(members, model.domains)
    names = F.expr(f"array({', '.join(repr(d) for d in model.domains)})") if model.domains else F.array().cast("array<string>")
    best = F.array_max("part")
    return plan.rated(members).select(
        "doc_id",
        "n_words",
        F.get(names, (F.array_position("part", best) - 1).cast("int")).alias("domain"),
        (best / F.lit(float(STEPS))).alias("membership"),
        "rate",
        _copies(F.col("rate"), "doc_id").alias("copies"),
    )


def mix(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, least: float = 1.0) -> DataFrame:
    """docs, each row as often as its rate says, with the same columns. With least = 1 no row is lost.

    Each text is classified once: the rows are written with their posteriors.
    """
    narrow = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(domain_col).alias("domain"))
    model = train(labelled_by(narrow, labels.select(named(id_col).alias("id")), "domain", "id"), "id", "text", "domain")
    rows = docs.select(whole_row(), named(id_col).alias("id"), named(text_col).alias("text"))
    members = stash(with_membership(rows, model).drop("text"))
    plan = solve(members.select("n_words", "part"), model.domains, targets, least)
    times = plan.rated(members).select(ROW, _copies(F.col("rate"), "id").alias("copies")).where("copies > 0")
    return times.select(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(f"{ROW}.*")


QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL: dict[str, str] = {}
