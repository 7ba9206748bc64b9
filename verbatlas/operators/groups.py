"""Semantic groups: probabilities of predictions summed by group, and means by lemma.

Groups are a long table (lemma, group, group_pos): a lemma may be in several groups. Two profiles differ
in their keys:

* standard: tokens and group lemmas are canonical and lemmatized; any probability counts; row lemmas are
  stripped and keep their case;
* fused: tokens lose all but word characters and are not lemmatized; group lemmas are stripped only; only
  probabilities above 0 count; row lemmas are treated as tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.functions.providers import Lemmatizer, RuleLemmatizer, lemmatized
from verbatlas.functions.text import canonical_token, number, strip, word_characters
from verbatlas.operators.frequency import running_count
from verbatlas.operators.naming import free_names, top_k_of
from verbatlas.session import stash

#: Rows of a group table up to which it is broadcast. Group tables are made by hand; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a group table up to which it becomes a constant map; beyond, it is joined. Both give the same rows.
INLINE_ROWS = 5_000


def labels_of(groups: DataFrame) -> list[str]:
    """Group labels in column order: the group table's columns, so a bounded list."""
    return [r.group for r in groups.groupBy("group").agg(F.min("group_pos").alias("p")).orderBy("p", "group").collect()]


def small(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups


def wide_to_array(df: DataFrame, out_col: str = "preds") -> DataFrame:
    """token_1, prob_1, ... as one array of (token, prob); cells that are no number get a null probability."""
    k = top_k_of(df.columns)
    pairs = [F.struct(F.coalesce(F.col(f"token_{i}").cast("string"), F.lit("")).alias("token"), number(F.col(f"prob_{i}").cast("string")).alias("prob")) for i in range(1, k + 1)]
    gone = {f"{name}_{i}" for i in range(1, k + 1) for name in ("token", "prob")}
    return df.select(*(c for c in df.columns if c not in gone), F.array(*pairs).alias(out_col))


def array_to_wide(df: DataFrame, k: int, preds_col: str = "preds") -> DataFrame:
    """The array as columns token_1, prob_1, ..., token_k, prob_k, in its place."""
    cells = [c for i in range(k) for c in (F.get(preds_col, F.lit(i))["token"].alias(f"token_{i + 1}"), F.get(preds_col, F.lit(i))["prob"].alias(f"prob_{i + 1}"))]
    return df.select(*(x for c in df.columns for x in (cells if c == preds_col else [c])))


def row_lemma(c: Column | str, profile: str = "standard") -> Column:
    return word_characters(c) if profile == "fused" else strip(c)


def group_sums(rows: DataFrame, groups: DataFrame, key_cols: list[str], profile: str = "standard", lemmatizer: Lemmatizer | None = None, preds_col: str = "preds") -> DataFrame:
    """key_cols, group, prob: the sum over the row's predictions in the group. Rows and groups without a hit are missing.

    One explode, one join with the small group table, one aggregation; a token in two groups counts fully
    in both.
    """
    flat = rows.select(*key_cols, F.explode(preds_col).alias("_p")).select(*key_cols, F.col("_p.token").alias("_token"), F.col("_p.prob").alias("_prob"))
    if profile == "fused":
        flat = flat.where(F.col("_prob") > 0).withColumn("_key", word_characters("_token"))
        table = groups.select(strip("lemma").alias("_key"), "group")
    else:
        flat = lemmatized(flat.where("_prob is not null"), "_token", lemmatizer or RuleLemmatizer(), "_key")
        table = lemmatized(groups, "lemma", lemmatizer or RuleLemmatizer(), "_key").select("_key", "group")
    table = table.where("_key != ''").distinct()
    return flat.join(small(table), "_key").groupBy(*key_cols, "group").agg(F.sum("_prob").alias("prob"))


def row_probabilities(rows: DataFrame, groups: DataFrame, profile: str = "standard", lemmatizer: Lemmatizer | None = None, lemma_col: str | None = "lemma", preds_col: str = "preds", count_active: bool = False) -> DataFrame:
    """rows (without empty lemmas; lemma_col None: all rows) with a column for each group: its summed probability, 0 without a hit.

    Columns are group_prob_<group> (standard) or <group> (fused), with _1, _2, ... where a name is taken.
    The group table becomes a constant map from key to groups, so that no row is exploded or shuffled;
    a lemmatizer that runs Python, or a large group table, takes the join of group_sums.
    """
    kept = rows if lemma_col is None else rows.where(row_lemma(lemma_col, profile) != "")
    labels = labels_of(groups)
    names = free_names("" if profile == "fused" else "group_prob_", labels, rows.columns)
    lem = lemmatizer or RuleLemmatizer()
    if groups.count() > INLINE_ROWS or getattr(lem, "by_distinct", False):
        keyed = stash(kept.withColumn("_row", F.monotonically_increasing_id()))  # both sides of the join must see the same numbers
        sums = group_sums(keyed, groups, ["_row"], profile, lem, preds_col).groupBy("_row").pivot("group", labels).agg(F.first("prob"))
        out = keyed.join(sums.select(F.col("_row").alias("_r"), *(F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(labels))), F.col("_row") == F.col("_r"), "left")
        out = out.select(*rows.columns, *(F.coalesce(f"_g{i}", F.lit(0.0)).alias(names[g]) for i, g in enumerate(labels)))
    else:
        if profile == "fused":
            table = groups.select(strip("lemma").alias("_key"), "group")
            key = lambda x: word_characters(x["token"])
            counted = lambda x: x["prob"] > 0
        else:
            table = lemmatized(groups, "lemma", lem, "_key").select("_key", "group")
            key = lambda x: F.lower(lem.lemma(canonical_token(x["token"])))
            counted = lambda x: x["prob"].isNotNull()
        members: dict[str, list[str]] = {}
        for r in table.where("_key != ''").distinct().collect():  # at most 5,000 rows
            members.setdefault(r.group, []).append(r._key)
        keyed = F.transform(F.filter(preds_col, counted), lambda x: F.struct(key(x).alias("k"), x["prob"].alias("prob")))
        out = kept.withColumn("_k", keyed)
        out = out.select(*rows.columns, *(_sum_if("_k", sorted(members.get(g, []))).alias(names[g]) for g in labels))
    if count_active:
        active = F.size(F.filter(F.array(*(F.col(f"`{names[g]}`") for g in labels)), lambda x: x > 0)) if labels else F.lit(0)
        out = out.withColumn("group_count", active)
    return out


def _sum_if(col: str, keys: list[str]) -> Column:
    if not keys:
        return F.lit(0.0)
    return F.aggregate(F.filter(col, lambda x: x["k"].isin(keys)), F.lit(0.0), lambda a, x: a + x["prob"])


def short_form(rows: DataFrame, group_names: list[str], order_col: str | None = None, lemma_col: str = "lemma") -> DataFrame:
    """lemma and the group columns; with order_col also lemma_count, the running count of the lemma in input order."""
    if not order_col:
        return rows.select(lemma_col, *group_names)
    return running_count(rows.select(lemma_col, *group_names, order_col), lemma_col, order_col, "lemma_count")


# -- means by lemma -------------------------------------------------------------------------------
def lemma_means(rows: DataFrame, group_cols: list[str], lemma_col: str = "lemma", order_col: str | None = None, times_col: str | None = None) -> DataFrame:
    """lemma, group, group_pos, mean, n, first_ord: the sum of the group's cells over all rows of the lemma.

    Cells that are empty or no number add 0 and still count in n. Rows without a lemma are left out. times_col: a row
    stands for so many equal ones.
    """
    cell = lambda c: F.coalesce(number(F.col(f"`{c}`").cast("string")), F.lit(0.0))
    order = F.col(order_col) if order_col else F.lit(0).cast("long")
    times = F.col(times_col).cast("long") if times_col else F.lit(1).cast("long")
    if not group_cols:
        raise ValueError("no group columns")
    sums = (
        rows.where(strip(lemma_col) != "")
        .groupBy(strip(lemma_col).alias("lemma"))
        .agg(F.sum(times).alias("n"), F.min(order).alias("first_ord"), *(F.sum(cell(c) * times).alias(f"_s{i}") for i, c in enumerate(group_cols)))
    )
    parts = F.array(*(F.struct(F.lit(c).alias("group"), F.lit(i).alias("group_pos"), (F.col(f"_s{i}") / F.col("n")).alias("mean")) for i, c in enumerate(group_cols)))
    return sums.select("lemma", "n", "first_ord", F.explode(parts).alias("x")).select("lemma", "x.group", "x.group_pos", "x.mean", "n", "first_ord")


def best_groups(means: DataFrame, threshold: float = 0.5) -> DataFrame:
    """lemma, best, mean, second, is_ambiguous, n, first_ord.

    The best group has the largest mean, the earlier column in a tie; a lemma is ambiguous if its best mean
    is above 0 and the runner-up reaches the threshold's share of it. A lone group's runner-up is 0.
    """
    return _best(means, threshold).drop("group_pos")


def _best(means: DataFrame, threshold: float) -> DataFrame:
    """best_groups with the group_pos of the best one."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("m"), "group_pos", "group")))
    best = means.groupBy("lemma").agg(ordered.alias("x"), F.max("n").alias("n"), F.min("first_ord").alias("first_ord"))
    top = -F.get("x", F.lit(0))["m"]
    second = F.coalesce(-F.get("x", F.lit(1))["m"], F.lit(0.0))
    return best.select("lemma", F.get("x", F.lit(0))["group"].alias("best"), top.alias("mean"), second.alias("second"), ((top > 0) & (second >= threshold * top)).alias("is_ambiguous"), "n", "first_ord", F.get("x", F.lit(0))["group_pos"].alias("group_pos"))


def groups_ranked(means: DataFrame, threshold: float = 0.5) -> DataFrame:
    """group, group_pos, rank, lemma, mean, is_ambiguous: the lemmas that have the group as their best one, largest mean first.

    Equal means keep the order of first appearance. Ranks are running counts in a sorted table: see ranked.
    """
    return ranked(_best(means, threshold).withColumnRenamed("best", "group"))


def ranked(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc("mean"), "first_ord", "lemma"))
    return rows.withColumn("rank", rank).select("group", "group_pos", "rank", "lemma", "mean", "is_ambiguous")


def ragged(rows: DataFrame, labels: list[str], group_col: str, value_col: str, rank_col: str) -> DataFrame:
    """Lists of different length as columns: a row for each rank, empty cells where a list is over."""
    out = rows.groupBy(rank_col).pivot(group_col, labels).agg(F.first(F.col(value_col).cast("string")))
    return out.na.fill("").orderBy(rank_col)


def members_of(groups: DataFrame) -> DataFrame:
    """group, lemmas: sorted and without repeats."""
    return groups.where("lemma != ''").groupBy("group").agg(F.min("group_pos").alias("group_pos"), F.sort_array(F.collect_set("lemma")).alias("lemmas"))
