"""Physical plans that matter at scale."""

from pyspark.sql import functions as F

from verbatlas.operators import frequency
from verbatlas.queries import QUERIES
from verbatlas.session import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filter_reads_one_column_for_the_counts_and_makes_no_window(spark):
    rows = table(spark, SF, "lineitem").select("l_orderkey", "l_partkey")
    text = plan(frequency.filter_by_count(rows, "l_partkey", least=3))
    assert "ReadSchema: struct<l_partkey:bigint>" in text and "Window" not in text


def test_predicates_reach_the_scan(spark):
    rows = table(spark, SF, "lineitem").where(F.col("l_partkey") > 10).select("l_partkey")
    assert "PushedFilters: [IsNotNull(l_partkey), GreaterThan(l_partkey,10)]" in plan(frequency.counts(rows, "l_partkey"))


def test_text_queries_stay_in_the_jvm(spark):
    for name in ("verb_lemma_counts", "verb_occurrences", "group_prob_rows", "text_verb_group_counts", "spell_auto", "inflection_match"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text and "ArrowEval" not in text, name


def test_row_counts_take_no_shuffle(spark):
    text = plan(QUERIES["text_verb_group_counts"](spark, SF))
    assert "Exchange" not in text.split("== Physical Plan ==")[1]


def test_sample_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in plan(frequency.sample(table(spark, SF, "documents"), 5, "doc_id"))
