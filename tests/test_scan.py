"""Words found in the bytes of a batch, against the expressions of the built-in splitter and tagger."""

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import providers as P
from verbatlas.functions import scan
from verbatlas.operators import extract, groups

TEXTS = [
    None, "", "...", "He is Jumping. (was)  it?!  Bed, walked", "  Ünïcode was 　\u0085.   iséended ing \U0001f600 being!", "is", "is.", ".is", "a\x1cis \x0b was",
    "no end " * 50 + "king", "Is IS iS. x is x. x are x. x are x", "walked\r\nwas. \t\x0cdone", "é is", "ended" * 40, "Â\u0085x", "    ",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("size", [1, 60, 1_000_000])
def test_verbs_and_trigrams_as_by_expressions(docs, monkeypatch, size):
    """The same verbs, places, neighbours and sentences as RuleSplitter and RuleTagger give."""
    monkeypatch.setattr(scan, "SLICE", size)
    names = ["doc_id", "sent_start", "token_index", "lemma", "left", "right", "sentence"]
    sents = extract.sentences(docs.withColumn("chunk_start", F.lit(0)), "text")
    want = sorted(tuple(r) for r in extract.with_context(extract.verbs(sents)).select(*names).collect())
    assert sorted(tuple(r) for r in extract.verbs_in_context(docs, ["doc_id"]).select(*names[:-1]).collect()) == [w[:-1] for w in want]
    some = ["be", "end"]
    assert sorted(tuple(r) for r in extract.verbs_in_context(docs, ["doc_id"], lemmas=some).select(*names).collect()) == [w for w in want if w[3] in some]
    keys = ["left", "right", "word"]
    counted = scan.trigram_counts(docs, "text", keys[:2], None).groupBy(*keys).agg(F.sum("c")).collect()
    assert sorted(map(tuple, counted)) == sorted(map(tuple, extract.word_trigrams(docs).groupBy(*keys).count().collect()))


def test_lemmas_of_words(spark):
    words = ["is", "king", "ing", "bed", "ended", "ed", "sing", "been", "x", "walking"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.l for r in rows.select(P.RuleLemmatizer().lemma(F.col("w")).alias("l")).collect()] == [P.RuleLemmatizer().lemma_of(w) for w in words]


def test_marks_fold_and_lose_no_key(spark, monkeypatch):
    rows = spark.range(3_000).select(F.concat(F.lit("w"), "id").alias("left"), F.when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("right"))
    docs = rows.select(F.regexp_replace(F.concat_ws(" x ", F.translate("left", "0123456789", "abcdefghij"), F.lit("y")), "$", ".").alias("text"))
    wanted = extract.word_trigrams(docs).where("word = 'x'").select("left", "right").where("left < 'wcf'").distinct()
    for least in (6, 20, 27):
        monkeypatch.setattr(scan, "LEAST_BITS", least)
        marks = scan.marked(wanted, ["left", "right"])
        assert least <= marks[1] <= 27 and len(marks[0].value) == 1 << (marks[1] - 6)
        found = scan.trigram_counts(docs, "text", ["left", "right"], marks)
        assert found.join(wanted, ["left", "right"], "left_semi").where("word = 'x'").count() == wanted.count()
        assert found.where("word = 'x'").count() < wanted.count() + 300
    assert scan.marked(rows, ["left", "right"])[1] <= 27  # nulls count as empty


def test_models_over_texts(spark, docs):
    """the same lists by texts as by trigrams, with every step back; and in one pass for the texts' own verbs."""
    rows = spark.createDataFrame([("x", "x"), ("", ""), ("x", "nowhere"), ("nowhere", ""), (None, "x"), ("it", None)], "left string, right string")
    by_texts, by_rows = P.TextCountLM(docs), P.ContextCountLM(extract.word_trigrams(docs))
    key = lambda found: sorted(map(repr, found.collect()))
    assert key(by_texts.predict(rows, 3)) == key(by_rows.predict(rows, 3))
    verbs = extract.verbs_in_context(docs, ["doc_id"])
    names = [*verbs.columns, "preds"]
    assert key(by_texts.predict_own(verbs, 3, P.wanted_verbs()).select(*names)) == key(by_rows.predict(verbs, 3).select(*names))


def test_groups_once_for_each_context(spark):
    """F8: group sums are taken from a context's list, before it meets its rows."""
    tri = spark.createDataFrame([("a", "is", "b"), ("a", "y", "b"), ("q", "was", "b")], "left string, word string, right string")
    table = spark.createDataFrame([("be", "being", 0)], "lemma string, group string, group_pos int")
    seen = []

    def derive(lists):
        seen.append(lists.count())
        return groups.row_probabilities(lists, table, lemma_col=None).drop("preds")

    rows = spark.createDataFrame([(i, "a", "b") for i in range(20)], "id int, left string, right string")
    out = P.ContextCountLM(tri).predict(rows, 5, derive=derive)
    assert seen == [1] and [r.group_prob_being for r in out.collect()] == [0.5] * 20


def test_ranks_read_the_means_once(spark):
    """the means, which stand for the whole prediction, are not computed a second time for the groups' places."""
    means = spark.createDataFrame([("a", "g", 0, 0.5, 2, 1), ("a", "h", 1, 0.25, 2, 1), ("b", "h", 1, 0.5, 1, 2), ("b", "g", 0, 0.0, 1, 2)], "lemma string, group string, group_pos int, mean double, n long, first_ord long")
    out = groups.groups_ranked(means)
    assert sorted(tuple(r) for r in out.collect()) == [("g", 0, 1, "a", 0.5, True), ("h", 1, 1, "b", 0.5, False)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_own_words_by_context(spark, docs):
    """a row for each verb of a context, with its count, tells the same as a row for each place."""
    lm = P.TextCountLM(docs)
    verbs = extract.verbs_in_context(docs, ["doc_id"])
    names = ["left", "right", "lemma", "preds"]
    want = sorted(repr(tuple(r)) for r in lm.predict_own(verbs, 3, P.wanted_verbs()).select(*names).collect())
    own = lm.own_contexts(3, P.wanted_verbs(), P.RuleTagger.is_verb_column).withColumn("lemma", P.RuleLemmatizer().lemma(F.col("word")))
    got = own.select(*names, "c").collect()
    assert sorted(repr(tuple(r)[:-1]) for r in got for _ in range(r.c)) == want and any(r.c > 1 for r in got)


def test_means_join_no_places(spark):
    """means come from counts; no row for each verb is made, shuffled or joined."""
    from verbatlas.queries import QUERIES

    for name in ("lemma_group_means", "lemma_best_group", "lemma_ambiguous"):
        assert "Join" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_means_of_rows_with_times(spark):
    rows = spark.createDataFrame([("a", "0.5", 3), ("a", None, 1), (" ", "1", 9), ("b", "x", 2)], "lemma string, g string, c int")
    assert sorted((r.lemma, r["mean"], r.n) for r in groups.lemma_means(rows, ["g"], times_col="c").collect()) == [("a", 0.375, 4), ("b", 0.0, 2)]
