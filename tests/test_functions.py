import pytest
from pyspark.sql import functions as F

from verbatlas.functions import providers as P
from verbatlas.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, want", [(None, ""), (" Run ", "run"), ("Ġrun", "run"), ("▁Run", "run"), ("Ġ▁ Run", "run"), ("ĠĠx", "ġx"), (" a\t", "a")])
def test_canonical_token(spark, value, want):
    assert one(spark, T.canonical_token, value) == want


@pytest.mark.parametrize("value, want", [("don't!", "dont"), (None, ""), ("Été-9", "été9")])
def test_word_characters(spark, value, want):
    assert one(spark, T.word_characters, value) == want


@pytest.mark.parametrize("value, seps, want", [("4-7", "-", (4, 7)), ("4:7", "-", None), ("4:7", "-:", (4, 7)), ("7-4", "-", None), ("a-b", "-", None), (None, "-", None), ("0-0", "-", (0, 0))])
def test_span(spark, value, seps, want):
    got = one(spark, lambda c: T.span(c, seps), value)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("sentence, a, b, want", [("She ran home.", 4, 7, " She <mask> home."), (" ran ", 1, 4, " <mask>"), ("She ran.", 4, 99, None), ("Go.", 0, 0, " <mask>Go.")])
def test_masked(spark, sentence, a, b, want):
    assert one(spark, lambda c: T.masked(c, F.lit(a), F.lit(b)), sentence) == want


@pytest.mark.parametrize("value, want", [("0.5", 0.5), (" 1e-3 ", 0.001), ("x", None), ("", None), (None, None)])
def test_number(spark, value, want):
    assert one(spark, T.number, value) == want


def test_ten_digits(spark):
    rows = spark.createDataFrame([(0.5,), (1 / 3,), (1e-12,), (None,), (100.0,)], "x double")
    assert [r[0] for r in rows.select(T.ten_digits("x")).collect()] == ["0.5", "0.3333333333", "1e-12", None, "100"]


@pytest.mark.parametrize("text, word, want", [("they ran off.", "ran", True), ("rerun it", "run", False), ("run!", "run", True), ("a+b c", "a+b", True), ("érun", "run", False), ("x", "\\E", False)])
def test_holds_word(spark, text, word, want):
    assert spark.createDataFrame([(text, word)], "t string, w string").select(T.holds_word("t", "w")).first()[0] is want


def test_tiles(spark):
    text = "ab, c\n" * 1000 + "end"
    got = one(spark, lambda c: T.tiles(c, P.WORD), text)
    assert "".join(x.text for x in got) == text
    assert all(text[x.start : x.start + len(x.text)] == x.text for x in got)
    assert one(spark, lambda c: T.tiles(c, P.WORD), None) == []


def test_sentences(spark):
    got = one(spark, lambda c: P.RuleSplitter().sentences(c), " One. Two!?  Three\n")
    assert [(s.start, s.text) for s in got] == [(1, "One."), (6, "Two!?"), (13, "Three")]


def test_tagger(spark):
    got = one(spark, lambda c: P.RuleTagger().tokens(c), "He is Jumping, red bed king.")
    assert [(t.i, t.start, t.pos, t.lemma) for t in got] == [(0, 0, "X", "he"), (1, 3, "AUX", "be"), (2, 6, "VERB", "jump"), (3, 15, "X", "red"), (4, 19, "X", "bed"), (5, 23, "VERB", "king")]


@pytest.mark.parametrize("lemma, want", [("run", ["run", "runs", "running", "ran"]), ("walk", ["walk", "walks", "walking", "walked"]), ("bake", ["bake", "bakes", "baking", "baked"]), ("carry", ["carry", "carries", "carrying", "carried"]), ("watch", ["watch", "watches", "watching", "watched"]), ("stop", ["stop", "stops", "stopping", "stopped"])])
def test_inflector(spark, lemma, want):
    assert one(spark, lambda c: P.RuleInflector().forms(c), lemma) == want


def test_arrow_providers(spark):
    def tagger():
        return lambda texts: [[(0, 0, t[:3], "VERB", t[:3].lower())] for t in texts]

    rows = spark.createDataFrame([("Ran off",), (None,)], "s string")
    got = rows.select(P.ArrowTagger(tagger).tokens("s").alias("t")).collect()
    assert [r.t[0].lemma for r in got] == ["ran", ""]

    def model():
        return lambda texts, k: [None if "<mask>" not in t else [("Run", 0.5), ("go", 0.25), ("x", 0.1)][:k] for t in texts]

    out = P.ArrowMaskedLM(model, batch=1).predict(spark.createDataFrame([(" a <mask>",), ("lost",)], "masked_text string"), 2).collect()
    assert [[(p.token, p.prob) for p in r.preds] for r in out] == [[("run", 0.5), ("go", 0.25)], [("", 0.0), ("", 0.0)]]
    with pytest.raises(RuntimeError):
        P.spacy_loader()()
    assert P.device() == "cpu"


def test_context_model_backs_off(spark):
    tri = spark.createDataFrame([("a", "x", "b"), ("a", "x", "b"), ("a", "y", "b"), ("a", "z", "c"), ("q", "y", "")], "left string, word string, right string")
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "?"), (3, "?", "?")], "id int, left string, right string")
    got = {r.id: [(p.token, round(p.prob, 4)) for p in r.preds] for r in P.ContextCountLM(tri).predict(rows, 2).collect()}
    assert got == {1: [("x", 0.6667), ("y", 0.3333)], 2: [("x", 0.5), ("y", 0.25)], 3: [("x", 0.4), ("y", 0.4)]}


def test_lemmas_by_distinct_token(spark):
    class Slow:
        by_distinct = True

        def lemma(self, word):
            return F.concat(word, F.lit("!"))

    rows = spark.createDataFrame([("Ġa",), ("A",), (None,)], "t string")
    assert sorted(r.l for r in P.lemmatized(rows, "t", Slow(), "l").collect()) == ["!", "a!", "a!"]


def test_driver_helpers():
    assert T.human_bytes(1536) == "1.5 KB" and T.human_bytes(12) == "12 B"
    assert T.sheet_title("a/b[c]" + "x" * 40) == "a_b_c_" + "x" * 25
    assert T.word_arguments("a, b\nc,,a") == ["a", "b", "c"]
    assert T.percent(5, 0) == 0 and T.percent(9, 3) == 100


class _Cutter:
    """Sentences of two words each."""

    @staticmethod
    def parse(texts):
        import re

        out = []
        for t in texts:
            own = [(m.start(), m[0], [(0, 0, m[0].split()[0], "VERB", m[0].split()[0].upper())]) for m in re.finditer(r"\S+ \S+", t)]
            out.append(own)
        return out


def test_pipeline_gives_sentences_and_tokens(spark):
    """A model that knows sentences cuts them; one that only tags gets those of the rule; both are loaded once for a worker."""
    from verbatlas.functions.providers import ArrowPipeline, ArrowTagger, CarriedTokens
    from verbatlas.operators import extract

    docs = spark.createDataFrame([("d", "a b c d. e f"), ("e", None), ("f", "")], "doc_id string, text string")
    rows = extract.verbs_of_documents(docs, "doc_id", "text", 8, 4, pipeline=ArrowPipeline(_Cutter), include_aux=False).collect()
    assert {(r.doc_id, r.sent_start, r.sentence, r.lemma) for r in rows} >= {("d", 0, "a b", "a"), ("d", 4, "c d.", "c"), ("d", 9, "e f", "e")}
    tag = lambda: lambda texts: [[(0, 0, t.split()[0], "VERB", t.split()[0])] for t in texts]
    chunks = docs.withColumnRenamed("text", "chunk_text").selectExpr("*", "0L as chunk_start")
    cut = extract.parsed_sentences(chunks, ArrowPipeline(tag))
    assert sorted((r.sent_start, r.sentence, r.tokens[0].text) for r in cut.collect()) == [(0, "a b c d.", "a"), (9, "e f", "e")]
    assert extract.verbs(cut, CarriedTokens()).count() == 2
    table = spark.createDataFrame([(1, "x y x y z"), (2, " ")], "row int, text string")
    assert [(r.sent_index, r.lemma) for r in extract.verbs_of_rows(table, "row", "text", pipeline=ArrowPipeline(_Cutter)).collect()] == [(0, "x")]


def test_loaders_run_once_for_each_worker(spark, tmp_path):
    from verbatlas.functions.providers import ArrowTagger
    from pyspark.sql import functions as F

    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[(0, 0, t, "VERB", t)] for t in texts]

    rows = spark.range(80).repartition(20).select(F.col("id").cast("string").alias("t"))
    assert rows.select(F.size(ArrowTagger(load).tokens("t")).alias("n")).agg(F.sum("n")).first()[0] == 80
    import os

    workers = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(workers) == len(set(workers)) < 20


def test_models_see_a_batch_in_pieces(spark, monkeypatch):
    """the tokens of a whole batch (10,000 texts) are never held at once, and only verbs leave the worker."""
    from verbatlas.functions import providers
    from verbatlas.operators import extract

    def load():
        def tag(texts: list[str]) -> list[list[tuple]]:
            assert len(texts) == 1 or sum(map(len, texts)) <= 262_144, "a batch is held whole"
            return [[(0, 0, t[:1], "X", t[:1]), (1, 1, t[1:3], "VERB", t[1:3])] if t else [] for t in texts]

        return tag

    rows = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.col("id").cast("string"), F.lit("abc" * 900))).alias("t"))
    tagger = providers.ArrowTagger(load)
    got = rows.select("id", tagger.tokens("t").alias("all"), tagger.verbs("t", False).alias("verbs")).collect()
    for r in got:
        assert [t.i for t in r["all"]] == ([0, 1] if r.id % 7 else []) and [t.i for t in r.verbs] == ([1] if r.id % 7 else [])
    docs = rows.withColumn("chunk_start", F.lit(0).cast("long"))
    kinds = {k: extract.parsed_sentences(docs, providers.ArrowPipeline(load), "t", kinds=k).select("id", F.transform("tokens", lambda x: x["i"]).alias("i")).collect() for k in (None, ("VERB",))}
    assert {len(x) for x in kinds.values()} == {257}
    assert {tuple(r.i) for r in kinds[None]} == {(0, 1)} and {tuple(r.i) for r in kinds["VERB",]} == {(1,)}


def test_texts_of_sentences(spark):
    """sentences without their starts are those with them."""
    text = " One. Two!?\u00a0 Three\n... .x"
    got = one(spark, lambda c: F.struct(P.RuleSplitter().sentences(c).alias("a"), P.RuleSplitter().texts(c).alias("b")), text)
    assert [x.text for x in got.a] == got.b


def test_models_run_once(spark):
    """an explode of what a model found runs it once; Spark infers a filter from it, which held a second run on the unspread files."""
    from verbatlas.operators import extract

    docs = spark.createDataFrame([("a b.",)], "t string").withColumn("chunk_start", F.lit(0).cast("long"))
    masks = docs.select(F.col("t").alias("masked_text"))
    for rows in (extract.parsed_sentences(docs, P.ArrowPipeline(None), "t"), P.ArrowMaskedLM(None).predict(masks, 1).select(F.explode("preds"))):
        assert rows._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1


def test_verbs_without_other_words(spark):
    """Verbs by one pattern are those among all tokens; other words pass no function of their own."""
    import random

    rng = random.Random(5)
    bits = ["is", "IS", "this", "being", "beings", "ed", "red", "Fred", "ring", "wing", "ing", "aing", "Running", "jumped", "edit", "mayor", "may", "\u0130s", "\u017fed", "did", "ed.ed", "x1ed", "doing", "was", "wasé", "éwas", "K", "\n", " ", "--", "'", "😀", "inged"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "is", "xx " * 5000 + "was", "xx " * 20_000]
    tagger = P.RuleTagger()
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for aux in (True, False):
        kinds = ["VERB", "AUX"] if aux else ["VERB"]
        for r in rows.select(F.filter(tagger.tokens("t"), lambda x: x["pos"].isin(*kinds)).alias("a"), tagger.verbs("t", aux).alias("b")).collect():
            assert r.a == r.b
    plan = rows.select(tagger.verbs("t", True))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^A-Za-z]+" not in plan
