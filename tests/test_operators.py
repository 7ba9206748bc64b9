import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatlas.functions.providers import RuleTagger
from verbatlas.operators import extract, frequency, groups, naming, spelling, textgroups
from verbatlas.plans import workflow
from verbatlas.plans.rowpred import PredicateError, compile_predicate
from verbatlas.sources import grouptables


@pytest.mark.parametrize("n, size, overlap, want", [(2500, 1000, 100, [(0, 1000), (900, 1000), (1800, 700)]), (1000, 1000, 100, [(0, 1000)]), (1001, 1000, 100, [(0, 1000), (900, 101)]), (0, 1000, 100, []), (25, 10, 0, [(0, 10), (10, 10), (20, 5)])])
def test_chunks(spark, n, size, overlap, want):
    df = spark.createDataFrame([(1, "x" * n)], "id int, text string")
    got = extract.char_chunks(df, "text", size, overlap).orderBy("chunk_start").collect()
    assert [(r.chunk_start, len(r.chunk_text)) for r in got] == want


def test_chunk_arguments(spark):
    df = spark.createDataFrame([(1, "a\r\nb")], "id int, text string")
    with pytest.raises(ValueError):
        extract.char_chunks(df, "text", 1000, 1000)
    assert extract.char_chunks(df, "text", 10, 0).first().chunk_text == "a\nb"


def keys(spark, ks):
    return spark.createDataFrame([(1, i, k, s) for i, (k, s) in enumerate(ks)], "doc int, chunk_start long, sent_start long, sentence string")


def test_unique_sentences(spark):
    got = extract.unique_sentences(keys(spark, [(0, "A."), (3, "B."), (3, "B."), (6, "B.")]), ["doc"]).orderBy("sent_index").collect()
    assert [(r.sent_start, r.sentence, r.sent_index) for r in got] == [(0, "A.", 0), (3, "B.", 1), (6, "B.", 2)]


def test_bounded_memory_forgets(spark):
    ks = [(1, "a"), (2, "b"), (3, "c"), (1, "a")]
    got = extract.bounded_unique_sentences(keys(spark, ks), ["doc"], 2).orderBy("sent_index").collect()
    assert [r.sent_start for r in got] == [1, 2, 3, 1]
    assert extract.bounded_unique_sentences(keys(spark, ks), ["doc"], 10).count() == 3


def test_chunked_equals_whole_without_edge_fragments(spark):
    rng = random.Random(3)
    text = " ".join(" ".join(rng.choice(["is", "jumped", "running", "cat", "of"]) for _ in range(rng.randint(2, 9))).capitalize() + "." for _ in range(80))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    whole = {(r.sent_start, r.sentence) for r in extract.sentences(extract.char_chunks(docs, "text", 10**6, 0)).collect()}
    chunks = extract.sentences(extract.char_chunks(docs, "text", 300, 120))
    cut = {(r.sent_start, r.sentence) for r in extract.unique_sentences(chunks, ["doc_id"]).collect()}
    assert whole <= cut
    assert {(r.sent_start, r.sentence) for r in extract.unique_sentences(chunks, ["doc_id"], drop_edge_fragments=True).collect()} == whole


def test_spans_point_at_the_word(spark):
    docs = spark.createDataFrame([(1, "The dog jumped. Éva is Running ; it was.")], "doc_id int, text string")
    got = extract.verbs_of_documents(docs).orderBy("sent_index", "token_index").collect()
    assert [r.sentence[r.span.start : r.span.end].lower() for r in got] == [r.surface_lower for r in got] == ["jumped", "is", "running", "was"]
    assert [r.lemma for r in extract.verbs_of_documents(docs, include_aux=False).collect()] == ["jump", "runn"]


def test_rows_with_text(spark):
    rows = spark.createDataFrame([(1, "It is. It is. Was.", "x"), (2, " ", "y"), (3, None, "z")], "n long, text string, extra string")
    got = extract.verbs_of_rows(rows, "n", "text").orderBy("sent_index").collect()
    assert [(r.n, r.lemma, r.sent_index, r.extra) for r in got] == [(1, "be", 0, "x"), (1, "be", 1, "x")]


def values(spark):
    return spark.createDataFrame(list(enumerate(["a", "a", "a", "b", "b", "c", "", "Run", "run"])), "row_ord long, v string")


def test_counts_and_filters(spark):
    df = values(spark)
    assert [tuple(r) for r in frequency.counts(df, "v", "row_ord").collect()] == [("a", 3), ("b", 2), ("c", 1), ("", 1), ("Run", 1), ("run", 1)]
    f = lambda **k: sorted(r.row_ord for r in frequency.filter_by_count(df, "v", **k).collect())
    assert f(least=2) == [0, 1, 2, 3, 4] and f(most=1) == [5, 6, 7, 8] and f(least=2, most=2) == [3, 4]
    for bad in ({}, {"least": 3, "most": 2}, {"least": 0}):
        with pytest.raises(ValueError):
            frequency.filter_by_count(df, "v", **bad)
    assert tuple(frequency.distinct_values(df, "v").first()) == (6, 9)
    nulls = spark.createDataFrame([(None,), (None,), ("x",)], "v string")
    assert frequency.filter_by_count(nulls, "v", least=2).count() == 2


def test_samples(spark):
    df = values(spark)
    for draw in (lambda n, s=1: frequency.sample(df, n, "row_ord", s), lambda n, s=1: frequency.sample_like_python(df, n, s)):
        assert draw(0).count() == 0 and draw(9).count() == 9
        assert {r.row_ord for r in draw(4).collect()} == {r.row_ord for r in draw(4).collect()}
        for n in (10, -1):
            with pytest.raises(ValueError):
                draw(n)
    assert [r.row_ord for r in frequency.sample_like_python(df, 4, 5).collect()] == sorted(random.Random(5).sample(range(9), 4))


def test_running_count(spark, monkeypatch):
    monkeypatch.setattr(frequency, "RUN_BLOCK", 3)
    rng = random.Random(2)
    seq = [rng.choice(["x", "y", None]) for _ in range(60)]
    got = frequency.running_count(spark.createDataFrame(list(enumerate(seq)), "o long, v string"), "v", "o", "n").orderBy("o").collect()
    assert [r.n for r in got] == [seq[: i + 1].count(v) for i, v in enumerate(seq)]


PREDS = [("run", [("running", 0.5), ("walk", 0.2), ("the", 0.1)]), ("run", [("thinks", 0.4), ("ran", 0.3), ("", 0.2)]), ("think", [("know", 0.6), ("think", 0.3), ("abc", None)]), ("", [("run", 0.9), ("walk", 0.1), ("a", 0.0)])]
LEMMAS = {"running": "run", "ran": "run", "thinks": "think"}


def predictions(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(PREDS)]
    return spark.createDataFrame(rows, "row_ord long, lemma string, preds array<struct<token:string,prob:double>>")


def two_groups(spark):
    return grouptables.from_columns(spark, {"motion": ["run", "walk"], "cognition": ["think", "know"]})


def test_row_probabilities(spark):
    from verbatlas.functions.providers import TableLemmatizer

    lem = TableLemmatizer(LEMMAS)
    got = groups.row_probabilities(predictions(spark), two_groups(spark), lemmatizer=lem).orderBy("row_ord")
    assert [(round(r.group_prob_motion, 9), round(r.group_prob_cognition, 9)) for r in got.collect()] == [(0.7, 0), (0.3, 0.4), (0, 0.9)]
    short = groups.short_form(got, ["group_prob_motion", "group_prob_cognition"], "row_ord").orderBy("row_ord").collect()
    assert [r.lemma_count for r in short] == [1, 2, 1]
    lem.by_distinct = True  # the way by a join
    joined = groups.row_probabilities(predictions(spark), two_groups(spark), lemmatizer=lem).orderBy("row_ord").collect()
    assert [(round(r.group_prob_motion, 9), round(r.group_prob_cognition, 9)) for r in joined] == [(0.7, 0), (0.3, 0.4), (0, 0.9)]
    taken = groups.row_probabilities(predictions(spark).withColumn("group_prob_motion", F.lit(1)), two_groups(spark))
    assert "group_prob_motion_1" in taken.columns
    both = grouptables.from_columns(spark, {"a": ["walk"], "b": ["walk", "the"]})
    r = groups.row_probabilities(predictions(spark), both).where("row_ord = 0").first()
    assert (r.group_prob_a, round(r.group_prob_b, 9)) == (0.2, 0.3)


def test_fused_profile(spark):
    got = groups.row_probabilities(predictions(spark), two_groups(spark), "fused", count_active=True).orderBy("row_ord").collect()
    assert [(r.motion, round(r.cognition, 9), r.group_count) for r in got] == [(0.2, 0, 1), (0, 0, 0), (0, 0.9, 1)]


def test_means_best_and_ranks(spark):
    rows = spark.createDataFrame([(0, "run", "0.7", "0"), (1, "run", "0.3", "0.4"), (2, "think", "0", "0.9"), (3, " ", "1", "1")], "row_ord long, lemma string, motion string, cognition string")
    means = groups.lemma_means(rows, ["motion", "cognition"], order_col="row_ord")
    got = {(r.lemma, r.group): (round(r["mean"], 9), r.n) for r in means.collect()}
    assert got == {("run", "motion"): (0.5, 2), ("run", "cognition"): (0.2, 2), ("think", "motion"): (0, 1), ("think", "cognition"): (0.9, 1)}
    flags = lambda t: {r.lemma: (r.best, r.is_ambiguous) for r in groups.best_groups(means, t).collect()}
    assert flags(0.4) == {"run": ("motion", True), "think": ("cognition", False)} and flags(0.5)["run"] == ("motion", False)
    with pytest.raises(ValueError):
        groups.best_groups(means, 1.5)
    table = groups.ragged(groups.groups_ranked(means), ["motion", "cognition"], "group", "lemma", "rank").collect()
    assert [(r.motion, r.cognition) for r in table] == [("run", "think")]


def test_unusable_cells_count_as_zero(spark):
    rows = spark.createDataFrame([("a", "0.4"), ("a", ""), ("a", "x"), ("z", "0"), ("b", "0.2")], "lemma string, g string")
    means = {r.lemma: (r["mean"], r.n) for r in groups.lemma_means(rows, ["g"]).collect()}
    assert means["a"] == (pytest.approx(0.4 / 3), 3)
    best = {r.lemma: (r.best, r.second, r.is_ambiguous) for r in groups.best_groups(groups.lemma_means(rows, ["g"]), 0).collect()}
    assert best["z"] == ("g", 0.0, False)


def test_wide_and_array(spark):
    df = spark.createDataFrame([("s", "a", "0.5", "b", "x"), ("t", None, "1", "c", "2")], "lemma string, token_1 string, prob_1 string, token_2 string, prob_2 string")
    arr = groups.wide_to_array(df)
    assert [[tuple(p) for p in r.preds] for r in arr.collect()] == [[("a", 0.5), ("b", None)], [("", 1.0), ("c", 2.0)]]
    assert groups.array_to_wide(arr, 2).columns == df.columns


def test_names():
    assert naming.free_name("a", ["a", "a_1"]) == "a_2"
    assert naming.top_k_of([" token_1", "prob_1", "token_2", "prob_2"]) == 2
    for bad in (["x"], ["prob_2", "token_2"]):
        with pytest.raises(ValueError):
            naming.top_k_of(bad)
    assert naming.group_columns(["token_1", "prob_1", "g", " "]) == ["g"]
    assert naming.bound_columns(["a"], ["lemma", "a"]) == {"a": "a"} and naming.bound_columns(["a"], ["﻿a"]) == {"a": "﻿a"}
    with pytest.raises(ValueError):
        naming.free_names("", ["x", "x"], [])


def truth(spark, expression, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    return df.select(compile_predicate(expression, df.columns).alias("y")).first().y


@pytest.mark.parametrize("expression, row, want", [
    ('{{s}} == "ok"', {"s": "ok"}, True), ('{{ s }} in ["a","b"] and not {{t}}', {"s": "a", "t": ""}, True), ('"b" in {{s}}', {"s": "abc"}, True),
    ('"1" < {{n}} < "3"', {"n": "25"}, True), ('{{missing}} == ""', {"s": "x"}, True), ("{{n}} == 1", {"n": "1"}, False), ('{{n}} != "1" or {{n}}', {"n": "1"}, True),
    ('{{s}} not in ("x",)', {"s": None}, True), ("1 < 2 <= 2", {"s": "x"}, True), ("not {{s}}", {"s": None}, True), ("[] or None", {"s": "x"}, False), ('{{a b}} == "q"', {"a b": "q"}, True),
])
def test_predicates(spark, expression, row, want):
    assert truth(spark, expression, **row) is want


@pytest.mark.parametrize("bad", ["{{n}} > 10", "len({{s}}) > 1", "{{n}} == -1", "{{s}}.x", "1 +", "{{s}} is None", "f'{1}'", "{{s}} + 'a'", "1 in 2", "x"])
def test_predicates_outside_the_language(bad):
    with pytest.raises(PredicateError):
        compile_predicate(bad, ["s", "n"])


ATOMS = st.sampled_from(["{{a}}", "{{b}}", '"x"', '"y"', '""'])
COMPARISONS = st.tuples(ATOMS, st.sampled_from(["==", "!=", "<", "<=", ">", ">=", "in", "not in"]), ATOMS).map(" ".join)
EXPRESSIONS = st.recursive(COMPARISONS, lambda e: st.one_of(st.tuples(e, st.sampled_from(["and", "or"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), e.map(lambda x: f"(not {x})")), max_leaves=5)


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(EXPRESSIONS)
def test_compiled_equals_interpreted(spark, expression):
    rows = [(a, b) for a in ("x", "", "xy", None) for b in ("y", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.y for r in df.select(compile_predicate(expression, df.columns).alias("y")).collect()]
    want = [bool(eval(expression.replace("{{a}}", repr(a or "")).replace("{{b}}", repr(b or "")))) for a, b in rows]  # noqa: S307
    assert got == want


def test_verb_group_counts(spark, monkeypatch):
    rows = spark.createDataFrame([("It is jumped and walked", "u"), ("", "u"), ("was", "v"), (None, "u")], "text string, kind string")
    table = grouptables.from_columns(spark, {"move": ["jump", "walk"], "be": ["be", "jump"]})
    got = textgroups.verb_group_counts(rows, table)
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(0, 0, 0), (0, 0, 0), (1, 0, 1), (3, 2, 2)]
    assert textgroups.verb_group_counts(rows, table, where='{{kind}} == "v"').count() == 1
    assert tuple(textgroups.run_statistics(got).first()) == (4, 2, 2, 4, 5)
    monkeypatch.setattr(textgroups, "INLINE_LEMMAS", 0)
    assert sorted(tuple(r)[2:] for r in textgroups.verb_group_counts(rows, table).collect()) == [(0, 0, 0), (0, 0, 0), (1, 0, 1), (3, 2, 2)]


def test_lookup(spark):
    rows = predictions(spark).withColumn("sentence", F.concat(F.lit("s"), "row_ord"))
    got = textgroups.lookup(rows, [" Run ", "think"], "row_ord", limit=2, top_k=5).collect()
    assert [(r.sentence, len(r.preds)) for r in got] == [("s0", 3), ("s1", 2)]
    by = textgroups.by_lemma(textgroups.lookup(rows, ["run", "think"], "row_ord"), "row_ord").collect()
    assert [(r.lemma, r.n, r.sentences) for r in by] == [("RUN", 2, ["s0", "s1"]), ("THINK", 1, ["s2"])]
    assert textgroups.lookup(rows, [], "row_ord").count() == 0


def test_inflections(spark):
    freqs = spark.createDataFrame([("run", "12"), ("be", "99"), ("go", "9"), ("x", "?")], "lemma string, freq string")
    lemmas = textgroups.qualifying_lemmas(freqs)
    assert [r.lemma for r in lemmas.collect()] == ["run"]
    clauses = spark.createDataFrame([("run", "They ran off."), ("run", "He ran and runs."), ("run", "Rerun it."), ("run", "RUN!"), ("go", "go")], "lemma string, sentence_text string")
    got = textgroups.inflection_matches(clauses, lemmas).collect()
    assert [(r.sentence_text, r.inflected_form) for r in got] == [("They ran off.", "ran"), ("RUN!", "run")]


def test_spelling(spark):
    known = spark.createDataFrame([("the", 5), ("cat", 2), ("sat", 1), ("ten", 9)], "word string, freq int")
    ignored = spark.createDataFrame([("xyzzy",)], "word string")
    rows = spark.createDataFrame([(1, "Teh,  teh xyzzy (sat) ..."), (2, ""), (3, None)], "id int, text string")
    fixes = spark.createDataFrame([("teh", "the")], "word string, replacement string")
    got = {r.id: (r.corrected, r.corrections, r.words_checked) for r in spelling.corrected(rows, "id", "text", fixes, known, ignored).collect()}
    assert got == {1: ("the, the xyzzy (sat) ...", 2, 4), 2: ("", 0, 0), 3: ("", 0, 0)}
    words = spelling.unknown_words(spelling.checked_tokens(rows, "id", "text"), known, ignored)
    assert [r.word for r in words.collect()] == ["teh"]
    assert [(r.word, r.suggestions) for r in spelling.suggestions(words, known).collect()] == [("teh", ["ten", "the"])]
    decided = spark.createDataFrame([("teh", "replace", "the"), ("qqq", "add", ""), ("zz", "ignore", "")], "word string, action string, replacement string")
    out, more, less = spelling.apply_decisions(rows, "id", "text", decided, known, ignored)
    assert out.where("id = 1").first().corrected == "the, the xyzzy (sat) ..."
    assert {r.word for r in more.collect()} >= {"qqq", "the"} and {r.word for r in less.collect()} == {"xyzzy", "zz"}
    assert spelling.output_mode(out, "text", "corrected", "single-column").columns == ["text_corrected"]


def test_suggestions_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 6)))
    have, asked = sorted({word() for _ in range(40)}), sorted({word() for _ in range(12)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    known = spark.createDataFrame([(w, len(w)) for w in have], "word string, freq int")
    got = {r.word: r.suggestions for r in spelling.suggestions(spark.createDataFrame([(w,) for w in asked], "word string"), known).collect()}
    for w in asked:
        near = sorted((edits(w, k), -len(k), k) for k in have if k != w and edits(w, k) <= 2)[:5]
        assert got.get(w, []) == [k for _, _, k in near]


def test_context_patterns(spark):
    rows = extract.verbs(spark.createDataFrame([("A dog is here. ",), ("is",)], "sentence string"))
    assert {(r.pattern, r.freq) for r in extract.context_patterns(rows, 1).collect()} == {("dog is here", 1), ("is", 1)}


def test_workflow(spark):
    docs = spark.createDataFrame([(1, "The cat is jumping. The cat was jumped. A dog is running.")], "doc_id int, text string")
    out = workflow.analyse(docs, grouptables.from_columns(spark, {"be": ["be"], "jump": ["jump"]}), workflow.Options(least=2, top_k=3))
    assert {r.lemma for r in out.verbs.collect()} == {"be", "jump"}
    assert {r.lemma: r.best for r in out.best.collect()}["be"] == "group_prob_be"


def test_corrections_of_repeated_and_null_ids(spark):
    rows = [("a", "x y"), ("a", "z"), ("a", "z"), (None, "x"), (None, "x (x) x"), ("b", None), ("b", " "), ("c", "Y x")]
    df = spark.createDataFrame(rows, "id string, text string")
    out = spelling.corrected(df, "id", "text", spark.createDataFrame([("x", "XX")], "word string, replacement string"), spark.createDataFrame([("y",)], "word string"))
    want = [("a", "XX y", 1, 2), ("a", "z", 0, 1), ("a", "z", 0, 1), (None, "XX", 1, 1), (None, "XX (XX) XX", 3, 3), ("b", "", 0, 0), ("b", "", 0, 0), ("c", "Y XX", 1, 2)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_rows_with_one_id_stay_apart(spark):
    rows = [(1, "u", "He walked. He walked. She was."), (1, "v", "It rained."), (None, "w", "He walked.")]
    got = extract.verbs_of_rows(spark.createDataFrame(rows, "row long, role string, text string"), "row", "text").select("row", "role", "sent_index", "lemma")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", 0, "walk"), (1, "u", 1, "be"), (1, "v", 0, "rain"), (None, "w", 0, "walk")], key=repr)


def test_null_keys_are_drawn_like_others(spark):
    df = spark.createDataFrame([(k if k < 1000 else None, k) for k in range(1003)], "k long, v long")
    picked = [sum(r.k is None for r in frequency.sample(df, 3, "k", seed=s).collect()) for s in range(12)]
    assert sum(picked) < 6
    ties = spark.createDataFrame([(1, i) for i in range(50)], "k long, v long")
    assert {r.v for r in frequency.sample(ties, 5, "k").collect()} == {r.v for r in frequency.sample(ties.repartition(7), 5, "k").collect()}


def test_verb_counts_equal_those_of_sentences(spark):
    docs = spark.createDataFrame([("He walked. She's walking, being BEING! a.b.was-is",), (None,), ("",)], "text string")
    by_word = {tuple(r) for r in extract.verb_counts(docs).collect()}
    tagger = RuleTagger()
    tagger.by_word = False
    assert by_word == {tuple(r) for r in extract.verb_counts(docs, tagger=tagger).collect()} == {("walk", 2), ("be", 4)}


def test_first_hits_hold_one_sentence(spark):
    """of a lemma's hits no list is made, in whatever order they come."""
    rows = spark.createDataFrame([(3, "run", "c"), (1, " Run", "a"), (2, "think", "b"), (4, "go", "d")], "row_ord long, lemma string, sentence string")
    hits = textgroups.lookup(rows, ["run", "think"], "row_ord", in_order=False)
    out = textgroups.first_by_lemma(hits, "row_ord")
    assert [tuple(r) for r in out.collect()] == [("RUN", 2, "a"), ("THINK", 1, "b")]
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "row_ord ASC" not in plan


def test_bounded_memory_takes_documents_row_by_row(spark):
    """no table is made for each document; keys of any name, null ones too, and repeats across batches."""
    rows = spark.createDataFrame([(d, i, i % 7, "s") for d in (1, 2, None) for i in range(60)], "`a.b` int, chunk_start long, sent_start long, sentence string")
    out = extract.bounded_unique_sentences(rows, ["a.b"], 5)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()

    def plain() -> list[tuple]:
        held, got = [], []
        for i in range(60):
            if i % 7 not in held:
                held.append(i % 7)
                got.append((i, i % 7))
                del held[: len(held) > 5]
        return [(*x, n) for n, x in enumerate(got)]

    for d in (1, 2, None):
        own = out.where(F.col("`a.b`").eqNullSafe(F.lit(d))).orderBy("sent_index").collect()
        assert [(r.chunk_start, r.sent_start, r.sent_index) for r in own] == plain()


def test_few_words_are_looked_up_where_the_known_are(spark, monkeypatch):
    """for a few words no list of known ones comes to the driver; F4, F7: a long list meets through marked deletions."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    known = spark.createDataFrame([(w, rng.randint(1, 9)) for w in {word() for _ in range(300)} | {"x" * 90}], "word string, freq long")
    words = spark.createDataFrame([(word(),) for _ in range(40)] + [("zzzzzzzzzz",), ("x" * 89,)], "word string")
    look = lambda: sorted((r.word, tuple(r.suggestions)) for r in spelling.suggestions(words, known).collect())
    monkeypatch.setattr(spelling, "FEW_WORDS", 0)
    want = look()
    monkeypatch.setattr(spelling, "KNOWN_BYTES", 0)
    assert look() == want
    monkeypatch.setattr(spelling, "FEW_WORDS", 1_000)
    monkeypatch.setattr(spelling, "_by_automaton", None)
    monkeypatch.setattr(spelling, "KNOWN_BYTES", 8_000_000)
    assert look() == want


@pytest.mark.parametrize("n", [0, 1, 500])
def test_marks_lose_no_key(spark, monkeypatch, n):
    """What may be wanted stays, most of the rest goes before it is shuffled."""
    from verbatlas import session

    rows = spark.range(20_000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    wanted = rows.where(F.col("a").cast("long") % 40 == 0).limit(n)
    got = session.may_match(rows, wanted, ["a", "b"])
    assert got.columns == ["a", "b"] and got.join(wanted, ["a", "b"], "left_semi").count() == wanted.count()
    assert got.count() < n + 20_000 / 4
    monkeypatch.setattr(session, "MARK_BITS", 7)
    assert session.may_match(rows, wanted, ["a", "b"]).join(wanted, ["a", "b"], "left_semi").count() == wanted.count()
