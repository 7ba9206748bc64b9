import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbatlas.llm import language_id as li

SF = "/root/testdata/sf0.01"


def parse(reference, text):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in reference:
            k += 1
        n, i = n + 1, i + k
    return n


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", max_size=40), st.text(alphabet="abcd ", max_size=30))
def test_automaton_against_substrings(reference, text):
    a = li.SuffixAutomaton(reference)
    for i in range(len(text)):
        state = 0
        for j in range(i, len(text)):
            state = a.to[state].get(text[j]) if state is not None else None
            assert (state is not None) == (text[i : j + 1] in reference)
    assert a.phrases(text) == parse(reference, text)


def test_identifier_against_plain_parsing():
    refs = {"x": " abra kadabra abba ", "y": " tock tick tack ", "z": " ticka brack "}
    own = li.Identifier(refs)
    for text in ["abra", "Tick tack TOCK", "kad tick", "abba 12 tick_tack", "q" * 100_000]:
        ws = li.words_of(text)
        cost = {k: sum(parse(v, f" {w} ") for w in ws) * w2 for (k, v), w2 in zip(sorted(refs.items()), own.weights, strict=True)}
        assert own(text)[0] == min(cost, key=lambda k: (cost[k], k))
    assert own("12 _ ½ !") == own(None) == own("") == (li.UNKNOWN, 0.0)
    assert own("中文")[0] in refs and li.Identifier({})("abc") == (li.UNKNOWN, 0.0)


def test_many_kept_words(monkeypatch):
    monkeypatch.setattr(li, "KEPT_WORDS", 3)
    own = li.Identifier({"x": " ab ", "y": " cd "})
    assert own("ab cd ab ab abab cd c d ab")[0] == "x" and len(own._counted) <= 3


@pytest.fixture(scope="module")
def on_table(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    return langs, li.op9_language(spark, SF).collect()


def test_held_out_accuracy(on_table):
    langs, rows = on_table
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_edge_cases(spark):
    rows = [(1, None, "en", 1.0), (2, "123 !", "en", 1.0), (3, "the word", None, 1.0), (4, "the words of the text", "en", 1.0), (6, "die Worte des Textes", "de", 1.0), (6, "die Worte des Textes", "de", 1.0), (None, "the", "fr", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    refs = li.learn(df)
    assert set(refs) == {"en", "de"}
    got = li.identify(df, refs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got} == {1: "und", 2: "und", 3: "en", 4: "en", 6: "de", None: "en"}
    assert {r.lang_pred for r in li.identify(df, {}).collect()} == {"und"}
    assert li.learn(df.limit(0)) == {} and li.identify(df.limit(0), refs).count() == 0


def test_reference_holds_a_slice_of_each_text(spark):
    long = "eins " * 50_000  # longer than what a text was allowed
    rows = [(0, long, "de")] + [(i, f"word{chr(96 + i)} " * 9_000, "en") for i in range(1, 9)]
    found = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert found["de"].startswith(" eins eins") and all(len(x) <= li.REFERENCE_CHARS + 2 for x in found.values())
    picked = {w for w in found["en"].split() if len(w) == 5}
    assert len(picked) >= 4 and len(found["en"]) > 0.99 * li.REFERENCE_CHARS
    assert li.sliced(["aaaa", "b", "cccc"], 9) == ["aaa", "b", "ccc"] and li.sliced(["abc", "d"], 100) == ["abc", "d"]
