"""Automata against plain distances and expressions; corrections in order against a run that asks word by word."""

import random
import re

import numpy as np
import pytest

from verbatlas.functions.automata import NearWords, WholeWords
from verbatlas.operators import spelling, textgroups


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_words(most):
    rng = random.Random(most)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    words = sorted({word("abcé漢", 8) for _ in range(200)} | {"a" * 62, "a" * 70})
    given = [word("abcz", 8) for _ in range(60)] + ["", "a" * 62, "a" * 61 + "b"]
    q, w, e = NearWords(words).pairs(given, most)
    assert set(zip(q.tolist(), w.tolist(), e.tolist(), strict=True)) == {(i, j, n) for i, a in enumerate(given) for j, b in enumerate(words) if (n := edits(a, b)) <= most}
    assert len(q) == len(set(zip(q.tolist(), w.tolist(), strict=True)))
    freq = np.array([rng.randrange(3) for _ in words])
    got = list(NearWords(words).nearest(given, most, 3, freq, batch=7))
    near = lambda a: sorted((edits(a, b), -freq[j], j) for j, b in enumerate(words))
    want = [[words[j] for n, _, j in near(a) if 0 < n <= most][:3] for a in given]
    assert got == want


def test_near_words_of_nothing():
    assert list(NearWords([]).nearest(["a", ""], 2, 5, np.zeros(0, int))) == [[], []]
    assert list(NearWords(["a"]).nearest([], 2, 5, np.ones(1, int))) == []
    with pytest.raises(ValueError):
        NearWords(["a"]).pairs(["x" * 63], 2)


def test_both_ways_to_suggestions(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))
    known = [(word(), rng.randrange(4)) for _ in range(150)] + [("q" * 66, 1), (None, 3), ("UPper", 2)]
    given = [(word(),) for _ in range(50)] + [("q" * 65,), ("upper",), ("q" * 66 + "xyz",), (None,), ("uper",)]
    ignored = spark.createDataFrame([(known[0][0],)], "word string")
    args = (spark.createDataFrame(given, "word string"), spark.createDataFrame(known, "word string, freq int"), ignored)
    one = {r.word: r.suggestions for r in spelling.suggestions(*args).collect()}
    monkeypatch.setattr(spelling, "KNOWN_BYTES", 0)
    two = {r.word: r.suggestions for r in spelling.suggestions(*args).collect()}
    assert one == two and one["uper"] == ["upper"] and one["q" * 65] == ["q" * 66] and "q" * 66 + "xyz" not in one


def test_whole_words():
    find = WholeWords(["run", "running", "é", "a b", "x.", "", "na"])
    assert find("run running, rerun 'run'") == {"run", "running"}
    assert find("un été é a b cab a bc xx. x. ná _run run2") == {"é", "a b", "na"} - {"na"}
    assert WholeWords([])("anything") == set()


def test_both_ways_to_matches(spark, monkeypatch):
    texts = ["He RUNS and walked.", "running run", "rerun runs-over", None, "", "walk walks", "naïve walked", "walking\nran"]
    clauses = spark.createDataFrame([(i, lemma, t) for i, t in enumerate(texts * 2) for lemma in ("run", "walk", "none", None)], "`my.id` int, lemma string, sentence_text string")
    lemmas = spark.createDataFrame([("run",), ("walk",), ("run",), (None,)], "lemma string")
    one = sorted(map(tuple, textgroups.inflection_matches(clauses, lemmas).collect()))
    monkeypatch.setattr(textgroups, "FORMS_BYTES", 0)
    two = sorted(map(tuple, textgroups.inflection_matches(clauses.withColumnRenamed("my.id", "id"), lemmas).collect()))
    assert one == two and (0, "run", texts[0], "runs") in one and not any(r[0] == 1 for r in one)


# -- decisions in order ---------------------------------------------------------------------------
def asked(rows, decisions, known):
    """The run that the decisions come from: word by word, with lists that grow."""
    right, lasting, out = set(known), {}, []
    kept = {}
    for d in decisions:
        kept.setdefault((d[0], d[1], d[2].lower()), []).append((d[3], d[4]))
    for doc, text in sorted(rows):
        fixed, n, checked = [], 0, 0
        for at, token in enumerate((text or "").split()):
            core = re.sub(r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$", "", token)
            checked += core != ""
            word = core.lower()
            new = None
            if core and word not in right:
                here = sorted(kept.get((doc, at, word), []), key=lambda x: (x[0], x[1] or ""))
                once = [x for x in here if x[0] in ("replace", "ignore_once")]
                stay = [x for x in here if x[0] not in ("replace", "ignore_once")]
                if stay:
                    lasting[word] = stay[0]
                if once:
                    new = once[0][1] if once[0][0] == "replace" else None
                elif lasting.get(word, ("", ""))[0] == "replace_all":
                    new = lasting[word][1]
                if lasting.get(word, ("", ""))[0] in ("ignore_all", "add"):
                    right.add(word)
            n += new is not None
            fixed.append(token if new is None else token.replace(core, new))
        out.append((doc, " ".join(fixed), n, checked))
    return sorted(out)


def test_decisions_hold_from_their_place(spark):
    rng = random.Random(9)
    words = ["teh", "Teh", "wrod", "(wrod)", "ok", "...", "thier,", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(60)] + [(60, None), (61, "")]
    decisions = []
    for doc, text in rows:
        for at, token in enumerate((text or "").split()):
            word = token.strip("(),.").lower()
            if word and rng.random() < 0.25:
                late = [] if doc < 40 else ["ignore_all", "add"]
                action = rng.choice(["replace", "ignore_once", "replace_all", *late])
                decisions.append((doc, at, word, action, f"{word.upper()}{len(decisions)}" if "replace" in action else None))
                if rng.random() < 0.2:
                    decisions.append((doc, at, word, "replace_all", f"second{len(decisions)}"))
    known = [("ok",)]
    got = spelling.corrected_in_order(spark.createDataFrame(rows, "id int, text string"), "id", "text", spark.createDataFrame(decisions, "id int, at int, word string, action string, replacement string"), spark.createDataFrame(known, "word string"))
    assert sorted(map(tuple, got.collect())) == asked(rows, decisions, ["ok"])


def test_a_right_word_changes_later_words_only(spark):
    rows = spark.createDataFrame([(1, "teh teh teh"), (2, "teh teh")], "id int, text string")
    decisions = spark.createDataFrame([(1, 0, "teh", "replace", "the"), (1, 1, "TEH", "replace_all", "the"), (2, 0, "teh", "ignore_all", None), (2, 1, "teh", "replace_all", "never")], "id int, at int, word string, action string, replacement string")
    got = spelling.corrected_in_order(rows, "id", "text", decisions, spark.createDataFrame([], "word string"))
    assert sorted(map(tuple, got.collect())) == [(1, "the the the", 3, 3), (2, "teh teh", 0, 2)]
