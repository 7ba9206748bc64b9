import re
from collections import Counter

from verbatlas.llm import quality_rules as q

SF = "/root/testdata/sf0.001"


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_base_against_brute_force(spark):
    eight = "a b c d e f g h"
    texts = [None, "", " \n\t", "one", eight, f"{eight} {eight}", f"{eight} x {eight} y", "z " * 500, "é ü x\n\né ü x\n \nq", "\x0bword\x0c#*$", "# " * 7, "l\nl\nm\nl", "🙂 " * 30, ("w%d " * 40) % tuple(range(40))]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(i, t, "en" if i % 3 else None, "s", 1.5) for i, t in enumerate(texts)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words double")
    got = q.measured(df.drop("n_words")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    assert q.keep_good(df.limit(0)).count() == 0


def test_limits_follow_the_group(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(i, line + f" x{i}" + " ##########" * (3 if s == "b" else 0), "en", s) for i, s in enumerate(["a"] * 150 + ["b"] * 150)]
    rows += [(900, line + " ##########" * 3, "en", "a"), (901, line, None, None), (902, line + " ####" * 40, "fr", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in q.keep_good(df).collect()}
    assert kept >= set(range(300)) and 900 not in kept and 901 in kept


def test_sketches_merge(spark):
    rows = q.measured(spark.read.parquet(f"{SF}/documents.parquet"))
    whole = {tuple(r) for r in q.merged(q.sketch(rows), "lang").collect()}
    halves = q.sketch(rows.where("doc_id % 2 = 0")).union(q.sketch(rows.where("doc_id % 2 = 1")))
    assert whole == {tuple(r) for r in q.merged(halves, "lang").collect()}


def test_native_plan(spark):
    rows = q.measured(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = q.judged(rows, q.limits(q.sketch(rows)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op8_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").selectExpr("quality", "kept").collect()
    good = [r.kept for r in got if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)


def test_clashing_names(spark):
    names = ["doc_id", "text", "lang", "source", "row", "lo_symbols", "hi_repeats", "_lang", "_source", "kept", "n_words", "_w", "_q__w", "a.b", "measure"]
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text if i else "short", "en", None, *range(11)) for i in range(5)]
    out = q.keep_good(spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names)))
    assert out.columns == names and sorted(map(tuple, out.collect())) == rows[1:]
