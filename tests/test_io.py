import csv
import json
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from verbatlas import cli
from verbatlas.operators import groups
from verbatlas.sources import grouptables, manifest, readers, sinks, xlsx
from verbatlas.streaming import files


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_paths(tmp_path):
    f = write(tmp_path / "p.txt", "# c\n\na.txt\nb.txt\n")
    got = readers.path_list(["b.txt", "b.txt"], f)
    assert [p.rsplit("/", 1)[-1] for p in got] == ["b.txt", "a.txt"]


def test_text_documents(spark, tmp_path):
    a = write(tmp_path / "a.txt", "x\r\ny")
    (tmp_path / "b.txt").write_bytes(b"\xff ok")
    with pytest.warns(UserWarning, match="missing"):
        got = readers.text_documents(spark, [a, str(tmp_path / "b.txt"), str(tmp_path / "none.txt")]).orderBy("doc_path").collect()
    assert [r.text for r in got] == ["x\ny", "� ok"] and got[0].doc_path.endswith("a.txt")


def test_delimited(spark, tmp_path):
    a = write(tmp_path / "a.csv", '﻿x,text\n1,"a ""q"", b\nc"\n,\n3,z\n')
    got = readers.delimited(spark, a).orderBy("row_ord").collect()
    assert [(r.x, r.text) for r in got] == [("1", 'a "q", b\nc'), ("", ""), ("3", "z")]
    numbered = readers.numbered_rows(readers.delimited(spark, a), "text").orderBy("csv_row_number").collect()
    assert [(r.csv_row_number, r.x) for r in numbered] == [(1, "1"), (2, ""), (3, "3")]
    b = write(tmp_path / "b.csv", "text,x\nq,9\n")
    readers.same_columns(spark, [a, b], text_col="text")
    c = write(tmp_path / "c.csv", "text,y\n")
    for bad in (lambda: readers.delimited(spark, [a, c]), lambda: readers.same_columns(spark, [a], text_col="no"), lambda: readers.delimited(spark, a, needed=["no"]), lambda: readers.delimited(spark, write(tmp_path / "d.csv", "a,a\n1,2\n"))):
        with pytest.raises(ValueError):
            bad()
    assert readers.count_rows(readers.single_column(spark, a, "x")) == 3


def test_words(spark, tmp_path):
    p = write(tmp_path / "w.txt", "# no\nCat\n\n dog \ncat\n")
    assert sorted(r.word for r in readers.word_list(spark, p).collect()) == ["cat", "dog"]
    sinks.write_words(readers.word_list(spark, p), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["cat", "dog"]


def test_groups(spark, tmp_path):
    p = write(tmp_path / "g.csv", "a, ,b \nrun,x,walk\nrun,,\n")
    assert {tuple(r) for r in grouptables.read(spark, p).collect()} == {("run", "a", 0), ("x", "b", 1)}
    fused = grouptables.read(spark, write(tmp_path / "f.csv", 'a,b\n"x, y",z\nq\n'), "fused")
    assert {tuple(r) for r in fused.collect()} == {("x", "a", 0), ("y", "a", 0), ("z", "b", 1), ("q", "a", 0)}
    with pytest.raises(ValueError):
        grouptables.from_rows(spark, [["a", "a"]])


TAGS = "Lemma,Freq,g1,g2,skipme\nthink,100,1,,\nrun,50,,1,\njump,x,1,,\nboth,5,1,1,\nnone,5,0,?,#N/A\nwalk,9,1\n,3,1,,\n"


def test_tags(spark, tmp_path):
    m = readers.delimited(spark, write(tmp_path / "t.csv", TAGS))
    tags = grouptables.tags_long(m, [" SKIPME "])
    assert {(r.lemma, r.frequency, r.group) for r in tags.collect()} == {("think", 100, "g1"), ("run", 50, "g2"), ("walk", 9, "g1")}
    assert [tuple(r) for r in grouptables.tags_to_columns(tags, ["g1", "g2"]).collect()] == [(1, "think", "run"), (2, "walk", "")]
    assert [tuple(r)[1:] for r in grouptables.odd_flags(m).collect()] == [("g2", "?")]
    with pytest.raises(ValueError):
        grouptables.tags_long(m.select("row_ord", "Freq", "Lemma", "g1"))


def test_written_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\n", None, (1, 2)), (1, 'a"', 0.5, (3, 4))], "o int, s string, p double, span struct<start:int,end:int>")
    assert sinks.write_local(df, str(tmp_path / "l.csv"), order_col="o") == 2
    assert list(csv.reader(open(tmp_path / "l.csv", newline=""))) == [["o", "s", "p", "span"], ["1", 'a"', "0.5", "3-4"], ["2", "b\n", "", "1-2"]]
    sinks.write_delimited(df, str(tmp_path / "d"), one_file=True, order_col="o")
    back = readers.delimited(spark, str(tmp_path / "d")).orderBy("o").collect()
    assert [(r.o, r.s, r.p) for r in back] == [("1", 'a"', "0.5"), ("2", "b\n", "")]
    with pytest.raises(ValueError):
        sinks.flat(df.withColumn("x", F.array("o")))


def test_patch_and_prints(spark, tmp_path):
    rows = spark.createDataFrame([(0, "teh", "the"), (1, "ok", "ok")], "row_ord long, a string, b string")
    sinks.write_patch(rows, "a", "b", str(tmp_path / "p"), "f.txt")
    text = (tmp_path / "p").read_text()
    assert "-teh\n+the\n ok\n" in text and "--- a/f.txt" in text
    assert sinks.predictions_table([("run", 0.5)]).splitlines()[3] == "| run   |    0.500000 |"
    hits = spark.createDataFrame([(0, "s", [("x", 0.25)])], "row_ord long, sentence string, preds array<struct<token:string,prob:double>>")
    assert list(sinks.hit_lines(hits, "row_ord")) == ["s", "                x 0.25", "1 sentences"]
    assert sinks.intermediate_path("/a/b.xlsx", csv_only=True) == "/a/b_intermediate.csv" and sinks.intermediate_path("/a/b.xlsx", keep_csv=True) == "/a/b.csv"
    sinks.write_lines(rows, str(tmp_path / "lines"), "b")
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["the", "ok"]


def cells(path, sheet):
    with zipfile.ZipFile(path) as z:
        xml = z.read(f"xl/worksheets/sheet{sheet}.xml").decode()
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
    return re.findall(r'<c r="(\w+)"(?: s="(\d)")?[^>]*>(?:<is><t[^>]*>(.*?)</t></is>|<v>(.*?)</v>)</c>', xml, re.DOTALL)


def test_workbook_report(spark, tmp_path):
    rows = spark.createDataFrame([(0, "run", 0.5, 0.3), (1, "think", 0.0, 0.9)], "row_ord long, lemma string, motion double, cognition double")
    means = groups.lemma_means(rows, ["motion", "cognition"], order_col="row_ord")
    p = str(tmp_path / "r.xlsx")
    xlsx.write_report(means, p, 0.5)
    got = {a: (s, t or v) for a, s, t, v in cells(p, 1)}
    assert got["A2"] == (str(xlsx.BLUE), "run") and got["B2"] == (str(xlsx.PCT_BOLD), "0.5") and got["C2"] == (str(xlsx.PCT), "0.3") and got["D2"] == ("", "1")
    assert got["A3"] == ("", "think") and got["C3"] == (str(xlsx.PCT_BOLD), "0.9")
    assert {a: t or v for a, _, t, v in cells(p, 2)} == {"A1": "motion_lemma", "B1": "motion_pct", "C1": "cognition_lemma", "D1": "cognition_pct", "A2": "run", "B2": "0.5", "C2": "think", "D2": "0.9"}
    xlsx.write_report(means, p, 0.5, "fused")
    assert "D1" not in {a for a, *_ in cells(p, 1)}


def test_workbook_table(spark, tmp_path):
    df = spark.createDataFrame([("a\x01<b>", 1.5, None), ("", 2.0, 7)], "s string, d double, i int")
    p = str(tmp_path / "t.xlsx")
    xlsx.write_table(df, p, "a/b" * 20, grouptables.from_columns(spark, {"g": ["y", "x"], "h": ["z"]}))
    got = {a: t or v for a, _, t, v in cells(p, 1)}
    assert got["A2"] == "a&lt;b&gt;" and got["B2"] == "1.5" and "C2" not in got and got["C3"] == "7"
    assert {a: t for a, _, t, _ in cells(p, 2)} == {"A1": "g", "B1": "h", "A2": "x", "B2": "z", "A3": "y"}
    with zipfile.ZipFile(p) as z:
        assert 'name="a_ba_b' in z.read("xl/workbook.xml").decode()


def test_manifest(tmp_path):
    src = write(tmp_path / "in.csv", "x\n")
    out = write(tmp_path / "out.csv", "y\n")
    run = manifest.Manifest.begin("count", [src], out, {"field": "x", "n": 0}, {"field": "lemma", "n": 5})
    assert manifest.load(run.write())["status"] == "incomplete"
    record = manifest.load(run.finish({"rows": 1}))
    assert record["status"] == "complete" and record["output"]["md5"] == manifest.file_md5(out)
    assert record["command"].endswith(f"count {src} --output {out} --field x --n 0")
    assert manifest.changed_inputs(record) == [] and manifest.check_upstream(out, record)
    write(tmp_path / "in.csv", "z\n")
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        manifest.changed_inputs(record, strict=True)
    record["versions"]["pyspark"] = "0"
    with pytest.warns(UserWarning):
        assert "pyspark" in manifest.version_changes(record)
    assert manifest.resolved({"field": None, "n": 0}, record, {"field": "lemma", "n": 5}) == {"field": "x", "n": 0}
    assert manifest.inputs_of([], record) == [src]


def test_commands(spark, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a])
    read = lambda name: list(csv.DictReader(open(tmp_path / name, newline="")))
    doc = write(tmp_path / "d.txt", "The cat is jumping. The cat was jumping. A dog is jumped.")
    assert run("extract", doc, "--output", tmp_path / "v.csv", "--include-aux", "--overlap", 0) == 0
    verbs = read("v.csv")
    assert [r["lemma"] for r in verbs] == ["be", "jump", "be", "jump", "be", "jump"] and verbs[0]["span_in_sentence_char"] == "8-10"
    assert json.loads((tmp_path / "v.csv.json").read_text())["settings"]["overlap"] == 0
    assert run("count", tmp_path / "v.csv", "-o", tmp_path / "f.csv") == 0
    assert [(r["lemma"], r["freq"]) for r in read("f.csv")] == [("be", "3"), ("jump", "3")]
    assert run("filter", tmp_path / "v.csv", "-o", tmp_path / "x.csv", "--field", "surface_lower", "--least", 2) == 0
    assert [r["surface_lower"] for r in read("x.csv")] == ["is", "jumping", "jumping", "is"]
    assert run("predict", tmp_path / "x.csv", "-o", tmp_path / "m.csv", "--top-k", 2) == 0
    assert [(r["token_1"], r["prob_1"], r["token_2"]) for r in read("m.csv")][1] == ("jumped", "0.5", "jumping")
    g = write(tmp_path / "g.csv", "be,move\nbe,jump\n")
    assert run("aggregate", tmp_path / "m.csv", "-o", tmp_path / "a.csv", "--groups", g) == 0
    assert [r["group_prob_move"] for r in read("a.csv")] == ["0", "1", "1", "0"]
    assert run("means", tmp_path / "a.csv", "-o", tmp_path / "e.csv") == 0
    assert [(r["lemma"], r["group_prob_move"], r["count"]) for r in read("e.csv")] == [("be", "0", "2"), ("jump", "1", "2")]
    assert run("means", tmp_path / "a.csv", "-o", tmp_path / "e.xlsx") == 0
    assert run("aggregate", tmp_path / "m.csv", "-o", tmp_path / "s.csv", "--groups", g, "--short", "--lemma-count") == 0
    assert sorted(r["lemma_count"] for r in read("s.csv")) == ["1", "1", "2", "2"]
    assert run("lookup", tmp_path / "m.csv", "-o", tmp_path / "l.csv", "--lemmas", "jump", "--limit", 1) == 0 and len(read("l.csv")) == 1
    assert run("tags", write(tmp_path / "t.csv", TAGS), "-o", tmp_path / "tg.csv", "--ignore", "skipme") == 0
    assert read("tg.csv") == [{"g1": "think", "g2": "run"}, {"g1": "walk", "g2": ""}]
    table = write(tmp_path / "rows.csv", "text,k\nit is jumped,a\nwas,b\n")
    assert run("textcount", table, "-o", tmp_path / "c.csv", "--groups", g, "--where", '{{k}} == "a"', "--include-aux") == 0
    assert [(r["total_verb_count"], r["group_count_move"]) for r in read("c.csv")] == [("2", "1")]
    assert run("spell", table, "-o", tmp_path / "sp.csv", "--words", write(tmp_path / "w.txt", "it\nis\nwas\njumper\n"), "--column", "text") == 0
    assert [r["text_corrected"] for r in read("sp.csv")] == ["it is jumper", "was"]
    clauses = write(tmp_path / "cl.tsv", "lemma\tsentence_text\njump\tThey jumped.\n")
    assert run("inflect", tmp_path / "f.csv", "-o", tmp_path / "i.csv", "--clauses", clauses, "--least", 2) == 0
    assert [r["inflected_form"] for r in read("i.csv")] == ["jumped"]
    assert run("sample", tmp_path / "v.csv", "-o", tmp_path / "n.csv", "--n", 3) == 0 and len(read("n.csv")) == 3
    assert run("count", "--load-record", tmp_path / "f.csv.json", "-o", tmp_path / "f2.csv") == 0
    assert read("f2.csv") == read("f.csv")
    assert run("count") == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "1.json", json.dumps({"doc_id": "1", "text": "It is. It was jumped."}) + "\n")
    verbs = files.verb_stream(files.document_stream(spark, str(src)))
    files.count_into(verbs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    write(src / "2.json", json.dumps({"doc_id": "2", "text": "He is."}) + "\n")
    files.count_into(files.verb_stream(files.document_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.lemma: r.freq for r in files.counts_so_far(spark, str(tmp_path / "out")).collect()} == {"be": 3, "jump": 1}


def test_stream_windows(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    rows = [{"t": "2024-01-01T00:00:01Z", "lemma": "be"}, {"t": "2024-01-01T00:00:02Z", "lemma": "be"}, {"t": "2024-01-01T00:20:00Z", "lemma": "be"}]
    write(src / "1.json", "\n".join(map(json.dumps, rows)))
    stream = files.document_stream(spark, str(src), schema="t timestamp, lemma string")
    out = files.windowed_counts(stream, "t", "5 minutes", "1 minute")
    q = out.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.freq for r in spark.table("w").collect()) == [1, 2]
    d = files.unique_stream(stream, ["lemma"], "t", "1 hour").writeStream.format("memory").queryName("u").trigger(availableNow=True).start()
    d.awaitTermination(60)
    assert spark.table("u").count() == 1


def test_rows_left_out_are_counted(spark, tmp_path, capsys, monkeypatch):
    run = lambda *a: cli.main([str(x) for x in a])
    read = lambda name: list(csv.DictReader(open(tmp_path / name, newline="")))
    record = lambda name: json.loads((tmp_path / f"{name}.json").read_text())
    rows = write(tmp_path / "v.csv", "lemma,sentence,span_in_sentence_char\nbe,He is.,3-5\nbe,He is.,3:5\nbe,He is.,x\n ,It was.,3-6\nbe,He is.,5-99\n")
    assert run("predict", rows, "-o", tmp_path / "m.csv", "--top-k", 1, "--log-file", tmp_path / "log.txt") == 0
    assert len(read("m.csv")) == 3 and record("m.csv")["statistics"] == {"rows_read": 5, "rows_skipped": 2, "rows_written": 3}
    assert "2 of 5 rows" in (tmp_path / "log.txt").read_text()
    g = write(tmp_path / "g.csv", "be,move\nbe,jump\nam,\n")
    assert run("aggregate", tmp_path / "m.csv", "-o", tmp_path / "a.csv", "--groups", g) == 0
    assert record("a.csv")["statistics"]["rows_skipped"] == 1 and record("a.csv")["groups"] == {"be": ["am", "be"], "move": ["jump"]}
    assert run("lookup", tmp_path / "m.csv", "-o", tmp_path / "l.csv", "--lemmas", "be", "--print") == 0
    assert capsys.readouterr().out.splitlines()[-3:] == ["He is.", "He is.", "2 sentences"]
    table = write(tmp_path / "rows.csv", "text,k\nit was,a\nfoo is,b\n")
    assert run("textcount", table, "-o", tmp_path / "c.csv", "--groups", g, "--where", '{{k}} == "a"') == 0
    assert record("c.csv")["statistics"] == {"rows_read": 2, "rows_filtered": 1, "rows_written": 1}
    words, fixes = write(tmp_path / "w.txt", "it\nis\nwas\n"), write(tmp_path / "d.csv", "word,action,replacement\nfoo,replace,it\nbar,add,\n")
    assert run("spell", table, "-o", tmp_path / "sp.csv", "--words", words, "--decisions", fixes, "--patch", tmp_path / "p.diff", "--save-words", tmp_path / "w2") == 0
    assert "-foo is\n+it is" in (tmp_path / "p.diff").read_text()
    assert {r.word for r in readers.word_list(spark, str(tmp_path / "w2")).collect()} == {"it", "is", "was", "bar"}

    from verbatlas.table_queries import _toy_pair

    monkeypatch.setattr(cli, "transformers_pair", lambda name: _toy_pair)
    monkeypatch.setattr(cli, "spacy_loader", lambda name: lambda: lambda texts: [[(0, 0, "Xs", "VERB", "x")] for _ in texts])
    assert run("predict", rows, "-o", tmp_path / "mm.csv", "--top-k", 2, "--model", "toy") == 0
    assert [(r["token_1"], r["token_2"]) for r in read("mm.csv")] == [("t2", "t1")] * 3
    assert run("extract", write(tmp_path / "d.txt", "One. Two."), "-o", tmp_path / "t.csv", "--model", "toy") == 0
    assert [r["lemma"] for r in read("t.csv")] == ["x", "x"]
