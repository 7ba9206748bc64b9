"""Runs of the command line: chains of records, rows left out with their reasons, a run that is stopped."""

import csv
import json
import threading

from pyspark.sql import functions as F

from verbatlas import cli
from verbatlas.operators import letters
from verbatlas.sources import manifest, sinks


def run(*a):
    return cli.main([str(x) for x in a])


def read(path):
    return list(csv.DictReader(open(path, newline="")))


def record(path):
    return json.loads((path.parent / f"{path.name}.json").read_text())


def test_a_record_of_an_earlier_step_names_the_input(spark, tmp_path):
    (tmp_path / "d.txt").write_text("The cat is jumping. A dog was here.")
    verbs, masked = tmp_path / "v.csv", tmp_path / "m.csv"
    assert run("extract", tmp_path / "d.txt", "-o", verbs, "--include-aux", "--overlap", 0) == 0
    assert run("predict", "--load-record", tmp_path / "v.csv.json", "-o", masked, "--top-k", 1) == 0
    assert len(read(masked)) == len(read(verbs)) == 3
    found = record(masked)
    assert found["inputs"][0]["path"] == str(verbs) and found["source"]["tool"] == "extract" and found["statistics"]["rows_read"] == 3
    assert run("predict", "--load-record", tmp_path / "m.csv.json", "-o", tmp_path / "m2.csv") == 0
    assert read(tmp_path / "m2.csv") == read(masked)
    assert run("predict", "--load-record", tmp_path / "v.csv.json") == 2  # an earlier step's output is not written over
    old = {"tool": "extract", "inputs": [{"path": "a"}], "output": {"path": "b"}}
    assert manifest.inputs_of([], old, "predict") == ["b"] and manifest.inputs_of([], old, "extract") == ["a"] and manifest.inputs_of(["c"], old, "predict") == ["c"]


def test_dead_letters(spark, tmp_path):
    rows = tmp_path / "v.csv"
    rows.write_text("lemma,sentence,span_in_sentence_char\nbe,He is.,3-5\nbe,He is.,x\nbe,It was.,3-6\nbe,He is.,5-99\n")
    assert run("predict", rows, "-o", tmp_path / "m.csv", "--top-k", 1, "--dead-letters", tmp_path / "dead.csv") == 0
    assert [(r["span_in_sentence_char"], r["reason"]) for r in read(tmp_path / "dead.csv")] == [("x", "no_span"), ("5-99", "span_outside")]
    assert record(tmp_path / "m.csv")["left_out"] == {"no_span": 1, "span_outside": 1}
    assert record(tmp_path / "m.csv")["statistics"] == {"rows_read": 4, "rows_skipped": 2, "rows_written": 2}


def test_reasons_are_counted_in_the_job_that_writes(spark):
    rows = spark.range(10).withColumn("x", F.when(F.col("id") < 8, F.col("id")))
    found = letters.Checked(rows, {"small": F.col("x") < 3, "even": F.col("x") % 2 == 0, "none": F.col("x").isNull()})
    assert found.counts == {"rows_read": 10, "small": 3, "even": 2, "none": 2}
    assert sorted(r.id for r in found.usable.collect()) == [3, 5, 7] and found.usable.columns == rows.columns
    assert {r.id: r.reason for r in found.dead.collect()} == {0: "small", 1: "small", 2: "small", 4: "even", 6: "even", 8: "none", 9: "none"}
    empty = letters.Checked(rows.limit(0), {"small": F.col("x") < 3})
    assert empty.counts == {"rows_read": 0, "small": 0} and empty.usable.count() == 0


def test_a_stopped_run_leaves_its_count_and_other_jobs_alone(spark, tmp_path, monkeypatch):
    (tmp_path / "v.csv").write_text("lemma\n" + "be\n" * 50)
    other = {}

    def slow():
        other["n"] = spark.range(4).repartition(4).mapInArrow(lambda it: (__import__("time").sleep(1) or b for b in it), "id long").count()

    thread = threading.Thread(target=slow)
    whole = sinks.write_local

    def stopped(df, path, sep=",", order_col=None, tally=None):
        thread.start()
        whole(df.limit(7), path, sep, order_col, tally)
        raise KeyboardInterrupt

    monkeypatch.setattr(cli.sinks, "write_local", stopped)
    assert run("filter", tmp_path / "v.csv", "-o", tmp_path / "x.csv", "--least", 2) == 130
    thread.join()
    assert other["n"] == 4  # work outside of the run went on
    found = record(tmp_path / "x.csv")
    assert found["status"] == "stopped" and found["statistics"] == {"rows_written": 7} and len(read(tmp_path / "x.csv")) == 7
    assert not spark.sparkContext.getJobTags()
