"""Every registered query of the core against its SQL, at the smallest scale."""

import os
import re
from collections import Counter

import duckdb
import pytest

from verbatlas.queries import ORACLE_SQL, QUERIES, WITHOUT_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=repr)


def test_each_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    want = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_spelling_of_all_unknown_words(spark, sql):
    known = Counter(w for (t,) in sql.execute("SELECT text FROM documents").fetchall() for w in re.findall("[a-z]+", (t or "").lower()))
    unknown = {r.word for r in QUERIES["spell_unknown"](spark, SF).collect()}
    got = {r.word: r.suggestions.split(" ") for r in WITHOUT_SQL["spell_suggestions_all"](spark, SF).collect()}
    assert len(unknown) > 100 and set(got) <= unknown
    for word in sorted(unknown)[:: max(1, len(unknown) // 40)]:
        near = sorted((e, -n, k) for k, n in known.items() if abs(len(k) - len(word)) <= 2 and 0 < (e := _edits(word, k)) <= 2)
        assert got.get(word, []) == [k for _, _, k in near[:5]], word
    fixed = WITHOUT_SQL["spell_auto_all"](spark, SF).collect()
    texts = {f"{c}/{t}": x or "" for c, t, x in sql.execute("SELECT conv_id, turn, text FROM conversations").fetchall()}
    assert {r.row for r in fixed} == set(texts)
    assert sum(r.corrections for r in fixed) > 100
    for r in fixed:
        want = []
        for token in texts[r.row].split():
            core = next((w for w in got if token.lower() == w), None)
            want.append(got[core][0] if core else None)
        have = r.corrected.split(" ") if r.corrected else []
        assert len(have) == len(want) and all(w is None or h == w for h, w in zip(have, want, strict=True))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
