"""Decontamination against brute force and SQL, awkward rows, no Python in its plan."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from mosaicell.llm import contamination, queries

from tests.conftest import SF

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs: list, items: list, window: int = 10) -> list[tuple]:
    wanted: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - window + 1, 1) if w else 0):
            wanted.setdefault(tuple(w[s : s + window]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for s in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]


def in_order(rows: list) -> list:
    return sorted(rows, key=repr)


@pytest.mark.parametrize("shingle", [1, 3, 4])
def test_by_brute_force(spark, shingle):
    rng = random.Random(shingle)
    say = lambda n, of="ABcdéÉ1": " ".join(rng.choice(of) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 30]), "abcdé12345")) for k in range(40)]
    items += [(k + 100, items[k][1]) for k in range(20)] + [(3, say(12)), (None, say(11)), (50, None), (51, "?!"), (3, items[3][1])]
    docs = [(k, say(rng.choice([0, 1, 8, 60, 400]), "abcdéx12345")) for k in range(60)]
    docs += [(k + 200, f"{say(5)}-{(rng.choice(items)[1] or '').upper()}.{say(20)}") for k in range(60)]
    docs += [docs[70]] * 40 + [(70, docs[70][1])] * 3 + [(None, docs[61][1]), (9, None), (10, ""), (11, "..")]
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, item_id string, words int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, key int")
    assert in_order(rows_of(contamination.contaminated(d, i, shingle=shingle))) == in_order(brute(docs, items))


def test_long_items_and_places(spark):
    rng = random.Random(5)
    items = [(1, " ".join(rng.choice("abc") for _ in range(10)))]
    docs = [(k, " ".join(rng.choice("abc") for _ in range(3000))) for k in range(4)] + [(9, items[0][1]), (10, f"x {items[0][1]}"), (11, f"{items[0][1]} x")]
    made = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert in_order(rows_of(made)) == in_order(brute(docs, items))
    assert {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in made.where("doc_id > 8").collect()} == {9: [(0, 10)], 10: [(1, 11)], 11: [(0, 10)]}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows_of(contamination.contaminated(docs.limit(0), items)) == []
    assert rows_of(contamination.contaminated(docs, items.limit(0))) == brute([(1, "a b")], [])


def test_query_like_sql_and_without_python(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = queries.op11_contamination(spark, SF)
    want = con.execute(queries.ORACLE_SQL["op11_contamination"])
    assert sorted(d[0] for d in want.description) == sorted(found.columns)
    want = [tuple(r[[d[0] for d in want.description].index(c)] for c in found.columns) for r in want.fetchall()]
    assert in_order(map(tuple, found.collect())) == in_order(want) and any(r[-1] for r in want)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
