"""Collocations against plain Python and SQL: every way in which words get to their pivots, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from mosaicell.llm import collocation, queries

from tests.conftest import SF

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows: list, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> list[tuple]:
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        if text is not None:
            lang = "und" if lang is None else lang
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
                w = re.findall("[^ \t]+", piece)
                n[lang] += len(w)
                for size in range(1, longest + 1):
                    f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        swallowed = {p[s : s + m] for p, a in good.items() for m in range(2, len(p)) for s in range(len(p) - m + 1) if 100 * a >= inside * counts[p[s : s + m]]}
        found = []
        for p, a in good.items():
            if p not in swallowed:
                score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def documents(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["The", "the", "of", "été", "É", "naïve", "x'y", "-", "😀", "a b", " "] + [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(len(words))]
    say = lambda n: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in rng.choices(words, weights, k=n))
    rows = [(rng.choice(["en", "fr", None, "und"]), say(rng.choice([0, 1, 5, 200]))) for _ in range(150)]
    return rows + [("en", "very common pair of words here")] * 200 + [("fr", "the the the the")] * 12 + [("en", None), (None, None), ("de", ""), ("de", "..."), ("xx", " ".join(["again"] * 500))]


@pytest.mark.parametrize("coded,chunk,deal", [(1 << 19, 1 << 20, 20_000), (10, 50, 30), (0, 50, 30), (1 << 19, 50, 10)])
def test_by_brute_force(spark, monkeypatch, coded, chunk, deal):
    monkeypatch.setattr(collocation, "DEAL", deal)
    rows = documents(coded % 7)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    assert found(collocation.collocations(df, most_coded=coded)) == brute(rows)


def test_other_bounds(spark):
    rows = documents(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(collocation.collocations(df, longest=2, least=5, top=20)) == brute(rows, 2, 5, top=20)
    assert found(collocation.collocations(df, least=40, inside=90)) == brute(rows, least=40, inside=90)


def test_empty_tables(spark):
    df = spark.createDataFrame(documents(1), "lang string, text string")
    assert found(collocation.collocations(df.limit(0))) == found(collocation.collocations(df.where("text IS NULL"))) == found(collocation.collocations(df.where("lang = 'de'"))) == []


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_collocations"])
    assert [d[0] for d in want.description] == COLUMNS
    want = sorted(want.fetchall())
    assert found(queries.op13_collocations(spark, SF)) == want and len(want) > 100


def test_words_held_are_bounded_for_all_languages_together(monkeypatch):
    monkeypatch.setattr(collocation, "HELD", 100)
    monkeypatch.setattr(collocation, "COUNTED", 30)
    rows = [(f"l{k % 5}", " ".join(f"w{k * i % 23}" for i in range(9))) for k in range(400)]
    taken = 0

    def batches():
        nonlocal taken
        for row in rows:
            taken += 10
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]])], ["lang", "text"])

    told = 0
    for _, tokens in collocation._chunks(batches()):
        assert taken - told <= 110
        told += len(tokens)
    assert told == 4000
    counts, most = Counter(), 0
    for b in collocation._count(batches()):
        most = max(most, b.num_rows)
        for r in b.to_pylist():
            counts[r["lang"], r["word"]] += r["f"]
    assert most < 60 and counts == Counter((lang, w) for lang, text in rows for w in text.split())
