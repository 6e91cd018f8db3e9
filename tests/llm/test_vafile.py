"""Vector codes against plain Python and SQL, bounds against distances, awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from mosaicell.llm import queries, vafile

from tests.conftest import SF


def whole(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows: list, parts: int = 4, entries: int = 256, rounds: int = 4, dims: int | None = None) -> list[tuple]:
    kept = [(k, label, [math.floor(Fraction(x) * 1024) for x in v]) for k, label, v in rows if whole(v)]
    fit = [r for r in kept if len(r[2]) == dims]
    size = (dims or 0) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, _, v in fit]
    first = sorted(range(len(fit)), key=lambda i: (fit[i][0] is None, fit[i][0] or 0, fit[i][2]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = {}
    for i, v in enumerate(cut):
        found = [near(v[p], books[p]) for p in range(parts)]
        codes[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    out, at = [], 0
    for k, label, v in kept:
        if len(v) == dims:
            out.append((k, label, *codes[at]))
            at += 1
        else:
            out.append((k, label, None, None))
    total = lambda label: sum(r[3] for r in out if r[1] == label and r[3] is not None) if any(r[3] is not None for r in out if r[1] == label) else None
    return sorted([(k, c, e, total(label), digest) for k, label, c, e in out], key=repr)


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def test_by_brute_force(spark):
    rng = random.Random(1)
    some = lambda: [float(np.float32(rng.choice([-1, 1, 0.5, rng.gauss(0, 0.2)]))) for _ in range(8)]
    rows = [(k, rng.choice([1, 2, None]), some()) for k in range(150)]
    rows += [(rows[3][0], rows[3][1], rows[3][2])] * 40 + [(5, 7, some()), (None, 1, some()), (200, 1, None), (201, 1, [float("nan")] * 8), (202, 1, [1.0] * 7 + [None]), (203, 1, [float("inf")] * 8)]
    rows += [(204, 9, [1.0] * 4), (205, 2, []), (206, 2, [1.0] * 9), (207, 3, [0.0] * 8)]
    df = spark.createDataFrame([(k, v, label, "clash", 1) for k, label, v in rows], SCHEMA)
    for entries, rounds in ((256, 1), (16, 4), (3, 2)):
        assert found(vafile.compressed(df, entries=entries, rounds=rounds)) == brute(rows, entries=entries, rounds=rounds, dims=8)


def test_components_of_any_size(spark):
    rng = random.Random(2)
    rows = [(k, k % 3, [rng.choice([1.5, -2e5, 7e5, 3e6, -1e9, 1e12]) * rng.random() for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame([(k, v, label) for k, label, v in rows], "vec_id long, embedding array<double>, label int")
    got, want = found(vafile.compressed(df, entries=8)), brute(rows, entries=8, dims=4)
    limit = lambda e: None if e is None or e > 2**63 - 1 else e
    assert any(r[2] is None for r in got) and [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want] and [r[2] for r in got] == [limit(r[2]) for r in want]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [], 2)], [(1, [1.0, 2.0], 2)]])
def test_nothing_to_code(spark, rows):
    got = vafile.compressed(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in got] == [(r[0], None, None) for r in rows if r[1] is not None]


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(3)
    entries, vectors = rng.integers(-500, 500, (256, 16)), rng.integers(-500, 500, (300, 16))
    lower, upper = vafile.Cells(entries).bounds(vectors)
    exact = ((vectors[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all() and (lower <= upper.min(axis=1)[:, None]).mean() < 0.1
    which, far = vafile.Cells(entries).nearest(vectors)
    assert (which == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_vafile"])
    assert [d[0] for d in want.description] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert found(queries.op12_vafile(spark, SF)) == sorted(want.fetchall(), key=repr)
