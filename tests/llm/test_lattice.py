"""Lattice hashing against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from mosaicell.llm import lattice, queries

from tests.conftest import SF


def brute(vectors: list, least: float = 0.9) -> list[tuple[int, int]]:
    """(n_links, component) of each vector by its position; vectors that don't count are None."""
    x = [np.array(v, float) if v and all(e is not None and math.isfinite(e) for e in v) and any(v) else None for v in vectors]
    n = len(x)
    links = [{b for b in range(n) if b != a and x[a] is not None and x[b] is not None and len(x[a]) == len(x[b])
              and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= least} for a in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            low = min([root[a], *(root[b] for b in links[a])])
            if low < root[a]:
                root[a], changed = low, True
    return [(len(links[a]), root[a]) for a in range(n)]


def near(rng, base: np.ndarray, cosine: float) -> np.ndarray:
    other = rng.standard_normal(len(base))
    other -= other @ base * base / (base @ base)
    other *= np.linalg.norm(base) / np.linalg.norm(other)
    return cosine * base + math.sqrt(1 - cosine**2) * other


def test_decode_gives_nearest_points():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)) * 3
    y = lattice.decode(x)
    assert len(lattice.STEPS) == 240 and ((lattice.STEPS**2).sum(axis=1) == 8).all()
    assert ((y % 2 == 0).all(axis=1) | (y % 2 == 1).all(axis=1)).all() and (y.sum(axis=1) % 4 == 0).all()
    best = ((x - y / 2) ** 2).sum(axis=1)
    for step in lattice.STEPS:  # Voronoi relevant: the 240 shortest, and the next shell at most touches
        assert (((x - (y + step) / 2) ** 2).sum(axis=1) >= best - 1e-9).all()


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(12), rng.standard_normal(12)
    vectors = [a, a, 2 * a, near(rng, a, 0.97), b, -b, None, np.zeros(12), [*a[:11], None], [*a[:11], float("nan")], [*a[:11], float("inf")], [], [0.5], [1.0], a, near(rng, b, 0.6)]
    vectors = [None if v is None else [None if e is None else float(e) for e in v] for v in vectors]
    rows = [(k, v, 1, "z", 0) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, key string, c int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df).collect()}
    assert got == {k: (n, root, k == root) for k, (n, root) in enumerate(brute(vectors))}
    empty = lattice.near_duplicates(df.limit(0))
    assert empty.collect() == []


@pytest.mark.parametrize("block", [4, 512])
def test_crowded_cells_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    vectors = [near(rng, base, 0.99 + 0.005 * rng.random()).tolist() for _ in range(40)] + [rng.standard_normal(16).tolist() for _ in range(20)] + [base.tolist()] * 5
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df, block=block).collect())
    want = brute(vectors)
    assert [g[2] for g in got] == [w[1] for w in want]
    assert sum(g[1] for g in got) >= 0.97 * sum(w[0] for w in want) and all(g[1] <= w[0] for g, w in zip(got, want))


@pytest.mark.parametrize("cosine", [0.902, 0.93, 0.96])
def test_recall(spark, cosine):
    rng = np.random.default_rng(4)
    bases = rng.standard_normal((400, 64))
    vectors = np.concatenate([bases, [near(rng, b, cosine) for b in bases]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["component_id"] for r in lattice.near_duplicates(df).collect()}
    recall = sum(found[400 + k] == k for k in range(400)) / 400
    print(f"recall at cosine {cosine}: {recall}")
    assert recall >= 0.95


def test_query(spark):
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in queries.op3_lattice(spark, SF).collect())
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids = [r["vec_id"] for r in rows]
    assert got == [(i, n, ids[root], i == ids[root]) for i, (n, root) in zip(ids, brute([r["embedding"] for r in rows]))]
