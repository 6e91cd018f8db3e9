"""Embedding near-duplicates by lattice hashing.

In each of several tables a unit vector is projected by a random matrix to a few dimensions and decoded, eight at a
time, to a point of the lattice E8: its cell. The cells around it that lie nearest to the projection are probed. Two
vectors of which one's probes meet the other's cell are compared by cosine in double precision. Equal vectors are one
class from the start. Cells with many vectors are compared in blocks; each link is counted where its first probe is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lowest_of_component, written

DIM = 8
#: The 240 shortest vectors of E8, doubled to be integers: steps to neighbouring cells.
STEPS = np.array([v for v in itertools.product((-2, 0, 2), repeat=8) if sum(map(abs, v)) == 4]
                 + [v for v in itertools.product((-1, 1), repeat=8) if v.count(-1) % 2 == 0], np.int64)
#: Members of a cell, or probes of it, in a block; rows of blocks that a task compares.
BLOCK, TASK_ROWS = 512, 8192
#: Blocks of up to so many pairs are compared pair by pair, larger ones by matrix products.
SMALL = 1024


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.nonzero(near.sum(axis=1).astype(np.int64) & 1)[0]
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, doubled: D8 or D8 shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


@dataclass(frozen=True)
class Lattice:
    """Parameters: tables, E8 points that make a cell, probes beside the cell itself, and the size of a cell."""

    tables: int = 12
    parts: int = 2
    probes: int = 16
    cell: float = 1.7
    seed: int = 42

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes): 64-bit keys of the cell, then of the probed cells, of unit vectors of one dimension.

        Rows don't influence each other, not even by rounding: the same vector has the same keys in any batch.
        """
        n, dim = unit.shape
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            random = np.random.Generator(np.random.Philox(key=[self.seed, t << 32 | dim]))
            matrix = random.standard_normal((dim, DIM * self.parts)) / self.cell
            code = random.integers(-(1 << 62), 1 << 62, DIM * self.parts) | 1
            x = np.einsum("ij,jk->ik", unit, matrix).reshape(n * self.parts, DIM)
            near = decode(x)
            home = (near.reshape(n, -1) * code).sum(axis=1)
            gain = np.einsum("ij,kj->ik", x - near / 2, STEPS.astype(float)) - (STEPS**2).sum(axis=1) / 4
            gain = gain.reshape(n, self.parts * len(STEPS))
            best = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            step_codes = np.concatenate([STEPS @ code[DIM * p : DIM * (p + 1)] for p in range(self.parts)])
            out[:, t, 0], out[:, t, 1:] = home, home[:, None] + step_codes[best]
        return out


def _units(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a list column without nulls, one dimension at a time."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.nonzero(sizes == dim)[0]
        x = values[offsets[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = lattice.tables * (1 + lattice.probes)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = np.empty((batch.num_rows, width), np.int64)
                for rows, unit in _units(pa.concat_arrays([batch.column(1)])):
                    keys[rows] = lattice.keys(unit).reshape(len(rows), width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, width, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["c", "keys"])

    return run


def _near(unit: np.ndarray, group: np.ndarray, is_home: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(probing row, home row) within a group whose cosine is `least` or more; groups are numbered from 0."""
    q, h = np.nonzero(~is_home)[0], np.nonzero(is_home)[0]
    q, h = q[np.argsort(group[q], kind="stable")], h[np.argsort(group[h], kind="stable")]
    n = int(group.max()) + 1
    q_n, h_n = np.bincount(group[q], minlength=n), np.bincount(group[h], minlength=n)
    q_at, h_at = np.cumsum(q_n) - q_n, np.cumsum(h_n) - h_n
    found = []
    small = (q_n * h_n <= SMALL)[group[q]]
    few = q[small]
    for k in range(0, len(few), 2000):
        some = few[k : k + 2000]
        sizes = h_n[group[some]]
        i = np.repeat(some, sizes)
        j = h[np.repeat(h_at[group[some]], sizes) + np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        hit = np.nonzero(np.einsum("ij,ij->i", unit[i], unit[j]) >= least)[0]
        found.append((i[hit], j[hit]))
    for g in np.nonzero(q_n * h_n > SMALL)[0].tolist():
        i, j = q[q_at[g] : q_at[g] + q_n[g]], h[h_at[g] : h_at[g] + h_n[g]]
        a, b = np.nonzero(unit[i] @ unit[j].T >= least)
        found.append((i[a], j[b]))
    return tuple(np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Links as a forest: pairs of (class, smallest it is joined to)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return np.stack([nodes[out], nodes[label[out]]], axis=1)


def _compare(lattice: Lattice, least: float):
    def run(task: pa.Table) -> pa.Table:
        task = task.combine_chunks()
        c, n, t, home = (task.column(x).to_numpy() for x in ("c", "n", "t", "home"))
        of = np.unique(np.stack([task.column(x).to_numpy().astype(np.int64) for x in ("key", "hb", "qb")]), axis=1, return_inverse=True)[1].ravel()
        links, counted = [], [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for rows, unit in _units(task.column("v").chunk(0)):
            group = np.unique(of[rows], return_inverse=True)[1]
            i, j = _near(unit, group, home[rows], least)
            other = c[rows[i]] != c[rows[j]]
            i, j = i[other], j[other]
            if not len(i):
                continue
            links.append(_forest(c[rows[i]], c[rows[j]]))
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys = lattice.keys(unit[used])
            for k in range(0, len(i), 50_000):
                x, y = at[k : k + 50_000], at[len(i) + k : len(i) + k + len(at[k : k + 50_000])]
                x, y = x[: len(i) - k], y[: len(i) - k]
                ci, cj, table = c[rows[used[x]]], c[rows[used[y]]], t[rows[i[k : k + len(x)]]]
                low, high = np.where(ci < cj, x, y), np.where(ci < cj, y, x)
                first = np.ones(len(x), bool)
                for s in range(lattice.tables):
                    up = (keys[low, s] == keys[high, s, :1]).any(axis=1)  # the lower class probes the higher one's cell
                    down = (keys[high, s] == keys[low, s, :1]).any(axis=1)
                    first &= ~((s < table) & (up | down) | (s == table) & up & (ci > cj))
                a, b = rows[used[x[first]]], rows[used[y[first]]]
                counted += [(c[a], n[b]), (c[b], n[a])]
        ids, weights = (np.concatenate([x[k] for x in counted]) for k in (0, 1))
        one, at = np.unique(ids, return_inverse=True)
        sums = np.zeros(len(one), np.int64)
        np.add.at(sums, at, weights)
        forest = np.concatenate([np.empty((0, 2), np.int64), *links])
        return pa.table({"c": np.concatenate([one, forest[:, 0]]), "links": np.concatenate([sums, np.zeros(len(forest), np.int64)]),
                         "other": pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(forest[:, 1].copy())])})

    return run


def class_links(classes: DataFrame, least: float, lattice: Lattice, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(c, links, other) for `classes` (c long, v array, n long): rows without `other` add up to the linked vectors outside
    a class; rows with `other` join classes as the links that were found do. Classes must not be repeated, nor have vectors
    that are null or have no direction; an empty table gives none. What is written on the way stays in `scratch`, for the caller to clear."""
    scratch = scratch or Scratch()
    each = 1 + lattice.probes
    cells = scratch.written(classes.select("c", "v").mapInArrow(_cells(lattice), "c long, keys array<long>"), "cells")
    rows = cells.select("c", F.posexplode("keys").alias("p", "key")).select("c", "key", F.expr(f"int(p div {each})").alias("t"), (F.col("p") % each == 0).alias("home"))
    homes = rows.where("home")
    taken = scratch.written(homes.groupBy("key").agg(F.count("*").alias("homes")), "taken")
    probes = scratch.written(rows.join(taken, "key").where("homes > 1 or not home").select("key", "t", "c", "homes"), "probes")
    met = scratch.written(probes.groupBy("key").agg(F.ceil(F.max("homes") / block).cast("int").alias("home_blocks"), F.ceil(F.count("*") / block).cast("int").alias("probe_blocks")), "met")
    asked = (homes.select("key", "t", "c").join(met, "key")
             .select("key", "t", "c", F.lit(True).alias("home"), F.pmod(F.xxhash64("c"), "home_blocks").cast("int").alias("hb"), F.explode(F.expr("sequence(0, probe_blocks - 1)")).alias("qb")))
    asking = (probes.select("key", "t", "c").join(met, "key")
              .select("key", "t", "c", F.lit(False).alias("home"), F.explode(F.expr("sequence(0, home_blocks - 1)")).alias("hb"), F.pmod(F.xxhash64("c"), "probe_blocks").cast("int").alias("qb")))
    both = scratch.written(asked.unionByName(asking), "asked")
    tasks = max(1, both.count() // TASK_ROWS)
    return (both.join(classes, "c").withColumn("task", F.pmod(F.xxhash64("key", "hb", "qb"), F.lit(tasks)))
            .groupBy("task").applyInArrow(_compare(lattice, least), "c long, links long, other long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
                    lattice: Lattice = Lattice(), block: int = BLOCK) -> DataFrame:
    """One row (id, n_links, component_id, kept) per row of `vectors`: links are pairs of cosine `least` or more that probes meet.

    n_links: other rows linked directly; component_id: smallest id reachable by links, itself included; kept: whether
    that is its own id. Vectors that are null, empty or zero or hold nulls or values that aren't finite link with
    nothing; vectors of different dimensions don't link. Equal vectors always link; repeated ids are rows of their own;
    a null id is never a component_id unless there is no other. Other columns are ignored; an empty table gives an
    empty result.
    """
    kind = "array<double>" if vectors.schema[vector_col].dataType.simpleString() == "array<double>" else "array<float>"
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v")).withColumn("v", F.when(sound, F.col("v")))
    rows = written(rows, "vectors")
    classes = written(rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first"))
                      .withColumn("c", F.monotonically_increasing_id()), "classes")
    scratch = Scratch()
    found = written(class_links(classes.select("c", "v", "n"), least, lattice, block, scratch), "found")
    scratch.clear()
    links = found.where("other is null").groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("c").alias("u"), F.col("other").alias("v")))
    lowest = lowest_of_component(classes.select(F.col("c").alias("node"), F.col("first").alias("component")), roots, "component").withColumnRenamed("node", "c")
    told = (classes.select("c", "v", "n").join(lowest, "c").join(links, "c", "left")
            .select("v", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    return (rows.join(written(told, "told"), "v", "left")
            .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
