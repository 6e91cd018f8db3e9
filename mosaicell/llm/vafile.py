"""Vector codes from codebooks of integers, with the nearest entry found by a vector-approximation file.

A codebook's entries are quantised coordinate by coordinate into CELLS cells. For a part of a vector, a table of each
coordinate's least and greatest squared distance to each cell is looked up by every entry's cells, which bounds the
distance to the entry from both sides. Only entries whose lower bound doesn't exceed the least upper bound are
compared, in exact integers. Codebooks are learnt in rounds over all vectors; a round's sums are added up by Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Cells of a coordinate: two to the power of the bits it is quantised to.
CELLS = 16
#: Vectors that are bounded at once: what a task holds beside its batch.
AT_ONCE = 1024
_LONG = 2**63 - 1


def floors(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), exactly: int64 where all fit, else Python's integers."""
    values = np.asarray(values, np.float64)
    if values.size == 0 or np.abs(values).max() < 2.0**50:
        return np.floor(values * 1024).astype(np.int64)
    return np.array([math.floor(Fraction(float(x)) * 1024) for x in values.ravel()], object).reshape(values.shape)


class Cells:
    """The approximation of one codebook (entries x places, integers)."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS) -> None:
        self.entries = entries
        n, places = entries.shape
        self.cell = np.empty((n, places), np.intp)
        self.low, self.high = np.zeros((places, cells), entries.dtype), np.zeros((places, cells), entries.dtype)
        for j in range(places):
            order = np.argsort(entries[:, j], kind="stable")
            self.cell[order, j] = np.arange(n) * cells // n
            for c in range(cells):
                own = entries[self.cell[:, j] == c, j]
                if own.size:
                    self.low[j, c], self.high[j, c] = own.min(), own.max()

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of `vectors` to all entries."""
        lower = np.zeros((len(vectors), len(self.entries)), vectors.dtype)
        upper = lower.copy()
        for j in range(vectors.shape[1]):
            below, above = vectors[:, j, None] - self.low[j], self.high[j] - vectors[:, j, None]
            outside = np.maximum(np.maximum(-below, -above), 0)
            farthest = np.maximum(np.abs(below), np.abs(above))
            lower += (outside * outside)[:, self.cell[:, j]]
            upper += (farthest * farthest)[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each vector, the lowest of several, and its squared distance."""
        which, far = np.empty(len(vectors), np.int64), np.empty(len(vectors), vectors.dtype)
        for i in range(0, len(vectors), AT_ONCE):
            some = vectors[i : i + AT_ONCE]
            lower, upper = self.bounds(some)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
            apart = some[row] - self.entries[entry]
            exact = (apart * apart).sum(axis=1)
            first = np.searchsorted(row, np.arange(len(some)))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[row])
            which[i : i + AT_ONCE] = entry[hit[np.searchsorted(row[hit], np.arange(len(some)))]]
            far[i : i + AT_ONCE] = least
        return which, far


def _exact(vectors: np.ndarray, books: list[np.ndarray]) -> np.dtype:
    """int64 if no sum of squared distances can overflow, else Python's integers."""
    widest = max([abs(int(x)) for a in (vectors, *books) if a.size for x in (a.min(), a.max())], default=0)
    return np.dtype(np.int64) if 4 * widest * widest * max(1, vectors.shape[-1]) <= _LONG else np.dtype(object)


def assigned(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entries (vectors x parts) and squared distances of whole vectors of integers."""
    kind = _exact(vectors, books)
    found = [Cells(book.astype(kind)).nearest(part.astype(kind)) for book, part in zip(books, np.split(vectors, len(books), axis=1))]
    return np.stack([w for w, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return floors(values.reshape(batch.num_rows, -1))


def _sums(books: list[np.ndarray]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch)
                which, _ = assigned(vectors, books)
                for p, part in enumerate(np.split(vectors, len(books), axis=1)):
                    counts[p] += np.bincount(which[:, p], minlength=len(books[p]))
                    safe = part.dtype != object and len(part) * int(np.abs(part).max(initial=0)) <= _LONG
                    own = np.zeros(books[p].shape, np.int64 if safe else object)
                    np.add.at(own, which[:, p], part)
                    sums[p] = sums[p] + own
        for p, e in zip(*np.nonzero(counts)):
            places = np.arange(sums[p].shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(places), p), pa.int32()), pa.array(np.full(len(places), e), pa.int32()), pa.array(places, pa.int32()),
                 pa.array(np.full(len(places), counts[p, e]), pa.int64()), pa.array([Decimal(int(s)) for s in sums[p][e]], pa.decimal128(38, 0))],
                ["part", "entry", "place", "n", "total"])

    return of


def _codes(books: list[np.ndarray]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, far = assigned(_matrix(batch), books)
                errors = [int(sum(map(int, d))) for d in far]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array(["".join(f"{int(e):02x}" for e in w) for w in which], pa.string()),
                     pa.array([e if e <= _LONG else None for e in errors], pa.int64())], ["id", "label", "code", "error"])

    return of


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (one array entries x places for each part) of `vectors` (id, v: arrays of doubles of one length).

    They start as the vectors of the `entries` smallest ids (null ids last, ties by the vector), of which there may be
    fewer. What comes to the driver is a row for each entry and place, whatever the number of vectors.
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.split(floors(np.array([r["v"] for r in first])), parts, axis=1) if first else []
    for _ in range(rounds if first else 0):
        found = vectors.select("v").mapInArrow(_sums(books), "part int, entry int, place int, n long, total decimal(38,0)")
        means = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
        books = [b.astype(object) for b in books]
        for r in means:
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = [b.astype(np.int64) if max(map(abs, b.ravel())) <= _LONG else b for b in books]
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row (id, code, error, label_error, codebooks_sha256) per row of `rows` whose vector is whole.

    code: two hex digits for each part; error: squared distances to the coded entries; label_error: errors summed over
    rows of the same label, nulls together. Vectors that are null or hold null or non-finite components are dropped.
    All others are coded, those alone excepted whose length isn't the most frequent one (the smallest of several) that
    can be cut into equal parts: they stay with a null code and error. Repeated rows and ids count as often as they
    occur; ties between entries go to the lowest. Components of any size are exact; an error or sum beyond 64 bits is null.
    Other columns are ignored, an empty table gives an empty result.
    """
    spark, scratch = rows.sparkSession, Scratch()
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)
    kept = scratch.written(kept, "vectors")
    sizes = kept.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).where(f"n > 0 AND n % {parts} = 0").orderBy(F.desc("rows"), "n").first()
    fits = F.size("v") == (sizes["n"] if sizes else -1)
    books = codebooks(kept.where(fits), parts, entries, rounds)
    schema = StructType([kept.schema["id"], kept.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    coded = kept.where(fits).mapInArrow(_codes(books), schema) if books else spark.createDataFrame([], schema)
    coded = scratch.written(coded.unionByName(kept.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), "codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "of")
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
            .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")))
