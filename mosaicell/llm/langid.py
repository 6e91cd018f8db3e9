"""Language by nearest centroid: normalised TF-IDF vectors of hashed byte n-grams against several centroids a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample

#: Documents of each language that are learned from at most, by their whole texts: a bound of the fit, not of prediction.
SAMPLE_DOCS = 400
BITS, ORDERS = 14, (2, 3, 4)
CENTROIDS = 4
#: A text is accepted if its cosine reaches the lowest of a centroid's own documents, less this much of it.
SLACK = 0.5
UNKNOWN = "und"
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


#: ASCII bytes other than letters become spaces, runs of which count once.
_LETTERS = bytes(k if k > 127 or chr(k).isalpha() else 32 for k in range(256))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the lower-case UTF-8 bytes of words occurs (2 ** BITS)."""
    words = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    raw = np.frombuffer(b" " + words + b" " if words else b"", np.uint8).astype(np.uint32)
    parts, gram = [], np.zeros(len(raw), np.uint32)
    for k in range(max(ORDERS)):
        if len(raw) <= k:
            break
        gram = gram[: len(raw) - k] * np.uint32(257) + (raw[k:] + np.uint32(1)) if k else raw + np.uint32(1)
        if k + 1 in ORDERS:
            parts.append((gram * np.uint32(_MIX[k])) >> np.uint32(32 - BITS))
    return np.bincount(np.concatenate(parts), minlength=1 << BITS) if parts else np.zeros(1 << BITS, np.int64)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    matrix: np.ndarray  # centroids x buckets, unit rows
    least: np.ndarray  # cosine from which a centroid accepts

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language of the nearest centroid, cosine, and whether it is near enough."""
        tf = counts(text)
        at = np.nonzero(tf)[0]
        if not len(at):
            return self.languages[0], 0.0, False
        v = (np.log1p(tf[at]) * self.idf[at]).astype(np.float32)
        cosines = self.matrix[:, at] @ v / np.float32(np.linalg.norm(v))
        best = int(cosines.argmax())
        cosine = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[best], cosine, cosine >= self.least[best]


def cluster(vectors: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: unit centroids, and the centroid of each vector."""
    seeds = [0]
    near = vectors @ vectors[0]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centre = vectors[seeds]
    for _ in range(rounds):
        own = (vectors @ centre.T).argmax(axis=1)
        centre = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    return centre, (vectors @ centre.T).argmax(axis=1)


def fit(texts: list[str], languages: list[str], k: int = CENTROIDS) -> Centroids | None:
    """Centroids for labelled texts; None if no text has an n-gram."""
    return fit_counts([packed_counts(t) for t in texts], languages, k)


def packed_counts(text: str) -> tuple[bytes, bytes]:
    """The n-grams of a text and the logarithms of one more than their counts: bounded, however long the text is."""
    tf = counts(text)
    at = np.nonzero(tf)[0]
    return at.astype("<u2").tobytes(), np.log1p(tf[at]).astype("<f4").tobytes()


def inverse_frequency(having: np.ndarray, n: int) -> np.ndarray:
    """Weights of n-grams that so many of `n` texts have."""
    return np.log((1 + n) / (1 + having)) + 1


def fit_language(found: list[tuple[bytes, bytes]], idf: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, list[float]]:
    """Centroids of one language, and the least cosine to each that is accepted, from n-grams of texts that have some."""
    x = np.zeros((len(found), 1 << BITS), np.float32)
    for row, (at, values) in enumerate(found):  # in place: nothing of this size is held twice
        x[row, np.frombuffer(at, "<u2")] = np.frombuffer(values, "<f4")
    x *= idf.astype(np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-30))[:, None]
    centre, at = cluster(x, k)
    members = [x[at == c] for c in range(len(centre))]
    return centre, [SLACK * float((own @ centre[c]).min()) if len(own) else 1.0 for c, own in enumerate(members)]


def joined(idf: np.ndarray, fitted: list[tuple[str, np.ndarray, list[float]]]) -> Centroids | None:
    """One model from those of languages (language, centroids, least cosines), in order of the languages' names."""
    fitted = sorted(fitted, key=lambda f: f[0])
    if not fitted:
        return None
    return Centroids([f[0] for f in fitted for _ in f[2]], idf, np.concatenate([f[1] for f in fitted]), np.array([x for f in fitted for x in f[2]]))


def fit_counts(found: list[tuple[bytes, bytes]], languages: list[str], k: int = CENTROIDS) -> Centroids | None:
    """Centroids for the n-grams of labelled texts."""
    some = [(f, language) for f, language in zip(found, languages) if f[0]]
    having = np.bincount(np.concatenate([np.frombuffer(f[0], "<u2") for f, _ in some] or [np.empty(0, np.int64)]), minlength=1 << BITS)
    idf = inverse_frequency(having, len(some))
    return joined(idf, [(own, *fit_language([f for f, language in some if language == own], idf, k)) for own in {language for _, language in some}])


def _having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the partition have each n-gram; -1: how many there are."""
    n, having = 0, np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for at in batch.column(0):
            having[np.frombuffer(at.as_py(), "<u2")] += 1
        n += batch.num_rows
    some = np.nonzero(having)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(having[some], n))], ["gram", "n"])


def _fit_task(idf: np.ndarray, k: int):
    def run(texts: pa.Table) -> pa.Table:
        texts = texts.sort_by("id")
        centre, least = fit_language(list(zip(texts.column("at").to_pylist(), texts.column("counts").to_pylist())), idf, k)
        return pa.table({"lang": texts.column("lang").slice(0, 1), "centres": pa.array([centre.astype("<f4").tobytes()], pa.binary()), "least": pa.array([least], pa.list_(pa.float64()))})

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS) -> Centroids | None:
    """Centroids from up to `per_language` documents of each non-null language whose id's crc32 modulo 3 is not 1.

    The sample is by a hash of the id. Rows of one id and language count once, with their smallest text; an id with
    several languages is learned from for each. None for an empty table, or if no text has an n-gram. Each language is
    clustered in a task of its own, which holds `per_language` texts' vectors of 256 KB; the driver gets the centroids, 1 MB
    a language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null").where(F.crc32(F.col("id").cast("string")) % 3 != 1)
    sample = bounded_sample(known.distinct(), "lang", per_language).select("id", "lang")
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    one = texts.where("text is not null").join(F.broadcast(sample), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # repeated ids: one text
    kind = one.schema["id"].dataType.simpleString()
    scratch = Scratch()
    rows = scratch.written(one.select("id", "lang", "text").mapInArrow(_counted, f"id {kind}, lang string, at binary, counts binary"), "counts").where(F.length("at") > 0)
    # To the driver: a number for each n-gram, then each language's centroids.
    totals = {r["gram"]: r["n"] for r in rows.select("at").mapInArrow(_having, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    having = np.zeros(1 << BITS, np.int64)
    n = totals.pop(-1, 0)
    having[list(totals)] = list(totals.values())
    idf = inverse_frequency(having, n)
    fitted = rows.groupBy("lang").applyInArrow(_fit_task(idf, CENTROIDS), "lang string, centres binary, least array<double>").collect()
    scratch.clear()
    return joined(idf, [(r["lang"], np.frombuffer(r["centres"], "<f4").reshape(-1, 1 << BITS), r["least"]) for r in fitted])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [packed_counts(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))], ["id", "lang", "at", "counts"])


def _predict(model: Centroids | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1):
                text = x.as_py()
                letters = text is not None and any(map(str.isalpha, text))
                found.append(model.predict(text) if model and letters else (UNKNOWN, 0.0, False))
            languages, scores, accepted = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                                             ["id", "language", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, language, score, accepted) per row of `docs`, from whole texts.

    language: of the nearest centroid; score: its cosine; accepted: false if the text is too far from it to be trusted.
    Null texts, texts without a letter, and all texts if there is no model are `und`, score 0, not accepted. Repeated
    rows stay; equal cosines go to the first language by name; other columns are ignored; an empty table gives an empty
    result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_predict(model), f"id {kind}, language string, score double, accepted boolean").withColumnRenamed("id", id_col))
