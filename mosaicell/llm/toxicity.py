"""Toxic spans by a linear-chain conditional random field; marginals add up to a score for each document.

Labels are of documents. Tokens of toxic documents are labelled through the words and word beginnings that set toxic
documents apart (a likelihood-ratio test on a bounded sample of labelled rows); from these tokens a field with two
states is trained, which is then run over whole texts: forward-backward marginals say where a text offends, and a
logistic curve over the largest marginal, the expected number of toxic words and their share gives its score.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, written

#: Labelled documents of each class that are learned from at most, by their whole texts: a bound of the fit, not of scoring.
SAMPLE_DOCS = 2000
#: Segments with a toxic token that the field is trained on at most, by a hash over all of them; clean segments, by a hash
#: over all of all clean documents of the sample: so many for each toxic one, and at least so many.
TOXIC_SEGMENTS, CLEAN_RATIO, CLEAN_LEAST = 20_000, 2, 500
#: A feature marks tokens as toxic from this likelihood-ratio statistic and log odds on.
MIN_G, MIN_ODDS = 20.0, 2.0
SEGMENT, ROUNDS, PENALTY = 32, 100, 1e-5
#: Segments that a round of the fit goes over at once.
FIT_BLOCK = 4096
PREFIXES = (4, 5)
EDGES = re.compile(r"^\W+|\W+$")
#: Documents whose chains are run side by side at most, and tokens that these may have together, padding included.
SIDE_BY_SIDE, CELLS = 256, 500_000
KEPT_WORDS = 300_000


def word_features(word: str) -> list[str]:
    """The word in lower case without punctuation around it, and its beginnings; none if nothing is left."""
    word = word.lower()
    if not word.isalnum():
        word = EDGES.sub("", word)
    return [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)] if word else []


def chain(odds: np.ndarray, a01: float, a10: float, a11: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios and marginals of the toxic state, for token odds (documents, tokens); a clean-clean step weighs 1."""
    forward, backward = np.empty_like(odds), np.empty_like(odds)
    ratio = np.zeros(len(odds))
    for t in range(odds.shape[1]):
        ratio = odds[:, t] * (a01 + ratio * a11) / (1 + ratio * a10)
        forward[:, t] = ratio
    ratio = np.full(len(odds), a10)  # the state after the last token is clean, as it is before the first: padding (odds 0) changes nothing
    for t in range(odds.shape[1] - 1, -1, -1):
        backward[:, t] = ratio
        x = odds[:, t] * ratio
        ratio = (a10 + a11 * x) / (1 + a01 * x)
    both = forward * backward
    return forward, backward, both / (1 + both)


@dataclass
class Field:
    """Weights of features, transitions (as factors), and of the logistic curve over 1 and the values of `summary`."""

    weights: dict[str, float]
    bias: float
    a01: float
    a10: float
    a11: float
    curve: tuple[float, ...] = ()

    def token(self, word: str) -> float:
        return math.exp(min(30.0, self.bias + sum(self.weights.get(f, 0.0) for f in word_features(word))))


def summary(words: list[str], marginals: np.ndarray) -> tuple[float, ...]:
    """What the score goes by: logit of the largest marginal; expected toxic words, different toxic words, and their share, as logarithms."""
    top = min(max(float(marginals.max(initial=0.0)), 1e-3), 1 - 1e-3)
    types: dict[str, float] = {}
    for k in np.nonzero(marginals > 0.05)[0].tolist():
        word = EDGES.sub("", words[k].lower())
        types[word] = max(types.get(word, 0.0), float(marginals[k]))
    many = float(marginals.sum())
    return math.log(top / (1 - top)), math.log1p(many), math.log1p(sum(types.values())), math.log(1e-3 + many / max(1, len(words)))


def marginals_of(field: Field, texts: list[list[str]], kept: dict[str, float]) -> list[np.ndarray]:
    """Marginals of the toxic state for each document's words; chains of like length run side by side."""
    out: list[np.ndarray] = [np.empty(0)] * len(texts)
    odds = []
    for words in texts:
        try:
            odds.append([kept[w] for w in words])
        except KeyError:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for w in words:
                if w not in kept:
                    kept[w] = field.token(w)
            odds.append([kept[w] for w in words])
    order = sorted((k for k in range(len(texts)) if odds[k]), key=lambda k: len(odds[k]))
    at = 0
    while at < len(order):
        n = min(SIDE_BY_SIDE, len(order) - at)
        while n > 1 and n * len(odds[order[at + n - 1]]) > CELLS:
            n //= 2
        group, at = order[at : at + n], at + n
        padded = np.zeros((len(group), len(odds[group[-1]])))
        for row, k in enumerate(group):
            padded[row, : len(odds[k])] = odds[k]
        found = chain(padded, field.a01, field.a10, field.a11)[2]
        for row, k in enumerate(group):
            out[k] = found[row, : len(odds[k])]
    return out


def features_of(words: list[str]) -> set[str]:
    return {f for w in set(words) for f in word_features(w)}


def sets_apart(k: int, c: int, n: tuple[int, int]) -> bool:
    """Whether a feature of `k` toxic and `c` clean documents, of `n` clean and toxic ones, marks tokens as toxic."""
    if not k:
        return False
    share = n[1] / (n[0] + n[1])
    g = 2 * (k * math.log(k / ((k + c) * share)) + (c * math.log(c / ((k + c) * (1 - share))) if c else 0))
    return g >= MIN_G and math.log((k + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1)) >= MIN_ODDS


def toxic_features(docs: list[list[str]], toxic: list[int]) -> set[str]:
    """Features that set the toxic documents apart, by documents they occur in."""
    n, found = Counter(toxic), (Counter(), Counter())
    for words, label in zip(docs, toxic):
        found[label].update(features_of(words))
    return {f for f, k in found[1].items() if sets_apart(k, found[0][f], (n[0], n[1]))}


def segments_of(key: object, words: list[str], label: int, marks: set[str]) -> Iterator[tuple[int, list[str], list[int]]]:
    """(draw, words, tags) of the segments of a whole text that the field may learn from: toxic ones with a tag, all clean ones."""
    for at in range(0, len(words), SEGMENT):
        part = words[at : at + SEGMENT]
        tagged = [int(label and not marks.isdisjoint(word_features(w))) for w in part]
        if any(tagged) or not label:
            yield xxhash.xxh64_intdigest(f"{key} {at}", 3) >> 1, part, tagged


def clean_number(toxic_segments: int) -> int:
    return max(CLEAN_LEAST, CLEAN_RATIO * toxic_segments)


def fit(texts: list[str], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Field | None:
    """The field for labelled texts; weights: of a clean and of a toxic document in the curve. None if a class is missing."""
    if len(set(toxic)) < 2:
        return None
    docs = [[*map(sys.intern, t.split())] for t in texts]  # a word is held once
    marks = toxic_features(docs, toxic)
    found = sorted(x for k, (words, label) in enumerate(zip(docs, toxic)) for x in segments_of(k, words, label, marks))
    some = [x for x in found if any(x[2])][:TOXIC_SEGMENTS]
    field = fit_segments(some + [x for x in found if not any(x[2])][: clean_number(len(some))])
    field.curve = fit_curve([summary(w, m) for w, m in zip(docs, marginals_of(field, docs, {}))], toxic, weights)
    return field


def fit_segments(chosen: list[tuple[int, list[str], list[int]]]) -> Field:
    """The field without its curve, from segments (draw, words, tags). Rounds go over blocks of segments, so that memory is bounded by a block."""
    count = Counter(f for _, part, _ in chosen for w in part for f in set(word_features(w)))
    names = [f for f, n in count.items() if n >= 3]
    index = {f: k + 1 for k, f in enumerate(names)}
    width = 1 + len(PREFIXES)
    ids, tags, sizes = np.zeros((len(chosen), SEGMENT, width), np.int32), np.zeros((len(chosen), SEGMENT), bool), np.array([len(part) for _, part, _ in chosen])
    for s, (_, part, tagged) in enumerate(chosen):
        tags[s, : len(part)] = tagged
        for t, w in enumerate(part):
            own = [index.get(f, 0) for f in word_features(w)]
            ids[s, t, : len(own)] = own
    theta, steps = np.zeros(len(names) + 1), np.array([-2.0, -2.0, -1.0, -1.0])  # steps: bias, 01, 10, 11
    sum_t, sum_s, total = np.full_like(theta, 1e-8), np.full(4, 1e-8), sizes.sum()
    for _ in range(ROUNDS):
        theta[0] = 0
        grad, grad_s = np.zeros_like(theta), np.zeros(4)
        for at in range(0, len(chosen), FIT_BLOCK):
            own, y = ids[at : at + FIT_BLOCK], tags[at : at + FIT_BLOCK].astype(float)
            real = (np.arange(SEGMENT) < sizes[at : at + FIT_BLOCK, None]).astype(float)
            odds = np.exp(np.minimum(30, theta[own].sum(-1) + steps[0])) * real
            a01, a10, a11 = np.exp(steps[1:])
            forward, backward, p = chain(odds, a01, a10, a11)
            before = np.concatenate([np.zeros((len(p), 1)), forward[:, :-1]], axis=1)
            x = odds * backward
            w01, w10, w11 = a01 * x, before * a10, before * a11 * x
            norm = (1 + w01 + w10 + w11) / real.clip(1e-300)
            was = np.concatenate([np.zeros((len(y), 1)), y[:, :-1]], axis=1)
            error = (y - p) * real
            grad += np.bincount(own.ravel(), np.repeat(error.ravel(), width), len(theta))
            grad_s += [error.sum(), (((1 - was) * y) - w01 / norm).sum(), ((was * (1 - y)) * real - w10 / norm).sum(), (was * y - w11 / norm).sum()]
        grad, grad_s = grad / total - PENALTY * theta, grad_s / total - PENALTY * steps
        sum_t += grad**2
        sum_s += grad_s**2
        theta += 0.5 * grad / np.sqrt(sum_t)
        steps += 0.2 * grad_s / np.sqrt(sum_s)
    used = {f: float(theta[k]) for f, k in index.items() if abs(theta[k]) > 0.02}
    return Field(used, float(steps[0]), *map(float, np.exp(steps[1:])))


def fit_curve(summaries: list[tuple[float, ...]], toxic: list[int], weights: tuple[float, float]) -> tuple[float, ...]:
    """The logistic curve over 1 and the values of `summary`."""
    x = np.array([(1.0, *found) for found in summaries])
    t, w, beta = np.array(toxic, float), np.where(np.array(toxic) == 1, weights[1], weights[0]), np.zeros(x.shape[1])
    w = w / w.sum()
    for _ in range(30):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(hessian, x.T @ (w * (t - p)) - 1e-4 * beta)
    return tuple(map(float, beta))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", per_class: int = SAMPLE_DOCS) -> DataFrame:
    """Up to `per_class` labelled rows (id, toxic, n) of each class, by a hash of the id; n: labelled rows of the class.

    Only ids whose crc32 modulo 3 is not 1; an id with both labels counts as toxic, null labels don't count.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
             .where(F.crc32(F.col("id").cast("string")) % 3 != 1).groupBy("id").agg(F.max("toxic").alias("toxic")))
    return bounded_sample(known, "toxic", per_class)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_DOCS) -> Field | None:
    """The field learned from a bounded sample of `labels` (id, toxic); None if it has no documents of both classes.

    Null ids, texts and labels are not learned from; rows of one id count once, with their smallest text, and as toxic if
    one label says so; ties of the sample go by id. Empty tables give None.
    """
    sample = training_rows(docs, labels, id_col, per_class)  # at most 2 * per_class rows: small enough to broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "id")
    one = texts.groupBy("id", "toxic", "n").agg(F.min("text").alias("text"))  # repeated ids: one text
    rows = written(one.select("id", "toxic", "n", "text"), "labelled")
    classes = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.count("*").alias("used"), F.max("n").alias("n")).collect()}
    if len(classes) < 2:
        return None
    n = classes[0]["used"], classes[1]["used"]
    counted = rows.select("toxic", "text").mapInArrow(_document_features, "f string, c long, k long").groupBy("f").agg(F.sum("c").alias("c"), F.sum("k").alias("k"))
    marks = {r["f"] for r in counted.where("k > 0").mapInArrow(_marking(n), "f string").collect()}
    # Of whole texts: what comes to the driver is bounded by the numbers of segments, features and summaries.
    segments = written(rows.select("id", "toxic", "text").mapInArrow(_segments(marks), "draw long, words string, tags binary, tagged boolean"), "segments")

    def first(tagged: bool, most: int) -> list[tuple[int, list[str], list[int]]]:
        found = segments.where(F.col("tagged") == tagged).orderBy("draw", "words").limit(most).collect()
        return [(r["draw"], [*map(sys.intern, r["words"].split(" "))], list(r["tags"])) for r in found]

    some = first(True, TOXIC_SEGMENTS)
    field = fit_segments(some + first(False, clean_number(len(some))))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "toxic", "text").mapInArrow(_summaries(field), f"id {kind}, toxic int, values array<double>").collect()
    found.sort(key=lambda r: r["id"])
    field.curve = fit_curve([r["values"] for r in found], [r["toxic"] for r in found], tuple(classes[c]["n"] / classes[c]["used"] for c in (0, 1)))
    return field


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, clean documents, toxic documents), summed up a batch."""
    for batch in batches:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found[label].update(features_of(text.as_py().split()))
        names = [*(found[0].keys() | found[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in found)], ["f", "c", "k"])


def _marking(n: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, c, k = batch.to_pydict().values()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, a, b in zip(f, c, k) if sets_apart(b, a, n)], pa.string())], ["f"])

    return run


def _segments(marks: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = [*segments_of(key, text.as_py().split(), label, marks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), pa.array([" ".join(x[1]) for x in found], pa.string()),
                     pa.array([bytes(x[2]) for x in found], pa.binary()), pa.array([any(x[2]) for x in found], pa.bool_())], ["draw", "words", "tags", "tagged"])

    return run


def _summaries(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                words = [x.split() for x in batch.column(2).to_pylist()]
                found = [summary(w, m) for w, m in zip(words, marginals_of(field, words, kept))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["id", "toxic", "values"])

    return run


def spans(text: str, marginals: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of words whose marginal is `least` or more: character offsets and the largest marginal."""
    out: list[dict] = []
    last = -2
    hot = set(np.nonzero(marginals >= least)[0].tolist())
    if hot:
        for k, word in enumerate(re.finditer(r"\S+", text)):
            if k in hot:
                p = float(marginals[k])
                if k == last + 1:
                    out[-1] = {"start": out[-1]["start"], "end": word.end(), "p": max(p, out[-1]["p"])}
                else:
                    out.append({"start": word.start(), "end": word.end(), "p": p})
                last = k
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _score(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [x or "" for x in batch.column(0).to_pylist()]
                words = [t.split() for t in texts]
                found = marginals_of(field, words, kept) if field else [np.empty(0)] * len(texts)
                scores = [0.0] * len(texts)
                if field:
                    for k, m in enumerate(found):
                        z = sum(b * x for b, x in zip(field.curve, (1.0, *summary(words[k], m))))
                        scores[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(scores, pa.float64()), pa.array([spans(t, m) for t, m in zip(texts, found)], _SPANS)], [*batch.schema.names[1:], "score", "spans"])

    return run


def toxicity(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, *keep, score, spans) per row of `docs`; spans: start, end (characters of the text) and marginal of what offends.

    Whole texts are scored. Null and empty texts have the score of a text without a toxic word and no spans; without a
    field (no labels of both classes) scores are 0. Repeated rows stay; columns not in `keep` are dropped; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return (rows.mapInArrow(_score(field), f"{kinds}, score double, spans array<struct<start:int,end:int,p:double>>")
            .select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "score", "spans"))
