"""Soft-membership mixing: rates per document whose expected token totals per domain match targets.

A multinomial logistic regression over hashed words, learned from a labelled table, predicts how far each document
belongs to each domain. Rates are found by accelerated projected gradient descent on the weighted squared differences
between expected and target totals. A document's rate follows from its posteriors and the residuals of all rounds so
far (a few numbers each), so that a round is one scan with one small aggregate: no rate is stored or shuffled.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, written

#: Labelled documents of each domain that the classifier is fitted on at most: a bound of the fit alone.
SAMPLE_DOCS = 3000
FEATURES, KEPT_WORDS = 1 << 14, 300_000
#: Rounds of the descent at most; it ends at this relative difference from the targets, or where three rounds in turn
#: change the sum of squares by less than this part of it (targets out of reach).
ROUNDS, NEAR, CALM = 100, 1e-4, 1e-6
#: Targets missed by more than this part of them are warned of.
MISS = 0.01
#: Cells of the space of posteriors in which budgets are tried, at most; factor from one budget to the next, and budgets tried.
CELLS, WIDER, TRIES = 4096, 1.1, 40
log = logging.getLogger(__name__)


def word_indices(text: str, known: dict[str, int]) -> list[int]:
    """The hashed feature of each word of a text, in lower case; `known` remembers words, up to a bound."""
    words = text.lower().split()
    try:
        return [known[w] for w in words]
    except KeyError:
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES
        return [known[w] for w in words]


@dataclass
class Domains:
    """A linear classifier: a row of weights for each domain, over hashed words, and biases. -inf: never seen."""

    names: list[str]
    weights: np.ndarray  # (FEATURES, domains)
    bias: np.ndarray

    def posterior(self, indices: list[int]) -> np.ndarray:
        z = self.bias + self.weights[indices].sum(axis=0) if indices else self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text",
                domain_col: str = "domain", per_domain: int = SAMPLE_DOCS) -> Domains:
    """The classifier for `names`, from up to `per_domain` rows of each domain of `labelled` (id, domain), by a hash of the id.

    Null ids, other domains and ids with two domains are not learned from; null texts are empty.
    """
    known = (labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where("id is not null").where(F.col("domain").isin(names))
             .groupBy("id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other").select("id", "domain"))
    sample = bounded_sample(known, "domain", per_domain).select("id", "domain")
    label = F.element_at(F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(float(k))))), F.col("domain"))

    # Buckets as words of a fixed vocabulary: counted into sparse vectors without Python.
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(FEATURES)], inputCol="buckets", outputCol="features")
    # At most len(names) * per_domain ids: small enough to broadcast.
    texts = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
             .groupBy("id", "domain").agg(F.min("text").alias("text")).select("text", label.alias("label")))
    scratch = Scratch()
    rows = scratch.written(vectors.transform(texts.mapInArrow(_buckets, "buckets array<string>, label double")).select("features", "label"), "labelled")
    seen = sorted(int(r[0]) for r in rows.select("label").distinct().collect())
    weights, bias = np.zeros((FEATURES, len(names))), np.full(len(names), -np.inf)
    if len(seen) > 1:
        model = LogisticRegression(family="multinomial", maxIter=40, regParam=0.01).fit(rows)
        for k in seen:
            weights[:, k], bias[k] = model.coefficientMatrix.toArray()[k], model.interceptVector[k]
    else:
        bias[seen[0] if seen else 0] = 0.0
    scratch.clear()
    return Domains(names, weights, bias)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        found = [[*map(str, word_indices(x.as_py(), known))] for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["buckets", "label"])


def _predict(domains: Domains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            tokens, p = np.zeros(batch.num_rows, np.int64), np.empty((batch.num_rows, len(domains.names)))
            for k, text in enumerate(batch.column(0)):
                indices = word_indices(text.as_py() or "", known)
                tokens[k], p[k] = len(indices), domains.posterior(indices)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(tokens), lists], [*batch.schema.names[1:], "tokens", "p"])

    return run


def with_posteriors(rows: DataFrame, domains: Domains) -> DataFrame:
    """`rows` (text, ...) without the text, with tokens (words) and p (posteriors in the order of the names)."""
    rest = rows.select("text", *(c for c in rows.columns if c != "text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields[1:])
    return rest.mapInArrow(_predict(domains), f"{kinds}, tokens long, p array<double>")


@dataclass(frozen=True)
class Descent:
    """All that a document's rate follows from: where rates start, their bounds, and each round's gradient and momentum."""

    start: float
    step: float
    least: float
    most: float
    history: tuple[tuple[tuple[float, ...], float], ...] = ()

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, points ahead of them) after all rounds, of documents with posteriors `p` (documents, domains)."""
        rate = point = np.full(len(p), self.start)
        for gradient, momentum in self.history:
            new = np.clip(point - self.step * (p @ np.array(gradient)), self.least, self.most)
            rate, point = new, new + momentum * (new - rate)
        return rate, point


def _posteriors(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(descent: Descent, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, tokens = _posteriors(batch.column(0), d), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            rate, point = descent.replay(p)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(p.T @ (tokens * rate), p.T @ (tokens * point))), pa.array(np.arange(2 * d, dtype=np.int32))], ["total", "k"])

    return run


def _with_rate(descent: Descent, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = descent.replay(_posteriors(batch.column(0), d))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    return run


def rates(members: DataFrame, targets: list[float], least: float = 0.0, most: float = float("inf"), rounds: int = ROUNDS, near: float = NEAR) -> tuple[Descent, np.ndarray]:
    """The descent for `members` (p array<double>, tokens), and the expected totals it reaches.

    Rates between `least` and `most` minimise the sum over domains of (expected total - target) ** 2 / target, from
    equal rates on; targets of 0 are weighed as the mean target. `members` is scanned once a round; what comes back is
    two sums a domain. Momentum starts anew where the sum of squares has grown.
    """
    target, d, most = np.array(targets, float), len(targets), min(most, 1e30)
    weight = 1 / np.where(target > 0, target, max(target.mean(), 1e-300))
    moments = members.agg(*(F.coalesce(F.sum(F.col("tokens") * F.get("p", a)), F.lit(0.0)).alias(f"t{a}") for a in range(d)),
                          *(F.coalesce(F.sum(F.col("tokens") * F.get("p", a) * F.get("p", b)), F.lit(0.0)).alias(f"m{a}_{b}") for a in range(d) for b in range(a, d))).first()
    totals = np.array([moments[f"t{a}"] for a in range(d)])
    if totals.sum() <= 0:
        return Descent(float(max(least, min(most, 1.0))), 0.0, least, most), totals
    gram = np.array([[moments[f"m{min(a, b)}_{max(a, b)}"] for b in range(d)] for a in range(d)])
    # In the metric of the tokens, the Hessian has the eigenvalues of sqrt(weight) gram sqrt(weight).
    step = float(1 / max(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram * np.sqrt(weight)).max(), 1e-300))
    descent = Descent(float(max(least, min(most, target.sum() / totals.sum()))), step, least, most)
    momentum, expected, at_point, calm = 1.0, descent.start * totals, descent.start * totals, 0
    loss = lambda s: float((weight * (s - target) ** 2).sum())
    for _ in range(rounds):
        if np.abs((expected - target) * weight).max() < near or calm == 3:
            break
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        round_ = tuple((weight * (at_point - target)).tolist()), (momentum - 1) / following
        descent = replace(descent, history=(*descent.history, round_))
        sums = {r["k"]: r["total"] for r in members.select("p", "tokens").mapInArrow(_sums(descent, d), "total double, k int").groupBy("k").agg(F.sum("total").alias("total")).collect()}
        before, expected, at_point = loss(expected), np.array([sums[a] for a in range(d)]), np.array([sums[d + a] for a in range(d)])
        calm = calm + 1 if abs(before - loss(expected)) < CALM * before else 0
        momentum = following if loss(expected) <= before else 1.0
    return descent, expected


def posterior_cells(members: DataFrame, d: int) -> np.ndarray:
    """(cells, domains): tokens times posteriors, added up by cells of like posteriors, of which there are CELLS at most."""
    parts = max(1, int(CELLS ** (1 / max(1, d - 1))) - 1)
    cell = F.concat_ws(",", *(F.floor(F.get("p", a) * parts).cast("int").cast("string") for a in range(d - 1)))
    sums = members.groupBy(cell.alias("cell")).agg(*(F.sum(F.col("tokens") * F.get("p", a)).alias(f"t{a}") for a in range(d))).drop("cell")
    return np.array([tuple(r) for r in sums.collect()], float).reshape(-1, d)


def reachable_budget(cells: np.ndarray, shares: list[float], least: float, most: float) -> float:
    """The smallest budget tried, in tokens over the tokens there are, at which rates from `least` to `most` reach the shares.

    Rates that are equal in a cell are a choice that documents have too. Where no budget will do, it is the one that
    misses least.
    """
    totals, share = cells.sum(axis=0), np.array(shares) / sum(shares)
    if totals.sum() <= 0:
        return max(least, min(most, 1.0))
    low = min(most, float(max(least, (least * totals / np.where(share > 0, share * totals.sum(), np.inf)).max()))) if least > 0 else 1.0
    weight, mean = 1 / np.where(share > 0, share, share.mean()), cells / np.maximum(cells.sum(axis=1, keepdims=True), 1e-300)
    step = 1 / np.linalg.eigvalsh(np.sqrt(weight)[:, None] * (cells.T @ mean) * np.sqrt(weight)).max()  # as for documents
    best = np.inf, low
    for k in range(TRIES):
        budget = low * WIDER**k
        if budget > most:
            break
        target = budget * share * totals.sum()
        rate = point = np.full(len(cells), float(np.clip(budget, least, most)))
        momentum = 1.0
        for _ in range(2000):
            new = np.clip(point - step * (mean @ (weight * (point @ cells - target))), least, most)
            following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            rate, point, momentum = new, new + (momentum - 1) / following * (new - rate), following
        miss = float((np.abs(rate @ cells - target) / np.maximum(target, 1e-300)).max())
        if miss < best[0]:
            best = miss, budget
        if miss < MISS / 10:
            break
    return best[1]


def report(names: list[str], target: list[float], reached: np.ndarray) -> list[str]:
    """A line for each domain with its reached and target share and tokens; domains off by more than MISS are warned of."""
    lines, all_target, all_reached = [], max(sum(target), 1e-300), max(float(reached.sum()), 1e-300)
    for name, t, r in zip(names, target, reached.tolist()):
        lines.append(f"{name}: share {r / all_reached:.4f}, target {t / all_target:.4f}; tokens {r:.0f}, target {t:.0f}")
        log.log(logging.WARNING if abs(r - t) > MISS * max(t, 1.0) else logging.INFO, "mix %s", lines[-1])
    return lines


def copies(rate: str, id_col: str, seed: int = 7) -> F.Column:
    """A rate as a whole number of copies: its floor, and one more as often as its fraction says, by a hash of the id."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], budget: float | None = 1.0, least: float = 0.0, most: float = 1e6,
        id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, *keep, tokens, posterior, rate, copies) per row of `docs`.

    shares: of the domains in the mix, over 0 or more tokens each; budget: tokens of the mix, as a multiple of the
    tokens of `docs`; None: the smallest at which rates from `least` to `most` reach the shares. rate: how often the document is to be seen on average; copies: that as a whole number.
    Posteriors are predicted by a classifier fitted on `labelled` (id, domain). Null and empty texts have 0 tokens and
    the classifier's prior; without labels of two domains all documents are of the one that was seen. A domain that no
    document is of has no target: the others share its weight. Texts are read
    whole; repeated rows are documents of their own; other columns are ignored; an empty table gives an empty result.
    """
    names = list(shares)
    domains = fit_domains(docs, labelled, names, id_col, text_col, domain_col)
    own = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep), F.col(text_col).cast("string").alias("text"))
    rows = written(with_posteriors(own, domains), "members")
    there = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *(F.coalesce(F.sum(F.col("tokens") * F.get("p", k)), F.lit(0.0)) for k in range(len(names)))).first()
    tokens, wanted = there[0], [s if t > 0 else 0.0 for s, t in zip(shares.values(), there[1:])]
    for name, s, w in zip(names, shares.values(), wanted):
        if s and not w and tokens:
            log.warning("mix %s: no document is of this domain; the others share its weight", name)
    if budget is None:
        budget = reachable_budget(posterior_cells(rows, len(names)), wanted, least, most) if sum(wanted) else 1.0
    target = [budget * tokens * w / (sum(wanted) or 1.0) for w in wanted]
    descent, reached = rates(rows.select("p", "tokens"), target, least, most)
    report(names, target, reached)
    rows = rows.select("p", *(c for c in rows.columns if c != "p"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return (rows.mapInArrow(_with_rate(descent, len(names)), f"{kinds}, rate double").withColumn("copies", copies("rate", "id"))
            .select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "tokens", F.col("p").alias("posterior"), "rate", "copies"))


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Domains (id, domain) of the table of labels: toxic, else fine or plain by quality; rows with a null label have none."""
    return labels.select(id_col, F.expr("case when toxic = 1 then 'toxic' when toxic = 0 and quality = 1 then 'fine' when toxic = 0 and quality = 0 then 'plain' end").alias("domain"))
