"""Thresholds of total-ion-current images: candidates, their scores, and the choice among them.

An image is what its histogram or a few sums say: never are its pixels gathered. Absent pixels of the grid are zeros
and count. Rows are per image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import grouped_quantiles
from ..functions.tables import Scratch, written
from .image import grid_bounds

BINS = 256
METHODS = ("otsu", "triangle", "li", "yen", "isodata", "percentile", "gmm2", "gmm3")


def with_zeros(tic: DataFrame) -> DataFrame:
    """(image_id, tic, n): how often each value occurs on an image's grid, zeros included."""
    bounds = grid_bounds(tic).select("image_id", (F.col("width").cast("long") * F.col("height")).alias("size"))
    seen = tic.groupBy("image_id").agg(F.count("*").alias("n"))
    zeros = bounds.join(seen, "image_id").select("image_id", F.lit(0.0).alias("tic"), (F.col("size") - F.col("n")).alias("n")).where("n > 0")
    return tic.groupBy("image_id", F.col("tic").cast("double").alias("tic")).agg(F.count("*").alias("n")).unionByName(zeros)


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(image_id, lo, hi, bucket, n) of (image_id, tic, n): equal widths, the last bucket closed; empty buckets have no row."""
    range_ = values.groupBy("image_id").agg(F.min("tic").alias("lo"), F.max("tic").alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("tic") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return values.join(range_, "image_id").groupBy("image_id", "lo", "hi", bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n"))


def _dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = float(rows["lo"].iloc[0]), float(rows["hi"].iloc[0])
    counts = np.zeros(BINS)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts, lo + (np.arange(BINS) + 0.5) * (hi - lo) / BINS


def otsu(counts: np.ndarray, centres: np.ndarray) -> float:
    """Centre after which the variance between the two sides is largest."""
    n, s = np.cumsum(counts)[:-1], np.cumsum(counts * centres)[:-1]
    rest = counts.sum() - n
    with np.errstate(all="ignore"):
        between = n * rest * (s / n - ((counts * centres).sum() - s) / rest) ** 2
    return float(centres[np.nanargmax(between)])


def triangle(counts: np.ndarray, centres: np.ndarray) -> float:
    """Bucket farthest from the line between the peak and the end of the longer tail."""
    peak, ends = int(counts.argmax()), np.flatnonzero(counts)[[0, -1]]
    flip = peak - ends[0] < ends[1] - peak
    own = counts[::-1] if flip else counts
    low, top = (len(counts) - 1 - ends[1], len(counts) - 1 - peak) if flip else (ends[0], peak)
    x = np.arange(top - low)
    if not len(x):
        return float(centres[peak])
    at = int((counts[peak] * x - (top - low) * own[low + x]).argmax()) + low
    return float(centres[len(counts) - 1 - at if flip else at])


def yen(counts: np.ndarray, centres: np.ndarray) -> float:
    """Centre with the largest correlation criterion."""
    p = counts / counts.sum()
    first, squares = np.cumsum(p)[:-1], np.cumsum(p * p)[:-1]
    rest = (p * p)[::-1].cumsum()[::-1][1:]
    with np.errstate(all="ignore"):
        criterion = np.log((first * (1 - first)) ** 2 / (squares * rest))
    return float(centres[np.nanargmax(np.where(np.isfinite(criterion), criterion, -np.inf))])


def isodata(counts: np.ndarray, centres: np.ndarray) -> float:
    """First centre that lies, to within a bucket, midway between the means of the two sides."""
    n, s = np.cumsum(counts)[:-1], np.cumsum(counts * centres)[:-1]
    with np.errstate(all="ignore"):
        off = (s / n + ((counts * centres).sum() - s) / (counts.sum() - n)) / 2 - centres[:-1]
    hit = np.flatnonzero((off >= 0) & (off < centres[1] - centres[0]))
    return float(centres[hit[0]]) if len(hit) else float("nan")


def _by_histogram(rows: pd.DataFrame) -> pd.DataFrame:
    counts, centres = _dense(rows)
    if rows["lo"].iloc[0] == rows["hi"].iloc[0]:
        found = {name: float(rows["lo"].iloc[0]) for name in ("otsu", "triangle", "yen", "isodata")}
    else:
        found = {f.__name__: f(counts, centres) for f in (otsu, triangle, yen, isodata)}
    return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "method": list(found), "threshold": list(found.values())})


def histogram_thresholds(tic: DataFrame) -> DataFrame:
    """(image_id, method, threshold) for otsu, triangle, yen and isodata: `BINS` rows an image reach a task."""
    return histogram(with_zeros(tic)).groupBy("image_id").applyInPandas(_by_histogram, "image_id string, method string, threshold double")


def li_threshold(tic: DataFrame, rounds: int = 100) -> DataFrame:
    """Minimum cross-entropy: t moves to (mean below - mean above) / (log of these) until it stays.

    All images take a round in one job; their state is a written table, whose size the next join goes by.
    """
    values, now = Scratch(), Scratch()
    counts = values.written(with_zeros(tic), "values")
    state = now.written(counts.groupBy("image_id").agg(F.min("tic").alias("low"), (F.sum(F.col("tic") * F.col("n")) / F.sum("n")).alias("mean"))
                        .select("image_id", "low", (F.col("mean") - F.col("low")).alias("t"), F.lit(True).alias("moving")), "li")
    for _ in range(rounds):
        if not state.where("moving").limit(1).count():
            break
        v = F.col("tic") - F.col("low")
        above = v > F.col("t")
        means = (counts.join(state.where("moving"), "image_id").groupBy("image_id").agg(
            (F.sum(F.when(above, v * F.col("n"))) / F.sum(F.when(above, F.col("n")))).alias("fore"), (F.sum(F.when(~above, v * F.col("n"))) / F.sum(F.when(~above, F.col("n")))).alias("back")))
        going = state.join(means.where("back > 0 and fore is not null"), "image_id", "left")
        new = F.coalesce((F.col("back") - F.col("fore")) / (F.log("back") - F.log("fore")), F.col("t"))
        moves = F.col("back").isNotNull() & (F.abs(new - F.col("t")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("t")))
        following = Scratch()
        state = following.written(going.select("image_id", "low", new.alias("t"), moves.alias("moving")), "li")
        now.clear()
        now = following
    values.clear()
    return state.select("image_id", F.lit("li").alias("method"), (F.col("low") + F.col("t")).alias("threshold"))


def percentile_threshold(tic: DataFrame, percentile: float = 75.0) -> DataFrame:
    """Percentile of the values over 0."""
    found = grouped_quantiles(tic.where("tic > 0"), ["image_id"], "tic", (percentile / 100,))
    return found.select("image_id", F.lit("percentile").alias("method"), F.get("q", F.lit(0)).alias("threshold"))


def _mixture(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a one-dimensional mixture by expectation-maximisation, from quantile starts."""
    share = np.cumsum(weight) / weight.sum()
    mean = np.array([x[np.searchsorted(share, (j + 0.5) / k)] for j in range(k)])
    overall = np.average((x - np.average(x, weights=weight)) ** 2, weights=weight)
    var, pi, last = np.full(k, max(overall, 1e-6)), np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        log = np.log(pi) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = log.max(axis=1, keepdims=True)
        density = np.exp(log - top)
        total = density.sum(axis=1, keepdims=True)
        own = density / total * weight[:, None]
        like = float((weight * (top + np.log(total))[:, 0]).sum() / weight.sum())
        n = own.sum(axis=0) + 1e-12
        pi, mean = n / n.sum(), (own * x[:, None]).sum(axis=0) / n
        var = (own * (x[:, None] - mean) ** 2).sum(axis=0) / n + 1e-6
        if abs(like - last) < 1e-6:
            break
        last = like
    return pi, mean, var


#: Components of the two mixtures; a mixture of two has a third one without weight.
COMPONENTS = (2, 3)
_STATE = [f"{c}{j}" for c in "pms" for j in range(max(COMPONENTS))]


def _start(rows: pd.DataFrame) -> pd.DataFrame:
    """Mixtures of a histogram (centre, n): where the rounds over all values start."""
    x, weight = rows["centre"].to_numpy(), rows["n"].to_numpy().astype(float)
    order = np.argsort(x)
    found = []
    for k in COMPONENTS:
        if len(x) >= k:
            pad = lambda a, fill: [*a.tolist(), *[fill] * (max(COMPONENTS) - k)]  # noqa: E731,B023
            pi, mean, var = _mixture(x[order], weight[order], k)
            found.append((rows["image_id"].iloc[0], k, *pad(pi, 0.0), *pad(mean, 0.0), *pad(var, 1.0)))
    return pd.DataFrame(found, columns=["image_id", "k", *_STATE])


def _crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the two lowest components are equally likely, on a grid of 500 places between their means."""
    for rows in batches:
        found = []
        for r in rows.itertuples():
            pi, mean, var = (np.array([getattr(r, f"{c}{j}") for j in range(r.k)]) for c in "pms")
            low, high = np.argsort(mean)[:2]
            grid = np.linspace(mean[low], mean[high], 500)
            log = np.log(pi) - 0.5 * np.log(var) - (grid[:, None] - mean) ** 2 / (2 * var)
            p = np.exp(log - log.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            found.append((r.image_id, f"gmm{r.k}", float(np.expm1(grid[np.abs(p[:, low] - p[:, high]).argmin()]))))
        yield pd.DataFrame(found, columns=["image_id", "method", "threshold"])


def _round(values: DataFrame, state: DataFrame) -> DataFrame:
    """The mixtures of `state` after a round of expectation and maximisation over `values` (image_id, v, n): one aggregation for all images and both k."""
    each, js = values.join(state, "image_id"), range(max(COMPONENTS))
    log = [F.when(F.col(f"p{j}") > 0, F.log(f"p{j}") - 0.5 * F.log(2 * math.pi * F.col(f"s{j}")) - F.pow(F.col("v") - F.col(f"m{j}"), 2) / (2 * F.col(f"s{j}"))).otherwise(F.lit(-1e300)) for j in js]
    each = each.withColumn("top", F.greatest(*log)).withColumns({f"d{j}": F.exp(log[j] - F.col("top")) for j in js})
    total = sum((F.col(f"d{j}") for j in js), F.lit(0.0))
    own = lambda j: F.col("n") * F.col(f"d{j}") / total
    gap = lambda j: F.col("v") - F.col(f"m{j}")
    sums = each.groupBy("image_id", "k", *_STATE, F.col("like").alias("was")).agg(
        F.sum("n").alias("all"), (F.sum(F.col("n") * (F.col("top") + F.log(total))) / F.sum("n")).alias("like"),
        *(F.sum(own(j)).alias(f"n{j}") for j in js), *(F.sum(own(j) * gap(j)).alias(f"a{j}") for j in js), *(F.sum(own(j) * gap(j) * gap(j)).alias(f"b{j}") for j in js))
    weight = lambda j: F.col(f"n{j}") + 1e-12
    there = lambda j, new: F.when(F.col(f"p{j}") > 0, new).otherwise(F.lit(0.0))
    moved = lambda j: F.col(f"a{j}") / weight(j)
    return sums.select("image_id", "k", *(there(j, weight(j) / F.col("all")).alias(f"p{j}") for j in js), *(there(j, F.col(f"m{j}") + moved(j)).alias(f"m{j}") for j in js),
                       *(F.when(F.col(f"p{j}") > 0, F.greatest(F.col(f"b{j}") / weight(j) - moved(j) * moved(j), F.lit(0.0)) + 1e-6).otherwise(F.lit(1.0)).alias(f"s{j}") for j in js), "like", "was")


def mixtures(tic: DataFrame, bins: int = 2048, rounds: int = 300, settled: float = 1e-6) -> DataFrame:
    """(image_id, k, p0.., m0.., s0..): weights, means and variances of mixtures over log1p of the values over 0, of all images.

    They start from mixtures of a histogram of `bins` buckets; then rounds go over all distinct values with their
    numbers, until an image's mean log-likelihood moves by less than `settled`. Rounds are written tables.
    """
    scratch = Scratch()
    values = scratch.written(tic.where("tic > 0").groupBy("image_id", F.log1p("tic").alias("v")).agg(F.count("*").alias("n")), "values")
    range_ = values.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    counts = values.join(range_, "image_id").groupBy("image_id", bucket.alias("bucket")).agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("centre"))
    kind = tic.schema["image_id"].dataType.simpleString()
    state = counts.groupBy("image_id").applyInPandas(_start, f"image_id {kind}, k int, " + ", ".join(f"{c} double" for c in _STATE))
    now = Scratch()
    state = now.written(state.withColumns({"like": F.lit(float("-inf")), "was": F.lit(float("inf"))}), "mixtures")
    still = ~F.coalesce(F.abs(F.col("like") - F.col("was")) < settled, F.lit(False))
    for _ in range(rounds):
        if state.where(still).isEmpty():
            break
        following = Scratch()
        new = following.written(_round(values, state.where(still).drop("was")).unionByName(state.where(~still)), "mixtures")
        now.clear()
        now, state = following, new
    out = written(state.select("image_id", "k", *_STATE), "fitted")
    now.clear()
    scratch.clear()
    return out


def gmm_thresholds(tic: DataFrame, bins: int = 2048) -> DataFrame:
    """gmm2 and gmm3: where the two lowest components of a mixture over log1p of the values over 0 are equally likely; an image with fewer different values has none."""
    kind = tic.schema["image_id"].dataType.simpleString()
    return mixtures(tic, bins).mapInPandas(_crossing, f"image_id {kind}, method string, threshold double")


def scored(tic: DataFrame, candidates: DataFrame, least: float = 0.05, most: float = 0.60) -> DataFrame:
    """Candidates (image_id, method, threshold) with score and cell_frac: how well they part the image, and how near the
    share of cells is to 0.15; 0 where that share is out of bounds. One pass over the values, zeros by number. Scores have
    twelve places: what differs by the order of summation alone is a tie."""
    v = F.col("tic")
    above = v > F.col("threshold")
    sums = (with_zeros(tic).join(candidates, "image_id").groupBy("image_id", "method", "threshold").agg(
        F.sum("n").alias("n"), F.sum(v * F.col("n")).alias("s"), F.sum(v * v * F.col("n")).alias("q"),
        F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("fn"), F.coalesce(F.sum(F.when(above, v * F.col("n"))), F.lit(0.0)).alias("fs")))
    mean, share = F.col("s") / F.col("n"), F.col("fn") / F.col("n")
    fore, back = F.col("fs") / F.col("fn"), (F.col("s") - F.col("fs")) / (F.col("n") - F.col("fn"))
    between = share * F.pow(fore - mean, 2) + (1 - share) * F.pow(back - mean, 2)
    total = F.col("q") / F.col("n") - mean * mean + 1e-9
    score = 0.6 * between / total + 0.4 * F.exp(-F.pow(share - 0.15, 2) / (2 * 0.12**2))
    fine = (share >= least) & (share <= most) & (F.col("fn") > 0) & (F.col("fn") < F.col("n"))
    return sums.select("image_id", "method", "threshold", F.round(F.when(fine, score).otherwise(0.0), 12).alias("score"), share.alias("cell_frac"))


def candidates(tic: DataFrame, percentile: float = 75.0, least: float = 0.05, most: float = 0.60) -> DataFrame:
    """All candidates with their scores: eight rows an image at most."""
    found = histogram_thresholds(tic).unionByName(li_threshold(tic)).unionByName(percentile_threshold(tic, percentile)).unionByName(gmm_thresholds(tic))
    return scored(tic, found.where("not isnan(threshold)"), least, most)


def auto_threshold(tic: DataFrame, method: str = "auto", percentile: float = 75.0, least: float = 0.05, most: float = 0.60) -> DataFrame:
    """The chosen candidate of each image: the best score (auto; ties in the order of METHODS), or the method named (gmm: gmm2, else gmm3)."""
    if method not in (*METHODS, "auto", "gmm"):
        raise ValueError(f"unknown method {method}")
    return best_of(candidates(tic, percentile, least, most), method)


def best_of(found: DataFrame, method: str = "auto") -> DataFrame:
    """The chosen one of each image's candidates (image_id, method, threshold, score, cell_frac), as auto_threshold chooses."""
    place = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    if method == "gmm":
        found = found.where("method like 'gmm%'").withColumn("score_", F.lit(0.0))
    elif method == "auto":
        found = found.withColumn("score_", F.col("score"))
    else:
        found = found.where(F.col("method") == method).withColumn("score_", F.lit(0.0))
    best = F.max_by(F.struct("method", "threshold", "score", "cell_frac"), F.struct("score_", -place))
    return found.groupBy("image_id").agg(best.alias("b")).select("image_id", "b.*")


def tic_histogram(tic: DataFrame) -> DataFrame:
    """(image_id, bucket, lo, hi, n): histogram of log1p of the values over 0, of min(300, max(80, n // 200)) buckets."""
    logs = tic.where("tic > 0").select("image_id", F.log1p("tic").alias("v"))
    range_ = logs.groupBy("image_id").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.least(F.lit(300), F.greatest(F.lit(80), F.floor(F.count("*") / 200))).alias("k"))
    bucket = F.least(F.col("k") - 1, F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * F.col("k"))).cast("int")
    width = (F.col("b") - F.col("a")) / F.col("k")
    return (logs.join(range_, "image_id").withColumn("bucket", F.when(F.col("b") > F.col("a"), bucket).otherwise(0)).groupBy("image_id", "bucket", "a", "b", "k").agg(F.count("*").alias("n"))
            .select("image_id", "bucket", (F.col("a") + F.col("bucket") * width).alias("lo"), (F.col("a") + (F.col("bucket") + 1) * width).alias("hi"), "n"))
