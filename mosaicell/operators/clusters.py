"""Soft clustering of cells: standardisation, principal components, mixtures, fuzzy means, and the choice of k.

Every round of an iterative fit is one scan: tasks return sums that have the size of the model, all models that are
fitted side by side at once. Cells are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

COVARIANCES = ("tied", "full", "diag", "spherical")
#: The pairwise comparison's parts: cells on one side, on the other, and of these as many as are compared at once; tasks that share a part of the other side.
BLOCK, ACROSS, STRIP, FLOWS = 4096, 65_536, 2048, 8
#: A mixture that can't be fitted is fitted again with one covariance for all and this much on its diagonal.
RETRY_REG = 1e-4


def standardize(rows: DataFrame) -> DataFrame:
    """Long rows (bin, value, ...) with z: distance from the bin's mean in population deviations, 0 where these are 0."""
    stats = rows.groupBy("bin").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.join(F.broadcast(stats), "bin").withColumn("z", z).drop("_m", "_s")


def standardized_cells(cells: DataFrame) -> DataFrame:
    """Cells whose spectrum array is standardised bin by bin; the two arrays of statistics travel as one row."""
    stats = (cells.select(F.posexplode("spectrum").alias("bin", "v")).groupBy("bin").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "m", "s"))), lambda x: F.struct(x["m"], x["s"])).alias("_stats")))
    z = F.zip_with("spectrum", "_stats", lambda v, st: F.when(st["s"] > 0, (v - st["m"]) / st["s"]).otherwise(0.0))
    return cells.crossJoin(F.broadcast(stats)).withColumn("spectrum", z).drop("_stats")


def _products(basis: np.ndarray):
    """(bin, p: one sum for each column) of the rows' outer products with what they are in the basis."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += x.T @ (x @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(basis))), *(pa.array(c) for c in total.T)], ["bin", *(f"p{k}" for k in range(basis.shape[1]))])

    return run


def principal_components(centred: DataFrame, n: int, spare: int = 8, tolerance: float = 1e-9, scans: int = 40, seed: int = 42) -> np.ndarray:
    """The first `n` principal components (bins x n) of `centred` (v: arrays of one length, with mean 0).

    Randomised block Krylov iteration: each scan multiplies a block of n + `spare` directions by the scatter matrix, which
    is never formed; tasks return bins x block sums, which Spark adds up. It ends when the residuals of the components
    are below `tolerance` of the largest eigenvalue, or the directions span all bins. The driver holds the blocks so
    far: for 7501 bins and two components about 1 MB a scan. Signs: the largest loading is positive.
    """
    first = centred.first()
    bins = len(first["v"]) if first is not None else 0
    n = min(n, bins)
    width = min(n + spare, bins)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(bins, width)))[0] if bins else np.zeros((0, 0))
    basis, images, found = np.zeros((bins, 0)), np.zeros((bins, 0)), np.zeros((bins, n))
    for _ in range(scans if n else 0):
        names = [f"p{k}" for k in range(block.shape[1])]
        sums = centred.select("v").mapInArrow(_products(block), "bin long, " + ", ".join(f"{c} double" for c in names)).groupBy("bin").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
        image = sums.sort_values("bin")[names].to_numpy()
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:n]
        found = basis @ vectors[:, top]
        left = np.linalg.norm(images @ vectors[:, top] - found * values[top], axis=0)
        if basis.shape[1] >= bins or (left <= tolerance * max(values[top[0]], 1e-300)).all():
            break
        for _ in range(2):  # twice: what is left after the first time is not orthogonal enough
            image = image - basis @ (basis.T @ image)
        q, r = np.linalg.qr(image)
        keep = np.abs(np.diag(r)) > 1e-12 * max(np.abs(np.diag(r)).max(), 1e-300)
        block = q[:, keep][:, : bins - basis.shape[1]]
        if not block.shape[1]:
            break
    return found * np.where(found[np.abs(found).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0) if n else found


def pca_embedding(cells: DataFrame, n: int = 2, zscore: bool = True) -> DataFrame:
    """Cells with `embedding`: the first `n` principal components of their spectra, each z-scored if asked for.

    A component's sign is such that its largest loading is positive.
    """
    spark = cells.sparkSession
    centre = cells.select(F.posexplode("spectrum").alias("bin", "v")).groupBy("bin").agg(F.avg("v").alias("m"))
    centre = centre.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "m"))), lambda x: x["m"]).alias("_m"))
    centred = written(cells.crossJoin(F.broadcast(centre)).withColumn("_v", F.zip_with("spectrum", "_m", lambda v, m: v - m)).drop("_m"), "centred")
    loadings = principal_components(centred.select(F.col("_v").alias("v")), n)
    table = F.broadcast(spark.createDataFrame([(loadings.T.tolist(),)], "_l array<array<double>>"))  # one row, bins x n
    dot = F.expr("transform(_l, l -> aggregate(zip_with(_v, l, (a, b) -> a * b), 0D, (s, x) -> s + x))")
    out = centred.crossJoin(table).withColumn("embedding", dot).drop("_v", "_l")
    return zscored(out) if zscore else out


def zscored(cells: DataFrame) -> DataFrame:
    """Embeddings moved to mean 0 and deviation 1, column by column."""
    stats = cells.select(F.posexplode("embedding").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m", "s"))), lambda x: F.struct(x["m"], x["s"])).alias("_stats"))
    return cells.crossJoin(F.broadcast(stats)).withColumn("embedding", F.zip_with("embedding", "_stats", lambda v, st: (v - st["m"]) / (st["s"] + 1e-9))).drop("_stats")


@dataclass(frozen=True)
class Mixture:
    """A Gaussian mixture: weights (k), means (k, d), covariances (k, d, d), and the log-likelihood it was left with."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float = -np.inf

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, j] = np.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        log = self.log_densities(x)
        top = log.max(axis=1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _sums(points: DataFrame, stat, models: list) -> list[np.ndarray]:
    """For each model, the sum over all points of `stat(model, x)`, a flat array: one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                sums = [stat(model, x) for model in models]
                sizes = list(map(len, sums))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sums)), sizes)), pa.array(np.concatenate([np.arange(n) for n in sizes])), pa.array(np.concatenate(sums))], ["m", "k", "v"])

    found = points.select("embedding").mapInArrow(run, "m long, k long, v double").groupBy("m", "k").agg(F.sum("v").alias("v")).collect()
    out: list[dict[int, float]] = [{} for _ in models]
    for r in found:
        out[r["m"]][r["k"]] = r["v"]
    return [np.array([o[k] for k in sorted(o)]) for o in out]


def _mixture_sums(model: Mixture, x: np.ndarray) -> np.ndarray:
    r, like = model.responsibilities(x)
    return np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x).ravel(), [like.sum()]])


def _stepped(model: Mixture, sums: np.ndarray, covariance: str, reg: float) -> Mixture:
    k, d = model.means.shape
    n, s, q, like = sums[:k] + 1e-10, sums[k : k + k * d].reshape(k, d), sums[k + k * d : -1].reshape(k, d, d), sums[-1]
    means = s / n[:, None]
    own = q / n[:, None, None] - means[:, :, None] * means[:, None, :]
    if covariance == "tied":
        own = np.repeat(((own * n[:, None, None]).sum(axis=0) / n.sum())[None], k, axis=0)
    elif covariance == "diag":
        own = own * np.eye(d)
    elif covariance == "spherical":
        own = np.einsum("kii->k", own)[:, None, None] / d * np.eye(d)
    return Mixture(n / n.sum(), means, own + reg * np.eye(d), like)


def _settled(centres: np.ndarray, x: np.ndarray, weights, tol: float, rounds: int = 2000) -> np.ndarray:
    """Centres after rounds over the points `x` alone, until they move by less than `tol`."""
    for _ in range(rounds):
        w = weights(centres, x)
        new = (w.T @ x) / w.sum(axis=0)[:, None]
        if np.abs(new - centres).max() < tol:
            return new
        centres = new
    return centres


def _starts(points: DataFrame, ks: list[int], restarts: int, seed: int, sample: int = 2000, with_sample: bool = False):
    """Starting centres for each (k, restart), spread out over a sample of points by a hash: a bound of the starts alone. With the sample before them if asked for."""
    rows = points.select("embedding", F.xxhash64("embedding", F.lit(seed)).alias("h")).orderBy("h").limit(sample).collect()
    x, random = np.array([r["embedding"] for r in rows], float), np.random.default_rng(seed)
    out = {}
    for k in ks:
        for t in range(restarts):
            centres = [x[random.integers(len(x))]]
            while len(centres) < min(k, len(x)):
                d2 = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
                centres.append(x[random.choice(len(x), p=d2 / d2.sum())] if d2.sum() > 0 else x[random.integers(len(x))])
            out[k, t] = np.array(centres)
    return (x, out) if with_sample else out


def sound(model: Mixture) -> bool:
    """Whether densities can be computed: all covariances finite and positive definite."""
    try:
        return bool(np.isfinite(model.means).all() and np.isfinite(np.linalg.cholesky(model.covariances)).all())
    except np.linalg.LinAlgError:
        return False


def fit_mixtures(points: DataFrame, ks: list[int], covariance: str = "tied", reg: float = 1e-6, restarts: int = 10, rounds: int = 200, tol: float = 1e-3, seed: int = 0) -> dict[int, Mixture]:
    """The likeliest mixture for each k; all k and restarts go through the same scans. Components are in order of their means.

    A k of which a fit breaks down (a covariance is singular) is fitted again with tied covariances and RETRY_REG.
    """
    if covariance not in COVARIANCES:
        raise ValueError(f"covariance must be one of {COVARIANCES}")
    n, spread = points.count(), points.agg(*(F.var_pop(F.get("embedding", i)) for i in range(len(points.first()["embedding"])))).first()
    models = {key: Mixture(np.full(len(c), 1 / len(c)), c, np.repeat(np.diag([v + reg for v in spread])[None], len(c), axis=0)) for key, c in _starts(points, ks, restarts, seed).items()}
    moving = {key for key, m in models.items() if sound(m)}
    broken = {k for k, _ in models.keys() - moving}
    for _ in range(rounds):
        moving = {key for key in moving if key[0] not in broken}
        if not moving:
            break
        keys = sorted(moving)
        for key, sums in zip(keys, _sums(points, _mixture_sums, [models[k] for k in keys])):
            new = _stepped(models[key], sums, covariance, reg)
            if not sound(new):
                broken.add(key[0])
            if abs(new.likelihood - models[key].likelihood) < tol * max(1, n):
                moving.discard(key)
            models[key] = new
    best: dict[int, Mixture] = {}
    if broken:
        if (covariance, reg) == ("tied", RETRY_REG):
            raise ValueError(f"no mixture of {sorted(broken)} components can be fitted")
        best |= fit_mixtures(points, sorted(broken), "tied", RETRY_REG, restarts, rounds, tol, seed)
    for (k, _), m in sorted(models.items()):
        if k in broken:
            continue
        if k not in best or m.likelihood > best[k].likelihood:
            order = np.lexsort(m.means.T[::-1])
            best[k] = Mixture(m.weights[order], m.means[order], m.covariances[order], m.likelihood)
    return best


def bic(model: Mixture, n: int, covariance: str) -> float:
    """Bayesian information criterion: less is better."""
    k, d = model.means.shape
    free = {"tied": d * (d + 1) / 2, "full": k * d * (d + 1) / 2, "diag": k * d, "spherical": k}[covariance]
    return -2 * model.likelihood + (free + k * d + k - 1) * np.log(n)


def soft_assignment(cells: DataFrame) -> DataFrame:
    """Adds class (place of the first largest membership) and soft_confidence (its value)."""
    return cells.withColumn("soft_confidence", F.array_max("membership")).withColumn("class", (F.array_position("membership", F.array_max("membership")) - 1).cast("int"))


def _with_membership(points: DataFrame, membership) -> DataFrame:
    rows = points.select("embedding", *(c for c in points.columns if c not in ("embedding", "membership", "class", "soft_confidence")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = membership(_matrix(batch.column(0))) if batch.num_rows else np.empty((0, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "membership"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return soft_assignment(rows.mapInArrow(run, f"{kinds}, membership array<double>"))


def assign_mixture(points: DataFrame, model: Mixture) -> DataFrame:
    """Cells with membership, class and soft_confidence under a mixture."""
    return _with_membership(points, lambda x: model.responsibilities(x)[0])


def gmm_clusters(points: DataFrame, k: int | None = None, least: int = 2, most: int = 10, covariance: str = "tied", reg: float = 1e-6, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cells with membership, class, soft_confidence; the choice) for cells with an embedding.

    Without `k`, it is the one with the best silhouette if that is over 0.25, else the one with the least BIC.
    """
    points = written(points, "points")
    n = points.count()
    ks = [k] if k else list(range(least, min(most + 1, max(least + 1, n // 3))))
    fits = fit_mixtures(points, ks, covariance, reg, seed=seed)
    means = mean_silhouettes(points, [lambda x, own=fits[c]: own.responsibilities(x)[0] for c in ks]) if len(ks) > 1 else [None] * len(ks)
    scores = [(c, float(bic(fits[c], n, covariance)), s) for c, s in zip(ks, means)]
    chosen = k or select_k(scores)
    choice = points.sparkSession.createDataFrame([(*s, s[0] == chosen) for s in scores], "k int, bic double, silhouette double, chosen boolean")
    return assign_mixture(points, fits[chosen]), choice


def select_k(scores: list[tuple[int, float, float | None]]) -> int:
    """k from (k, BIC, silhouette): the best silhouette above 0.25, else the least BIC; the smaller k wins ties."""
    good = [(-s, k) for k, _, s in scores if s is not None and s > 0]
    if good and -min(good)[0] > 0.25:
        return min(good)[1]
    return min((b, k) for k, b, _ in scores)[1]


def _fuzzy(centres: np.ndarray, x: np.ndarray, m: float, power: float) -> np.ndarray:
    d2 = np.maximum(((x[:, None] - centres) ** 2).sum(axis=2), 1e-18)
    u = d2 ** (-power / 2 / (m - 1))
    return u / u.sum(axis=1, keepdims=True)


def fuzzy_memberships(m: float = 2.0, distance_power: float = 2.0):
    """Membership of points under centres: distances to the power distance_power / (m - 1), inverted and shared out.

    2 is the textbook rule; 4 sharpens memberships by squaring distances once more.
    """
    return lambda centres, x: _fuzzy(centres, x, m, distance_power)


def fcm_steps(points: DataFrame, models: list[np.ndarray], m: float = 2.0, distance_power: float = 2.0) -> list[np.ndarray]:
    """Centres of each model after one round: means weighted by memberships to the power m. One scan for all models."""
    u_of = fuzzy_memberships(m, distance_power)

    def stat(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
        u = u_of(centres, x) ** m
        return np.concatenate([u.sum(axis=0), (u.T @ x).ravel()])

    return [sums[len(c) :].reshape(len(c), -1) / sums[: len(c), None] for c, sums in zip(models, _sums(points, stat, models))]


def fcm_step(points: DataFrame, centres: np.ndarray, m: float = 2.0, distance_power: float = 2.0) -> np.ndarray:
    """Centres after one round."""
    return fcm_steps(points, [centres], m, distance_power)[0]


class Extrapolated:
    """Steps to the fixed point of a slow linear convergence (Anderson's): the next point is where the last few steps, taken together, would come to rest.

    A step after which the residual grew is followed by a plain one.
    """

    def __init__(self, depth: int = 5) -> None:
        self._depth, self._at, self._to = depth, [], []

    def next(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """From `x` and what a round makes of it."""
        if self._at and np.abs(g - x).max() > 2 * np.abs(self._to[-1] - self._at[-1]).max():
            self._at, self._to = [], []
        self._at, self._to = [*self._at[-self._depth :], x], [*self._to[-self._depth :], g]
        if len(self._at) < 2:
            return g
        at, to = np.array([v.ravel() for v in self._at]), np.array([v.ravel() for v in self._to])
        rest = to - at
        weights = np.linalg.lstsq(np.diff(rest, axis=0).T, rest[-1], rcond=1e-10)[0]
        new = (to[-1] - weights @ np.diff(to, axis=0)).reshape(x.shape)
        return new if np.isfinite(new).all() else g


def fcm_clusters(points: DataFrame, k: int | None = None, least: int = 2, most: int = 10, m: float = 2.0, rounds: int = 300, tol: float = 1e-6, distance_power: float = 2.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cells with membership, class, soft_confidence; the choice) by fuzzy c-means; without `k`, the best silhouette from least to most."""
    points = written(points, "points")
    ks = [k] if k else list(range(least, most + 1))
    u_of = fuzzy_memberships(m, distance_power)
    # Rounds over the bounded sample that centres start from are cheap; what they end at is where the rounds over all points start.
    sample, starts = _starts(points, ks, 1, seed, with_sample=True)
    found = {c: _settled(centres, sample, lambda own, x: u_of(own, x) ** m, tol) for (c, _), centres in starts.items()}
    moving, steps = set(found), {c: Extrapolated() for c in found}
    for _ in range(rounds):  # all k that still move share a scan
        keys = sorted(moving)
        if not keys:
            break
        for c, new in zip(keys, fcm_steps(points, [found[c] for c in keys], m, distance_power)):
            if np.abs(new - found[c]).max() < tol:
                moving.discard(c)
                found[c] = new
            else:
                found[c] = steps[c].next(found[c], new)
    found = {c: centres[np.lexsort(centres.T[::-1])] for c, centres in found.items()}
    means = mean_silhouettes(points, [lambda x, own=found[c]: u_of(own, x) for c in ks]) if len(ks) > 1 else [None] * len(ks)
    scores = list(zip(ks, means))
    chosen = k or max(scores, key=lambda s: (s[1] if s[1] is not None else -1, -s[0]))[0]
    choice = points.sparkSession.createDataFrame([(c, s, c == chosen) for c, s in scores], "k int, silhouette double, chosen boolean")
    own = found[chosen]
    return _with_membership(points, lambda x: u_of(own, x)), choice


def _silhouettes(rows: DataFrame, block: int, across: int) -> DataFrame:
    """(row, j, class, silhouette) for rows (row long, classes array<int>, embedding), each of whose classes is one clustering j.

    Cells are packed into parts of about `block` and of about `across`, each a row; pairs of parts are compared as matrices,
    once for all clusterings. A pair gives one row per cell of the first part, with its sums for each class: no pair of
    cells is a row, cells aren't sorted by pair, and no task holds more than some pairs of parts.
    """
    n = rows.count()
    # Few cells are cut finer, so that there is work for several tasks.
    blocks, chunks = max(1, -(-n // block), min(FLOWS, -(-n // 256))), max(1, -(-n // across))
    sizes = rows.select(F.posexplode("classes").alias("j", "other")).groupBy("j", "other").agg(F.count("*").alias("n"))
    names = sorted((r["j"], r["other"], r["n"]) for r in sizes.collect())  # a row for each class of each clustering
    if not names:
        return rows.sparkSession.createDataFrame([], "row long, j int, class int, silhouette double")
    columns = [f"s{k}" for k in range(len(names))]
    packed = lambda k, salt, *own: rows.groupBy(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(k)).cast("int").alias("part")).agg(F.collect_list(F.struct(*own)).alias("cells"))
    own = packed(blocks, 1, "row", "embedding").select("cells", F.pmod("part", F.lit(FLOWS)).alias("flow"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"))
    others = packed(chunks, 2, "classes", "embedding").select(F.col("cells").alias("others"), F.explode(F.sequence(F.lit(0), F.lit(FLOWS - 1))).alias("flow"), F.col("part").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, there in zip(batch.column(0), batch.column(1)):
                mine, there = mine.values, there.values
                x, right, of = _matrix(mine.field("embedding")), _matrix(there.field("embedding")), _matrix(there.field("classes"))
                sums = np.zeros((len(x), len(names)))
                for at in range(0, len(right), STRIP):
                    y, member = right[at : at + STRIP], np.stack([of[at : at + STRIP, j] == c for j, c, _ in names], axis=1).astype(float)
                    for lo in range(0, len(x), 1024):
                        left = x[lo : lo + 1024]
                        d2 = np.zeros((len(left), len(y)))
                        for k in range(x.shape[1]):
                            d2 += (left[:, k, None] - y[:, k]) ** 2
                        sums[lo : lo + 1024] += np.sqrt(d2, out=d2) @ member
                yield pa.RecordBatch.from_arrays([mine.field("row"), *(pa.array(v) for v in np.ascontiguousarray(sums.T))], ["row", *columns])

    pairs = own.join(others.hint("merge"), ["c", "flow"]).select("cells", "others")
    sums = pairs.mapInArrow(run, ", ".join(["row long", *(f"{c} double" for c in columns)])).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns))
    each = sums.join(rows.select("row", "classes"), "row").select("row", F.posexplode("classes").alias("j", "class"), F.array(*(
        F.struct(F.lit(j).alias("j"), F.lit(c).alias("other"), F.lit(m).alias("n"), F.col(name).alias("d")) for (j, c, m), name in zip(names, columns))).alias("sums"))
    a = F.array_max(F.transform(F.filter("sums", lambda s: (s["j"] == F.col("j")) & (s["other"] == F.col("class")) & (s["n"] > 1)), lambda s: s["d"] / (s["n"] - 1)))
    b = F.array_min(F.transform(F.filter("sums", lambda s: (s["j"] == F.col("j")) & (s["other"] != F.col("class"))), lambda s: s["d"] / s["n"]))
    out = each.select("row", "j", "class", a.alias("a"), b.alias("b"))
    return out.select("row", "j", "class", F.coalesce(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def mean_silhouettes(points: DataFrame, memberships: list, block: int = BLOCK, across: int = ACROSS) -> list[float | None]:
    """The mean silhouette of `points` under each of several clusterings, given by functions of the embeddings; one comparison for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                classes = np.stack([u(x).argmax(axis=1) for u in memberships], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, classes.size + 1, classes.shape[1], dtype=np.int32)), pa.array(classes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["embedding", "classes"])

    rows = points.select("embedding").mapInArrow(run, "embedding array<double>, classes array<int>").withColumn("row", F.monotonically_increasing_id())
    found = _silhouettes(written(rows, "cells"), block, across).groupBy("j").agg(F.avg("silhouette").alias("s")).collect()
    means = {r["j"]: r["s"] for r in found}
    return [means.get(j) for j in range(len(memberships))]


def silhouette(cells: DataFrame, block: int = BLOCK, across: int = ACROSS) -> DataFrame:
    """(image_id, cell_id, class, silhouette) by Euclidean distances of embeddings, over all pairs of cells of all images.

    Cells are told apart by image and id (by id alone where there is no image_id); repeated rows are cells of their own.
    Cells alone in their class, and all if there is one class, have 0; cells without a class or an embedding have no row.
    """
    keys = [c for c in ("image_id", "cell_id") if c in cells.columns]
    rows = cells.where("class is not null and embedding is not null").select(*keys, F.array(F.col("class").cast("int")).alias("classes"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "cells")
    return _silhouettes(rows, block, across).join(rows.select("row", *keys), "row").select(*keys, "class", "silhouette")
