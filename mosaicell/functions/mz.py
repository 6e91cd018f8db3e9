"""The m/z axis and what is computed per spectrum: bins, normalisation, formulas."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, grouped_quantiles
from .tables import written

NORMALIZATIONS = ("none", "tic", "rms", "median")


def axis_size(lo: float, hi: float, width: float) -> int:
    """Number of bins of a uniform axis from `lo` to `hi`, both included if the width divides the range."""
    if not width > 0 or hi < lo:
        raise ValueError("an axis needs a positive width and lo <= hi")
    return math.ceil((hi + width / 2 - lo) / width)


def fixed_axis(spark: SparkSession, lo: float = 600.0, hi: float = 1100.0, width: float = 0.1) -> DataFrame:
    """Uniform axis (bin, mz, lo, hi, width); mz is the left edge, and the last bin may reach beyond `hi`."""
    at = F.lit(float(lo)) + F.col("id") * F.lit(float(width))
    return spark.range(axis_size(lo, hi, width)).select(F.col("id").cast("int").alias("bin"), at.alias("mz"), at.alias("lo"), (at + width).alias("hi"), F.lit(float(width)).alias("width"))


def adaptive_edges(lo: float, hi: float, resolving_power: float | None = None, ppm: float | None = None,
                   least: float = 0.01, most: float = 1.0) -> np.ndarray:
    """Edges whose distance follows m/z, by resolving power or ppm, within bounds: a recurrence over 10**4 values or so."""
    if (resolving_power is None) == (ppm is None):
        raise ValueError("give either a resolving power or a ppm width")
    edges = [float(lo)]
    while edges[-1] < hi:
        own = edges[-1] / resolving_power if resolving_power is not None else edges[-1] * ppm / 1e6
        edges.append(edges[-1] + min(max(own, least), most))
    return np.array(edges)


def adaptive_axis(spark: SparkSession, edges: np.ndarray) -> DataFrame:
    """Axis (bin, mz, lo, hi, width) for edges; mz is the bin's centre in single precision."""
    centres = ((edges[:-1] + edges[1:]) / 2).astype(np.float32).astype(float)
    rows = [(k, *map(float, x)) for k, x in enumerate(zip(centres, edges[:-1], edges[1:], np.diff(edges)))]
    return spark.createDataFrame(rows, "bin int, mz double, lo double, hi double, width double")


def axis_diagnostics(axis: DataFrame) -> DataFrame:
    """n_bins, narrowest and widest bin, and these as ppm of their m/z."""
    ppm = F.col("width") / F.col("mz") * 1e6
    return axis.agg(F.count("*").alias("n_bins"), F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min(ppm).alias("min_ppm"), F.max(ppm).alias("max_ppm"))


def fixed_bin(mz: str, lo: float, width: float) -> F.Column:
    """Bin of an m/z on a uniform axis, in single precision."""
    real = lambda x: F.lit(float(x)).cast("float")
    return F.floor(((F.col(mz).cast("float") - real(lo)).cast("float") / real(width)).cast("float")).cast("int")


def bin_fixed(peaks: DataFrame, lo: float, hi: float, width: float) -> DataFrame:
    """Peaks of the range with their bin: a projection, no join."""
    return peaks.withColumn("bin", fixed_bin("mz", lo, width)).where(F.col("bin").between(0, axis_size(lo, hi, width) - 1))


def bin_adaptive(peaks: DataFrame, edges: np.ndarray) -> DataFrame:
    """Peaks of the range with their bin: the last edge at or below their m/z. Edges travel as one row with a sorted array.

    A bin is found by bisection inside an expression, so that there is neither a shuffle nor a Python worker.
    """
    rounds = max(1, math.ceil(math.log2(len(edges))) + 1)
    one = pa.table({"_edges": pa.array([edges.astype(float)], pa.list_(pa.float64()))})
    table = F.broadcast(peaks.sparkSession.createDataFrame(one))
    half = "int((b.lo + b.hi) / 2)"
    found = F.expr(f"aggregate(sequence(1, {rounds}), named_struct('lo', 0, 'hi', {len(edges)}), "
                   f"(b, i) -> if(b.hi - b.lo <= 1, b, if(_edges[{half}] <= mz, named_struct('lo', {half}, 'hi', b.hi), named_struct('lo', b.lo, 'hi', {half})))).lo")
    inside = peaks.where((F.col("mz") >= float(edges[0])) & (F.col("mz") < float(edges[-1])))
    return inside.crossJoin(table).withColumn("bin", found).drop("_edges")


def auto_mz_range(peaks: DataFrame) -> DataFrame:
    """First and 99th percentile of m/z as (mz_min, mz_max)."""
    ends = exact_quantiles(peaks, "mz", (0.01, 0.99))
    return peaks.sparkSession.createDataFrame([tuple(ends)], "mz_min double, mz_max double")


def auto_ppm(peaks: DataFrame, lo: float, hi: float, least_peaks: int = 5, least_gaps: int = 200) -> DataFrame:
    """Typical distance of neighbouring strong peaks in ppm, within [2, 500], as one row (n_gaps, ppm); null where there are too few gaps.

    Of spectra with `least_peaks` peaks or more, those above the median intensity count; gaps whose centre is in range,
    its ends included, gaps of 0 too. A spectrum is told by its image and its id: ids may repeat across images.
    """
    spectrum = ["image_id", "spectrum_id"]
    medians = grouped_quantiles(peaks, spectrum, "intensity", (0.5,)).where(F.col("n") >= least_peaks).select(*spectrum, F.get("q", F.lit(0)).alias("_median"))
    strong = peaks.join(medians, spectrum).where("intensity > _median")
    gaps = strong.withColumn("_before", F.lag("mz").over(W.partitionBy(*spectrum).orderBy("mz"))).where("_before is not null")
    centre = (F.col("mz") + F.col("_before")) / 2
    gaps = gaps.where(centre.between(lo, hi)).select(((F.col("mz") - F.col("_before")) / centre * 1e6).alias("ppm"))
    gaps = written(gaps, "gaps")
    n, median = gaps.count(), exact_quantiles(gaps, "ppm", (0.5,))[0]
    return peaks.sparkSession.createDataFrame([(n, max(2.0, min(500.0, median)) if n >= least_gaps and median is not None else None)], "n_gaps long, ppm double")


def sample_spectra(spectra: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """`n` spectra by the MD5 of their id and the seed: the same ones each time, here and in any other engine."""
    return spectra.orderBy(F.md5(F.concat_ws(":", F.col("spectrum_id").cast("string"), F.lit(str(seed)))), "spectrum_id").limit(n)


def sound(spectra: DataFrame) -> DataFrame:
    """Spectra with m/z and intensity arrays of one length that isn't 0, and a place if the table has places."""
    placed = spectra.dropna(subset=[c for c in ("x", "y") if c in spectra.columns]) if {"x", "y"} & set(spectra.columns) else spectra
    return placed.where((F.size("mz") > 0) & (F.size("mz") == F.size("intensity")))


def rejects(spectra: DataFrame) -> DataFrame:
    """The other spectra, with the reason."""
    why = (F.when(F.col("mz").isNull() | F.col("intensity").isNull(), "missing").when((F.size("mz") == 0) | (F.size("intensity") == 0), "empty").when(F.size("mz") != F.size("intensity"), "unequal"))
    for c in ("x", "y"):
        if c in spectra.columns:
            why = why.when(F.col(c).isNull(), "unplaced")
    return spectra.withColumn("reason", why).where("reason is not null")


def explode_peaks(spectra: DataFrame) -> DataFrame:
    """A row for each peak; null or empty arrays give none."""
    rest = [c for c in spectra.columns if c not in ("mz", "intensity")]
    return spectra.select(*rest, F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select(*rest, "p.mz", "p.intensity")


def normalized(spectra: DataFrame, method: str = "none") -> DataFrame:
    """Spectra with intensities divided by their sum, root mean square or median of positive values, where that is over 0."""
    kind = method.lower()
    if kind not in NORMALIZATIONS:
        raise ValueError(f"normalization must be one of {NORMALIZATIONS}")
    if kind == "none":
        return spectra
    if kind == "tic":
        by = "aggregate(intensity, 0D, (s, v) -> s + v)"
    elif kind == "rms":
        by = "sqrt(aggregate(intensity, 0D, (s, v) -> s + v * v) / size(intensity))"
    else:
        some = "sort_array(filter(intensity, v -> v > 0))"
        half = f"(({some})[int(size({some}) / 2)] + ({some})[int((size({some}) - 1) / 2)]) / 2D"
        by = f"greatest(coalesce(if(size({some}) > 0, {half}, null), 1D), 1e-12D)"
    scaled = spectra.withColumn("_by", F.expr(by))
    return scaled.withColumn("intensity", F.expr("transform(intensity, v -> if(_by > 0, double(v) / _by, double(v)))")).drop("_by")


def formula_counts(compounds: DataFrame, formula: str = "formula") -> DataFrame:
    """Adds `atoms`, a map from element to count, repeated elements added up; null or empty formulas: an empty map."""
    text = F.coalesce(F.col(formula), F.lit(""))
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?)(\d*)"), F.lit(1)).alias("e"), F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?)(\d*)"), F.lit(2)).alias("n"))
    count = lambda p: F.when(p["n"] == "", F.lit(1)).otherwise(p["n"].cast("int"))
    elements = lambda ps: F.array_distinct(F.transform(ps, lambda p: p["e"]))
    out = compounds.withColumn("_parts", parts)
    atoms = F.map_from_arrays(elements(F.col("_parts")), F.transform(elements(F.col("_parts")), lambda e: F.aggregate(F.filter("_parts", lambda p: p["e"] == e), F.lit(0), lambda s, p: s + count(p))))
    return out.withColumn("atoms", atoms).drop("_parts")


def dbe(atoms: str = "atoms") -> F.Column:
    """Double-bond equivalent: 1 + C - H/2 + N/2; null where there is no formula."""
    n = lambda e: F.coalesce(F.col(atoms)[e], F.lit(0))
    return F.when(F.size(atoms) > 0, F.lit(1.0) + n("C") - n("H") / 2 + n("N") / 2)


def formula_dbe(formula: str = "formula") -> F.Column:
    """The same from the formula itself: three short searches and no map, for filters, which Spark copies down to where the formula is read."""
    text = F.coalesce(F.col(formula), F.lit(""))
    count = lambda s, d: s + F.when(d == "", F.lit(1)).otherwise(d.cast("int"))
    n = lambda e: F.aggregate(F.regexp_extract_all(text, F.lit(rf"{e}(?![a-z])(\d*)"), F.lit(1)), F.lit(0), count)
    return F.when(text.rlike("[A-Z]"), F.lit(1.0) + n("C") - n("H") / 2 + n("N") / 2)
