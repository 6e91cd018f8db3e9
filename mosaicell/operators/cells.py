"""Cells: spectra of labelled pixels, quality, management, and what is told per class.

Cell tables hold a dense `spectrum` array along the axis, or are long (cell_id, bin, value) with zeros left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, grouped_quantiles
from ..functions.tables import dense
from .image import PIXEL

CELL = ["image_id", "cell_id"]
AGGREGATES = ("mean", "sum", "median", "max", "min", "std")


def regions(labels: DataFrame, pixel_um: float = 10.0) -> DataFrame:
    """Area (pixels and square micrometres) and centroid of each cell."""
    return labels.groupBy(*CELL).agg(F.count("*").alias("area_px"), (F.count("*") * float(pixel_um) ** 2).alias("area_um"), F.avg("y").alias("centroid_row"), F.avg("x").alias("centroid_col"))


def cell_spectra(cube: DataFrame, labels: DataFrame, agg: str = "mean") -> DataFrame:
    """(image_id, cell_id, bin, value): a statistic over all pixels of the cell, those without the bin as zeros."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    rows = cube.join(labels.select(*PIXEL, "cell_id"), PIXEL)
    if agg in ("mean", "sum", "std"):
        parts = [F.sum("intensity").alias("s"), F.sum(F.col("intensity") * F.col("intensity")).alias("q")]
    elif agg == "median":
        parts = [F.sort_array(F.collect_list("intensity")).alias("v")]  # of one cell's pixels
    else:
        parts = [F.count("*").alias("k"), F.max("intensity").alias("hi"), F.min("intensity").alias("lo")]
    found = rows.groupBy(*CELL, "bin").agg(*parts).join(labels.groupBy(*CELL).agg(F.count("*").alias("n")), CELL)
    at = lambda i: F.expr(f"if({i} < n - size(v), 0D, v[int({i} - (n - size(v)))])")
    value = {"sum": F.col("s") if agg == "sum" else None, "mean": F.col("s") / F.col("n") if agg == "mean" else None,
             "std": F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))) if agg == "std" else None,
             "median": (at("(n - 1) div 2") + at("n div 2")) / 2 if agg == "median" else None,
             "max": F.when(F.col("k") < F.col("n"), F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")) if agg == "max" else None,
             "min": F.when(F.col("k") < F.col("n"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo")) if agg == "min" else None}[agg]
    return found.select(*CELL, "bin", value.alias("value"))


def with_spectrum(long: DataFrame, cells: DataFrame, n_bins: int) -> DataFrame:
    """`cells` with their spectrum as a dense array of `n_bins` values."""
    packed = long.groupBy(*CELL).agg(F.collect_list(F.struct("bin", "value")).alias("_at"))
    none = F.array().cast("array<struct<bin:int,value:double>>")
    return cells.join(packed, CELL, "left").withColumn("spectrum", dense(F.coalesce("_at", none), F.lit(n_bins), "bin", "value")).drop("_at")


def carry_class(cells: DataFrame, former: DataFrame) -> DataFrame:
    """Cells with the class they had before; null for cells that are new."""
    return cells.join(former.select(*CELL, "class"), CELL, "left")


def long(cells: DataFrame, *keep: str) -> DataFrame:
    """(image_id, cell_id, *keep, bin, value) of dense spectra."""
    return cells.select(*CELL, *keep, F.posexplode("spectrum").alias("bin", "value"))


def _percentile(q: float) -> str:
    h = f"((size(s) - 1) * {q}D)"
    return f"(s[int(floor({h}))] + ({h} - floor({h})) * (s[int(ceil({h}))] - s[int(floor({h}))]))"


def qc_metrics(cells: DataFrame) -> DataFrame:
    """Adds snr, sparsity (share of bins over 0), dynamic_range, total_intensity, spectral_entropy, n_peaks: in the row, no shuffle."""
    out = cells.withColumn("s", F.array_sort("spectrum")).withColumn("total_intensity", F.expr("aggregate(spectrum, 0D, (a, v) -> a + v)"))
    share = "(v / (total_intensity + 1e-9D))"
    return out.withColumns({
        "snr": F.expr(f"total_intensity / size(s) / ({_percentile(0.1)} + 1e-9D)"),
        "sparsity": F.expr("size(filter(spectrum, v -> v > 0)) / size(s)"),
        "dynamic_range": F.expr(f"log10(s[size(s) - 1] / ({_percentile(0.05)} + 1e-9D))"),
        "spectral_entropy": F.expr(f"-aggregate(spectrum, 0D, (a, v) -> a + {share} * log2({share} + 1e-9D))"),
        "n_peaks": F.expr(f"cast(size(filter(spectrum, v -> v > {_percentile(0.5)})) as bigint)")}).drop("s")


METRICS = ("snr", "sparsity", "dynamic_range", "total_intensity", "spectral_entropy", "n_peaks")


def qc_summary(scored: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max) over all cells."""
    each = scored.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS))).alias("e"))
    return each.groupBy("e.metric").agg(F.avg("e.v").alias("mean"), F.stddev_pop("e.v").alias("std"), F.min("e.v").alias("min"), F.max("e.v").alias("max"))


def qc_flags(scored: DataFrame, snr: float = 2.0, intensity_percentile: float = 10.0, sparsity: float = 0.05, entropy: float | None = None) -> DataFrame:
    """Adds low_snr, low_intensity, low_sparsity, low_entropy, flagged and reasons; the intensity bound is the image's percentile."""
    # A row for each image.
    bounds = grouped_quantiles(scored, ["image_id"], "total_intensity", (intensity_percentile / 100,)).select("image_id", F.get("q", F.lit(0)).alias("_bound"))
    flags = {"low_snr": F.col("snr") < snr, "low_intensity": F.col("total_intensity") < F.col("_bound"), "low_sparsity": F.col("sparsity") < sparsity,
             "low_entropy": F.lit(False) if entropy is None else F.col("spectral_entropy") < entropy}
    out = scored.join(bounds, "image_id").withColumns(flags).drop("_bound")
    return out.withColumns({"flagged": F.greatest(*flags), "reasons": F.array_compact(F.array(*(F.when(F.col(f), f) for f in flags)))})


def qc_flag_summary(flagged: DataFrame) -> DataFrame:
    """(flag, n, percent): how many cells each flag marks."""
    each = flagged.select(F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("v")) for f in ("low_snr", "low_intensity", "low_sparsity", "low_entropy", "flagged")))).alias("e"))
    return each.groupBy("e.flag").agg(F.sum("e.v").alias("n"), (100 * F.avg("e.v")).alias("percent"))


def _ids(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(i),) for i in ids], "cell_id int")


def remove_cells(labels: DataFrame, ids: Sequence[int] | DataFrame, image_id: str | None = None) -> DataFrame:
    """Labels without these cells: their pixels become background. Ids that aren't there change nothing.

    `ids`: numbers of cells of the image `image_id`, which labels of several images need; or a table (image_id, cell_id).
    """
    if isinstance(ids, DataFrame):
        return labels.join(ids, [c for c in CELL if c in ids.columns], "left_anti")
    if image_id is None and labels.select("image_id").distinct().limit(2).count() > 1:
        raise ValueError("labels are of several images: say whose cells go")
    gone = _ids(labels, ids)
    own = labels if image_id is None else labels.where(F.col("image_id") == image_id)
    kept = own.join(gone, "cell_id", "left_anti").select(*labels.columns)
    return kept if image_id is None else kept.unionByName(labels.where(~F.col("image_id").eqNullSafe(F.lit(image_id))))


def remove_clusters(cells: DataFrame, classes: int | Sequence[int], column: str = "class") -> DataFrame:
    """Cells without these classes; labels are left as they are."""
    gone = [classes] if isinstance(classes, int) else list(classes)
    return cells.where(~F.col(column).isin(gone) | F.col(column).isNull())


def remove_clone(labels: DataFrame, cells: DataFrame, clone: int) -> tuple[DataFrame, DataFrame]:
    """Labels and cells without a clone."""
    return labels.join(cells.where(F.col("class") == clone).select(*CELL), CELL, "left_anti"), remove_clusters(cells, clone)


def combine_clones(cells: DataFrame, clones: Sequence[int], new_label: int | None = None) -> DataFrame:
    """Cells with these clones as one (`new_label`, else the smallest of them), and classes renumbered from 0 without gaps.

    A `membership` array follows: probabilities of merged clones are added up, at most 1, and take their new places.
    """
    if len(set(clones)) < 2:
        raise ValueError("two clones or more are needed")
    target = min(clones) if new_label is None else new_label
    merged = F.when(F.col("class").isin(list(clones)), F.lit(target)).otherwise(F.col("class"))
    # A row for each class.
    map_ = (cells.select("class").distinct().withColumn("_merged", merged).withColumn("_new", (F.dense_rank().over(W.orderBy("_merged")) - 1).cast("int")))
    out = cells.join(F.broadcast(map_.select("class", "_new")), "class")
    if "membership" in cells.columns:
        table = map_.agg(F.map_from_entries(F.collect_list(F.struct("class", "_new"))).alias("_map"), F.max("_new").alias("_top"))
        moved = F.expr("transform(sequence(0, _top), k -> least(1D, aggregate(transform(membership, (p, i) -> if(_map[i] = k, p, 0D)), 0D, (a, p) -> a + p)))")
        out = out.crossJoin(F.broadcast(table)).withColumn("membership", moved).drop("_map", "_top")  # one row
    return out.withColumn("class", F.col("_new")).drop("_new").select(*cells.columns)


def global_spectrum(cells: DataFrame, agg: str = "mean") -> DataFrame:
    """(bin, value) over all cells; an unknown `agg` means mean."""
    return _central(long(cells), ["bin"], agg).select("bin", "value")


def _central(rows: DataFrame, keys: list[str], agg: str, *more: F.Column) -> DataFrame:
    """(*keys, value, *more) of the rows of each group."""
    value = {"max": F.max("value"), "min": F.min("value")}.get(agg, F.avg("value"))
    out = rows.groupBy(*keys).agg(value.alias("value"), *more)
    if agg != "median":
        return out
    middle = grouped_quantiles(rows, keys, "value", (0.5,)).select(*(F.col(k).alias(f"_{k}") for k in keys), F.get("q", F.lit(0)).alias("value"))
    return out.drop("value").join(middle, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))


def _spectrum_sd(rows: DataFrame, keys: list[str], agg: str, normalize: bool) -> DataFrame:
    sd = F.stddev_pop("value") if agg not in ("max", "min") else F.lit(None).cast("double")
    out = _central(rows, [*keys, "bin"], agg, sd.alias("sd"), F.count("*").alias("n"))
    if not normalize:
        return out
    top = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # a row for each bin
    out = out.withColumn("_top", F.max("value").over(top))
    return out.withColumns({c: F.when(F.col("_top") > 0, F.col(c) / F.col("_top")).otherwise(F.col(c)) for c in ("value", "sd")}).drop("_top")


def global_spectrum_sd(cells: DataFrame, agg: str = "mean", normalize: bool = False) -> DataFrame:
    """(bin, value, sd, n); sd only for mean and median; over the largest value if `normalize`."""
    return _spectrum_sd(long(cells), [], agg, normalize)


def clone_spectra(cells: DataFrame, agg: str = "mean", normalize: bool = False) -> DataFrame:
    """(class, bin, value, sd, n) for each class."""
    return _spectrum_sd(long(cells, "class"), ["class"], agg, normalize)


def clone_quality(cells: DataFrame, least_confidence: float = 0.6, least_cells: int = 5, percentile: float = 20.0) -> DataFrame:
    """A row for each class: status GOOD, QUESTIONABLE, ARTIFACT or LOW_SIZE with its figures, flags and reason.

    `cells` have class, soft_confidence, spectrum, and embedding (array) where distances are wanted. Distances are from
    a class's centre to all other cells; centres are a few rows and are broadcast.
    """
    cells = cells.withColumn("_total", F.expr("aggregate(spectrum, 0D, (a, v) -> a + v)"))
    bound = exact_quantiles(cells, "_total", (percentile / 100,))[0]
    base = cells.groupBy("class").agg(F.count("*").alias("n_cells"), F.avg("soft_confidence").alias("mean_confidence"),
                                      F.avg((F.col("soft_confidence") < least_confidence).cast("int")).alias("low_conf_ratio"), F.avg("_total").alias("mean_intensity"))
    cv = long(cells, "class").groupBy("class", "bin").agg((F.stddev_pop("value") / (F.avg("value") + 1e-9)).alias("cv"))
    cv = cv.where("not isnan(cv) and abs(cv) < double('infinity')").groupBy("class").agg(F.avg("cv").alias("mean_cv"))
    out = base.join(cv, "class", "left").withColumn("_bound", F.lit(bound).cast("double"))
    if "embedding" in cells.columns:
        at = cells.select("class", F.posexplode("embedding").alias("k", "v")).groupBy("class", "k").agg(F.avg("v").alias("v"))
        centres = at.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("centre"))
        all_centres = centres.agg(F.collect_list(F.struct("class", "centre")).alias("centres"))  # a row with an entry for each class
        d = F.sqrt(F.expr("aggregate(zip_with(embedding, c.centre, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)"))
        near = (cells.select("class", "embedding").crossJoin(F.broadcast(all_centres)).select(F.col("class").alias("_own"), "embedding", F.explode("centres").alias("c"))
                .where("_own <> c.class").groupBy("c.class").agg(F.min(d).alias("min_dist_to_other")))
        out = out.join(near, "class", "left").withColumn("min_dist_to_other", F.coalesce("min_dist_to_other", F.lit(float("inf"))))
    else:
        out = out.withColumn("min_dist_to_other", F.lit(None).cast("double"))
    flags = {"LOW_CONFIDENCE": F.col("mean_confidence") < 0.5, "HIGH_UNCERTAINTY": F.col("low_conf_ratio") > 0.4, "HIGH_VARIABILITY": F.col("mean_cv") > 1.5,
             "LOW_INTENSITY": F.col("mean_intensity") < F.col("_bound"), "POOR_SEPARATION": F.col("min_dist_to_other") < 1.0}
    small = F.col("n_cells") < least_cells
    out = out.withColumn("flags", F.when(~small, F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items())))))
    status = F.when(small, "LOW_SIZE").when(F.size("flags") == 0, "GOOD").when(F.size("flags") >= 3, "ARTIFACT").otherwise("QUESTIONABLE")
    figures = ("mean_confidence", "low_conf_ratio", "mean_cv", "mean_intensity", "min_dist_to_other")
    return out.select("class", status.alias("status"), "n_cells", *(F.when(~small, F.col(c)).alias(c) for c in figures), "flags",
                      F.when(small, F.concat(F.lit("Only "), F.col("n_cells").cast("string"), F.lit(f" cells (min={least_cells})"))).alias("reason"))


def clone_quality_summary(quality: DataFrame) -> DataFrame:
    """How many classes are good, questionable, and neither."""
    return quality.agg(F.count_if(F.col("status") == "GOOD").alias("good"), F.count_if(F.col("status") == "QUESTIONABLE").alias("questionable"),
                       F.count_if(F.col("status").isin("ARTIFACT", "LOW_SIZE")).alias("artifact_or_low_size"))


def ion_by_clone(cells: DataFrame, axis: DataFrame, mz: float, tolerance: float = 0.1, normalize: bool = False) -> DataFrame:
    """(cell_id, class, value): sum of the bins whose m/z, to four places, is within `tolerance`."""
    mz4 = F.round("mz", 4)
    bins = [r["bin"] for r in axis.where((mz4 >= mz - tolerance) & (mz4 <= mz + tolerance)).select("bin").collect()]
    if not bins:
        raise ValueError(f"no bin within {tolerance} of m/z {mz}")
    value = sum((F.get("spectrum", b) for b in bins[1:]), F.get("spectrum", bins[0]))
    return scaled(cells.select(*CELL, "class", value.alias("value")), normalize)


def scaled(values: DataFrame, normalize: bool) -> DataFrame:
    """Values moved to [0, 1] by their smallest and largest, where these differ."""
    if not normalize:
        return values
    ends = values.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))  # one row
    moved = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("value"))
    return values.crossJoin(F.broadcast(ends)).withColumn("value", moved).drop("_lo", "_hi")


def tic_at_centroid(cells: DataFrame, tic: DataFrame, normalize: bool = False) -> DataFrame:
    """(cell_id, class, value): the image at the cell's centroid, cut to whole pixels, on the grid."""
    bounds = tic.groupBy("image_id").agg(F.max("x").alias("_x"), F.max("y").alias("_y"))
    at = lambda c, m: F.least(F.greatest(F.floor(c), F.lit(0)), F.col(m)).cast("int")
    points = cells.join(bounds, "image_id").select(*CELL, "class", at("centroid_col", "_x").alias("x"), at("centroid_row", "_y").alias("y"))
    return scaled(points.join(tic.select(*PIXEL, "tic"), PIXEL, "left").select(*CELL, "class", F.coalesce("tic", F.lit(0.0)).alias("value")), normalize)


def five_numbers(values: DataFrame) -> DataFrame:
    """(class, n, min, q1, median, q3, max): what a box shows."""
    found = grouped_quantiles(values, ["class"], "value", (0.0, 0.25, 0.5, 0.75, 1.0))
    return found.select("class", "n", *(F.get("q", k).alias(c) for k, c in enumerate(("min", "q1", "median", "q3", "max"))))


def umap_points(cells: DataFrame, palette: int = 10) -> DataFrame:
    """(image_id, cell_id, e0, e1, class, size, opacity, colour_index) of embedded cells."""
    # A row for each class.
    order = cells.select("class").distinct().withColumn("_k", F.row_number().over(W.orderBy("class")) - 1)
    return cells.join(F.broadcast(order), "class").select(*CELL, F.get("embedding", 0).alias("e0"), F.get("embedding", 1).alias("e1"), "class", (6 + 8 * F.col("soft_confidence")).alias("size"),
                                                          F.col("soft_confidence").alias("opacity"), (F.col("_k") % palette).cast("int").alias("colour_index"))


def clone_overlay(boundary: DataFrame, cells: DataFrame, confidence: bool = True) -> DataFrame:
    """Boundary pixels with the class of their cell and its opacity."""
    opacity = 0.3 + 0.6 * F.col("soft_confidence") if confidence else F.lit(0.9)
    return boundary.join(cells.select(*CELL, "class", opacity.alias("opacity")), CELL)


def export_rows(cells: DataFrame, axis: DataFrame, mode: str = "full", decimals: int | None = 4) -> DataFrame:
    """The wide table of a CSV export: full, metadata (no ions) or ions (only these, with their cell); half-even rounding of ions.

    Rows tell their image and cell. Columns are made at this sink alone, a name per bin as its m/z with four places.
    """
    if mode not in ("full", "metadata", "ions"):
        raise ValueError("mode must be full, metadata or ions")
    about = CELL if mode == "ions" else [c for c, kind in cells.dtypes if not kind.startswith("array")]
    rounded = lambda c: c if decimals is None else F.bround(c, decimals)
    bins = [] if mode == "metadata" else sorted((r["bin"], r["mz"]) for r in axis.select("bin", "mz").collect())
    return cells.select(*about, *(rounded(F.get("spectrum", b)).alias(f"{mz:.4f}") for b, mz in bins))


def export_csv(cells: DataFrame, axis: DataFrame, path: str, mode: str = "full", decimals: int | None = 4, hits: DataFrame | None = None) -> None:
    """Writes that table with a header; with annotation hits (best_clone, name), the names found for the cell's class too."""
    rows = export_rows(cells, axis, mode, decimals)
    if hits is not None and "class" in rows.columns:
        names = hits.groupBy(F.col("best_clone").alias("class")).agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("annotation"))
        rows = rows.join(names, "class", "left")
    rows.write.mode("overwrite").csv(path, header=True)


def export_pixels(cube: DataFrame, labels: DataFrame) -> DataFrame:
    """Bins of labelled pixels, which an imzML export writes out."""
    return cube.join(labels.select(*PIXEL), PIXEL, "left_semi")
