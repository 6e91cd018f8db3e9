"""Names for ions: an index of compounds and adducts, matches by mass tolerance, annotation of classes, enrichment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mz import formula_dbe
from ..functions.quantiles import exact_quantiles
from ..sources import catalogue
from .cells import long

MODES = ("pos", "neg", "both")


def annotation_index(compounds: DataFrame, adducts: DataFrame, mode: str = "pos", charge_aware: bool = False) -> DataFrame:
    """A row for each compound and adduct that fit the mode and each other's polarity, with obs_mz, dbe and charge.

    With `charge_aware`, m/z of multiply charged ions is divided by their charge. Catalogues are small dimension tables.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    sign = F.when(F.col("charge") > 0, "pos").otherwise("neg")
    own, ions = compounds, adducts.withColumn("polarity", sign)
    if mode != "both":
        own, ions = own.where(F.col("mode").isin("both", mode)), ions.where(F.col("polarity") == mode)
    mz = F.col("neutral_mass") * F.col("mult") / F.abs("charge") + F.col("delta") if charge_aware else F.col("neutral_mass") + F.col("delta")
    # A formula is parsed once for a compound, not for each adduct, and side by side: a catalogue of millions may be one small file.
    own = own.repartition("seq").withColumn("dbe", formula_dbe())
    return own.join(F.broadcast(ions.drop("polarity")), how="cross").withColumn("obs_mz", mz).where("obs_mz > 0").select(*compounds.columns, *adducts.columns, "obs_mz", "dbe")


def dbe_filter(index: DataFrame, least: float = -0.5) -> DataFrame:
    """Rows whose double-bond equivalent is unknown or `least` or more."""
    return index.where(F.col("dbe").isNull() | (F.col("dbe") >= least))


def ppm_matches(queries: DataFrame, index: DataFrame, ppm: float = 5.0) -> DataFrame:
    """Queries (with mz) joined to index rows within `ppm` of their obs_mz; adds ppm_error, to four places.

    Both sides fall into logarithmic buckets a tolerance wide; a query probes three. An equi-join at any size.
    """
    step = math.log1p(ppm / 1e6) * 1.001
    bucket = lambda c: F.floor(F.log(c) / step)
    asked = queries.where("mz > 0").withColumn("_b", F.explode(F.array(*(bucket("mz") + k for k in (-1, 0, 1)))))
    kept = index.withColumn("_b", bucket("obs_mz"))
    error = F.abs(F.col("mz") - F.col("obs_mz")) / F.col("obs_mz") * 1e6
    return asked.join(kept, "_b").where(error <= ppm).withColumn("ppm_error", F.round(error, 4)).drop("_b")


def annotate_peaks(queries: DataFrame, index: DataFrame, ppm: float = 5.0, top_n: int | None = 3, least_dbe: float = -0.5, pathways: DataFrame | None = None) -> DataFrame:
    """The nearest `top_n` index rows (all if None) of each query (query_id, mz), with mz_query, rank, confidence_score and pathways.

    Ties keep the catalogue's order. A query without a match has no row; queries with one m/z are annotated each. Hits are
    looked for and ranked once for each m/z, so that only those wanted meet the queries.
    """
    found = ppm_matches(queries.select("mz").distinct(), dbe_filter(index, least_dbe), ppm)
    order = W.partitionBy("mz").orderBy("ppm_error", "seq", "adduct_seq")
    found = found.withColumn("rank", F.row_number().over(order))
    if top_n is not None:
        found = found.where(F.col("rank") <= top_n)
    found = queries.join(found, "mz").select(*queries.columns, *(c for c in found.columns if c != "mz"))
    found = found.withColumn("confidence_score", 1 / (1 + F.col("ppm_error")))
    if pathways is not None:
        found = found.join(F.broadcast(pathways), "subclass", "left").withColumn("pathways", F.array_join(F.coalesce("pathways", F.array().cast("array<string>")), "; "))
    return found.withColumnRenamed("mz", "mz_query")


def intense_peaks(peaks: DataFrame, percentile: float) -> DataFrame:
    """Peaks (mz, intensity) above that percentile of the intensities over 0."""
    bound = exact_quantiles(peaks.where("intensity > 0"), "intensity", (percentile / 100,))[0]
    return peaks.where(F.col("intensity") > F.lit(bound))  # without such peaks there is no bound and no row


def search(index: DataFrame, text: str, top: int = 20) -> DataFrame:
    """The first `top` index rows whose name, class or subclass contains the text, in any case."""
    hit = lambda c: F.lower(c).contains(text.lower())
    return index.where(hit("name") | hit("class") | hit("subclass")).orderBy("seq", "adduct_seq").limit(top)


def clone_means(cells: DataFrame) -> DataFrame:
    """(class, bin, mean, rest): a bin's mean in a class and in all others (null if there are none)."""
    by = long(cells, "class").groupBy("class", "bin").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    all_ = by.groupBy("bin").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = F.when(F.col("all_n") > F.col("n"), (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")))
    return by.join(all_, "bin").select("class", "bin", (F.col("s") / F.col("n")).alias("mean"), rest.alias("rest"))


def clone_top_ions(means: DataFrame, axis: DataFrame, n: int = 30) -> DataFrame:
    """(class, bin, mz, log2_fc, rank): the bins of each class that differ most, up or down, from the other classes."""
    fc = F.log2((F.col("mean") + 1e-9) / (F.col("rest") + 1e-9))
    ranked = means.where("rest is not null").withColumn("log2_fc", fc).withColumn("rank", F.row_number().over(W.partitionBy("class").orderBy(F.desc(F.abs("log2_fc")), "bin")))
    return ranked.where(F.col("rank") <= n).join(F.broadcast(axis.select("bin", "mz")), "bin").select("class", "bin", "mz", "log2_fc", "rank")


def annotate_clones(cells: DataFrame, axis: DataFrame, index: DataFrame, ppm: float = 5.0, n_top: int = 30, markers: DataFrame | None = None, ppm_filter: float | None = None, pathways: DataFrame | None = None) -> DataFrame:
    """Hits for the ions that mark classes (or `markers` with mz), each with the class in which its bin is strongest."""
    means = clone_means(cells)
    mzs = (clone_top_ions(means, axis, n_top) if markers is None else markers).select("mz").distinct()
    hits = annotate_peaks(mzs.withColumn("query_id", F.xxhash64("mz")), index, ppm, pathways=pathways)
    if ppm_filter is not None:
        hits = hits.where(F.col("ppm_error") <= ppm_filter)
    # The nearest bin of each ion: ions and axis are small tables.
    nearest = hits.select("query_id", "mz_query").distinct().join(F.broadcast(axis.agg(F.collect_list(F.struct("mz", "bin")).alias("_axis"))), how="cross")
    nearest = nearest.select("query_id", F.expr("array_min(transform(_axis, a -> struct(abs(a.mz - mz_query) as d, a.bin as bin))).bin").alias("bin"))
    best = means.groupBy("bin").agg(F.max_by("class", F.struct("mean", -F.col("class"))).alias("best_clone"))
    return hits.join(nearest.join(best, "bin").select("query_id", "best_clone"), "query_id")


def enrichment(hits: DataFrame) -> DataFrame:
    """(best_clone, subclass, n)."""
    return hits.groupBy("best_clone", "subclass").agg(F.count("*").alias("n"))


def enrichment_heatmap(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, subclass, share): counts of every class and subclass, absent ones 0, over the subclass's largest."""
    # Both sides are short lists.
    full = classes.select("class").distinct().join(F.broadcast(counts.select("subclass").distinct()), how="cross")
    n = full.join(counts.withColumnRenamed("best_clone", "class"), ["class", "subclass"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    top = n.groupBy("subclass").agg(F.max("n").alias("top"))
    return n.join(top, "subclass").select("class", "subclass", (F.col("n") / (F.col("top") + 1e-9)).alias("share"))


class Annotator:
    """An index for a mode and tolerance, and what can be asked of it."""

    def __init__(self, spark, mode: str = "pos", ppm: float = 5.0, least_dbe: float = -0.5, compounds: DataFrame | None = None, adducts: DataFrame | None = None, pathways: DataFrame | None = None):
        self.spark, self.ppm, self.least_dbe = spark, ppm, least_dbe
        self.index = annotation_index(compounds if compounds is not None else catalogue.compounds(spark), adducts if adducts is not None else catalogue.adducts(spark), mode)
        self.pathways = pathways if pathways is not None else catalogue.pathways(spark)

    def peak(self, mz: float) -> DataFrame:
        return annotate_peaks(self.spark.createDataFrame([(0, float(mz))], "query_id long, mz double"), self.index, self.ppm, None, self.least_dbe)

    def peaks(self, queries: DataFrame, top_n: int = 3, intensity_percentile: float = 0.0) -> DataFrame:
        chosen = intense_peaks(queries, intensity_percentile) if "intensity" in queries.columns and intensity_percentile > 0 else queries
        return annotate_peaks(chosen, self.index, self.ppm, top_n, self.least_dbe, self.pathways)

    def clones(self, cells: DataFrame, axis: DataFrame, **options) -> DataFrame:
        return annotate_clones(cells, axis, self.index, self.ppm, pathways=self.pathways, **options)

    def search(self, text: str, top: int = 20) -> DataFrame:
        return search(self.index, text, top)
