"""Which ions differ between classes: rank and variance tests, multiple-testing correction, fold changes.

Inputs are long (bin, class, value); zeros that were left out are added by number. Tests count equal values first:
what is shuffled and ranked are distinct values with their counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.survival import chi2_sf, f_sf

#: Ranges of a bin's values that are ranked by themselves.
RANGES = 256


def value_counts(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(bin, class, value, n). With `sizes` (class, cells), cells without a row for a bin count as zeros."""
    counts = rows.groupBy("bin", "class", "value").agg(F.count("*").alias("n"))
    if sizes is None:
        return counts
    seen = rows.groupBy("bin", "class").agg(F.count("*").alias("seen"))
    # A row for each bin and class: small tables.
    full = seen.select("bin").distinct().join(F.broadcast(sizes.agg(F.collect_list(F.struct("class", "cells")).alias("all"))), how="cross").select("bin", F.explode("all").alias("s")).select("bin", "s.class", "s.cells")
    zeros = full.join(seen, ["bin", "class"], "left").select("bin", "class", F.lit(0.0).alias("value"), (F.col("cells") - F.coalesce("seen", F.lit(0))).alias("n")).where("n > 0")
    return counts.unionByName(zeros).groupBy("bin", "class", "value").agg(F.sum("n").alias("n"))


def kruskal_h(counts: DataFrame) -> DataFrame:
    """(bin, n, k, h): tie-corrected Kruskal-Wallis statistic by bin; 0 where all values are equal."""
    ties = counts.groupBy("bin", "value").agg(F.sum("n").alias("t"))
    # A bin's values are cut into RANGES, each of which is ranked by itself and moved by what lies below it: no task ranks a whole bin.
    ends = ties.groupBy("bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(RANGES - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES))).otherwise(0)
    ties = ties.join(ends, "bin").select("bin", "value", "t", part.cast("int").alias("part"))
    earlier = lambda *keys, order: F.coalesce(F.sum("t").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = ties.groupBy("bin", "part").agg(F.sum("t").alias("t")).select("bin", "part", earlier("bin", order="part").alias("below"))
    ranks = (ties.withColumn("before", earlier("bin", "part", order="value")).join(below, ["bin", "part"])
             .select("bin", "value", (F.col("below") + F.col("before") + (F.col("t") + 1) / 2).alias("rank")))
    by_class = (counts.join(ranks, ["bin", "value"]).groupBy("bin", "class")
                .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("s"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("q")))
    sums = by_class.groupBy("bin").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    middle = F.col("s") * F.col("s") / F.col("n")
    h = (F.col("n") - 1) * (F.col("between") - middle) / (F.col("q") - middle)
    return sums.select("bin", "n", "k", F.when(F.col("q") - middle > 1e-9, h).otherwise(0.0).alias("h"))


def kruskal(counts: DataFrame) -> DataFrame:
    """(bin, stat, pval) by the rank test; constant bins have 0 and 1."""
    found = kruskal_h(counts)
    return found.select("bin", F.col("h").alias("stat"), F.when(F.col("h") > 0, chi2_sf(F.col("h"), (F.col("k") - 1).cast("int"))).otherwise(1.0).alias("pval"))


def anova_f(counts: DataFrame) -> DataFrame:
    """(bin, df1, df2, f): one-way analysis of variance; null where there is no variance within classes."""
    v = F.col("value")
    by_class = counts.groupBy("bin", "class").agg(F.sum("n").alias("n"), F.sum(v * F.col("n")).alias("s"), F.sum(v * v * F.col("n")).alias("q"))
    sums = by_class.groupBy("bin").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    f = (between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))
    return sums.select("bin", (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), F.when(within > 1e-12, f).alias("f"))


def anova(counts: DataFrame) -> DataFrame:
    """(bin, stat, pval) by analysis of variance; bins without a statistic have 0 and 1."""
    found = anova_f(counts)
    return found.select("bin", F.coalesce("f", F.lit(0.0)).alias("stat"), F.when(F.col("f").isNotNull(), f_sf(F.col("f"), F.col("df1").cast("int"), F.col("df2").cast("int"))).otherwise(1.0).alias("pval"))


def bh_fdr(tests: DataFrame) -> DataFrame:
    """Adds pval_adj by Benjamini and Hochberg. A row for each bin of the axis: one window over a table of bounded size."""
    all_ = W.partitionBy(F.lit(0))
    order = all_.orderBy("pval", "bin")
    out = tests.withColumn("_raw", F.col("pval") * F.count("*").over(all_) / F.row_number().over(order))
    return out.withColumn("pval_adj", F.least(F.lit(1.0), F.min("_raw").over(order.rowsBetween(0, W.unboundedFollowing)))).drop("_raw")


def fold_change(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(bin, fold_change, best_clone): largest class mean over the mean of all; the smallest class wins ties. `sizes` as in value_counts."""
    sums = rows.groupBy("bin", "class").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    if sizes is not None:
        sums = sums.drop("n").join(F.broadcast(sizes.withColumnRenamed("cells", "n")), "class")
    total = None if sizes is None else sizes.agg(F.sum("cells")).first()[0]
    mean = F.col("s") / F.col("n")
    found = sums.groupBy("bin").agg(F.max(mean).alias("top"), (F.sum("s") / (F.sum("n") if total is None else F.lit(total))).alias("mean"), F.max_by("class", F.struct(mean, -F.col("class"))).alias("best_clone"))
    return found.select("bin", (F.col("top") / (F.col("mean") + 1e-12)).alias("fold_change"), "best_clone")


def differential(rows: DataFrame, axis: DataFrame, method: str = "kruskal", sizes: DataFrame | None = None) -> DataFrame:
    """(bin, mz, stat, pval, pval_adj, fold_change, best_clone, neg_log10_p) for each bin. ValueError below two classes or for an unknown method."""
    if method not in ("kruskal", "anova"):
        raise ValueError("method must be kruskal or anova")
    if rows.select("class").distinct().limit(2).count() < 2:
        raise ValueError("two classes or more are needed")
    counts = value_counts(rows, sizes)
    tests = bh_fdr(kruskal(counts) if method == "kruskal" else anova(counts))
    out = tests.join(fold_change(rows, sizes), "bin").join(F.broadcast(axis.select("bin", "mz")), "bin")
    return out.withColumn("neg_log10_p", -F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-300), F.col("pval_adj"))))).select("bin", "mz", "stat", "pval", "pval_adj", "fold_change", "best_clone", "neg_log10_p")


def significant_ions(table: DataFrame, alpha: float = 0.05, fold: float = 1.5, adjusted: bool = True) -> DataFrame:
    """Rows below `alpha`, with `fold` or more where that is over 0."""
    out = table.where(F.col("pval_adj" if adjusted else "pval") < alpha)
    return out.where(F.col("fold_change") >= fold) if fold > 0 else out


def top_markers(table: DataFrame, n: int = 30, alpha: float = 0.05, fold: float = 1.5) -> DataFrame:
    """The first `n` significant ions by neg_log10_p, fold change and m/z."""
    return significant_ions(table, alpha, fold).orderBy(F.desc("neg_log10_p"), F.desc("fold_change"), "mz").limit(n)


def volcano(table: DataFrame, alpha: float = 0.05, fold: float = 1.5) -> DataFrame:
    """(mz, log2_fc, neg_log10_p, kind): kind says which of the two bounds an ion passes."""
    p, f = F.col("pval_adj") < alpha, F.col("fold_change") >= fold
    return table.select("mz", F.log2(F.col("fold_change") + 1e-6).alias("log2_fc"), "neg_log10_p", F.when(p & f, "significant").when(p, "p only").when(f, "fold only").otherwise("none").alias("kind"))


def zscore_heatmap(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """(image_id, cell_id, class, bin, z) of marker bins: distance from the bin's mean in population deviations, within 3."""
    rows = rows.join(F.broadcast(bins.select("bin").distinct()), "bin", "left_semi")
    keys = [c for c in ("image_id", "cell_id") if c in rows.columns]
    stats = rows.groupBy("bin").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("value") - F.col("m")) / (F.col("s") + 1e-12)
    return rows.join(F.broadcast(stats), "bin").select(*keys, "class", "bin", F.least(F.lit(3.0), F.greatest(F.lit(-3.0), z)).alias("z"))
