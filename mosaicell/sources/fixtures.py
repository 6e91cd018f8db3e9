"""Domain views over the star-schema tables: peaks, spectra, labels and cells to run the operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import table

IMAGE = "fx"
SUBCLASSES = ("PC", "PE", "Cer", "FA", "none")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks (image_id, spectrum_id, x, y, mz, intensity) from lineitem: an order is a pixel, a part an m/z."""
    order = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.lit(IMAGE).alias("image_id"), order.alias("spectrum_id"), (order % 128).cast("int").alias("x"), F.floor(order / 128).cast("int").alias("y"),
        (F.lit(350.05) + F.lit(0.1) * (F.col("l_partkey") % 2000)).alias("mz"), F.col("l_quantity").alias("intensity"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one row per spectrum with sorted arrays."""
    pairs = F.array_sort(F.collect_list(F.struct("mz", "intensity")))
    return (peaks(spark, sf_dir).groupBy("image_id", "spectrum_id", "x", "y").agg(pairs.alias("p"))
            .select("image_id", "spectrum_id", "x", "y", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")))


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (image_id, cell_id, class, spectrum) from embeddings: absolute values, five classes."""
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select(
        F.lit(IMAGE).alias("image_id"), F.col("vec_id").alias("cell_id"), (F.col("label") % 5).cast("int").alias("class"),
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("spectrum"))


def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (image_id, cell_id, bin, value) from lineitem: suppliers over 200 bins, absent rows are zeros."""
    return (table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 200).cast("int").alias("bin"))
            .agg(F.sum("l_quantity").alias("value")).select(F.lit(IMAGE).alias("image_id"), "cell_id", "bin", "value"))


def surrogate_labels(masked: DataFrame) -> DataFrame:
    """Labels of mask pixels (image_id, x, y): each 4 x 4 square of the grid is a cell."""
    return masked.select("image_id", "x", "y", (F.lit(1) + F.floor(F.col("y") / 4) * 32 + F.floor(F.col("x") / 4)).cast("int").alias("cell_id"))


def spoiled_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectra, of which some have lost an array, its values or its last value, by a rule of their number."""
    kind, none = F.col("spectrum_id") % 11, F.array().cast("array<double>")
    mz = F.when(kind == 0, F.lit(None)).when(kind == 1, none).when(kind == 2, F.slice("mz", 1, F.size("mz") - 1)).otherwise(F.col("mz"))
    intensity = F.when(kind == 3, F.lit(None)).when(kind.isin(1, 4), none).otherwise(F.col("intensity"))
    return spectra(spark, sf_dir).select("image_id", "spectrum_id", "x", "y", mz.alias("mz"), intensity.alias("intensity"))


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds from part, as a catalogue has them: formulas by size and key, masses near what lineitem's peaks weigh as [M-H]-."""
    key = F.col("p_partkey")
    text = lambda c: c.cast("string")
    formula = F.concat(F.lit("C"), text(F.col("p_size")), F.lit("H"), text(key % 97 + 2), F.when(key % 3 == 0, F.concat(F.lit("N"), text(key % 5 + 1))).otherwise(""), F.lit("O"), F.when(key % 4 == 0, "CH3").otherwise("2P"))
    return table(spark, sf_dir, "part").select(
        key.cast("int").alias("seq"), F.col("p_name").alias("name"), formula.alias("formula"), (F.lit(351.057276) + F.lit(0.1) * (key % 2000) + F.lit(0.0007) * (key % 7 - 3)).alias("neutral_mass"),
        F.col("p_brand").alias("class"), F.get(F.array(*map(F.lit, SUBCLASSES)), (key % len(SUBCLASSES)).cast("int")).alias("subclass"), F.lit("").alias("hmdb"), F.lit("").alias("lipidmaps"),
        F.get(F.array(F.lit("both"), F.lit("neg"), F.lit("pos")), (key % 3).cast("int")).alias("mode"))
