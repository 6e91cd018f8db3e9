"""Cubes on disk for reading a few bins of many: ranges of bins are folders, pixels are sorted within their files.

A reader of some bins lists and opens the files of their ranges only, and of those the row groups whose statistics
allow the bins. Ranges with many peaks have several files, so that no task writes or reads a whole range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of a range, and rows of a row group, for which Parquet keeps the least and largest bin.
RANGE, GROUP_BYTES = 64, 4 << 20


def write_cube(cube: DataFrame, path: str, bins: int = RANGE, group_bytes: int = GROUP_BYTES) -> None:
    """Writes `cube` (image_id, x, y, bin, intensity, ...) to a new folder. Rows are dealt by sampled ranges of (range, bin, image, pixel): even shares, in order."""
    order = ["bin_range", "bin", "image_id", "y", "x"]
    rows = cube.withColumn("bin_range", F.floor(F.col("bin") / bins).cast("int"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bin_range").option("parquet.block.size", group_bytes).parquet(path)
    cube.sparkSession.range(1).select(F.lit(bins).alias("bins")).coalesce(1).write.parquet(f"{path}/_range")


def read_cube(spark: SparkSession, path: str, bins: Sequence[int] | None = None) -> DataFrame:
    """The cube as written, or only those `bins`: their ranges' files, and what these have of them."""
    rows = spark.read.option("basePath", path).parquet(path)
    if bins is None:
        return rows.drop("bin_range")
    wanted = sorted({int(b) for b in bins})
    size = spark.read.parquet(f"{path}/_range").first()["bins"]
    return rows.where(F.col("bin_range").isin(sorted({b // size for b in wanted})) & F.col("bin").isin(wanted)).drop("bin_range")


def bins_of(axis: DataFrame, mzs: Sequence[float], tolerance: float) -> list[int]:
    """Bins of the axis whose m/z, to four places, is within `tolerance` of one of `mzs`."""
    at = F.round("mz", 4)
    near = F.lit(False)
    for m in mzs:
        near = near | at.between(m - tolerance, m + tolerance)
    return [r["bin"] for r in axis.where(near).select("bin").collect()]  # a part of the axis
