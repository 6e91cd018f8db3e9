"""Total ion current per pixel from spectra that arrive as files: sums add up, so that state is a row for each pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.image import PIXEL

SPECTRA = "image_id string, spectrum_id long, x int, y int, mz array<double>, intensity array<double>"


def spectra_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of spectra as a stream."""
    return spark.readStream.schema(SPECTRA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_tic(spectra: DataFrame) -> DataFrame:
    """(image_id, x, y, tic, spectra) so far; for output modes update and complete."""
    own = F.expr("aggregate(intensity, 0D, (s, v) -> s + v)")
    return spectra.where((F.size("mz") > 0) & (F.size("mz") == F.size("intensity"))).select(*PIXEL, own.alias("own")).groupBy(*PIXEL).agg(F.sum("own").alias("tic"), F.count("*").alias("spectra"))
