"""What several operators of this subpackage share."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.tables import components, lowest_of_component, shared_folder, table

__all__ = ["Scratch", "bounded_sample", "components", "lowest_of_component", "shared_folder", "table", "written"]

# Rows of texts are as large as their files say.
Scratch, written = partial(tables.Scratch, by_files=True), partial(tables.written, by_files=True)


def bounded_sample(rows: DataFrame, by: str, most: int, id_col: str = "id") -> DataFrame:
    """Up to `most` rows of each value of `by` (few values), by a hash of the id, with n: how many there are.

    A share of each value's rows that holds `most` is drawn first, so that what is sorted is bounded too.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(sizes), by).where(draw < (1.3 * most + 100) / F.col("n"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(draw, id_col))
    return some.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
