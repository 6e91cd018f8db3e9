"""Exact quantiles of a column of any size, of all rows or of each group, without a task that holds the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Scratch, written

#: Buckets of a pass; values between two buckets' ends that are told one by one.
BUCKETS, FEW = 1024, 50_000


def _ranked(rows: DataFrame, rank: int, lo: float, hi: float, below: int, within: int) -> list[float]:
    """The values of 0-based ranks `rank` and `rank` + 1, which lie in [lo, hi], where `within` values are and before which `below`.

    A pass counts the values in equal parts of the range and leaves the part with the wanted ranks, until few enough
    distinct values are left to be counted each.
    """
    while within > FEW and lo < hi:
        width = (hi - lo) / BUCKETS
        part = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - lo) / width)) if width > 0 else F.lit(0)
        counts = sorted(tuple(r) for r in rows.where(F.col("v").between(lo, hi)).groupBy(part.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).collect())
        kept, start = [], below
        for _, n, a, z in counts:
            if start + n > rank and start <= rank + 1:
                kept.append((a, z, start, n))
            start += n
        new = kept[0][0], kept[-1][1], kept[0][2], sum(k[3] for k in kept)
        if new[3] == within and new[:2] == (lo, hi):
            break
        lo, hi, below, within = new
    counts = rows.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v")
    found, start = [], below
    for v, n in counts.toLocalIterator():
        while len(found) < 2 and start <= rank + len(found) < start + n:
            found.append(v)
        start += n
        if len(found) == 2:
            break
    return found


def exact_quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of the non-null, non-NaN values of a column, interpolated between neighbours; None where there are none."""
    own = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, lo, hi = own.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    out = []
    for share in shares:
        at = (n - 1) * share
        two = _ranked(own, int(at), lo, hi, 0, n)
        out.append(two[0] + (at - int(at)) * (two[-1] - two[0]))
    return out


def _quantiles(sorted_: F.Column, n: F.Column, shares: Sequence[float]) -> F.Column:
    """Interpolated quantiles of a sorted array of `n` values."""
    def one(share: float) -> F.Column:
        at = (n - 1) * F.lit(float(share))
        low = F.get(sorted_, F.floor(at).cast("int"))
        return low + (at - F.floor(at)) * (F.get(sorted_, F.ceil(at).cast("int")) - low)

    return F.array(*map(one, shares))


def grouped_quantiles(rows: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(*keys, n, q): quantiles of the non-null, non-NaN values of each group, interpolated between neighbours, in the order of `shares`.

    Groups of up to `few` values are sorted as they are. All larger ones are refined together: each pass counts the values
    in equal parts of what is left of a group and keeps the parts with the wanted ranks, until a part has few values or
    only one. Those are counted each and ranked. Null keys are groups like others; groups without values are missing.
    """
    keys, scratch = list(keys), Scratch()
    own = scratch.written(rows.select(*keys, F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"), "values")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = scratch.written(sizes.where(F.col("_n") > few).withColumn("_group", F.monotonically_increasing_id()), "large")
    names = large.select(*(F.col(k).alias(f"_{i}_") for i, k in enumerate(keys)), "_group")
    same = [F.col(k).eqNullSafe(F.col(f"_{i}_")) for i, k in enumerate(keys)]
    some = not large.isEmpty()
    small = own.join(names, same, "left_anti") if some else own
    out = small.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s")).select(*keys, F.size("_s").cast("long").alias("n"), _quantiles(F.col("_s"), F.size("_s"), shares).alias("q"))
    if some:
        values = scratch.written(own.join(names, same).select("_group", "_v"), "refined")
        at = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(r), F.ceil(r)) for r in ((F.col("_n") - 1) * F.lit(float(s)) for s in shares))))))
        wanted = scratch.written(large.select("_group", at.alias("_rank")), "wanted")
        spans = scratch.written(large.select("_group", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_n"), "spans")
        inside = lambda s: values.join(s, "_group").where("_v between _lo and _hi")
        before = lambda *c: F.sum("_k").over(W.partitionBy("_group", "_lo").orderBy(*c).rowsBetween(W.unboundedPreceding, -1))
        while True:
            part = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / buckets)))
            going = F.expr(f"_n > {few} and _hi > _lo and (_hi - _lo) / {buckets} > 0")
            parts = (inside(spans.where(going)).groupBy("_group", "_lo", "_below", part.alias("_part")).agg(F.count("*").alias("_k"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
                     .withColumn("_start", F.col("_below") + F.coalesce(before("_part"), F.lit(0))))
            kept = (parts.join(wanted, "_group").where("_rank >= _start and _rank < _start + _k")
                    .select("_group", F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), F.col("_start").alias("_below"), F.col("_k").alias("_n")).distinct())
            if spans.where(going).isEmpty():
                break
            spans = scratch.written(spans.where(~going).unionByName(kept), "spans")
        each = inside(spans).groupBy("_group", "_lo", "_below", "_v").agg(F.count("*").alias("_k")).withColumn("_start", F.col("_below") + F.coalesce(before("_v"), F.lit(0)))
        ranked = each.join(wanted, "_group").where("_rank >= _start and _rank < _start + _k").groupBy("_group").agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"))

        def one(share: float) -> F.Column:
            r = (F.col("_n") - 1) * F.lit(float(share))
            low = F.col("_at")[F.floor(r)]
            return low + (r - F.floor(r)) * (F.col("_at")[F.ceil(r)] - low)

        out = out.unionByName(large.join(ranked, "_group").select(*keys, F.col("_n").alias("n"), F.array(*map(one, shares)).alias("q")))
    out = written(out, "quantiles")
    scratch.clear()
    return out
