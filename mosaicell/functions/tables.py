"""Tables, written intermediate results, and connected components, which several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the members of a component are dealt to by a hash.
SALTS = 32
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST, _BROADCAST_BY_ROWS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` under `sf_dir`, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, one of our own on a single machine; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mosaicell-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Written tables that are removed together, once what follows from them has been written itself.

    Files of pixels and numbers are a few bytes a row, of which a hash table on the driver makes a hundred: joins are
    planned as shuffles, and broadcast only where the rows turn out to be few. With `by_files`, Spark goes by the size of files.
    """

    def __init__(self, by_files: bool = False) -> None:
        self._paths: list[tuple[SparkSession, str]] = []
        self._by_files = by_files

    def written(self, df: DataFrame, name: str, by_files: bool | None = None) -> DataFrame:
        """`df` as a table written to the shared folder and read again: cuts lineage, survives lost executors. by_files: for this table alone."""
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        # Nothing reads the shuffles again once the table is there: they needn't stay on the executors' disks.
        confs = {_CLEANUP: "true"}
        if not (self._by_files if by_files is None else by_files):
            confs |= {_BROADCAST: "-1", _BROADCAST_BY_ROWS: spark.conf.get(_BROADCAST_BY_ROWS, None) or spark.conf.get(_BROADCAST)}
        before = {c: spark.conf.get(c, None) for c in confs}
        try:
            for c, value in confs.items():
                spark.conf.set(c, value)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for c, value in before.items():
                spark.conf.unset(c) if value is None else spark.conf.set(c, value)
        self._paths.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes the tables."""
        for spark, path in self._paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self._paths.clear()


_holder: ContextVar[Scratch | None] = ContextVar("holder", default=None)


@contextmanager
def holding() -> Iterator[Scratch]:
    """What `written` writes inside belongs to the Scratch given, which its user clears once nothing that reads it is left."""
    scratch = Scratch(by_files=True)
    token = _holder.set(scratch)
    try:
        yield scratch
    finally:
        _holder.reset(token)


def written(df: DataFrame, name: str, by_files: bool = False) -> DataFrame:
    """A table as Scratch writes it, which stays, but for what `holding` says."""
    return (_holder.get() or Scratch()).written(df, name, by_files)


def sweep(spark: SparkSession) -> None:
    """The driver's heap after many plans: what they left is collected, so that Spark takes back their broadcasts and the heap shrinks.

    For steps that plan dozens of joins in a row; nothing that is still referred to goes.
    """
    spark._jvm.System.gc()


def dense(entries: F.Column, size: F.Column, place: str, value: str) -> F.Column:
    """An array of `size` doubles from an array of structs: each entry's value at its place (different ones from 0 on), zeros between them.

    One pass over the sorted entries: the gap before each is filled, then the rest.
    """
    entries = F.array_sort(F.transform(entries, lambda x: F.struct(x[place].cast("int").alias("i"), x[value].cast("double").alias("v"))))
    entries = F.filter(entries, lambda x: (x["i"] >= 0) & (x["i"] < size))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    # A place's gap reaches from the entry before it: the shifted array of places.
    before = F.transform(F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("v"))), entries), lambda x: x["i"])
    ends = F.zip_with(entries, F.slice(before, F.lit(1), F.size(entries)), lambda x, b: F.concat(zeros(x["i"] - b - 1), F.array(x["v"])))
    return F.concat(F.flatten(ends), zeros(size - 1 - F.element_at(before, -1)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the links (u, v), both long: one row (node, root) for every node that isn't a root.

    Alternating large-star and small-star steps; each round is one written table, which goes when the next is there. A
    node's smallest neighbour is a partial aggregate, and the join that hands it out splits hot nodes (adaptive skew
    join), so that a node with very many links is never gathered. Loops, repeated links and nulls are dropped; no links
    give an empty table.
    """
    now = Scratch()
    edges = now.written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "links")
    for _ in range(rounds):
        # Settled are stars: a node has one link down at most, and none that leads on.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").agg(F.count("*")).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = Scratch()
        edges = following.written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now.clear()
        now = following
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def lowest_of_component(nodes: DataFrame, roots: DataFrame, value: str) -> DataFrame:
    """(node, value) with the smallest value of each node's component, for `nodes` (node, value; node not repeated) and
    what `components` returns for their links. Nulls are no values.

    Of a component, values go up as partial aggregates and come down through a join on the root and one of SALTS
    parts, so that a component of any size is spread over as many tasks.
    """
    own = nodes.select("node", value).join(roots, "node", "left")
    low = own.where("root is not null").groupBy(F.col("root").alias("node")).agg(F.min(value).alias("low"))
    heads = own.where("root is null").join(low, "node", "left").select("node", F.least(value, "low").alias(value))
    down = (heads.join(low.select("node"), "node", "left_semi")
            .select(F.col("node").alias("root"), value, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    tails = own.where("root is not null").select("node", "root", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("_salt")).join(down, ["root", "_salt"])
    return heads.select("node", value).unionByName(tails.select("node", value))
