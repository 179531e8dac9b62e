"""Shared parts of the operators: the query registry, tables, digests and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid.session import pinned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Rows of two longs or less: 16 MB before Spark hashes them.
BROADCAST_KEYS = 1_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches sized for rows that hold whole texts, so that a worker's memory does not follow the default row count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by their exact names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_key(*columns: str | Column) -> Column:
    """64-bit key of a row's values, nulls told apart by their places; equal rows share it and all results."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in parts for x in (c.isNull(), c)])


def small_side(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A table of few narrow rows that is kept (``pinned``), marked for broadcast if counted at most ``most``.

    So the wide rows it is joined with stay where they are; beyond the bound Spark joins both sides by shuffle, with the same result.
    """
    return F.broadcast(keys) if keys.count() <= most else keys


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of each node's connected component: columns ``node`` and ``root`` (longs).

    ``edges`` has longs ``u`` and ``v``. Labels fall to the smallest neighbour's label and then jump to their
    label's label, so rounds grow with the logarithm of a component's diameter. Every round is one aggregate
    with map-side combine and two joins by node, checkpointed; no node's neighbours are ever gathered.
    """
    both = edges.select("u", "v").where("u <> v")
    links = pinned(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = pinned(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("jumped"))
        moved = low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jumped", "low")).alias("root"), "was")
        moved = pinned(moved)
        labels = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
