"""What the operators share: table access, the shared work folder, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, and workers that can import this package."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH") or os.environ.get("PYTHONPATH")]))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; only a session without
    executors of its own, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pageloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later passes and
    lost executors find it there instead of computing it again."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_numbers(texts) -> list[int | None]:
    """Ids that came as text: pandas would turn longs beside nulls into doubles."""
    return [int(t) if isinstance(t, str) else None for t in texts]


def drawn(doc_id: str, share) -> Column:
    """Whether a row is in the training sample: that share of rows, by a hash of the id."""
    return F.pmod(F.xxhash64(doc_id, F.lit("train")), F.lit(1 << 53)) < share * float(1 << 53)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def finite_vector(v: str) -> Column:
    """A vector that has a direction: not null, no null or non-finite parts, not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(v).isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the undirected edges (u, v); component is the
    smallest node reachable.  Nodes without an edge to another are left out.

    Alternating large-star and small-star steps; each round is checkpointed, so
    a lost executor costs one round.  A hub with many edges is a key of plain
    joins and minima, which Spark splits or pre-aggregates.
    """
    work_dir(edges.sparkSession, "components")  # makes sure that a checkpoint folder is set
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v")
        e = small.where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("coalesce(sum(cast(v as decimal(38,0))), 0)")).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
