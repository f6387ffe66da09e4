"""Consistent-hash sharding with virtual nodes and bounded loads (operator 3).

Every shard owns VIRTUAL places of a ring, each named by a hash of (shard, replica), so
another shard adds places and moves none.  A text hashes to a place and belongs to the
first node at or after it.  A shard keeps the documents that belong to it, in the order
in which they arrive, until it is full; what overflows continues clockwise to the first
shard with room.  Keys at home come first, so an overflow never pushes others out.
The bounds are as tight as they can be: capacities differ by one and add up to the
number of documents, so the law that holds is `rows`: counts are at most one apart.

DataFrame operations only.  Documents arrive in the order of a hash of their id.
The plan needs counts for each cell (arrival bucket, arc of the ring), a table
of fixed size whatever the input: the driver walks through it once and writes
down which ranks of a cell go to which shard, and from which slot on.  A second
pass over the hashed rows (written once, without texts) ranks each cell's
documents and joins that plan.  A group of equal texts,
however large, is one arc spread over all arrival buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS, VIRTUAL, BUCKETS, PLACES = 8, 64, 128, 1 << 14
PLAN = "bucket int, arc int, low long, high long, shard int, slot long"


def ring(spark: SparkSession, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes in ring order; of nodes that share a place
    the one with the least hash holds it, whatever other shards there are."""
    nodes = spark.range(shards * virtual).selectExpr(f"int(id div {virtual}) AS shard", f"xxhash64(int(id div {virtual}), int(id % {virtual}), 'node') AS hash")
    held: dict[int, tuple[int, int]] = {}
    for r in nodes.collect():  # shards * virtual rows
        place = r["hash"] % PLACES
        held[place] = min(held.get(place, (r["hash"], r["shard"])), (r["hash"], r["shard"]))
    return sorted((place, shard) for place, (_, shard) in held.items())


def clockwise(nodes: list[tuple[int, int]]) -> list[list[int]]:
    """For each arc, all shards in the order in which they follow clockwise."""
    return [list(dict.fromkeys(nodes[(arc + i) % len(nodes)][1] for i in range(len(nodes)))) for arc in range(len(nodes))]


def arcs(nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place, arc) for every place: the arc whose node is the first at or after it."""
    out, arc = [], 0
    for place in range(PLACES):
        while arc < len(nodes) and nodes[arc][0] < place:
            arc += 1
        out.append((place, arc % len(nodes)))
    return out


def fill(cells: list[tuple[int, int, int]], order: list[list[int]], shards: int, total: int) -> list[tuple]:
    """Rows of PLAN from cells (bucket, arc, n): first what shards keep of their own, in
    the order of arrival, then the overflow, clockwise into the room that is left."""
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, plan, over = [0] * shards, [], []

    def place(bucket: int, arc: int, low: int, high: int, shard: int) -> int:
        stop = low + min(high - low, room[shard] - used[shard])
        if stop > low:
            plan.append((bucket, arc, low, stop, shard, used[shard]))
            used[shard] += stop - low
        return stop

    for bucket, arc, n in sorted(cells):
        kept = place(bucket, arc, 0, n, order[arc][0])
        if kept < n:
            over.append((bucket, arc, kept, n))
    for bucket, arc, low, high in over:
        for shard in order[arc][1:]:
            if low == high:
                break
            low = place(bucket, arc, low, high, shard)
    return plan


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text has size 1, crc32 0 and one place on the ring.  Rows with equal ids and
    texts take their slots in any order; rows without an id arrive in the order of the
    input's partitions.  grown_shard is null: under this law a new shard also moves the
    bounds of the others.  An empty table gives no rows; other columns, whatever their
    names, are left out.
    """
    spark = docs.sparkSession
    nodes = ring(spark, shards, virtual)
    arrival = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit("arrival"))).otherwise(F.xxhash64("doc_id", "text", F.lit("arrival")))
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("text", F.lit("text")), F.lit(PLACES)).cast("int").alias("place"),
        arrival.alias("arrival"),
    ).withColumn("bucket", F.pmod("arrival", F.lit(buckets)).cast("int"))
    on_ring = spark.createDataFrame(arcs(nodes), "place int, arc int")  # PLACES rows
    keyed = stored(keyed.join(F.broadcast(on_ring), "place").drop("place"), "ring")
    cells = [tuple(r) for r in keyed.groupBy("bucket", "arc").count().collect()]  # at most buckets * shards * virtual rows
    plan = spark.createDataFrame(fill(cells, clockwise(nodes), shards, sum(n for *_, n in cells)), PLAN)
    cell = Window.partitionBy("bucket", "arc").orderBy("arrival", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("rank", F.row_number().over(cell) - 1)
    found = ranked.join(F.broadcast(plan), ["bucket", "arc"]).where("low <= rank AND rank < high")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
