"""Mixing sources to target weights along a time-varying curriculum (operator 9).

Every source has a weight in the whole mix and a schedule: how its rate changes
over training time 0..1, as a straight line from 1 - slope to 1 + slope, whose
integral is 1.  The source's demand up to time t is target * (t + slope * (t*t - t));
a document that starts at word c of its source's demand is due when demand
reaches c, so inverting that quadratic gives its training position.  Sources
are read again, at most three times, until their target is met.  DataFrame
operations only.

Word positions need running sums over a source, which may hold a third of all
rows: documents are ordered by md5 of their id, sums are taken first per prefix
of that digest, then inside each prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

PASSES = 3
PREFIX = 3
#: Schedules, given to sources in turn: steady, rising, falling.
SLOPES = (0.0, 0.75, -0.75)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, slope, target from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating.  Filling
    by weight with caps of PASSES * source_size: in the order of cap / weight, a
    source is capped as long as its cap is below its share of what is left.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())  # windows over sources, one row each
    one = sizes.withColumn("turn", F.row_number().over(turn) - 1)
    one = one.withColumn("weight", (F.col("turn") % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * PASSES)
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "turn")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    one = one.withColumn("capped", F.col("cap").cast("double") <= F.col("weight") * (left.cast("double") / weights))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_weights = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.try_divide(rest.cast("double"), open_weights))
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("turn") % len(SLOPES) + 1).cast("int"))
    return one.select("source", "source_size", slope.alias("slope"), target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions for every row.

    taken: words that the mix takes of the document, over all its passes;
    positions: for each pass with any words, its training position (0 to 1).
    Null texts have size 0 and are never taken.  A null source is a source of
    its own; equal rows share one running sum in any order; rows without an id are
    ordered by their text.  An empty table gives no rows; other columns of the input,
    whatever their names, are left out.
    """
    return _mixed(docs.select("doc_id", "source", "text", F.lit(None).cast("long").alias("row"))).drop("row", "digest")


def _mixed(docs: DataFrame) -> DataFrame:
    """mix() of (doc_id, source, text, row), with row and the digest that orders rows."""
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))).cast("binary")).alias("digest"),
        "row",
    ).withColumn("prefix", F.substring("digest", 1, PREFIX))
    cells = sized.groupBy("source", "prefix").agg(F.sum("size").alias("n"))
    want = targets(cells.groupBy("source").agg(F.sum("n").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "prefix", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    cells = cells.join(want, cells["source"].eqNullSafe(want["source"])).drop(want["source"])
    inside = Window.partitionBy("source", "prefix").orderBy("digest", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d").join(cells.alias("c"), F.expr("d.source <=> c.source AND d.prefix = c.prefix"))
    run = run.select("d.doc_id", "d.row", "d.digest", "size", "source_size", "slope", "target", (F.col("base") + F.col("inside")).alias("c"))

    def starts(k: int):  # words of demand before the document's pass k
        return F.col("c") + F.col("source_size") * k

    def words(k: int):
        return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - starts(k)))

    def position(k: int):
        u, a = F.try_divide(starts(k), F.col("target")), F.col("slope")
        return F.when(a == 0, u).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * u)) / (2 * a))

    taken = sum((words(k) for k in range(1, PASSES)), words(0))
    due = F.filter(F.array(*[F.when(words(k) > 0, position(k)) for k in range(PASSES)]), lambda t: t.isNotNull())
    return run.select("doc_id", "row", "size", "source_size", "target", taken.alias("taken"), due.alias("positions"), "digest")


def training_order(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, whatever their names, once for each pass that
    the mix takes of them, sorted over all partitions by training position (ties: digest of
    the id).  The rows are written once, so that both uses of them see the same numbers.
    Rows with null or wordless texts are never taken; an empty table gives no rows."""
    named = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    taken = _mixed(named.select("doc.doc_id", "doc.source", "doc.text", "row")).where("taken > 0")
    due = taken.select("row", F.explode("positions").alias("position"), "digest")
    return named.join(due, "row").orderBy("position", "digest", "row").select("doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("positions", F.lit(1)), 9).alias("position")).orderBy("position", "doc_id")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, turn % 3 + 1 AS weight, source_size * {PASSES} AS cap FROM o),
b AS (
  SELECT *, sum(source_size) OVER () AS total,
    sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS weights
  FROM w WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(cap AS DOUBLE) <= weight * (CAST(left_over AS DOUBLE) / CAST(weights AS DOUBLE)) AS capped FROM b),
t AS (
  SELECT source, source_size, CASE turn % 3 WHEN 0 THEN {SLOPES[0]} WHEN 1 THEN {SLOPES[1]} ELSE {SLOPES[2]} END::DOUBLE AS slope,
    CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (CAST(total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE)
      / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE)) END AS target FROM f),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, {", ".join(f"greatest(0, least(size, CAST(floor(target) AS BIGINT) - (c + source_size * {k}))) AS w{k}" for k in range(PASSES))} FROM c)
SELECT doc_id, size, source_size, target, CAST({" + ".join(f"w{k}" for k in range(PASSES))} AS BIGINT) AS taken,
  CASE WHEN w0 > 0 THEN round(CASE WHEN slope = 0 THEN c / target ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (c / target))) / (2 * slope) END, 9) END AS position
FROM p"""
