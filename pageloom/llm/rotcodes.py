"""Near-duplicate vectors by randomly rotated binary codes (operator 6).

A unit vector is turned by a fixed random rotation and kept as its signs, with
the inner product of vector and code as correction factor.  A query's rotated
vector is rounded to a few bits per part, so that bit operations give its inner
product with a code; divided by the correction factor that is an unbiased
estimate of the cosine.  A pair goes on to the exact cosine unless the upper
confidence bound of its estimate lies below the threshold, so every link is
decided in double precision.

Candidates: in each of several tables a vector lives in the cell of its largest part
(signed) under a rotation of that table, over the first parts, then over further
rotations as the vectors grow in number.  How often two vectors at the threshold share a
cell is measured on such pairs, and there are as many tables as let a pair share none with
probability MISS at most.  A pair counts in the first table where it shares a cell.
Codes travel to the cells; vectors follow only for rows that some bound lets link there.
Cells of many vectors are dealt into a grid of blocks.  Equal vectors are one class.  A
block returns link counts and, for each linked class, the smallest class of its group
there; pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, finite_vector, importable, stored, table
from .simhash import Groups

#: SURE: standard errors allowed for an estimate; PLANES: bits of a query's part.
THRESHOLD, CELL, BLOCK, SURE, MISS, PLANES = 0.95, 1024, 4096, 5.0, 1e-6, 4
TRIALS, PAIRS_AT_ONCE = 4096, 1 << 19


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([dim, 0]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def record(dim: int, planes: int) -> np.dtype:
    words = -(-dim // 64)
    return np.dtype([("sign", "<u8", (words,)), ("plane", "<u8", (planes, words)), *((c, "<f8") for c in ("ones", "factor", "low", "step", "level_sum", "rounding"))])


def code(turned: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """Records of rotated unit rows: signs, correction factor, and the row rounded to planes."""

    def bits(b: np.ndarray) -> np.ndarray:
        packed = np.packbits(b, axis=1)
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")

    n, dim = turned.shape
    out = np.zeros(n, record(dim, planes))
    out["sign"], out["ones"] = bits(turned > 0), (turned > 0).sum(axis=1)
    out["factor"] = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
    step = np.maximum(high - low, 1e-12) / (2**planes - 1)
    level = np.rint((turned - low) / step).astype(np.int64)
    for p in range(planes):
        out["plane"][:, p] = bits((level >> p) & 1 == 1)
    out["low"], out["step"], out["level_sum"] = low[:, 0], step[:, 0], level.sum(axis=1)
    out["rounding"] = np.linalg.norm(level * step + low - turned, axis=1)
    return out


def may_reach(asking: np.ndarray, codes: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Whether the cosine of each asking row and each code may reach threshold."""
    common = np.zeros((len(asking), len(codes)), np.uint32)
    for p in range(asking["plane"].shape[1]):
        for word in range(asking["plane"].shape[2]):
            common += np.bitwise_count(asking["plane"][:, p, word][:, None] & codes["sign"][:, word]).astype(np.uint32) << np.uint32(p)
    # sqrt(dim) times the estimate is 2 * (step * common + low * ones) less the sum of the query's parts; everything but
    # `common` is a product of a query's and a code's terms
    step, low, wide = asking["step"][:, None], asking["low"][:, None], np.sqrt(dim)
    error = SURE * np.sqrt((1 - threshold**2) * np.maximum(0, 1 - codes["factor"] ** 2) / max(1, dim - 1))
    level_sum = asking["level_sum"][:, None] * step + low * dim
    query = np.concatenate([wide / step, -2 * low / step, (level_sum - wide * asking["rounding"][:, None]) / step], axis=1)
    other = np.stack([threshold * codes["factor"] - error, codes["ones"], np.ones(len(codes))])
    return common >= (query @ other / 2).astype(np.float32) * np.float32(1 - 1e-5)


def cell_levels(n: int, dim: int, cell: int = CELL) -> list[int]:
    """Parts per level: each level of m parts makes 2 * m cells."""
    want, levels = n / cell, []
    while want > 2 and len(levels) < 4:
        levels.append(int(min(dim, np.ceil(want / 2))))
        want /= 2 * levels[-1]
    return levels


def cells(turned: np.ndarray, levels: list[int], tables: int) -> np.ndarray:
    """The cell of each rotated row in each table: its signs flipped at random and turned once more."""
    n, dim = turned.shape
    home = np.zeros((n, tables), np.int64)
    for number, parts in enumerate(levels):
        flips = np.random.default_rng([dim, 1, number]).choice([-1.0, 1.0], (dim, 1000))
        for t in range(tables):
            part = (turned * flips[:, t]) @ rotation(dim).T[:, :parts]
            home[:, t] = home[:, t] * 2 * parts + np.concatenate([part, -part], axis=1).argmax(axis=1)
    return home


def table_count(dim: int, levels: list[int], threshold: float) -> int:
    """How many tables it takes, from TRIALS random pairs at the threshold."""
    if not levels:
        return 1
    r = np.random.default_rng([dim, 2])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in r.normal(size=(2, TRIALS, dim)))
    b = b - (a * b).sum(axis=1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    together = (cells(a, levels, 4) == cells(b, levels, 4)).mean()
    return int(np.clip(np.ceil(np.log(MISS) / np.log(1 - np.clip(together, 0.02, 1 - MISS))), 1, 1000))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors null, zero or holding null or non-finite parts, and rows with a null
    id, link with nothing and are components of their own.  Vectors of different
    lengths never link.  Equal rows are vectors of their own and link with each
    other.  An empty table gives no rows; other columns, whatever their names, are left out.
    """
    importable(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding").withColumn("ok", F.col("vec_id").isNotNull() & finite_vector("embedding"))
    classes = stored(rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    counts = {r["dim"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    levels = {dim: cell_levels(n, dim, cell) for dim, n in counts.items()}
    tables = {dim: table_count(dim, levels[dim], threshold) for dim in counts}

    def unit_rows(embeddings: pd.Series) -> np.ndarray:
        x = np.stack(embeddings.tolist()).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(dim=b["embedding"].map(len))
            for dim, some in b.groupby("dim", sort=True):
                for lo in range(0, len(some), 1024):
                    part = some.iloc[lo : lo + 1024]
                    turned = unit_rows(part["embedding"]) @ rotation(dim).T
                    yield pd.DataFrame({"dim": dim, "rep": part["rep"], "n": part["n"], "code": [c.tobytes() for c in code(turned)], "cells": list(cells(turned, levels[dim], tables[dim]))})

    codes = stored(classes.mapInPandas(coded, "dim int, rep long, n long, code binary, cells array<long>"), "codes")
    at = ["dim", "table", "cell"]

    def placed(there: DataFrame) -> DataFrame:
        """Rows in a cell, those of a cell beyond BLOCK in a grid: its vectors in blocks, and
        turns of those that ask, so that no group grows with the cell."""
        large = there.groupBy(*at).agg(F.count("*").alias("n_cell")).where(F.col("n_cell") > BLOCK)
        large = large.select(*at, F.ceil(F.col("n_cell") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_cell") / (4 * BLOCK)).cast("int").alias("turns"))
        sized = there.join(large, at, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("blocks", "turns")})
        draw = F.xxhash64("rep")
        keeps = sized.select("*", F.lit(True).alias("data"), F.pmod(draw, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        asks = sized.select("*", F.lit(False).alias("data"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(draw, F.col("turns")).cast("int").alias("turn"))
        return keeps.where("blocks * turns > 1").unionByName(asks).drop("blocks", "turns")  # a cell of one block: its rows are asking and asked

    def candidates(key: tuple, some: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]]:
        """(asking rows, asked rows, pairs of them that a bound lets link and that share no cell before)."""
        dim, t = key[0], key[1]
        q = some[~some["data"]].sort_values("rep").reset_index(drop=True)
        d = some[some["data"]].sort_values("rep").reset_index(drop=True) if some["data"].any() else q
        if len(q) < 2 and d is q or not len(q):
            return
        (cq, hq, rq), (cd, hd, rd) = ((np.frombuffer(b"".join(x["code"]), record(dim, PLANES)), np.stack(x["cells"].tolist())[:, :t], x["rep"].to_numpy(np.int64)) for x in (q, d))
        step = max(1, PAIRS_AT_ONCE // len(d))
        for lo in range(0, len(q), step):
            i, j = np.nonzero(may_reach(cq[lo : lo + step], cd, dim, threshold))
            i += lo
            fresh = rq[i] != rd[j]
            for before in range(t):
                fresh[fresh] = hq[i[fresh], before] != hd[j[fresh], before]
            yield q, d, i[fresh], j[fresh]

    def survivors(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        reps = [x["rep"].to_numpy(np.int64)[np.unique(k)] for q, d, i, j in candidates(key, some) for x, k in ((q, i), (d, j))]
        return pd.DataFrame({"dim": key[0], "table": key[1], "cell": key[2], "rep": np.unique(np.concatenate(reps)) if reps else np.zeros(0, np.int64)}).astype({"dim": "int32", "table": "int32", "cell": "int64"})

    there = codes.select("dim", "rep", "code", "cells", F.posexplode("cells").alias("table", "cell"))
    reached = placed(there).groupBy(*at, "block", "turn").applyInPandas(survivors, "dim int, table int, cell long, rep long").distinct()
    whole = codes.drop("dim").join(classes.select(F.col("rep").alias("of"), "embedding"), F.expr("rep = of")).drop("of")
    reached = stored(reached.join(whole, "rep"), "survivors")

    def linked(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(some["rep"].to_numpy(np.int64))
        credit, groups, known = np.zeros(len(names), np.int64), Groups(len(names)), None
        for q, d, i, j in candidates(key, some):
            if known is None:
                known = tuple((np.searchsorted(names, x["rep"].to_numpy(np.int64)), unit_rows(x["embedding"]), x["n"].to_numpy(np.int64)) for x in (q, d))
            (at_q, y, _), (at_d, x, n_d) = known
            step = max(1, (1 << 22) // key[0])
            for lo in range(0, len(i), step):
                a, b = i[lo : lo + step], j[lo : lo + step]
                exact = np.einsum("ij,ij->i", y[a], x[b]) >= threshold
                a, b = a[exact], b[exact]
                np.add.at(credit, at_q[a], n_d[b])
                groups.join(at_q[a], at_d[b])
        out = np.flatnonzero((credit > 0) | (groups.of != np.arange(len(names))))
        return pd.DataFrame({"rep": names[out], "credit": credit[out], "root": names[groups.of[out]]})

    told = stored(placed(reached).groupBy(*at, "block", "turn").applyInPandas(linked, "rep long, credit long, root long"), "links")
    found = connected_components(told.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = told.groupBy("rep").agg(F.sum("credit").alias("credit"))
    of = classes.join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("embedding", (F.coalesce("credit", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("ok"))
    out = rows.join(of, ["embedding", "ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_aggregate(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id"""
