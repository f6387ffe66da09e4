"""Approximate nearest neighbours by sharded navigable small-world graphs (operator 2).

Vectors are dealt into shards of bounded size by a hash of their id: a shard for each
PARTS-th of the table, of SHARD vectors at least and MOST at most.  A task
builds a shard's hierarchy: a node's top level comes from a hash of its id, each
level is a graph stored as one flat array of neighbour numbers, and nodes enter
a level in batches that are searched together.  The index is written to the
shared folder.  Every query asks every shard, in blocks, and the shards' nearest
are merged.  Equal vectors are one node that names its smallest members; no
result of k rows can hold more of them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finite_vector, importable, stored, table

SHARD, MOST, PARTS, QUERY_BLOCK = 8192, 32768, 64, 4096
LINKS, BASE_LINKS, BUILD_WIDTH, SEARCH_WIDTH, BATCH, STEP = 16, 32, 96, 160, 256, 4


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a to the rows of b that stand beside them."""
    d = a[:, None, :] - b
    return np.einsum("ijk,ijk->ij", d, d)


def beam(x: np.ndarray, links: np.ndarray, start: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all rows of q together: the (numbers,
    squared distances) of up to width nodes each, nearest first, -1 for none."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x)), bool)
    ids = np.full((len(q), width), -1, np.int64)
    dist = np.full((len(q), width), np.inf, x.dtype)
    done = np.ones((len(q), width), bool)
    k = min(start.shape[1], width)
    ids[:, :k], dist[:, :k], done[:, :k] = start[:, :k], squared(q, x[start[:, :k]]), False
    seen[rows[:, None], ids[:, :k]] = True
    while True:
        todo = np.where(done, np.inf, dist)
        live = np.flatnonzero(np.isfinite(todo.min(axis=1)))
        if not len(live):
            order = np.argsort(dist, axis=1, kind="stable")
            return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        pick = np.argpartition(todo[live], min(STEP, width) - 1, axis=1)[:, :STEP]
        open_ = np.isfinite(np.take_along_axis(todo[live], pick, 1))
        done[live[:, None], pick] = True
        near = links[ids[live[:, None], pick]]
        near[~open_] = -1
        near = near.reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near.sort(axis=1)
        near = near[:, -max(1, int((near >= 0).sum(axis=1).max())) :]
        there = near >= 0
        r, c = np.nonzero(there)
        seen[live[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, x.dtype)
        delta = x[near[r, c]] - q[live[r]]
        d[r, c] = np.einsum("ij,ij->i", delta, delta)
        all_d = np.concatenate([dist[live], d], axis=1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1)
        dist[live] = np.take_along_axis(all_d, keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~there], axis=1), keep, 1)


def choose(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """From candidates of each row, nearest first: those nearer to the row than
    to any candidate chosen before, then the nearest of the others, up to most."""
    between = x[np.maximum(ids, 0)]
    norm = np.einsum("ijk,ijk->ij", between, between)
    between = norm[:, :, None] + norm[:, None, :] - 2 * between @ between.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, bool)
    there = (ids >= 0) & np.isfinite(dist)
    for j in range(ids.shape[1]):
        hidden = ((between[:, j, :] < dist[:, j, None]) & kept).any(axis=1)
        kept[:, j] = there[:, j] & ~hidden & (kept.sum(axis=1) < most)
    order = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(there, order, 1), np.take_along_axis(ids, order, 1), -1)


def enter(x: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> None:
    """Links the new nodes to chosen candidates, and those back to them."""
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    out = choose(x, ids, dist, most)
    links[new, : out.shape[1]] = out
    r, c = np.nonzero(out >= 0)
    to, frm = out[r, c], new[r]
    d = x[to] - x[frm]
    order = np.lexsort((np.einsum("ij,ij->i", d, d), to))
    to, frm = to[order], frm[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, count)
    more = np.full((len(nodes), int(min(count.max(initial=1), links.shape[1]))), -1, np.int64)
    fits = rank < more.shape[1]
    more[np.repeat(np.arange(len(nodes)), count)[fits], rank[fits]] = frm[fits]
    for lo in range(0, len(nodes), 256):
        v = nodes[lo : lo + 256]
        cand = np.concatenate([links[v], more[lo : lo + 256]], axis=1)
        d = np.where(cand >= 0, squared(x[v], x[np.maximum(cand, 0)]), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        links[v] = choose(x, np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), links.shape[1])


def build(x: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the top: (members of the level, flat neighbours as rows of -1-padded
    positions among the members)."""
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for top in range(int(level.max(initial=0)), -1, -1):
        members = np.flatnonzero(level >= top)
        members = members[np.argsort(-level[members], kind="stable")]
        y, most = x[members], LINKS if top else BASE_LINKS
        links = np.full((len(members), most), -1, np.int64)
        known = 0
        while known < len(members):
            new = np.arange(known, min(len(members), known + max(32, min(BATCH, known))))
            own = y[new]
            own_d = ((own[:, None, :] - own[None]) ** 2).sum(axis=2) if len(new) <= 32 else np.maximum(0, (n := np.einsum("ij,ij->i", own, own))[:, None] + n[None] - 2 * own @ own.T)
            own_d[np.arange(len(new))[:, None] <= np.arange(len(new))[None]] = np.inf
            ids, dist = np.broadcast_to(new, own_d.shape), own_d
            if known:
                found = beam(y[:known], links[:known], entry(levels, x, own, members, known), own, BUILD_WIDTH)
                ids, dist = np.concatenate([found[0], ids], axis=1), np.concatenate([found[1], dist], axis=1)
            near = np.argpartition(dist, min(BUILD_WIDTH, dist.shape[1]) - 1, axis=1)[:, :BUILD_WIDTH]
            ids, dist = np.take_along_axis(ids, near, 1), np.take_along_axis(dist, near, 1)
            enter(y, links, new, np.where(np.isfinite(dist), ids, -1), dist, LINKS)
            known = int(new[-1]) + 1
        levels.append((members, links))
    return levels


def entry(levels: list, x: np.ndarray, q: np.ndarray, members: np.ndarray, known: int) -> np.ndarray:
    """Where to start on the level of members: found by going down the levels
    above; a level's members come first on the level below, in the same order."""
    at = np.zeros((len(q), 1), np.int64)
    for upper, links in levels:
        at = beam(x[upper], links, at, q, STEP)[0][:, :1]
    return np.where(at < known, at, 0)


def search(x: np.ndarray, levels: list, q: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the nodes found for each row of q, nearest first, -1 for none."""
    out = []
    for lo in range(0, len(q), BATCH):
        some = q[lo : lo + BATCH]
        members, links = levels[-1]
        out.append(np.where((found := beam(x[members], links, entry(levels[:-1], x, some, members, len(members)), some, min(width, len(members)))[0]) >= 0, members[found], -1))
    return np.concatenate(out)


def _pack(**arrays: np.ndarray) -> bytes:
    np.savez(f := io.BytesIO(), **arrays)
    return f.getvalue()


def index(nodes: DataFrame, shard_size: int | None = None) -> DataFrame:
    """shard, graph from nodes (vec_id, embedding, members): one row a shard.
    Vectors of different lengths never share a shard."""
    n = nodes.count()
    shards = max(1, -(-n // (shard_size or min(MOST, max(SHARD, n // PARTS)))))

    def graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        original = np.array(rows["embedding"].tolist(), np.float64)
        u = (rows["draw"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        level = np.minimum(8, (-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(int))
        levels = build(original.astype(np.float32), level)
        members = rows["members"].tolist()
        flat = {f"m{i}": m for i, (m, _) in enumerate(levels)} | {f"l{i}": k.astype(np.int32).ravel() for i, (_, k) in enumerate(levels)}
        data = _pack(x=original, members=np.concatenate(members).astype(np.int64), counts=np.array([len(m) for m in members]), **flat)
        return pd.DataFrame({"shard": [key[0]], "graph": [data]})

    dealt = nodes.withColumn("shard", F.format_string("%d-%d", F.size("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)))).withColumn("draw", F.xxhash64("vec_id", F.lit("level")))
    return dealt.groupBy("shard").applyInPandas(graph, "shard string, graph binary")


def ask(graph: bytes, ids: np.ndarray, q: np.ndarray, k: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, neighbour ids, distances): each query's k nearest members
    found in one shard, itself left out, ties to the smaller id."""
    z = np.load(io.BytesIO(graph))
    x, counts, members = z["x"], z["counts"], z["members"]
    first = np.cumsum(counts) - counts
    levels = [(m := z[f"m{i}"], z[f"l{i}"].astype(np.int64).reshape(len(m), -1)) for i in range(sum(n[0] == "m" and n[1:].isdigit() for n in z.files))]
    found = search(x.astype(np.float32), levels, q.astype(np.float32), max(width, k + 1))
    for lo in range(0, len(q), 256):
        f = found[lo : lo + 256]
        r, c = np.nonzero(f >= 0)
        node = f[r, c]
        d = np.sqrt(((x[node] - q[lo : lo + 256][r]) ** 2).sum(axis=1))
        n = counts[node]
        r, d = np.repeat(r, n), np.repeat(d, n)
        who = members[np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        own = ids[lo : lo + 256][r]
        keep = who != own
        r, d, who, own = r[keep], d[keep], who[keep], own[keep]
        order = np.lexsort((who, d, r))
        r, d, who, own = r[order], d[order], who[order], own[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield own[top], who[top], d[top]


def nearest(vectors: DataFrame, is_query, k: int = 10, shard_size: int | None = None, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row.

    Vectors null, zero or holding null or non-finite parts take no part, nor
    does a null vec_id; equal rows count once; an empty table gives no rows;
    fewer candidates give fewer rows; other columns, whatever their names, are left out.
    """
    spark = vectors.sparkSession
    importable(spark)
    valid = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite_vector("embedding")).dropDuplicates()
    least = Window.partitionBy("embedding").orderBy("vec_id")
    few = valid.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    nodes = stored(few.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("members")), "nodes")
    graphs = stored(index(nodes, shard_size), "graphs")
    queries = valid.where(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = graphs.select("shard", F.split("shard", "-")[0].cast("int").alias("dim"))
    asked = queries.withColumn("dim", F.size("embedding")).join(shards.groupBy("dim").agg(F.collect_list("shard").alias("shards")), "dim")
    asked = asked.select("vec_id", "embedding", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).alias("block"))
    there = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def answers(graph: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = list(ask(graph["graph"][0], rows["vec_id"].to_numpy(np.int64), np.array(rows["embedding"].tolist(), np.float64), k, width)) if len(graph) and len(rows) else []
        return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i, n in enumerate(("query_id", "vec_id", "score"))}).astype({"query_id": "int64", "vec_id": "int64"})

    found = there.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(answers, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
