"""SimHash near-duplicates through vantage-point trees (operator 4).

A text's fingerprint has a bit set where over half of its shingles' hashes have
it.  Equal fingerprints are one class from the start.  A vantage-point tree from
a bounded sample of the classes cuts them into shards by Hamming distance; a
fingerprint is stored in one shard and asks in every shard that the triangle
inequality cannot rule out for its radius.  Inside a shard, whose asking rows are dealt
into turns, a second tree prunes the same way down to small buckets, which are compared
exactly.  No link is lost and no pair is emitted: a task returns, for each linked class,
the first class of its group there, and those edges go through components().

Texts with a Jaccard similarity of 0.8 differ in about 10 of 64 bits; at that
radius triangle bounds cut nothing off.  If a similarity is asked for, texts with a
common key are therefore linked as well: a key names
the KEPT smallest of a text's shingles in one of TABLES random orders, so two
texts of similarity s share one with probability 1 - (1 - s**KEPT)**TABLES.  Among
a key's texts, fingerprints of 512 bits over distinct shingles say which are as near
as that similarity lets expect, with MARGIN standard errors (texts of FEW shingles, whose
bits say little, always are).  Forests over those pairs
and the trees' links name families; inside a family every pair near by either
fingerprint is compared exactly, shingle set with shingle set, unless confirmed pairs
already join the two.  Then only equal shingle sets are one class from the start.

Keys and families of more than BLOCK texts are first compared inside blocks, dealt at
random DEALS times, which joins nearly all of a group of near copies with work in
proportion to its size; then every text outside the largest joined part meets every
text of the group once, so no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, drawn, id_numbers, importable, stored, table

SEED, BITS, RADIUS = 42, 2, 2
SHARD, SAMPLE_PER_SHARD, MOST_SHARDS, BUCKET, TURN = 16384, 64, 1 << 16, 128, 8192
PAIRS_AT_ONCE = 1 << 20
WIDE, TABLES, KEPT, MARGIN, FEW = 8, 16, 3, 4.5, 16
#: Texts of a key or family in a block, how often they are dealt, and up to how many texts several of them share a task.
BLOCK, DEALS, SMALL, TASK_ROWS = 4096, 2, 256, 16384


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.fromiter((h(join(g), SEED) for g in grams), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 if there are none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of a text; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle))


def mixed(h: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Hashes shuffled anew for each turn (the finaliser of SplitMix64)."""
    x = h + (turn + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> tuple[bytes, int, bytes, list[int]]:
    """(hash of the set, its size, wide fingerprint, keys) of a text's distinct shingles; no keys without a word."""
    import xxhash

    own = np.unique(hashes)
    counts, least = np.zeros(64 * WIDE, np.int64), np.zeros((0, TABLES), np.uint64)
    for lo in range(0, len(own), 1 << 14):
        x = mixed(own[lo : lo + (1 << 14), None], np.arange(WIDE + TABLES, dtype=np.uint64))
        counts += np.unpackbits(np.ascontiguousarray(x[:, :WIDE]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.concatenate([least, x[:, WIDE:]])
        least = np.partition(least, KEPT - 1, axis=0)[:KEPT] if len(least) > KEPT else least
    code = np.packbits(2 * counts > len(own), bitorder="little").tobytes()
    least = np.sort(least, axis=0).T.astype("<u8")
    keys = [xxhash.xxh64_intdigest(row.tobytes(), t) - 2**63 for t, row in enumerate(least)] if len(own) else []
    return xxhash.xxh3_128_digest(own.astype("<u8").tobytes()), len(own), code, keys


def fingerprints(docs: DataFrame, shingle: int = 3, sketches: bool = False) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint as a signed long; set_hash, size, code, keys: sketch(), if wanted."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps, found = np.zeros(len(b), np.uint64), []
            for i, t in enumerate(b["text"]):
                hashes = shingle_hashes(t if isinstance(t, str) else None, shingle)
                fps[i] = majority(hashes)
                if sketches:
                    found.append(sketch(hashes))
            out = pd.DataFrame({"doc_id": pd.array(id_numbers(b["doc_id"]), "Int64"), "text_hash": b["text_hash"], "fp": fps.view(np.int64)})
            yield out.assign(**{c: [f[k] for f in found] for k, c in enumerate(("set_hash", "size", "code", "keys"))}) if sketches else out

    columns = "doc_id long, text_hash long, fp long" + ", set_hash binary, size int, code binary, keys array<long>" * sketches
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInPandas(run, columns)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def split(sample: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the largest distance that counts as inside; None if
    no point of a few tried parts the sample."""
    best = None
    for p in sample[:: max(1, len(sample) // 8)][:8]:
        d = distance(sample, p)
        for cut in np.unique(np.quantile(d, [0.4, 0.5, 0.6]).astype(int)):
            inside = int((d <= cut).sum())
            both = int(((d > cut - RADIUS) & (d <= cut + RADIUS)).sum())
            if 0 < inside < len(sample):
                cost = max(inside, len(sample) - inside) + both
                if best is None or cost < best[0]:
                    best = (cost, p, int(cut))
    return best and best[1:]


def shard_tree(sample: np.ndarray, depth: int) -> list:
    """Nested [point, cut, inside, outside] with shard numbers as leaves; the sample in any order."""
    sample = np.random.default_rng(SEED).permutation(sample)
    numbers = iter(range(1 << 30))

    def build(s: np.ndarray, depth: int):
        at = split(s) if depth and len(s) > 1 else None
        if at is None:
            return next(numbers)
        near = distance(s, at[0]) <= at[1]
        return [at[0], at[1], build(s[near], depth - 1), build(s[~near], depth - 1)]

    return build(sample, depth)


def route(tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes that ask there, whether each is stored there)."""

    def walk(node, at: np.ndarray, home: np.ndarray):
        if not len(at):
            return
        if not isinstance(node, list):
            yield node, at, home
            return
        d = distance(fps[at], node[0])
        inside, outside, in_home = d - radius <= node[1], d + radius > node[1], d <= node[1]
        yield from walk(node[2], at[inside], (home & in_home)[inside])
        yield from walk(node[3], at[outside], (home & ~in_home)[outside])

    yield from walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))


class Groups:
    """Union of indexes; the smallest index names a group."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            if not (differ := x != y).any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.of, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def link(stored_at: np.ndarray, asking: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """The group of each of fps, those at stored_at being searched for each of those at asking."""
    groups = Groups(len(fps))

    def walk(data: np.ndarray, ask: np.ndarray) -> None:
        if not len(data) or not len(ask):
            return
        at = split(fps[data[:: max(1, len(data) // 256)]]) if len(data) > BUCKET else None
        if at is None:
            step = max(1, PAIRS_AT_ONCE // len(data))
            for lo in range(0, len(ask), step):
                q = ask[lo : lo + step]
                i, j = np.nonzero(distance(fps[q][:, None], fps[data][None]) <= radius)
                groups.join(q[i], data[j])
            return
        d, e = distance(fps[data], at[0]), distance(fps[ask], at[0])
        walk(data[d <= at[1]], ask[e - radius <= at[1]])
        walk(data[d > at[1]], ask[e + radius > at[1]])

    walk(stored_at, asking)
    return groups.of


def tree_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect the classes (fp, rep) that are near each other."""
    n = classes.count()
    depth = max(0, (min(MOST_SHARDS, -(-n // SHARD)) - 1).bit_length())
    sample = np.sort(classes.where(drawn("fp", min(1.0, (SAMPLE_PER_SHARD << depth) / max(1, n)))).select("fp").toArrow()["fp"].to_numpy()) if depth else []  # about that many numbers
    tree = shard_tree(np.array(sample, np.int64).view(np.uint64), depth) if len(sample) else 0

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps, reps = b["fp"].to_numpy(np.int64), b["rep"].to_numpy(np.int64)
            parts, held = [], 0
            for shard, at, home in route(tree, fps.view(np.uint64), radius):
                parts.append((np.full(len(at), shard, np.int32), fps[at], reps[at], home))
                held += len(at)
                if held > PAIRS_AT_ONCE:
                    yield pd.DataFrame(dict(zip(("shard", "fp", "rep", "home"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                    parts, held = [], 0
            if parts:
                yield pd.DataFrame(dict(zip(("shard", "fp", "rep", "home"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    def searched(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
        reps, data = rows["rep"].to_numpy(np.int64), rows["data"].to_numpy(bool)
        of = link(np.flatnonzero(data), np.flatnonzero(~data), rows["fp"].to_numpy(np.int64).view(np.uint64), radius)
        linked = reps[of] != reps
        return pd.DataFrame({"u": reps[linked], "v": reps[of[linked]]})

    spread = stored(classes.mapInPandas(dealt, "shard int, fp long, rep long, home boolean"), "shards")
    turns = spread.groupBy("shard").agg(F.ceil(F.count("*") / TURN).cast("int").alias("turns"))  # at most MOST_SHARDS rows
    placed = spread.join(F.broadcast(turns), "shard")
    kept = placed.where("home").select("shard", "fp", "rep", F.lit(True).alias("data"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    asks = placed.select("shard", "fp", "rep", F.lit(False).alias("data"), F.pmod(F.xxhash64("rep"), "turns").cast("int").alias("turn"))
    return kept.unionByName(asks).groupBy("shard", "turn").applyInPandas(searched, "u long, v long")


def code_limit(similarity: float) -> int:
    """Differing bits of two wide fingerprints that such a similarity allows."""
    bits, p = 64 * WIDE, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + MARGIN * np.sqrt(bits * p * (1 - p)))


def nearest_links(codes: np.ndarray, small: np.ndarray, of: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within limit, or both small, that connect all rows of different groups
    `of` that are near each other: each group takes its nearest row outside until none is
    left (Boruvka's minimum forest)."""
    groups, found, n = Groups(len(codes)), [(np.zeros(0, np.int64),) * 2], len(codes)
    groups.of = of.copy()
    while True:
        nearest, far = np.zeros(n, np.int64), np.full(n, 64 * WIDE + 1, np.uint16)
        step = max(1, PAIRS_AT_ONCE // n)
        for lo in range(0, n if groups.of.any() else 0, step):
            q = slice(lo, lo + step)
            d = np.zeros((len(codes[q]), n), np.uint16)
            for w in range(codes.shape[1]):
                d += np.bitwise_count(codes[q, w][:, None] ^ codes[:, w])
            d[small[q][:, None] & small & (d > limit)] = limit
            d[groups.of[q][:, None] == groups.of] = 64 * WIDE + 1
            nearest[q], far[q] = d.argmin(axis=1), d.min(axis=1)
        order = np.lexsort((far, groups.of))
        first = order[np.diff(groups.of[order], prepend=-1) > 0]
        first = first[far[first] <= limit]
        if not len(first):
            return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))
        found.append((first, nearest[first]))
        groups.join(first, nearest[first])


def jaccard(a: str | None, b: str | None, shingle: int) -> float:
    """Similarity of the shingle sets of two texts; 0 if both have none."""
    x, y = (np.unique(shingle_hashes(t, shingle)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and stop of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True)


def first_of(values: np.ndarray) -> np.ndarray:
    """For each value the index of its first occurrence."""
    _, first, at = np.unique(values, return_index=True, return_inverse=True)
    return first[at]


def compared(rows: DataFrame, by: str, join: Callable[[DataFrame], DataFrame], links: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges (u, v) between the rows (by, n, rep, ...) that links() finds among the rows of
    each group `by`, n being its size.  join() brings a task's rows what links() needs beside;
    links() gets the rows of one group with the `part` of each, and returns pairs of indexes
    that join parts."""

    def linked(some: pd.DataFrame) -> pd.DataFrame:
        some = some.drop_duplicates([by, "rep"]).sort_values([by, "rep"], kind="stable").reset_index(drop=True)
        reps, pairs = some["rep"].to_numpy(np.int64), []
        for lo, hi in runs(some[by].to_numpy(np.int64)):
            i, j = links(some.iloc[lo:hi])
            pairs.append((lo + i, lo + j))
        u, v = (reps[np.concatenate([p[k] for p in pairs])] for k in (0, 1))
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).drop_duplicates()

    def run(placed: DataFrame) -> DataFrame:
        return join(placed).groupBy("task").applyInPandas(linked, "u long, v long")

    rows = stored(rows.withColumn("part", F.col("rep")), "groups")
    tasks = max(1, -(-rows.where(F.col("n") <= SMALL).count() // TASK_ROWS))
    name = lambda *c: F.concat_ws("-", by, *c)
    few = rows.where(F.col("n") <= BLOCK).withColumn("task", F.when(F.col("n") <= SMALL, F.pmod(F.xxhash64(by), F.lit(tasks)).cast("string")).otherwise(name()))
    many, blocks, found = rows.where(F.col("n") > BLOCK), lambda n: F.ceil(n / BLOCK).cast("int"), run(few)
    if many.isEmpty():
        return found
    for deal in range(DEALS):
        found = found.unionByName(run(many.withColumn("task", name(F.lit(deal), F.pmod(F.xxhash64("rep", F.lit(deal)), blocks(F.col("n")))))))
    found = stored(found, "block-links")
    parts = connected_components(found).withColumnRenamed("node", "rep")
    many = stored(many.drop("part").join(parts, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component"), "parts")
    largest = many.groupBy(by, "part").agg(F.count("*").alias("of_part")).groupBy(by).agg(F.max_by("part", F.struct("of_part", "part")).alias("largest"), F.max("of_part").alias("of_part"))
    many = many.join(largest, by).withColumn("turns", blocks(F.col("n") - F.col("of_part"))).where("turns > 0")
    draw, n = F.xxhash64("rep"), blocks(F.col("n"))
    there = many.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("block", F.pmod(draw, n))
    asks = many.where("part <> largest").withColumn("turn", F.pmod(draw, "turns").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
    return found.unionByName(run(there.unionByName(asks).withColumn("task", name("turn", "block")).drop("largest", "of_part", "turns", "turn", "block")))


def codes_of(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["code"]), "<u8").reshape(len(rows), WIDE)


def key_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) that connect the classes (rep, size, code, keys) that share a key and seem
    near.  Keys travel without codes until those of a single text are gone."""
    keys = classes.select("rep", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    codes, limit = classes.select("rep", "size", "code"), code_limit(similarity)

    def links(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return nearest_links(codes_of(rows), rows["size"].to_numpy() < FEW, first_of(rows["part"].to_numpy(np.int64)), limit)

    return compared(keys.join(several, "key"), "key", lambda placed: placed.join(codes, "rep"), links)


def alike_links(sets: list[np.ndarray], codes: np.ndarray, fps: np.ndarray, of: np.ndarray, limit: int, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of similar shingle sets that join groups `of`; all pairs within limit of the wide
    or radius of the short fingerprints, or both small, are compared exactly, unless they
    are in one group."""
    groups, sizes, found = Groups(len(sets)), np.array([len(s) for s in sets]), [(np.zeros(0, np.int64),) * 2]
    groups.of = of.copy()
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    stops = np.cumsum(sizes)
    mine = np.zeros(len(names), bool)
    for i in np.flatnonzero(sizes):
        if not groups.of.any():
            break
        rest = i + 1 + np.flatnonzero((groups.of[i + 1 :] != groups.of[i]) & (sizes[i + 1 :] > 0))
        near = np.bitwise_count(codes[rest] ^ codes[i]).sum(axis=1, dtype=np.int64) <= limit
        rest = rest[near | (distance(fps[rest], fps[i]) <= radius) | ((sizes[rest] < FEW) & (sizes[i] < FEW))]
        if not len(rest):
            continue
        mine[ids[stops[i] - sizes[i] : stops[i]]] = True
        step = max(1, PAIRS_AT_ONCE // int(sizes[rest].max()))
        for lo in range(0, len(rest), step):
            part = rest[lo : lo + step]
            theirs = mine[np.concatenate([ids[stops[j] - sizes[j] : stops[j]] for j in part])]
            both = np.add.reduceat(theirs, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
            hit = part[both / (sizes[i] + sizes[part] - both) >= similarity]
            found.append((np.full(len(hit), i), hit))
            groups.join(*found[-1])
        mine[ids[stops[i] - sizes[i] : stops[i]]] = False
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def confirmed(candidates: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """Edges (u, v) that connect the classes (fp, rep, doc_id, text_hash, code) whose texts have
    that Jaccard similarity, of those that the candidates (u, v) connect."""
    families = connected_components(candidates)
    many = families.groupBy("component").agg(F.count("*").alias("n"))
    members = classes.select("rep", "fp", "code", "doc_id", "text_hash").join(families.withColumnRenamed("node", "rep").join(many, "component"), "rep").withColumnRenamed("component", "family")
    asked = members.select(F.col("doc_id").alias("asked_id"), F.col("text_hash").alias("asked_hash"), F.col("rep").alias("asked_rep"))
    same = F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_hash") == F.col("asked_hash"))
    found = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(asked, same).select(F.col("asked_rep").alias("rep"), "text").dropDuplicates(["rep"])
    limit, found = code_limit(similarity), stored(found, "family-texts")

    def links(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.unique(shingle_hashes(t if isinstance(t, str) else None, shingle)) for t in rows["text"]]
        return alike_links(sets, codes_of(rows), rows["fp"].to_numpy(np.int64).view(np.uint64), first_of(rows["part"].to_numpy(np.int64)), limit, radius, similarity)

    return compared(members.drop("doc_id", "text_hash"), "family", lambda placed: placed.join(found, "rep"), links)


def near_classes(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, component) for the classes (fp, rep) that have a near one."""
    return connected_components(tree_links(classes.select("fp", "rep"), radius))


def alike_classes(classes: DataFrame, docs: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """(node, component) for the classes (fp, rep, doc_id, text_hash, size, code, keys) that have
    one of that Jaccard similarity, among those near by either fingerprint."""
    by_fp = stored(classes.groupBy("fp").agg(F.min("rep").alias("rep")), "by-fingerprint")
    equal = classes.select("fp", F.col("rep").alias("u")).join(by_fp.withColumnRenamed("rep", "v"), "fp").where("u <> v").select("u", "v")
    candidates = key_links(classes, similarity).unionByName(tree_links(by_fp, radius)).unionByName(equal)
    return connected_components(confirmed(candidates, classes, docs, shingle, radius, similarity))


def grouped(docs: DataFrame, shingle: int, radius: int, similarity: float | None) -> DataFrame:
    """doc_id, text_hash, fp, component (a number of its own), least (the smallest doc_id of
    the component) for every row."""
    fps = stored(fingerprints(docs, shingle, similarity is not None), "fingerprints")
    own = ["fp"] if similarity is None else ["fp", "set_hash"]
    one = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    sketches = [] if similarity is None else [F.min_by(c, one).alias(c) for c in ("text_hash", "size", "code", "keys")]
    # classes are numbered once they are written: two texts with one doc_id are two classes
    classes = stored(fps.groupBy(*own).agg(F.min("doc_id").alias("doc_id"), *sketches).withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = near_classes(classes, radius) if similarity is None else alike_classes(classes, docs, shingle, radius, similarity)
    of = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*own, "doc_id", F.coalesce("component", "rep").alias("component"))
    of = of.join(of.groupBy("component").agg(F.min("doc_id").alias("least")), "component").drop("doc_id")
    return fps.select("doc_id", "text_hash", *own).join(of, own).select("doc_id", "text_hash", "fp", "component", "least")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest doc_id reachable.

    With a similarity, only texts whose shingle sets are equal or that similar link
    (of pairs at 0.8, 1 in 100,000 shares no key and is not found).
    A null or wordless text has fingerprint 0.  Rows with a null doc_id link
    with nothing and have a null component.  Rows with equal ids, equal rows among them, are
    grouped by their texts alone.  An empty table gives no rows; other columns of the input,
    whatever their names, are left out.
    """
    found = grouped(docs.where("doc_id IS NOT NULL"), shingle, radius, similarity).select("doc_id", "fp", F.col("least").alias("component_id"))
    nameless = fingerprints(docs.where("doc_id IS NULL"), shingle).select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(nameless)


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = RADIUS, similarity: float | None = 0.8) -> DataFrame:
    """One row of docs of each component, with all its columns, whatever their names: that of
    the smallest doc_id (rows without one last), then of the least hash of its text.

    Rows are told apart by id and text, so rows with one id stay unless their texts are near;
    of rows that share both, one stays, by a hash of the other columns.  Null and wordless
    texts are one component.  An empty table gives no rows.
    """
    per = grouped(docs, shingle, radius, similarity).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = per.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "n")).alias("kept"))
    kept = stored(kept.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"), F.col("kept.n").alias("copies")), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    wanted = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    alone = rows.join(kept.where("copies = 1"), wanted, "left_semi")
    hashable = [F.col("row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    several = rows.join(kept.where("copies > 1"), wanted, "left_semi").groupBy("id", "text_hash").agg(F.min_by("row", F.xxhash64(*hashable)).alias("row"))
    return alone.select("row.*").unionByName(several.select("row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
