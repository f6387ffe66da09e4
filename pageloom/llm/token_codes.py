"""Token ids in directly addressable codes (operator 1).

Every id is split into chunks of eight bits, lowest first.  Level k holds the
k-th chunk of all ids that have one, a bitmap says which of them go on to the
next level, and a rank directory (32-bit counts per 512 bits, 16-bit counts per
64 bits) tells in constant time where: any token, or any run of tokens, is read
without decoding what stands before it.

File format: a folder of Parquet files in ascending doc_id order.  A row is a
segment of whole documents: part, segment, n_tokens, doc_ids, lengths, codes.
`codes` is MAGIC, the number of ids and of levels, and per level its length and
bytes, bitmap, and both directories.  The files have no block compression, so a token
is read from the bytes as they lie on disk.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_numbers, table, work_dir
from .tokens import encoder, vocabulary

MAGIC = b"DAC1"
SEGMENT_TOKENS = 1 << 20
SEGMENTS = "part int, segment int, n_tokens long, doc_ids array<string>, lengths array<int>, codes binary"


def encode_codes(ids: np.ndarray) -> bytes:
    """The codes of unsigned ids below 2**32."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        words = np.bitwise_count(bits.view("<u8")).astype(np.int64).reshape(-1, 8)
        before = np.cumsum(words, axis=1) - words
        blocks = np.concatenate([[0], np.cumsum(words.sum(axis=1))])[:-1] if len(words) else np.zeros(0)
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), blocks.astype("<u4").tobytes(), before.astype("<u2").tobytes()))
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<QI", len(ids), len(levels))
    return head + b"".join(struct.pack("<Q", n) + a + b + c + d for n, a, b, c, d in levels)


class Codes:
    """Read access to encoded ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a code segment")
        self.n, levels = struct.unpack_from("<QI", data, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            blocks = -(-n // 512)
            parts = []
            for dtype, count in ((np.uint8, n), (np.uint8, blocks * 64), ("<u4", blocks), ("<u2", blocks * 8)):
                parts.append(np.frombuffer(data, dtype, count, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def _rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits of a level are set."""
        chunks, bits, blocks, words = self.levels[level]
        if not len(blocks):
            return np.zeros_like(i)
        at = np.minimum(i, len(chunks) - 1) if len(chunks) else i
        word = at >> 6
        keep = np.where(i - (word << 6) >= 64, np.uint64(2**64 - 1), (np.uint64(1) << ((i - (word << 6)) & 63).astype(np.uint64)) - np.uint64(1))
        return blocks[at >> 9].astype(np.int64) + words[word] + np.bitwise_count(bits.view("<u8")[word] & keep)

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the segment")
        out, on, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for level, (chunks, bits, _, _) in enumerate(self.levels):
            if not len(at):
                break
            out[on] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            on, at, shift = on[more], self._rank(level, at[more]), shift + 8
        return out

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop: one contiguous piece of every level."""
        out, on, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for level, (chunks, bits, _, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[on] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start] == 1
            on, shift = on[more], shift + 8
            start, stop = (int(x) for x in self._rank(level, np.array([start, stop])))
        return out


def checksums(codes: Codes, stops: np.ndarray) -> list[int]:
    """The CRC-32 of the ids of each document, which end at stops, read in long runs."""
    out, at, low, high, ids = [], 0, 0, 0, memoryview(b"")
    for stop in stops.tolist():
        crc = 0
        while at < stop:
            if at == high:
                low, high = at, min(codes.n, at + SEGMENT_TOKENS)
                ids = memoryview(codes.run(low, high).astype("<u4", copy=False)).cast("B")
            end = min(stop, high)
            crc, at = zlib.crc32(ids[4 * (at - low) : 4 * (end - low)], crc), end
        out.append(crc)
    return out


def write_codes(docs: DataFrame, path: str, vocab: str, cut: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes (doc_id, text) and writes the segments to path.

    Documents are dealt out by ranges of doc_id as text, which is smaller than
    ids; a null text is empty, a null doc_id comes first, equal doc_ids stand
    side by side in the order of a hash of their text, which also lets many rows
    of one doc_id fill more than one partition.  A segment ends with the document that fills it.
    """

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, number = encoder(vocab, cut), TaskContext.get().partitionId(), 0
        ids, lengths, parts, size, end = [], [], [], 0, np.array([end_id], "<u4").tobytes()

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "segment": [number], "n_tokens": [size], "doc_ids": [ids], "lengths": [lengths], "codes": [encode_codes(np.frombuffer(b"".join(parts), "<u4"))]})

        for b in batches:
            for lo in range(0, len(b), 256):
                some = b.iloc[lo : lo + 256]
                for doc_id, coded in zip(some["doc_id"], encode([t if isinstance(t, str) else "" for t in some["text"]]), strict=True):
                    n = len(coded) // 4 + 1
                    ids.append(doc_id if isinstance(doc_id, str) else None)
                    lengths.append(n)
                    parts += [coded, end]
                    size += n
                    if size >= segment_tokens:
                        yield row()
                        ids, lengths, parts, size, number = [], [], [], 0, number + 1
        if ids:
            yield row()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ordered.mapInPandas(segments, SEGMENTS).write.option("compression", "none").parquet(path)


def directory(files: DataFrame) -> DataFrame:
    """part, segment, first (ids before it), n_tokens: a row for each segment."""
    sizes = files.select("part", "segment", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written partition
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return sizes.join(base, "part").select("part", "segment", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("first"), "n_tokens")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, token_id for the distinct `position`s, counted over the whole folder; null
    positions and those outside it give no row.  The directory names the segment of each;
    only those segments are read, and in them only the bytes of the positions' codes."""
    cell = F.lit(SEGMENT_TOKENS)
    spans = directory(spark.read.schema(SEGMENTS).parquet(path)).withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("n_tokens") - 1) / cell))))
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("cell", F.floor(F.col("position") / cell))
    found = asked.join(spans, "cell").where("first <= position AND position < first + n_tokens").select("part", "segment", "position", (F.col("position") - F.col("first")).alias("inside"))

    def taken(rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        ids = Codes(segment["codes"][0]).take(rows["inside"].to_numpy(np.int64)) if len(rows) else []
        return pd.DataFrame({"position": rows["position"], "token_id": np.array(ids, np.int64)})

    wanted = found.select(F.col("part").alias("p"), F.col("segment").alias("s")).distinct()
    codes = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "codes").join(wanted, F.expr("part = p AND segment = s"), "left_semi")
    return found.groupBy("part", "segment").cogroup(codes.groupBy("part", "segment")).applyInPandas(taken, "position long, token_id long")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and its first and last id, taken at
    their positions; all from the files.  Repeated rows as often as they were written, a
    null doc_id as null.  Files of an empty table give no rows."""
    files = spark.read.schema(SEGMENTS).parquet(path)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, segment, ids, lengths, data in zip(b["part"], b["segment"], b["doc_ids"], b["lengths"], b["codes"], strict=True):
                codes, stops = Codes(data), np.cumsum(lengths)
                starts = stops - lengths
                yield pd.DataFrame({"part": part, "segment": segment, "doc_id": pd.array(id_numbers(ids), "Int64"), "inside": starts, "n_tokens": lengths, "ids_crc32": checksums(codes, stops), "first_id": codes.take(starts).astype(np.int64), "last_id": codes.take(stops - 1).astype(np.int64)})

    first = directory(files).drop("n_tokens")
    rows = files.mapInPandas(documents, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long, first_id long, last_id long")
    return rows.join(first, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "first_id", "last_id")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "codes")
    write_codes(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), "word", 2)
    return read_codes(spark, path)
