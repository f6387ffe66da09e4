"""Packing token sequences by first-fit decreasing (operator 8).

A document's ids, with the end id, are cut into pieces of at most `length`;
every piece but a document's last fills a sequence of its own.  The last pieces
go, group by group, into the first open sequence that has room, longest first.
A tournament tree over the room of all sequences of the group finds that
sequence in logarithmic time.  Groups are random and of bounded size, so no
order or key of the input can fill one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_numbers, importable, stored, table
from .tokens import encoder, vocabulary

LENGTH = 2048
GROUP_DOCS = 8192
PIECES = "salt long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Room of up to n bins; the first with enough room is found from the top."""

    def __init__(self, n: int, length: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [length] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Index of the first bin with room for size, and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] -= size
        bin_no = at - self.leaves
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
        return bin_no, had


def first_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, placed longest first, ties in the given order."""
    tree, out = RoomTree(len(sizes), length), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_no, had = tree.place(sizes[i])
        out[i] = (bin_no, length - had)
    return out


def cut_pieces(docs: DataFrame, vocab: str, cut: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document; a null text is empty."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, seen = encoder(vocab, cut), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for lo in range(0, len(b), 256):
                some = b.iloc[lo : lo + 256]
                for doc_id, coded in zip(id_numbers(some["doc_id"]), encode([t if isinstance(t, str) else "" for t in some["text"]]), strict=True):
                    coded += end
                    n, seen = len(coded) // 4, seen + 1
                    for start in range(0, n, length):
                        piece = coded[4 * start : 4 * (start + length)]
                        rows.append((seen, doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            columns = dict(zip(("salt", "doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows, strict=True), strict=True)) if rows else {}
            if columns:
                yield pd.DataFrame(columns | {"doc_id": pd.array(list(columns["doc_id"]), "Int64")})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(pieces, PIECES)


def pack(docs: DataFrame, vocab: str, cut: str, end_id: int, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Columns PACKED, a row for each piece.

    Null texts and empty texts are one end id.  Repeated rows are packed as
    often as they occur: groups are dealt by a hash of the document's place in
    its partition, so equal ids do not meet in one group; the pieces are written with
    that number once, so a task that runs again reads the same ones.  An empty table
    gives no rows; other columns, whatever their names, are left out.
    """
    importable(docs.sparkSession)
    pieces = stored(cut_pieces(docs, vocab, cut, end_id, length), "pieces")
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("salt"), F.lit(groups))).withColumn("text_id", F.col("doc_id").cast("string")).drop("doc_id")

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text_id", "start", "salt"], kind="stable", na_position="first").reset_index(drop=True)
        at = first_fit_decreasing(rows["length"].tolist(), length)
        rows["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in at]
        rows["offset"] = [o for _, o in at]
        rows["doc_id"] = pd.array(id_numbers(rows["text_id"]), "Int64")
        return rows[[c.split()[0] for c in PACKED.split(", ")]]

    return grouped.groupBy("group").applyInPandas(packed, PACKED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "byte", 1)
