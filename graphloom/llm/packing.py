"""Packing of token pieces into sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import releasing
from graphloom.llm.pretokens import PreTokens

#: Documents in a group, on average.
GROUP = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class Bins:
    """Bins of one capacity under a tournament tree: each inner node holds the largest room below it, so that the
    first bin with enough room is found from the root."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        offset = self.capacity - room[i]
        leaf = i - self.leaves
        room[i] -= length
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return leaf, offset


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each length; lengths come in falling order and fit a bin."""
    bins = Bins(capacity, len(lengths))
    return [bins.put(n) for n in lengths]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Cuts each document's ids, with end_id behind them, into full pieces of `capacity` and a rest."""
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        pre = PreTokens.at(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), pre.id_bytes(batch.column(1).to_pylist())):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECES.replace(" long", "").split(", "))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents fall into groups of about `group` by a hash, whatever their source or key, and each group is packed
    by itself: longest piece first, each into the first sequence with room. A group holds numbers only, no ids, and
    its size doesn't grow with the input. A document is cut only where it exceeds a sequence.

    A null or empty text is the end id alone. Each of repeated rows is packed (rows of one doc_id can be told apart
    by what they hold only). Ties in length go by doc_id (null first), start and checksum. An empty table gives an
    empty table; other columns are not read.
    """
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, tokenizer, capacity, end_id)

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first"
        )
        at = first_fit_decreasing(rows["length"].tolist(), capacity)
        rows["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in at]
        rows["offset"] = [o for _, o in at]
        return rows.drop(columns="grp")

    # The group of a document: its pieces stay together, a long document's too.
    keyed = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "doc_tokens", F.lit(7)), F.lit(groups)))
    return keyed.groupBy("grp").applyInPandas(fill, PACKED)
