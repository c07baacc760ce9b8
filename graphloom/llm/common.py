"""What the corpus operators share: reading inputs, checkpoints, Arrow batches and rolling hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def release() -> None:
    """Gives memory that is free back to the system; allocators keep it otherwise, and workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def releasing(run):
    """run(batches) for mapInArrow, with release() once it has ended."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return released


def release_executors(spark: SparkSession) -> None:
    """Has executors collect their heaps in full, which gives what is then free back to the system: a heap that one
    operator filled stays at that size otherwise, beside the workers of the next. One short task for each core, so
    that every executor that is idle gets one; where explicit collections are disabled, nothing happens."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset and Spark is local (tests), a
    local one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    return named or os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")


def text_key():
    """With doc_id this identifies a document where doc_ids repeat; equal rows are one document."""
    return F.xxhash64("text")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its n + 1 offsets."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


#: Bytes of text, about, whose words are found at once: their places take some twenty times as much.
SLICE = 1 << 21


def slices(column: pa.Array, size: int | None = None):
    """(first row, rows) of parts of a string column without nulls, of `size` bytes each or one longer text."""
    ends, first = raw(column)[1], 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + (size or SLICE), "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of all ranges of a sequence of 64-bit values, from prefix sums. Sequences can be
    made that collide, so these only choose places and groups; nothing is held to be equal by them."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=U64, endpoint=False)
        self.base = int(rng.integers(0, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k consecutive values, by start."""
        n = len(sums) - k
        return mix((sums[k:] - sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


#: Bytes that end a word in [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside ASCII letters and digits and outside multi-byte characters.
NO_ALNUM = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def hashed_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes. Eight bytes at a time go through a bijection, which is no sum of terms: no
    two ranges that differ in one place only collide, nor do those that break polynomials modulo 2**64."""
    length = end - start
    out = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    if not len(length):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live, done = np.flatnonzero((length > 0) & (length <= LONG_WORD)), 0
    while len(live):
        rest = length[live] - done
        value = eights[start[live] + done]
        few = rest < 8
        value[few] &= (U64(1) << (U64(8) * rest[few].astype(U64))) - U64(1)
        out[live] = mix(out[live] ^ mix(value + U64(0xD1B54A32D192ED03)))
        live, done = live[rest > 8], done + 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def chained(values: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of `length` consecutive values from each start, each through a bijection of the one before."""
    out = np.full(len(start), 0x9E3779B97F4A7C15 * length % 2**64, U64)
    for i in range(length):
        out = mix(out * U64(0xD1342543DE82EF95) + values[start + i])
    return out


def word_ranges(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Start and end of each word, and the n + 1 offsets of each document's words."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)  # where a word can't go on
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    del first
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Hash of each word, and the n + 1 offsets of each document's words."""
    starts, ends, at = word_ranges(data, offsets, gap)
    return hashed_ranges(data, starts, ends), at


def record_batches(rows, schema: pa.Schema, most: int = 2000, size=None, most_size: int = 1 << 23):
    """Record batches of tuples; size(row) bounds a batch besides the number of rows."""
    held, held_size = [], 0

    def batch():
        columns = zip(*held) if held else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        held.append(row)
        held_size += size(row) if size else 0
        if len(held) >= most or held_size >= most_size:
            yield batch()
            held, held_size = [], 0
    if held:
        yield batch()
