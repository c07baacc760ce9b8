"""Repeated windows of documents: anchored runs, a count-min prefilter, and exact groups.

A window is L consecutive units (words or bytes) of one document. Its anchor is the k-gram in it with the least
hash, leftmost on ties; equal windows have equal anchors. The starts of a document fall into runs that share an
anchor, and a run with the L - 1 units behind its last start is a context. So an equal pair of windows lies either
in two equal contexts or in two different contexts of one anchor:

1. count_min(): each partition counts its anchors in a sketch of fixed size; merged, the sketches give an upper
   bound for the number of times that any window occurs (anchors are counted, not windows: the bound is the same
   for all windows of an anchor).
2. runs(): a second pass keeps the runs whose anchors may occur twice. None that does is lost.
3. contexts(): exact groups of equal contexts, pre-aggregated before the shuffle, so that thousands of copies
   become one row. Only where an anchor has several contexts, windows are looked at: a third pass fetches one
   occurrence of each such context with its content (mixed_runs), and whole anchors meet in shards.

Contexts are equal by the 128-bit BLAKE2b digest of their bytes (words: joined by one space), windows of a shard by
their bytes themselves. The hashes that choose anchors and places decide nothing.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import (
    U64, Rolling, checkpoint_dir, hashed_ranges, mix, raw, record_batches, releasing, slices, text_key, word_ranges,
)

#: Units worked on at once.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Kind:
    """What a window is made of."""

    words: bool
    window: int
    k: int


class Units:
    """Units of some documents: their values, which anchors are chosen by, and their bytes."""

    def __init__(self, values: np.ndarray, data: np.ndarray, at: np.ndarray | None):
        self.values, self.data, self.at = values, data, at

    def bytes_of(self, start: np.ndarray, end: np.ndarray):
        """Start and end of the bytes of ranges of units."""
        return (start, end) if self.at is None else (self.at[start], self.at[end])

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits of the bytes of each range, as two columns."""
        data = memoryview(self.data)
        ranges = zip(*(x.tolist() for x in self.bytes_of(start, end)))
        found = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in ranges])
        return np.frombuffer(found, np.int64).reshape(-1, 2)


def trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The same ranges of the part of the data that holds them."""
    a, b = (int(start[0]), int(end[-1])) if len(start) else (0, 0)
    return data[a:b], start - a, end - a


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The words, each with a space behind it, and the n + 1 places where they begin there."""
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.take(data, np.arange(at[-1]) + np.repeat(start - at[:-1], end - start + 1), mode="clip")
    out[at[1:] - 1] = 0x20
    return out, at


class Cutter:
    """Runs of the documents in Arrow batches of (doc_id, tk, text)."""

    def __init__(self, kind: Kind):
        self.kind = kind
        self.first = Rolling(2)

    def chunks(self, batch: pa.RecordBatch):
        """(row of each document, its Units, unit offsets, first unit's place in its document)."""
        for first, column in slices(batch.column(2).fill_null("")):
            for rows, units, offsets, skipped in self.parts(column):
                yield first + rows, units, offsets, skipped

    def parts(self, column: pa.Array):
        data, offsets = raw(column)
        words = None
        if self.kind.words:
            *words, offsets = word_ranges(data, offsets)
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
            a, b = int(offsets[lo]), int(offsets[hi])
            if hi == lo + 1 and b - a > 2 * CHUNK:  # a long document, in pieces that overlap by a window less one
                for at in range(a, b - self.kind.window + 1, CHUNK):
                    end = min(b, at + CHUNK + self.kind.window - 1)
                    yield self.part(np.array([lo]), words, data, np.array([at, end]), at - a)
            elif b - a >= self.kind.window:
                yield self.part(np.arange(lo, hi), words, data, offsets[lo : hi + 1], 0)
            lo = hi

    def part(self, rows, words, data, offsets, skipped):
        a, b = int(offsets[0]), int(offsets[-1])
        if words is None:
            units = Units(self.first.table[data[a:b]], np.ascontiguousarray(data[a:b]), None)
        else:
            start, end = (x[a:b] for x in words)
            units = Units(hashed_ranges(*trimmed(data, start, end)), *spelled(data, start, end))
        return rows, units, offsets - a, skipped

    def anchors(self, values, offsets):
        """Start and number of windows of each run, the document it is in, and its anchor's hash."""
        kind, n = self.kind, len(values)
        sums = self.first.sums(values)
        grams = self.first.windows(sums, kind.k)
        low = U64((1 << n.bit_length()) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=U64)
        width, span = kind.window - kind.k + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
        starts = np.flatnonzero(offsets[1:][docs] - np.arange(len(least)) >= kind.window)
        at = (least[starts] & low).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        n_windows = np.diff(new, append=len(starts))
        return starts[new], n_windows, docs[starts[new]], grams[at[new]]


class Sketch:
    """A count-min sketch with counters that stop at two: ROWS rows of 2**bits."""

    ROWS, BLOCK = 2, 1 << 18

    def __init__(self, bits: int):
        self.bits = bits
        self.block = min(self.BLOCK, 1 << bits)

    def places(self, hashes: np.ndarray):
        for row in range(self.ROWS):
            yield row, (mix(hashes ^ U64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> U64(64 - self.bits)).astype(np.int64)

    def counts(self, batches_of_hashes):
        """(row * blocks + block, packed "one or more", packed "two or more") for each block with a count. The counters are
        two bits each throughout: a byte each would take four times as much in every worker."""
        one, two = (np.zeros((self.ROWS, 1 << self.bits >> 3), np.uint8) for _ in range(2))
        for hashes in batches_of_hashes:
            for row, at in self.places(hashes):
                if not len(at):
                    continue
                at.sort()
                new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
                twice = np.diff(new, append=len(at)) > 1
                bit = np.uint8(128) >> (at[new] & 7).astype(np.uint8)
                byte = at[new] >> 3
                start = np.flatnonzero(np.diff(byte, prepend=-1) != 0)
                byte = byte[start]
                had = one[row, byte]
                now = np.bitwise_or.reduceat(bit, start)
                two[row, byte] |= had & now | np.bitwise_or.reduceat(np.where(twice, bit, np.uint8(0)), start)
                one[row, byte] = had | now
        one, two = (x.reshape(-1, self.block >> 3) for x in (one, two))
        for i in np.flatnonzero(one.any(axis=1)):
            yield int(i), zlib.compress(one[i].tobytes(), 1), zlib.compress(two[i].tobytes(), 1)

    @staticmethod
    def merged(rows):
        """The same rows, one for each block."""
        found: dict[int, list[np.ndarray]] = {}
        for i, one, two in rows:
            one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (one, two))
            if i in found:
                have = found[i]
                have[1] |= two | (have[0] & one)
                have[0] |= one
            else:
                found[i] = [one.copy(), two.copy()]
        for i, (one, two) in found.items():
            yield i, zlib.compress(one.tobytes(), 1), zlib.compress(two.tobytes(), 1)

    def repeated(self, rows) -> np.ndarray:
        """Packed bits of the counters at two, from merged rows."""
        bits = np.zeros((self.ROWS << self.bits) // self.block * (self.block // 8), np.uint8).reshape(-1, self.block // 8)
        for i, two in rows:
            bits[i] = np.frombuffer(zlib.decompress(two), np.uint8)
        return bits.reshape(self.ROWS, -1)

    def may_repeat(self, repeated: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row, at in self.places(hashes):
            out &= (repeated[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


BLOCKS = pa.schema([("block", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])
BLOCKS_SQL = "block int, one binary, two binary"


def block_batches(rows):
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS)], schema=BLOCKS)


#: A document among those with its doc_id: 31 bits of its text's hash. A place within it is t * 2**32 + start.
T_BITS = 0x7FFFFFFF


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().bitwiseAND(F.lit(T_BITS)).alias("t"), "text"
    )


def position():
    """Where a window or run starts, in the order of documents."""
    return F.struct("doc_id", "p")


def spans(start, end):
    """Columns doc_id, t, s, e of spans, from where p starts."""
    t = F.shiftright("p", 32)
    s = F.col("p").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.col("doc_id"), t.alias("t"), (s + start).cast("long").alias("s"), (s + end).cast("long").alias("e")


def count_min(docs: DataFrame, kind: Kind, sketch: Sketch) -> np.ndarray:
    """Which counters of the merged sketch reach two. Its size is fixed by sketch.bits, whatever the input."""

    def count(batches):
        cutter = Cutter(kind)

        def hashes():
            for batch in batches:
                for _, units, offsets, _ in cutter.chunks(batch):
                    yield cutter.anchors(units.values, offsets)[3]

        yield from block_batches(sketch.counts(hashes()))

    return sketch.repeated(merged_blocks(keyed(docs).mapInArrow(releasing(count), BLOCKS_SQL), sketch, "two"))


def merged_blocks(blocks: DataFrame, sketch: Sketch, which: str):
    def merge(batches):
        yield from block_batches(sketch.merged(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))))

    # In one job; an iterator takes one for each partition. At most one packed bit for each counter.
    found = blocks.repartition("block").mapInArrow(releasing(merge), BLOCKS_SQL).select("block", which).toArrow()
    for batch in found.to_batches():
        yield from zip(*(c.to_pylist() for c in batch.columns))


def bitmap(rows: DataFrame, sketch: Sketch, hashes) -> np.ndarray:
    """Which counters the hashes(batch) of all rows touch; for may_repeat()."""

    def count(batches):
        yield from block_batches(sketch.counts(hashes(b) for b in batches))

    return sketch.repeated(merged_blocks(rows.mapInArrow(releasing(count), BLOCKS_SQL), sketch, "one"))


RUNS = "anchor long, c1 long, c2 long, doc_id long, p long, n int"


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def ranges_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """A binary column of ranges of the bytes."""
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


def cut_runs(batches, cutter: Cutter, wanted):
    """The columns of RUNS for the wanted runs of a chunk, with what their contents are cut from."""
    for batch in batches:
        doc_ids, t = batch.column(0), batch.column(1).to_numpy()
        for rows, units, offsets, skipped in cutter.chunks(batch):
            start, n, doc, anchor = cutter.anchors(units.values, offsets)
            p = (t[rows[doc]] << 32) + start - offsets[doc] + skipped
            owners = doc_ids.take(pa.array(rows[doc]))
            keep = wanted(anchor, owners, p)
            if not len(keep):
                continue
            start, n = start[keep], n[keep]
            end = start + n + cutter.kind.window - 1
            digests = units.digests(start, end)
            columns = [
                pa.array(anchor[keep].view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                owners.take(pa.array(keep)), pa.array(p[keep]), pa.array(n.astype(np.int32)),
            ]
            yield columns, units, start, end


def runs(docs: DataFrame, kind: Kind, sketch: Sketch, repeated: np.ndarray) -> DataFrame:
    """The runs whose anchors may occur twice: anchor, c1 and c2 (the context's digest), doc_id, p, n windows."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(repeated), schema_of(RUNS)

    def cut(batches):
        wanted = lambda anchor, *_: np.flatnonzero(sketch.may_repeat(shared.value, anchor))
        for columns, *_ in cut_runs(batches, Cutter(kind), wanted):
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return keyed(docs).mapInArrow(releasing(cut), RUNS)


class Scratch:
    """Tables in the shared folder, for what is read more than once: executors may be lost. They go when the
    operator no longer needs them."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/graphloom-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for x in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(x))[0])
            path.getFileSystem(conf).delete(path, True)

    def clear(self, *kept: DataFrame) -> None:
        """Drops all but the given tables."""
        self.drop(*(x for _, x in list(self.paths.values()) if all(x is not k for k in kept)))

    def free(self) -> None:
        """Lets Spark remove the shuffle files of plans that are out of use."""
        gc.collect()
        self.spark._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    return Scratch(df.sparkSession).write(df)


def contexts(found: DataFrame) -> DataFrame:
    """Of runs(): anchor, c1, c2, the first place where the context occurs, and whether it occurs at others."""
    place = position()
    out = found.groupBy("anchor", "c1", "c2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return out.select("anchor", "c1", "c2", "first", (~F.col("first").eqNullSafe(F.col("last"))).alias("again"))


def occurrence_hash(anchor: np.ndarray, doc_id: pa.Array, p: np.ndarray) -> np.ndarray:
    return mix(mix(anchor.view(U64) ^ doc_id.fill_null(-1).to_numpy(zero_copy_only=False).view(U64)) + p.view(U64))


MIXED = RUNS + ", content binary, many boolean"


def mixed_runs(docs: DataFrame, kind: Kind, known: DataFrame, bits: int, many: int) -> DataFrame:
    """Of each context whose anchor has several, the first occurrence, as in runs(), with its content (bytes;
    words have a space behind each) and whether the anchor has more than `many` contexts, which is decided
    exactly, so that all rows of an anchor go one way. Other occurrences may come with them, as the places are looked
    up in a bitmap of fixed size."""
    several = known.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    firsts = known.join(several, "anchor").select("anchor", F.col("first.doc_id").alias("doc_id"), F.col("first.p").alias("p"))
    present = Sketch(bits)
    hashes = lambda b: occurrence_hash(b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy())
    # One in `many` of the contexts at most.
    large = np.sort(several.where(F.col("n") > many).select("anchor").toArrow()["anchor"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(firsts, present, hashes), large))
    schema = schema_of(MIXED)

    def cut(batches):
        cutter = Cutter(kind)
        wanted = lambda anchor, owners, p: np.flatnonzero(
            present.may_repeat(shared.value[0], occurrence_hash(anchor, owners, p))
        )
        for columns, units, start, end in cut_runs(batches, cutter, wanted):
            start, end = units.bytes_of(start, end)
            content = ranges_of(units.data, start, end - start)
            of_large = np.isin(columns[0].to_numpy(), shared.value[1])
            yield pa.RecordBatch.from_arrays([*columns, content, pa.array(of_large)], schema=schema)

    return keyed(docs).mapInArrow(releasing(cut), MIXED)


SPANS = "doc_id long, t long, s long, e long"


#: Bytes of contents, about, that are narrowed at once: their hashes take some eighty times as much.
PART = 1 << 20


def in_shards(mixed: DataFrame, spans_of, shard: int, window: int, narrow=None) -> DataFrame:
    """Spans from spans_of(doc_id, p, contents) -> starts of windows by content, over shards of whole anchors.
    narrow(rows) may leave out first, of whole anchors, what no window shares; a shard's size is what it leaves."""
    schema = schema_of(SPANS)

    def run(batches):
        def of(rows):
            doc_id, p, anchor, contents = zip(*rows)
            for i, at in enumerate(spans_of(doc_id, p, anchor, contents)):
                if len(at):
                    new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                    last, start = np.append(new[1:], len(at)) - 1, p[i] & 0xFFFFFFFF
                    for s, e in zip(at[new].tolist(), at[last].tolist()):
                        yield doc_id[i], p[i] >> 32, start + s, start + e + window

        def parts(most):
            rows, size, anchor, known = [], 0, None, None
            for batch in batches:
                for a, c1, c2, doc_id, p, content in zip(*(c.to_pylist() for c in batch.columns)):
                    if a != anchor and size >= most:
                        yield rows
                        rows, size = [], 0
                    if (a, c1, c2) != known:  # the first occurrence stands for a context
                        rows.append((doc_id, p, a, content))
                        size += len(content)
                    anchor, known = a, (a, c1, c2)
            if rows:
                yield rows

        def narrowed():
            rows, size = [], 0
            for part in parts(min(PART, shard)):
                part = narrow(part)
                rows += part
                size += sum(len(r[3]) for r in part)
                if size >= shard:
                    yield rows
                    rows, size = [], 0
            if rows:
                yield rows

        def found():
            for rows in narrowed() if narrow else parts(shard):
                yield from of(rows)

        yield from record_batches(found(), schema, 20_000)

    by_anchor = mixed.select("anchor", "c1", "c2", "doc_id", "p", "content").repartition("anchor")
    return by_anchor.sortWithinPartitions("anchor", "c1", "c2", "doc_id", "p").mapInArrow(releasing(run), SPANS)


def window_rows(mixed: DataFrame, window: int, words: bool) -> DataFrame:
    """(w1, w2, doc_id, p): the digest and place of each window of the contents, for anchors of any number of contexts."""

    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0)
            for i, (p, content) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                data = np.frombuffer(content, np.uint8)
                at = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1]) if words else None
                start = np.arange((len(data) if at is None else len(at) - 1) - window + 1)
                digests = Units(data, data, at).digests(start, start + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[:, 0]), pa.array(digests[:, 1]), doc_ids.take(pa.array(np.full(len(start), i))), pa.array(start + p)],
                    ["w1", "w2", "doc_id", "p"],
                )

    return mixed.select("doc_id", "p", "content").mapInArrow(releasing(run), "w1 long, w2 long, doc_id long, p long")


def removals(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the sorted spans of each document: array of (s, e), null for none."""
    by_doc = spans.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "spans")
    docs = keyed(docs)
    return docs.join(by_doc, docs["doc_id"].eqNullSafe(by_doc["d"]) & (docs["t"] == by_doc["u"]), "left").select(
        "doc_id", "text", "spans"
    )


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for span in spans or ():
        s, e = span["s"], span["e"]
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]

