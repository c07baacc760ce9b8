"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact similarity."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NO_ALNUM, U64, chained, mix, raw, record_batches, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, its blocks, and the errors within which a block counts as near. A fingerprint within
#: RADIUS of an item's has a near block: with more errors in every block there would be BLOCKS * (NEAR + 1).
#: Windows and items of one length at similarity 0.8 agree in 8/9 of their votes or more, so that a bit differs with
#: probability arccos(8/9)/pi = 0.151 at most: 19.4 of 128 bits, with a deviation of 4.1. RADIUS is 4.8 of these away.
WORDS, BLOCKS, NEAR = 2, 4, 9
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Benchmark items in an index; more are taken in further passes over the documents.
ITEMS = 20_000
CHUNK, STARTS = 1 << 20, 2048


class Words:
    """Words of lower-cased texts (runs of letters and digits) and their shingles, as hashes."""

    def of(self, column: pa.Array):
        data, offsets = raw(pc.utf8_lower(column.fill_null("")))
        return word_hashes(data, offsets, NO_ALNUM)

    def shingles(self, words: np.ndarray, size: int) -> np.ndarray:
        return chained(words, np.arange(max(0, len(words) - size + 1)), size)


def votes(shingles: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit. The turn-th occurrence of a shingle in a window votes for itself: windows then agree in
    their votes as they do in their counts, and no shingle outvotes others by being repeated."""
    own = mix(shingles + turns.astype(U64) * U64(0x9E3779B97F4A7C15))
    words = np.stack([mix(own ^ U64(0xA5A5 + i)) for i in range(WORDS)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def occurrences(shingles: np.ndarray):
    """For each place how often its shingle occurs before it, and a function that tells how often it occurs before
    another place of each."""
    _, name = np.unique(shingles, return_inverse=True)
    n = len(shingles)
    key = np.sort(name.astype(np.int64) * (n + 1) + np.arange(n))
    first = np.searchsorted(key, name.astype(np.int64) * (n + 1))
    before = lambda at, place: np.searchsorted(key, name[at].astype(np.int64) * (n + 1) + place) - first[at]
    return before(np.arange(n), np.arange(n)), before


def prints(shingles: np.ndarray, n: int, first: int, last: int) -> np.ndarray:
    """Fingerprints (as BLOCKS 32-bit numbers) of the windows of n shingles that start at first to last, each from
    the one before: the last occurrence of what leaves goes, and what comes in votes as one more."""
    own = shingles[first : last + n]
    so_far, before = occurrences(own)
    sums = np.empty((last - first + 1, 64 * WORDS), np.int32)
    sums[0] = votes(own[:n], so_far[:n]).sum(axis=0, dtype=np.int32)
    if last > first:
        out = np.arange(last - first)
        change = votes(own[out + n], so_far[out + n] - before(out + n, out + 1)).astype(np.int32)
        change -= votes(own[out], before(out, out + n) - so_far[out] - 1)
        sums[1:] = sums[0] + np.cumsum(change, axis=0)
    return np.packbits(sums > 0, axis=1).view(np.uint32)


class Index:
    """The items of a benchmark by length: their shingles, fingerprints and fingerprint blocks."""

    def __init__(self, items: list[tuple[int | None, str]]):
        words = Words()
        hashes, at = words.of(pa.array([t for _, t in items], pa.string()))
        rows = []
        for (item_id, _), a, b in zip(items, at[:-1].tolist(), at[1:].tolist()):
            if b > a:
                size = min(SHINGLE, b - a)
                rows.append((item_id, b - a, size, words.shingles(hashes[a:b], size)))
        self.ids = [r[0] for r in rows]
        self.lengths = np.array([r[1] for r in rows], np.int64)
        self.sizes = np.array([r[2] for r in rows], np.int64)
        self.counts = [Counter(r[3].tolist()) for r in rows]
        #: By length: the items, and each block of their fingerprints as a posting of its own.
        self.postings = {}
        for length in sorted(set(self.lengths.tolist())):
            own = np.flatnonzero(self.lengths == length)
            found = np.vstack([prints(rows[i][3], len(rows[i][3]), 0, 0) for i in own])
            self.postings[length] = own, np.ascontiguousarray(found.T)
        self.by_size = {}
        for size in sorted(set(self.sizes.tolist())):
            own = [i for i in range(len(rows)) if self.sizes[i] == size]
            pairs = sorted({(s, i) for i in own for s in self.counts[i]})
            shingles = np.array([s for s, _ in pairs], U64)
            seen = np.zeros(1 << 20, bool)
            seen[(shingles & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_size[size] = shingles, np.array([i for _, i in pairs]), seen

    def near(self, found: np.ndarray, length: int):
        """(fingerprint, item) of all items of that length within RADIUS, by way of the blocks."""
        own, blocks = self.postings[length]
        at, item = np.nonzero(np.logical_or.reduce([np.bitwise_count(found[:, b, None] ^ blocks[b]) <= NEAR for b in range(BLOCKS)]))
        distance = sum(np.bitwise_count(found[at, b] ^ blocks[b][item]).astype(np.int64) for b in range(BLOCKS))
        close = distance <= RADIUS
        return at[close], own[item[close]]


def hits(index: Index, size: int, shingles: np.ndarray) -> np.ndarray:
    known, _, seen = index.by_size[size]
    maybe = np.flatnonzero(seen[(shingles & U64((1 << 20) - 1)).astype(np.int64)])
    at = np.searchsorted(known, shingles[maybe])
    at[at == len(known)] = 0
    return maybe[known[at] == shingles[maybe]]


def stretches(starts: np.ndarray):
    """First and last of each stretch of consecutive starts, of STARTS at most."""
    cuts = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(starts)).tolist()):
        for x in range(a, b, STARTS):
            yield int(starts[x]), int(starts[min(x + STARTS, b) - 1])


def weighted_jaccard(counts: Counter, theirs: Counter) -> float:
    both = sum(min(c, theirs[s]) for s, c in counts.items() if s in theirs)
    return both / (counts.total() + theirs.total() - both)


def matches(index: Index, words: Words, own: np.ndarray, similarity: float):
    """(item, similarity, start, length) of the best window of a document for each item that has one.

    Only windows with a shingle of an item can be similar to it, so fingerprints are taken of windows of that item's
    length over its shingles, a limited number at a time; the blocks then give all items of the length within the
    radius, and the weighted Jaccard similarity of shingle counts decides.
    """
    best: dict[int, tuple[float, int, int]] = {}
    for size in index.by_size:
        if len(own) < size:
            continue
        shingles = words.shingles(own, size)
        hit = hits(index, size, shingles)
        if not len(hit):
            continue
        known, item_of, _ = index.by_size[size]
        lo, hi = np.searchsorted(known, shingles[hit]), np.searchsorted(known, shingles[hit], "right")
        places = np.repeat(hit, hi - lo)
        lengths = index.lengths[item_of[np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist())])]]
        for length in np.unique(lengths).tolist():
            at = places[lengths == length]
            n = min(length, len(own)) - size + 1  # shingles in a window
            last = len(shingles) - n
            starts = np.zeros(last + 2, np.int64)  # marks the window starts that cover a hit
            np.add.at(starts, np.maximum(at - n + 1, 0), 1)
            np.add.at(starts, np.minimum(at, last) + 1, -1)
            for a, b in stretches(np.flatnonzero(np.cumsum(starts)[: last + 1] > 0)):
                for w, i in zip(*(x.tolist() for x in index.near(prints(shingles, n, a, b), length))):
                    if index.sizes[i] != size:
                        continue
                    found = weighted_jaccard(Counter(shingles[a + w : a + w + n].tolist()), index.counts[i])
                    if found >= similarity - 1e-12 and found > best.get(i, (0.0, 0, 0))[0]:
                        best[i] = found, a + w, n + size - 1
    return [(index.ids[i], *x) for i, x in best.items()]


def documents_of(words: Words, column: pa.Array):
    """(row, word hashes) of each document, a limited number of bytes at a time."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column.fill_null("")).to_numpy())])
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + CHUNK, "right")) - 1)
        hashes, at = words.of(column.slice(lo, hi - lo))
        for i in range(hi - lo):
            yield lo + i, hashes[at[i] : at[i + 1]]
        lo = hi


def indexes(benchmark: DataFrame, most: int = ITEMS):
    """Broadcast indexes of at most `most` items each."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-rows.count() // most)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for b in range(blocks):
        own = rows.where(block == b).collect() if blocks > 1 else rows.collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(sorted(((r.item_id, r.text) for r in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))))


ROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("length", pa.int64())]
)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document and benchmark item whose text it holds: doc_id, item_id, similarity, and the best window's start
    and length in words.

    Words are lower-case runs of letters and digits. A window has as many words as the item (a shorter document is
    one window); similarity is the weighted Jaccard similarity of the counts of five-word shingles, 0.8 or more.
    Items of fewer words are one shingle. An item without an id is one like others; its matches have a null item_id. Null or empty texts and items hold nothing. Repeated rows of docs give
    repeated results; of equal windows the first is given. An empty table on either side gives an empty table; other
    columns are not read. The benchmark is broadcast in indexes of at most ITEMS items, with a pass for each.
    """
    out = None
    for shared in indexes(benchmark):

        def run(batches, shared=shared):
            words = Words()

            def rows():
                for batch in batches:
                    ids = batch.column(0).to_pylist()
                    for i, own in documents_of(words, batch.column(1)):
                        for item, found, start, length in matches(shared.value, words, own, similarity):
                            yield ids[i], item, found, start, length

            yield from record_batches(rows(), ROW)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            run, "doc_id long, item_id long, similarity double, start long, length long"
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start long, length long")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    at = docs.columns.index("text")
    for shared in indexes(benchmark):

        def run(batches, shared=shared):
            words = Words()
            for batch in batches:
                clean = [not matches(shared.value, words, own, similarity) for _, own in documents_of(words, batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
