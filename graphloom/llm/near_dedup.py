"""Near-duplicates with ProbMinHash over sets of word shingles, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, chained, mix, raw, releasing, slices, word_hashes
from graphloom.llm.components import components, few, frequent, held, spread
from graphloom.llm.pretokens import forget
from graphloom.llm.repeats import Scratch, Sketch, bitmap

#: Words in a shingle, least Jaccard similarity, bands, registers in a band: each shingle of a text has weight 1, so
#: that registers agree with the probability of the very similarity that decides, and a pair at the least one shares a
#: band with probability 1 - (1 - 0.8**4)**24 > 0.99999.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
#: Most texts in a bucket whose classes are all compared, text by text; larger ones are joined by rare shingles.
FEW = 64
#: Counters of shingles that rank them by how rare they are.
RANKS = 1 << 18
#: Texts of a class, about, that others are compared with first.
TURN = 32
CHUNK_DOCS, CHUNK_WORDS = 2048, 1 << 18
#: Bytes of text, about, whose words are hashed at once: their places take some twenty times as much.
CHUNK_BYTES = 1 << 21
GOLDEN = 0x9E3779B97F4A7C15


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs x m): two documents agree in a register with the probability of their
    probability Jaccard similarity.

    Each element arrives in a Poisson process of its weight's rate, each arrival at a random register; a register
    keeps the element that arrives first. An element ends once it arrives later than every register's first.
    """
    first = np.full(n_docs * m, np.inf)
    kept = np.zeros(n_docs * m, U64)
    time, turn = np.zeros(len(element)), 0
    while len(element):
        turn += 1
        random = mix(element + U64(turn * GOLDEN % 2**64))
        time = time - np.log(uniform(random)) / weight
        at = doc * m + (mix(random ^ U64(GOLDEN)) % U64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        kept[at[won]] = element[won]
        live = time < first.reshape(n_docs, m).max(axis=1)[doc]
        doc, element, weight, time = doc[live], element[live], weight[live], time[live]
    return kept.reshape(n_docs, m)


class Shingler:
    """Shingles of the documents in Arrow batches."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def chunks(self, column: pa.Array):
        """(first row, number of documents, document of each shingle, shingle), sorted, each shingle as often as it
        occurs. A document of fewer words has one shingle, of all its words."""
        for first, part in slices(column.fill_null(""), CHUNK_BYTES):
            for lo, n, doc, shingle in self.parts(part):
                yield first + lo, n, doc, shingle

    def parts(self, column: pa.Array):
        words, offsets = word_hashes(*raw(column))
        lo, n = 0, len(column)
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_WORDS, "right")) - 1
            hi = max(lo + 1, min(hi, lo + CHUNK_DOCS, n))
            own, at = words[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            length = np.diff(at)
            doc = np.repeat(np.arange(hi - lo), length)
            start = np.flatnonzero(at[1:][doc] - np.arange(len(own)) >= self.size)
            found, docs = [chained(own, start, self.size)], [doc[start]]
            for n_words in range(1, self.size):
                docs.append(np.flatnonzero(length == n_words))
                found.append(chained(own, at[:-1][docs[-1]], n_words))
            doc, shingle = np.concatenate(docs), np.concatenate(found)
            order = np.lexsort((shingle, doc))
            yield lo, hi - lo, doc[order], shingle[order]
            lo = hi

    def weighted(self, column: pa.Array):
        """The same with each shingle of a document once, and how often it occurs."""
        for lo, n, doc, shingle in self.chunks(column):
            new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(shingle, prepend=U64(0)) != 0))
            yield lo, n, doc[new], shingle[new], np.diff(new, append=len(doc))


def text_id():
    """128 bits of a text: copies share it. A null text is empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def bands(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(h, keys) per document with words: the keys of the buckets it falls into."""

    def run(batches):
        forget()
        shingler = Shingler()
        for batch in batches:
            for lo, n, doc, shingle, _ in shingler.weighted(batch.column(1)):
                signature = prob_min_hash(doc, shingle, np.ones(len(doc)), n, n_bands * rows)
                keys = np.zeros((n, n_bands), U64)
                for r in range(rows):
                    keys = mix(keys * U64(GOLDEN) + signature[:, r::rows])
                keys = mix(keys ^ mix(np.arange(n_bands, dtype=U64) + U64(1)))
                some = np.unique(doc)
                values = pa.array(keys[some].reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n_bands), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + some)), lists], ["h", "keys"])

    return docs.select(text_id().alias("h"), "text").mapInArrow(releasing(run), "h binary, keys array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """(h, shingles): the set of each text's shingles, of those docs whose h may be in ids(h): a bitmap of fixed size spares
    the shuffle of others."""
    sketch = Sketch(bits)

    def prefix(column):
        data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)
        return data[:, :8].copy().view(U64)[:, 0] if len(data) else np.zeros(0, U64)

    present = bitmap(ids.select("h"), sketch, lambda batch: prefix(batch.column(0)))
    shared = docs.sparkSession.sparkContext.broadcast(present)

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            batch = batch.filter(pa.array(sketch.may_repeat(shared.value, prefix(batch.column(0)))))
            for lo, n, doc, shingle, _ in shingler.weighted(batch.column(1)):
                bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(shingle.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), lists], ["h", "shingles"])

    return docs.select(text_id().alias("h"), "text").mapInArrow(releasing(run), "h binary, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of a written table whose shingle sets are similar enough, exactly."""
    left = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("h").alias("b"), F.col("shingles").alias("y"))
    if few(pairs):  # then only the sets that these pairs name are shuffled, and once
        right = right.join(F.broadcast(pairs.select("b")), "b", "left_semi")
        pairs = F.broadcast(pairs)
    both = F.size(F.array_intersect("x", "y"))
    # Of two sets, the smaller has at least that share of the larger, or they can't be similar enough.
    sizes = F.least(F.size("x"), F.size("y")) >= F.lit(similarity) * F.greatest(F.size("x"), F.size("y"))
    return (
        pairs.join(left, "a").join(right, "b").where(sizes)
        .where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9)
        .select("a", "b")
    )


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id and class_id, the least doc_id of its class. Documents are linked if
    the Jaccard similarity of their sets of word shingles is `similarity` or more, and classes are the connected
    groups; copies of a text are in one class.

    Candidates share a band of a ProbMinHash signature, in which all shingles of a text weigh the same. Copies have
    one signature and are one row from then on. In a bucket each text is compared with the least one, then with the
    one of most links, unless they are in one class by then; at last, in buckets of up to FEW texts, all that are
    still in different classes with one another, and in larger ones those of them that share a rare shingle, without
    which no two texts are similar enough, class by class in growing samples; see rare_pairs(). No bucket is gathered in one place and none is cut off.

    Words are [^\\x20\\x09-\\x0D]+; fewer than five are one shingle. Texts without words (null is empty) are linked to
    equal texts only. Rows with the same doc_id keep their own class each; a null doc_id sorts first. An empty table
    gives an empty table; other columns are not read.
    """
    scratch, own = Scratch(docs.sparkSession), docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("h"))
    labels, own = linked(docs, similarity), scratch.write(own)
    texts = own.groupBy("h").agg(F.min("doc_id").alias("d")).join(held(labels), "h", "left")
    texts = scratch.write(texts.select("h", F.coalesce("label", "h").alias("label"), "d"))
    heads = texts.groupBy("label").agg(F.min("d").alias("class_id"))
    texts = scratch.write(spread(texts, heads, "label").select("h", "class_id"))
    return spread(own, texts, "h").select("doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all columns of docs, whatever their names: that with the least doc_id (null first),
    then the least 128-bit hash of its text; of rows that repeat both, one."""
    keyed = docs.select(F.expr("struct(*)").alias("row"), F.col("doc_id").cast("long").alias("d"), text_id().alias("h"))
    keyed = keyed.withColumn("k", F.xxhash64("d"))
    texts = keyed.groupBy("h").agg(F.min(F.struct("d", "h", "k")).alias("head")).join(held(linked(docs, similarity)), "h", "left")
    heads = texts.groupBy(F.coalesce("label", "h").alias("label")).agg(F.min("head").alias("head"))
    kept = keyed.join(heads.select("head.h", "head.k"), ["h", "k"], "left_semi").dropDuplicates(["h", "k"])
    return kept.select("row.*")


def linked(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h, label) for those texts that have a near-duplicate among other texts."""
    scratch = Scratch(docs.sparkSession)
    signatures = scratch.write(bands(docs).dropDuplicates(["h"]))
    keys = signatures.select("h", F.explode("keys").alias("key"))
    ends = keys.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.count("*").alias("n"))
    ends = scratch.write(ends.where("least <> most").drop("most"))
    hot = frequent(ends.withColumnRenamed("n", "n_rows"), "key")
    # One row for each text and bucket that has others, with the least text of the bucket and the number of its texts.
    buckets = scratch.write(spread(keys, ends, "key", hot))
    scratch.drop(signatures, ends)
    texts = scratch.write(buckets.select("h").distinct())
    sets = scratch.write(shingle_sets(docs, texts).dropDuplicates(["h"]).join(texts, "h", "left_semi"))
    scratch.drop(texts)
    labels, tried = scratch.write(docs.sparkSession.createDataFrame([], "h binary, label binary")), None

    def compared(pairs):
        """The labels once all new ones of these pairs are compared, and the new links."""
        nonlocal tried
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("old"))
        if tried is not None:
            pairs = pairs.unionByName(tried.withColumn("old", F.lit(1)))
        pairs = scratch.write(pairs.groupBy("a", "b").agg(F.max("old").alias("old")).where("old = 0").select("a", "b"))
        if pairs.isEmpty():
            scratch.drop(pairs)
            return labels, None
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = scratch.write(verified(pairs, sets, similarity))
        # What was linked before is as well linked by its labels.
        found = components(new.unionByName(labels.select(F.col("h").alias("a"), F.col("label").alias("b"))), scratch)
        scratch.drop(labels)
        return found, new

    labels, links = compared(least_members(buckets))
    if links is not None:
        most = scratch.write(most_linked(labelled(buckets, labels), links))
        labels, _ = compared(linked_members(labelled(buckets, labels), most, hot))
        scratch.drop(most)
    labels, _ = compared(all_members(labelled(buckets, labels)))
    large = scratch.write(large_members(labelled(buckets, labels), hot))
    if not large.isEmpty():
        prefixes = scratch.write(rare_prefixes(large, sets, similarity, scratch))
        most = prefixes.agg(F.max("turn")).first()[0]
        for turn in range(most + 1):
            labels, _ = compared(rare_pairs(prefixes, labels, similarity, turn, scratch))
    scratch.clear(labels)
    return labels


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of each h: its own, if it has no link."""
    return rows.join(held(labels), "h", "left").withColumn("label", F.coalesce("label", "h"))


def least_members(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text of members(h, key, least, n) with the least of its bucket."""
    return members.where("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))


def most_linked(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, m): the text of most links of each bucket of members(h, key, label) that holds different classes."""
    ends = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    ends = F.broadcast(ends) if few(links) else ends
    known = members.join(ends, "h", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    most = known.groupBy("key").agg(F.max(F.struct("links", "h", "label")).alias("m"), F.min("label").alias("x"), F.max("label").alias("y"))
    return most.where("x <> y").select("key", "m")


def linked_members(members: DataFrame, most: DataFrame, hot: list) -> DataFrame:
    """Pairs of each text with the one of most links in its bucket, if they are in different classes: where copies of
    one text were changed here and there, that is the text in their middle."""
    pairs = spread(members, most, "key", hot).where(F.col("label") != F.col("m.label"))
    return pairs.select(F.col("m.h").alias("a"), F.col("h").alias("b"))


def all_members(members: DataFrame) -> DataFrame:
    """All pairs of different classes in buckets of up to FEW texts: FEW - 1 for each text at most."""
    own = members.where(F.col("n") <= FEW).groupBy("key")
    own = own.agg(F.collect_list(F.struct("h", "label")).alias("m"), F.min("label").alias("x"), F.max("label").alias("y"))
    own = own.where("x <> y").select("m", F.explode("m").alias("x"))
    other = F.expr("filter(m, o -> o.h > x.h and o.label <> x.label)")
    return own.select(F.col("x.h").alias("a"), F.explode(other).alias("y")).select("a", F.col("y.h").alias("b"))


def large_members(members: DataFrame, hot: list) -> DataFrame:
    """(h, label) of the texts in buckets of more than FEW texts that hold different classes."""
    own = members.where(F.col("n") > FEW)
    many = own.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return spread(own, many, "key", hot).select("h", "label").distinct()


def shingle_ranks(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each of RANKS counters occur, about the number of texts that hold one."""

    def count(batches):
        times = np.zeros(RANKS, np.int64)
        for batch in batches:
            times += np.bincount(place(batch.column(0).flatten().to_numpy().view(U64)), minlength=RANKS)
        at = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times[at])], ["at", "times"])

    found = sets.select("shingles").mapInArrow(releasing(count), "at long, times long").groupBy("at").agg(F.sum("times").alias("times"))
    out, found = np.zeros(RANKS, np.int64), found.toArrow()
    out[found["at"].to_numpy()] = found["times"].to_numpy()
    return out


def place(shingle: np.ndarray) -> np.ndarray:
    return (mix(shingle) % U64(RANKS)).astype(np.int64)


def rare_prefixes(texts: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """h, s, at, size, smaller, turn: the rare shingles of texts(h, label) by which an exact prefix filter finds pairs.

    Shingles are in one order for all texts, the rarer first. Two sets of that similarity share so many shingles that
    they share one among the first of each: those that remain of a set once all but one of the least number of shared
    ones are taken off its end. For the smaller set that number is higher. About TURN texts of a class, by a hash, have
    turn 0, eight times as many have turn 1, and so on.
    """
    sizes = scratch.write(texts.groupBy("label").agg(F.count("*").alias("n")))
    share = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    turn = F.greatest(F.lit(0), F.ceil(F.log((share * F.col("n") + 1e-9) / TURN) / F.log(F.lit(8.0)))).cast("int")
    by_label = texts.join(F.broadcast(sizes), "label") if few(sizes) else spread(texts, sizes, "label")
    own = scratch.write(sets.join(held(scratch.write(by_label.select("h", turn.alias("turn")))), "h"))
    shared = sets.sparkSession.sparkContext.broadcast(shingle_ranks(own))

    def least(size, share):
        return np.ceil(share * size - 1e-6).astype(np.int64)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            shingle, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((shingle, shared.value[place(shingle.view(U64))], doc))
            doc, shingle = doc[order], shingle[order]
            at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            first = at <= (size - least(size, similarity))[doc]
            smaller = at <= (size - least(size, 2 * similarity / (1 + similarity)))[doc]
            keep = np.flatnonzero(first)
            rows = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), pa.array(shingle[keep]), pa.array(at[keep]),
                    pa.array(size[doc[keep]].astype(np.int64)), pa.array(smaller[keep]), batch.column(2).take(rows),
                ],
                ["h", "s", "at", "size", "smaller", "turn"],
            )

    return own.select("h", "shingles", "turn").mapInArrow(releasing(run), "h binary, s long, at long, size long, smaller boolean, turn int")


def rare_pairs(prefixes: DataFrame, labels: DataFrame, similarity: float, turn: int, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of texts of different classes that may be similar enough and whose later turn is this one.

    Each pair has its turn, so none is lost; but a text that is like some members of a large class joins it after
    a few of them, and isn't compared with the others. The first shared shingle can't stand further on than leaves
    room for the others. Shingles of one class only are left out, and of each other one pairs within its largest class
    are never formed.
    """
    found = scratch.write(labelled(prefixes.where(F.col("turn") <= turn), labels))
    tops = found.groupBy("s", "label").agg(F.count("*").alias("n")).groupBy("s").agg(
        F.max(F.struct("n", "label"))["label"].alias("top"), F.count("*").alias("classes")
    )
    found = scratch.write(found.join(tops.where("classes > 1").select("s", "top"), "s").withColumn("other", F.col("label") != F.col("top")))
    columns = ("h", "label", "at", "size", "other", "turn")
    x = found.where("smaller").select("s", *(F.col(c).alias(f"x_{c}") for c in columns))
    y = found.select("s", *(F.col(c).alias(f"y_{c}") for c in columns))
    room = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    able = (
        (F.col("x_label") != F.col("y_label")) & (F.col("x_size") <= F.col("y_size"))
        & (F.greatest("x_turn", "y_turn") == turn)
        & (F.col("x_size") >= F.lit(similarity) * F.col("y_size") - 1e-6)
        & (room >= F.lit(similarity / (1 + similarity)) * (F.col("x_size") + F.col("y_size")) - 1e-6)
    )
    pairs = lambda x, y: x.join(y, "s").where(able).select(F.col("x_h").alias("a"), F.col("y_h").alias("b"))
    return pairs(x.where("x_other"), y).unionByName(pairs(x.where(~F.col("x_other")), y.where("y_other"))).distinct()
