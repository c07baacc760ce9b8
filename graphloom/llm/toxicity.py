"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from graphloom.llm.common import releasing
from graphloom.llm.pretokens import Known, forget

WORD = re.compile(r"\w+")
#: By character of Latin-1 its lower case, or a space if WORD has no place for that.
LATIN = "".join(c if WORD.match(c) else " " for c in (chr(b).lower() for b in range(256))).encode("latin-1")
#: Most labelled rows that a fit takes, of either class, and the most characters that it reads of all.
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS = 3000, 6000, 32_000_000
#: The most that a model says of any text that had too little to learn from: it predicts nothing to be toxic.
UNTRAINED = 0.25
#: Words in a window, bytes in a dictionary.
WINDOW, DICTIONARY = 12, 1 << 15
#: Windows that are held to be compressed under one dictionary, then under the other: some 4 MB.
HELD = 1 << 14
CODE, PREFIXES = 8, ((3, "3"), (5, "5"))
#: Least log odds ratio, less so many standard errors, of what tells toxic text.
ODDS, ERRORS = 1.0, 2.5


def units(word: str) -> list[str]:
    """A word and its beginnings, each marked with its length."""
    return [mark + word[:n] for n, mark in PREFIXES if len(word) > n] + ["=" + word]


#: Of a unit's UTF-8 bytes.
digest_of = xxh3_64_digest


def code(word: str) -> bytes:
    """The digests of a word's units: its spelling for the compressor. zstandard gains nothing from matches of a few bytes,
    so that a short word known to a dictionary would cost as much as an unknown one; of codes of fixed length it spares most."""
    out, size = b"", len(word)  # most calls are for rare words, each made anew, so without a list of units
    for n, mark in PREFIXES:
        if size <= n:
            break
        out += xxh3_64_digest(mark + word[:n])
    return out + xxh3_64_digest("=" + word)


def words_of(text: str | None) -> list[str]:
    """What WORD finds in the text in lower case. Texts within Latin-1 are cut at white space, after a translation."""
    if not text:
        return []
    try:
        latin = text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD.findall(text.lower())
    return latin.translate(LATIN).decode("latin-1").split()


class Lengths:
    """Compressed lengths under one dictionary. The match finder searches trees: a plain hash table loses many of
    the dictionary's entries, by chance, which would blur the margins."""

    END = bytes(12)  # zstandard leaves the last bytes unmatched

    def __init__(self, dictionary: bytes):
        import zstandard as z

        search = z.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=5, target_length=32,
            strategy=z.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        held = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=search)
        self.compressor = z.ZstdCompressor(dict_data=held, compression_params=search)

    def of(self, window: bytes) -> int:
        return len(self.compressor.compress(window + self.END))


@dataclass
class Model:
    """Two dictionaries, and the calibration of window margins to a probability."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def scorer(self):
        """A function from a list of texts to their scores."""
        if not self.toxic:
            return lambda texts: [self.weights[0]] * len(texts)
        toxic, ordinary, codes = Lengths(self.toxic), Lengths(self.ordinary), Known(code)

        def score(found: list[int]) -> float:
            x = features(found)
            z = self.weights[0] + sum(
                w * (v - c) / s for w, v, c, s in zip(self.weights[1:], x, self.centre, self.scale)
            )
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return lambda texts: list(map(score, margins(texts, toxic, ordinary, codes)))


def margins(texts: list[str | None], toxic: Lengths, ordinary: Lengths, codes: Known):
    """For each text, of each of its windows by how many bytes it is shorter under the toxic dictionary. The dictionaries
    don't take turns at every window: either has tables of half a megabyte, which the processor's caches then keep."""
    get, windows, found, ends = codes.__getitem__, [], [], [0]

    def measure():
        under_ordinary, under_toxic = list(map(ordinary.of, windows)), list(map(toxic.of, windows))
        found.extend(map(int.__sub__, under_ordinary, under_toxic))
        windows.clear()

    def measured():
        measure()
        yield from [found[a:b] for a, b in zip(ends, ends[1:])]
        found.clear()
        del ends[1:]

    for text in texts:
        words = words_of(text)
        for i in range(0, len(words), WINDOW):
            windows.append(b"".join(map(get, words[i : i + WINDOW])))
            if len(windows) >= HELD:  # of a long text some at a time
                measure()
        ends.append(len(found) + len(windows))
        if ends[-1] >= HELD:
            yield from measured()
    yield from measured()


def features(found: list[int]) -> tuple[float, ...]:
    """The largest margins of a document, how far windows stand out and how many, and its length."""
    if not found:
        return 0.0, 0.0, 0.0, 0.0
    top = sorted(found, reverse=True)[:3]
    high = sum(max(0, m - CODE) for m in found)
    return float(top[0]), sum(top) / 3, math.log1p(high), math.log1p(len(found))


def raw_dictionary(counts: Counter, first: list[str], size: int, without=()) -> bytes:
    """Content for a dictionary: units that tell its class, then the most frequent ones that don't tell the other;
    the best come last, where zstandard reaches them at the least cost."""
    best = dict.fromkeys(first) | dict.fromkeys(u for u, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    chosen = [u for u in best if u not in without][: size // CODE]
    return b"".join(map(digest_of, reversed(chosen)))


def unit_counts(vocabulary: list[str], times: np.ndarray) -> Counter:
    """How often each unit occurs, from how often each word does."""
    out: Counter = Counter()
    for i in np.flatnonzero(times).tolist():
        n = int(times[i])
        for u in units(vocabulary[i]):
            out[u] += n
    return out


def places(docs: list[np.ndarray], size: int) -> np.ndarray:
    """For each word in how many places it stands. A place is a word with the one behind it, counted once, so that
    copies of a document count as one."""
    pairs = [d.astype(np.int64) * (size + 1) + np.append(d[1:], size) for d in docs if len(d)]
    known = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return np.bincount(known // (size + 1), minlength=size)


def telling_units(toxic: list[np.ndarray], ordinary: list[np.ndarray], vocabulary: list[str]) -> list[str]:
    """Units that stand in more places of toxic text than of ordinary text, beyond chance, the surest first."""
    times = [places(docs, len(vocabulary)) for docs in (toxic, ordinary)]
    a, b = (unit_counts(vocabulary, t) for t in times)
    n, m = (int(t.sum()) for t in times)
    out = []
    for u, x in a.items():
        if x >= 3:
            y = b[u]
            odds = math.log((x + 0.5) / (n + 1)) - math.log((y + 0.5) / (m + 1))
            error = math.sqrt(1 / (x + 0.5) + 1 / (y + 0.5))
            if (sure := odds - ERRORS * error) > ODDS:
                out.append((-sure, u))
    return [u for _, u in sorted(out)]


def train(rows: list[tuple[int, str | None, int]]) -> Model:
    """From (doc_id, text, toxic). Seven tenths of the rows make the dictionaries, the others the calibration. Rows that
    don't tell the classes apart give a constant, by which no text is toxic."""
    share = sum(y for _, _, y in rows)
    constant = Model(b"", b"", (min((share + 1) / (len(rows) + 2), UNTRAINED),), (), ())
    if share < 10 or len(rows) - share < 10:
        return constant
    made = [i for i, r in enumerate(rows) if hashlib.blake2b(str(r[0]).encode(), digest_size=8).digest()[0] % 10 < 7]
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(rows[i][1])], np.int32) for i in made]
    vocabulary = list(ids)
    del ids
    of = lambda label: [d for d, i in zip(docs, made) if rows[i][2] == label]
    telling = telling_units(of(1), of(0), vocabulary)
    if not telling:
        return constant
    # Toxic documents are ordinary text but for a few places: what both kinds have in common stands in both
    # dictionaries alike, or its chance differences would drown what tells toxic text.
    both = unit_counts(vocabulary, sum(np.bincount(d, minlength=len(vocabulary)) for d in docs))
    model = Model(raw_dictionary(both, telling, DICTIONARY), raw_dictionary(both, [], DICTIONARY, set(telling)), (), (), ())
    del both, docs, vocabulary
    if not model.toxic or not model.ordinary:
        return constant
    lengths, codes = (Lengths(model.toxic), Lengths(model.ordinary)), Known(code)
    held = sorted(set(range(len(rows))) - set(made))
    x = np.array([features(found) for found in margins([rows[i][1] for i in held], *lengths, codes)])
    y = np.array([rows[i][2] for i in held], float)
    model.centre, model.scale = tuple(x.mean(0).tolist()), tuple((x.std(0) + 1e-6).tolist())
    model.weights = tuple(logistic((x - model.centre) / model.scale, y).tolist())
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights with the intercept first, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out():
    """Rows that no fit may see."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a bounded sample of the labelled rows that are not held out: at most FIT_TOXIC and FIT_ORDINARY
    rows, those with the least hashes, and FIT_CHARS characters. Where they have more, the longest texts are read as
    far as the limit that all of them fit under, wherever they are stored; repeated rows count once."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash(1, FIT_TOXIC).unionByName(by_hash(0, FIT_ORDINARY))
    # At most FIT_TOXIC + FIT_ORDINARY ids, so their size is bounded; of texts that share one, so many as well.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    known = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "t", "toxic").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "t"))
    known = known.withColumn("place", place).where(F.col("place") <= max(FIT_TOXIC, FIT_ORDINARY))
    sizes = known.where(F.col("place") <= F.when(F.col("toxic") == 1, FIT_TOXIC).otherwise(FIT_ORDINARY)).collect()
    if not sizes:
        return train([])
    most = longest([r.n for r in sizes], FIT_CHARS)
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.t, r.toxic) for r in sizes], "doc_id long, t long, toxic int")
    rows = texts.join(F.broadcast(wanted), ["doc_id", "t"]).select("doc_id", "t", F.substring("text", 1, most).alias("text"), "toxic")
    rows = rows.dropDuplicates(["doc_id", "t"]).select("doc_id", "text", "toxic").repartition(1)

    def run(batches):
        sample = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        model = train(sorted(sample, key=lambda r: (r[0], r[2], r[1] or "")))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return pickle.loads(rows.mapInArrow(releasing(run), "model binary").first()["model"])


def longest(lengths: list[int], total: int) -> int:
    """The greatest limit under which the lengths, none counted beyond it, have at most that total."""
    left, rest = total, sorted(lengths)
    for i, n in enumerate(rest):
        if n * (len(rest) - i) > left:
            return left // (len(rest) - i)
        left -= n
    return max(rest)


ROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score (0 to 1) and predicted (score >= 0.5).

    A text is cut into windows of WINDOW words; a window's margin is its compressed length under the ordinary
    dictionary less that under the toxic one, and the calibrated margins of all windows are the score. A null or
    empty text has no windows and the score of that. Repeated rows give equal rows, a null doc_id isn't held out,
    an empty table gives an empty table; other columns are not read.
    """

    def run(batches):
        forget()
        of = model.scorer()
        for batch in batches:
            doc_id, held, text = batch.columns
            yield pa.RecordBatch.from_arrays([doc_id, held, pa.array(of(text.to_pylist()), pa.float64())], schema=ROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted to be toxic."""
    at = docs.columns.index("text")

    def run(batches):
        forget()
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([p < 0.5 for p in of(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
