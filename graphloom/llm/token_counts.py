"""Token counts from pre-token frequencies."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretokens import LATIN, Known, PreTokens
from graphloom.llm.repeats import Scratch

#: Most pre-tokens that are joined where the documents are: the most frequent ones. The others are joined by a shuffle.
FREQUENT = 1 << 17
#: Distinct words or pre-tokens that a task holds before it hands its counts on.
HELD = 1 << 17


def pre_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(token, n): how often each pre-token occurs in docs(text), summed in tasks before the shuffle. Texts that hold a
    special string have none here; see token_counts()."""

    def count(batches):
        pre = PreTokens.at(tokenizer)
        words, tokens = Counter(), Counter()

        def handed_on():
            for w, n in words.items():
                for t in LATIN.findall(w):
                    tokens[t] += n
            out = pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.string()), pa.array(list(tokens.values()), pa.int64())], ["token", "n"])
            words.clear()
            tokens.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not pre.has_special(text):
                    for of_words, part in pre.cut(text):
                        (words if of_words else tokens).update(part)
                if len(words) + len(tokens) > HELD:
                    yield handed_on()
        yield handed_on()

    return docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """(token, n, pieces): the number of pieces of each distinct pre-token."""

    def count(batches):
        pre = PreTokens.at(tokenizer)
        for batch in batches:
            pieces = pa.array([pre.n_pieces(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["token", "n", "pieces"])

    return tokens.select("token", "n").mapInArrow(count, "token string, n long, pieces long")


JOINED = "doc_id long, n_bytes long, known long, tokens array<string>, times array<long>"


def joined(rows: DataFrame, tokenizer: str, pieces: dict[str, int]) -> DataFrame:
    """Per row of rows(doc_id, n_bytes, text): the pieces of its pre-tokens in `pieces`, and its other pre-tokens with
    their frequencies."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def join(batches):
        pre, pieces = PreTokens.at(tokenizer), shared.value

        def of(word):
            """The pieces of a word, or -1 if they aren't all known."""
            found = [pieces.get(t) for t in LATIN.findall(word)]
            return -1 if None in found else sum(found)

        of_word = Known(of)

        def of_document(text):
            if not text:
                return 0, {}
            if (ids := pre.whole(text)) is not None:
                return len(ids), {}
            known, rest = 0, Counter()
            for words, part in pre.cut(text):
                for x, n in Counter(part).items():
                    if words and (found := of_word[x]) >= 0:
                        known += n * found
                        continue
                    for t in LATIN.findall(x) if words else (x,):
                        if (found := pieces.get(t)) is None:
                            rest[t] += n
                        else:
                            known += n * found
            return known, rest

        for batch in batches:
            found = [of_document(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.int64()),
                    pa.array([list(r) for _, r in found], pa.list_(pa.string())),
                    pa.array([list(r.values()) for _, r in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_bytes", "known", "tokens", "times"],
            )

    return rows.mapInArrow(join, JOINED)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The distinct pre-tokens of all documents are summed before and after a shuffle, and the pieces of each counted
    once. Each document then becomes its pre-token frequencies, which are joined to these counts and summed; no ids
    are built. The `frequent` most frequent pre-tokens, a bounded table, are joined in place, so that a document's
    common pre-tokens aren't shuffled; all others are joined by a shuffle.

    A text that holds a special string isn't cut into pre-tokens and is counted by the library as a whole. A null or
    empty text has 0 bytes and 0 tokens. Repeated rows and repeated doc_ids each give their own row, a null doc_id
    stays null, an empty table gives an empty table; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.write(piece_counts(pre_token_counts(docs, tokenizer), tokenizer))
    most = counted.orderBy(F.desc("n"), "token").limit(frequent)
    pieces = {r.token: r.pieces for r in most.select("token", "pieces").toLocalIterator()}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    found = scratch.write(joined(rows, tokenizer, pieces).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("row", "x.tokens", "x.times")
    each = each.join(counted.select(F.col("token").alias("tokens"), "pieces"), "tokens")
    rest = each.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    whole = found.where(F.size("tokens") == 0).select("doc_id", "n_bytes", F.col("known").alias("n_tokens"))
    others = found.where(F.size("tokens") > 0).join(rest, "row")
    out = whole.unionByName(others.select("doc_id", "n_bytes", (F.col("known") + F.col("rest")).alias("n_tokens")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
