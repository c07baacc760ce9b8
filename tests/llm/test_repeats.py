"""Repeated words and bytes against brute force; suffix arrays against sorting."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import substring_dedup, suffix_dedup
from graphloom.llm.suffix_array import permuted_lcp, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(rows, window):
    """rows of (doc_id, text) in order -> {row: (n_words, n_removed, sha)}"""
    seen, out = set(), []
    done: dict = {}
    for row in rows:
        if row in done:
            out.append(done[row])
            continue
        words = WORD.findall(row[1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        done[row] = (row[0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        out.append(done[row])
    return out


def plain_bytes(rows, window):
    distinct = list(dict.fromkeys(rows))
    data = [(r[1] or "").encode() for r in distinct]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    result = {}
    for r, d in zip(distinct, data):
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(d, gone) if not g)
        result[r] = (r[0], len(d), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return [result[r] for r in rows]


def some(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("many", [1 << 16, 1])
def test_words(make, odd, corpus, many):
    docs = make(corpus + ["a b " * 40, "c " * 30], range(10, 12 + len(corpus)))
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs, 6, bits=16, many=many)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_words(some(docs), 6))


def test_words_odd(odd, empty):
    got = substring_dedup.digest(substring_dedup.remove_repeats(odd, 20, bits=16)).collect()
    expected = plain_words([r for r in some(odd)], 20)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert substring_dedup.remove_repeats(empty, bits=16).count() == 0


@pytest.mark.parametrize("many", [1 << 16, 1])
def test_bytes(make, corpus, many):
    docs = make(corpus + ["ab" * 80, "ab" * 30 + "é" * 40], range(10, 12 + len(corpus)))
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 40, bits=16, many=many)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_bytes(some(docs), 40))


def test_bytes_odd(odd, empty):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(odd, 200, bits=16)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain_bytes(some(odd), 200), key=key)
    assert suffix_dedup.remove_repeats(empty, bits=16).count() == 0


def test_large_and_small_anchors(make):
    """Passages in two surroundings each beside one in many: with few counters the places of both kinds collide."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    passage = lambda n: " ".join(word() for _ in range(n))
    common, small = passage(7), [passage(7) for _ in range(40)]
    texts = [f"{passage(8)} {common} {passage(8)}" for _ in range(40)]
    texts += [f"{passage(8)} {s} {passage(8)}" for s in small for _ in range(2)]
    docs = make(texts)
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs, 6, bits=9, many=8)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_words(some(docs), 6))
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 40, bits=9, many=8)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_bytes(some(docs), 40))


def test_anchors_of_a_large_batch_take_bounded_memory(monkeypatch):
    """Words of a whole batch, and counters of a byte each, took more than an executor has."""
    import tracemalloc

    import pyarrow as pa

    from graphloom.llm import common, repeats

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(300)]
    texts = [None, "", "a b", *(" ".join(rng.choices(words, k=500)) for _ in range(5000))]
    column, size = pa.array(texts), sum(len(t or "") for t in texts)
    batch = lambda c: pa.RecordBatch.from_arrays([pa.array(range(len(c))), pa.array([0] * len(c)), c], ["doc_id", "t", "text"])
    kind, sketch = repeats.Kind(True, 20, 5), repeats.Sketch(24)

    def hashes(c):
        cutter = repeats.Cutter(kind)
        for _, units, offsets, _ in cutter.chunks(batch(c)):
            yield cutter.anchors(units.values, offsets)[3]

    def cut(c):
        every = lambda anchor, *_: np.arange(len(anchor))
        found = repeats.cut_runs([batch(c)], repeats.Cutter(kind), every)
        return [r for columns, *_ in found for r in zip(*(x.to_pylist() for x in columns))]

    few = column.slice(0, 60)
    rows, times = cut(few), Counter(h for x in hashes(few) for h in x.tolist())
    repeated = sketch.repeated((i, two) for i, _, two in sketch.merged(sketch.counts(hashes(few))))
    known = np.array(list(times), np.uint64)
    assert sketch.may_repeat(repeated, known)[[n > 1 for n in times.values()]].all()
    assert sketch.may_repeat(repeated, known).mean() < 0.1
    monkeypatch.setattr(common, "SLICE", 3000)
    assert cut(few) == rows
    monkeypatch.undo()
    tracemalloc.start()
    for _ in sketch.counts(hashes(column)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 3 * common.SLICE and peak < 6 * size + (sketch.ROWS << sketch.bits) // 2


def morse(a: str, b: str, n: int) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse(make):
    """A Thue-Morse word and its complement collide modulo 2**64, whatever the base."""
    common = [f"w{i}" for i in range(10)]
    texts = [" ".join([*common, morse(a, b, 1024), *common]) for a, b in ("ab", "ba")]
    texts += [morse(*x, 2048) for x in ("xy", "yx")] + [" ".join(morse(*x, 2048)) for x in ("pq", "qp")]
    docs = make(texts)
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs, 20, bits=16)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_words(some(docs), 20)) and got[0].n_removed == got[1].n_removed == 0
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 200, bits=16)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_bytes(some(docs), 200))


@pytest.mark.parametrize("few", [1 << 10, 0])
def test_suffix_arrays(few, monkeypatch):
    monkeypatch.setattr("graphloom.llm.suffix_array.FEW_SYMBOLS", few)
    rng = random.Random(1)
    for _ in range(150):
        sigma, n = rng.choice([2, 3, 8, 200]), rng.randint(1, 100)
        t = [rng.randint(1, sigma) for _ in range(n)]
        if rng.random() < 0.5:
            t = t[: max(1, n // 4)] * 4
        t = t + [0]
        text = np.array(t)
        order = suffix_array(text, sigma + 1)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp, phi = permuted_lcp(text, order)
        for a, b in zip(order[1:], order):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert phi[a] == b and lcp[a] == k


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(60):
        parts = [bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 9))]
        count = Counter(p[i : i + 5] for p in parts for i in range(len(p) - 4))
        expected = [[i for i in range(len(p) - 4) if count[p[i : i + 5]] > 1] for p in parts]
        assert [a.tolist() for a in suffix_dedup.repeated_starts(parts, 5)] == expected


def test_contexts_are_cut_to_what_may_be_shared():
    """Whole contexts went into the suffix arrays, also those that share little more than their anchor."""
    import pyarrow as pa

    from graphloom.llm import repeats

    rng = random.Random(17)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passages = [letters(n) for n in (30, 39, 40, 41, 55, 80, 200) for _ in range(4)]
    texts = ["ab" * 60, "a" * 90]
    texts += [letters(rng.randint(0, 90)) + p + letters(rng.randint(0, 90)) for p in passages for _ in range(3)]
    texts += [letters(50) + p[:a] + "Z" + p[a:] + letters(50) for p in passages[12:] for a in (7, 20, 35)]
    kind = repeats.Kind(False, 40, 6)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["doc_id", "t", "text"])
    rows = {}
    for columns, units, start, end in repeats.cut_runs([batch], repeats.Cutter(kind), lambda anchor, *_: np.arange(len(anchor))):
        content = repeats.ranges_of(units.data, start, end - start).to_pylist()
        for anchor, c1, c2, doc_id, p, c in zip(*(x.to_pylist() for x in columns[:5]), content):
            rows.setdefault((anchor, c1, c2), (doc_id, p, anchor, c))
    rows = [rows[k] for k in sorted(rows)]

    def repeated(rows):
        found = [(c[i : i + 40], doc_id, p + i) for doc_id, p, _, c in rows for i in range(len(c) - 39)]
        count = Counter(w for w, *_ in found)
        return {x for x in found if count[x[0]] > 1}

    narrowed = suffix_dedup.Narrow(kind)(rows)
    assert repeated(rows) and repeated(narrowed) == repeated(rows)
    size = lambda rows: sum(len(r[3]) for r in rows)
    assert size(narrowed) < size(rows) / 2
    starts = suffix_dedup.repeated_starts([r[3] for r in narrowed], 40)
    assert {(r[0], r[1] + i) for r, at in zip(narrowed, starts) for i in at.tolist()} == {x[1:] for x in repeated(rows)}
