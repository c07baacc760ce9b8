"""Near-duplicates, benchmark passages and nearest neighbours against brute force."""

import random
import re
from collections import Counter

import numpy as np

from graphloom.llm.decontamination import BLOCKS, NEAR, RADIUS, Index, contaminated, keep_clean, prints
from graphloom.llm.near_dedup import classes, keep_one, prob_min_hash
from graphloom.llm.neighbours import Searcher, chi_square_bound, nearest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_classes(rows, least=0.8):
    def shingles(text):
        w = WORD.findall(text or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else None

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, own in enumerate(sets):
        for x in own or [rows[i][1] or ""]:
            holders.setdefault(x, []).append(i)
    for i in range(len(rows)):
        for j in {j for x in sets[i] or [rows[i][1] or ""] for j in holders[x] if j < i}:
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    least_id = {r: min((d for d in own if d is not None), default=None) for r, own in ids.items()}
    return sorted(((d, least_id[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_classes(make, corpus):
    rng = random.Random(5)
    base = [f"u{i}" for i in range(100)]
    chain = []
    for _ in range(12):  # each like the one before, the ends unlike
        base = list(base)
        for _ in range(2):
            base[rng.randrange(100)] = f"v{rng.random()}"
        chain.append(" ".join(base))
    docs = make(corpus + chain)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, classes(docs).collect()), key=str) == plain_classes(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in plain_classes(rows)})


def test_classes_with_repeated_shingles(make):
    """Equal sets of shingles, which one text of each pair repeats hundreds of times."""
    rng, texts = random.Random(8), []
    for i in range(12):
        words = [f"r{i}x{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(words + words[:1] * n + words[:5]) for n in (5, 2000)]
    docs = make(texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, classes(docs).collect()), key=str) == plain_classes(rows)


def test_classes_on_one_template(make):
    """Texts on a template, not quite similar enough to each other, in pairs that are."""
    template = [f"t{i}" for i in range(200)]
    ends = [[f"p{i // 2}a", f"p{i // 2}b", *(f"o{i}x{j}" for j in range(23))] for i in range(240)]
    docs = make([" ".join(template + end) for end in ends])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_classes(rows)
    assert len({c for _, c in expected}) == 120
    assert sorted(map(tuple, classes(docs).collect()), key=str) == expected


def test_classes_in_few_stages(spark, make):
    """Rounds, and jobs for each partition, cost time however little is left to compare."""
    docs = make([" ".join([f"t{i // 4}x{j}" for j in range(60)] + [f"e{i % 4}"]) for i in range(40)])
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in settings}
    stages = spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    before = stages()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert len({r.class_id for r in classes(docs).collect()}) == 10
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert stages() - before < 150


def test_classes_of_many_links(make, corpus, monkeypatch):
    """Tables of pairs that are too large to be broadcast or joined up by one task."""
    monkeypatch.setattr("graphloom.llm.components.FEW_ROWS", 0)
    texts = corpus + [" ".join(f"t{(i + j) % 300}" for j in range(60)) for i in range(30)]  # a chain
    docs = make(texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_classes(rows)
    assert len({c for d, c in expected if d >= len(corpus)}) == 1
    assert sorted(map(tuple, classes(docs).collect()), key=str) == expected


def test_classes_on_tables(spark):
    """The documents of sf0.01 against brute force: pairs that share a shingle, each compared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, classes(docs).collect()), key=str) == plain_classes(rows)


def test_classes_odd(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, classes(odd).collect()), key=str) == plain_classes(rows)
    assert keep_one(odd).count() == 7  # null and empty are one class, and "short" twice
    assert classes(empty).count() == 0 and keep_one(empty).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x, y = np.ones(60), np.ones(60)
    y[:20] = 3.0
    x[50:], y[:5] = 0, 0
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(60) if x[i] and y[i])
    own = [(np.zeros(int((w > 0).sum()), np.int64), elements[w > 0], w[w > 0]) for w in (x, y)]
    a, b = (prob_min_hash(d, e, w, 1, 4096)[0] for d, e, w in own)
    assert abs((a == b).mean() - exact) < 0.04


def test_contaminated(spark, make, corpus, odd, empty):
    rng = random.Random(7)
    items = [" ".join(f"q{rng.randrange(500)}" for _ in range(n)) for n in (30, 45, 60, 5, 2)]
    changed = items[1].split()
    changed[20] = "other"
    texts = [*corpus, f"some words {items[0].upper()}, and more", f"a b {' '.join(changed)} c", "x " + items[2][: len(items[2]) // 2], f"z {items[4]} z", items[3]]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(9, None, "x"), (10, "", "x")], "item_id long, text string, start string")
    docs = make(texts)
    n = len(corpus)
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in contaminated(docs, benchmark).collect()}
    assert got == {(n, 0): 1.0, (n + 1, 1): round(36 / 46, 6), (n + 3, 4): 1.0, (n + 4, 3): 1.0} or (
        got == {(n, 0): 1.0, (n + 3, 4): 1.0, (n + 4, 3): 1.0} and 36 / 46 < 0.8
    )
    clean = keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert contaminated(odd, benchmark).count() == 0 and keep_clean(odd, benchmark).count() == odd.count()
    assert contaminated(empty, benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0


def best_windows(texts, items, least=0.8):
    """{(document, item): weighted Jaccard similarity} of the best window, by looking at each."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, item in enumerate(items):
        w = words(item)
        k = min(5, len(w))
        theirs = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        for d, text in enumerate(texts):
            own = words(text)
            n = min(len(w), len(own))
            # Windows without any shingle of the item have similarity 0.
            at = [j for j in range(len(own) - k + 1) if tuple(own[j : j + k]) in theirs] if n >= k else []
            for s in sorted({x for j in at for x in range(max(0, j - n + k), min(j, len(own) - n) + 1)}):
                counts = Counter(tuple(own[j : j + k]) for j in range(s, s + n - k + 1))
                found = (counts & theirs).total() / (counts | theirs).total()
                if found >= max(least - 1e-12, out.get((d, i), 0)):
                    out[d, i] = found
    return out


def test_contaminated_is_what_brute_force_finds(spark, make):
    """Items with and without repeated words, with so many changes that similarities lie on either side of 0.8."""
    rng = random.Random(12)
    items = [" ".join(f"a{rng.randrange(10**6)}" for _ in range(n)) for n in (40, 40, 70, 120)]
    items += [" ".join([f"b{rng.randrange(10**6)}" for _ in range(200)] + ["same"] * n) for n in (24, 60)]
    items += [" ".join(rng.choices(["x", "y", "z"], k=90)), "one two three", " ".join(["w"] * 30)]
    texts = []
    for item in items * 12:
        words = item.split()
        for _ in range(rng.randint(0, max(1, len(words) // 28))):
            words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
        cut = rng.randrange(0, max(1, len(words) // 12)) if rng.random() < 0.3 else 0
        texts.append(" ".join([f"d{rng.randrange(999)}" for _ in range(rng.randint(0, 50))] + words[cut:] + [f"d{rng.randrange(999)}" for _ in range(rng.randint(0, 9))]))
    for item in items[4:6]:  # all the repeated words gone, or some, and none of the others
        words = item.split()
        texts += [" ".join(words[: 200 + n] + [f"e{j}" for j in range(24 - n)]) for n in range(0, 24, 3)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(make(texts), benchmark).collect()}
    expected = best_windows(texts, items)
    assert len([x for x in expected.values() if x < 0.95]) > 20
    assert got.keys() == expected.keys() and all(abs(got[k] - x) < 1e-9 for k, x in expected.items())


def test_contaminated_on_tables(spark):
    """The documents and benchmark of sf0.001, window by window."""
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = docs.select("doc_id", "text").collect(), benchmark.collect()
    expected = best_windows([r.text for r in rows], [r.text for r in items])
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
    assert got == {(rows[d].doc_id, items[i].item_id) for d, i in expected}


def test_contaminated_in_a_very_long_text(spark, make):
    words = [f"l{i}" for i in range(60_000)]
    words[10:40] = words[50_000:50_030] = [f"m{i}" for i in range(30)]
    benchmark = spark.createDataFrame([(None, " ".join(f"m{i}" for i in range(30)))], "item_id long, text string")
    got = contaminated(make([" ".join(words)]), benchmark).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.start, r.length) for r in got] == [(0, None, 1.0, 10, 30)]


def test_fingerprints_of_sliding_windows():
    rng = np.random.default_rng(3)
    for sigma in (2, 5, 1000):
        shingles = rng.integers(0, sigma, 60).astype(np.uint64)
        for n in (1, 7, 60):
            found = prints(shingles, n, 0, 60 - n)
            assert (found == np.vstack([prints(shingles[i : i + n].copy(), n, 0, 0) for i in range(61 - n)])).all()


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(2)
    index = Index([(i, f"t{i} a b c d e f") for i in range(50)])
    own, blocks = index.postings[7]
    found = rng.integers(0, 2**32, (400, BLOCKS), dtype=np.uint32)
    found[:50] = blocks.T
    for i in range(50):
        for b in rng.integers(0, 32 * BLOCKS, rng.integers(0, RADIUS + 1)):
            found[i, b // 32] ^= np.uint32(1 << (b % 32))
    exact = np.bitwise_count(found[:, None] ^ blocks.T[None]).sum(axis=2) <= RADIUS
    at, item = index.near(found, 7)
    assert set(zip(at.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(exact))))
    assert RADIUS < BLOCKS * (NEAR + 1)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:90] = x[10]  # a group of copies around a query
    rows = [(i * 10, v.tolist(), 1, "k") for i, v in enumerate(x)]
    rows += [(5000, None, 1, "k"), (5100, [0.0] * 16, 1, "k"), (5200, [float("nan")] * 16, 1, "k"), (5300, [None] * 16, 1, "k"), (None, x[0].tolist(), 1, "k"), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, size string")
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.arange(400) * 10
    assert set(got) == set(ids[ids % 100 == 0])
    hits = 0
    for q in got:
        d = np.sqrt(((x.astype(float) - x[q // 10].astype(float)) ** 2).sum(axis=1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(abs(d[v // 10] - s) < 1e-9 for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len(set(best) & {v for _, v, _ in own})
    assert hits >= 0.9 * 10 * len(got)
    assert sorted(v for _, v, _ in got[100]) == [500 + 10 * i for i in range(10)]
    few = nearest(df.where("vec_id < 30")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    assert nearest(df.limit(0)).count() == 0


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 8)).tolist()
    rows = [(100 + i, x[0]) for i in range(12)] * 2 + [(300, x[1])] * 11 + [(301, x[1])] + [(400 + i, v) for i, v in enumerate(x[2:30])]
    rows += [(1001 + i // 2, v) for i, v in enumerate(x[30:])]  # two vectors to a vec_id
    rows += [(500, x[50]), (500, x[55])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(df).collect())
    points, expected = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows}), []
    for i, q in points:
        if i % 100 == 0:
            far = sorted((float(np.linalg.norm(np.subtract(v, q))), j) for j, v in points if j != i)
            expected += [(i, n, j, round(d, 9)) for n, (d, j) in enumerate(far[:10], 1)]
    assert got == sorted(expected)


def test_nearest_over_shards(spark, monkeypatch):
    """Recall at 10 against brute force where queries are routed to many cells."""
    from graphloom.llm import neighbours

    monkeypatch.setattr(neighbours, "CELL", 300)
    x = np.random.default_rng(9).standard_normal((3000, 32)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, every=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, 3000, 20)) and all(len(v) == 10 for v in got.values())
    hits = 0
    for q, own in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(own & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_nearest_stops_early(spark):
    """On the embeddings of sf0.1: recall at 10 against brute force, and the share of vectors that are verified."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got, verified = {}, {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        verified[r.query_id] = r.verified
    hits = 0
    for q, own in got.items():
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        hits += len(own & set(ids[[i for i in np.lexsort((ids, d)) if ids[i] != q][:10]].tolist()))
    print("recall", hits / 10 / len(got), "verified", sum(verified.values()) / len(got) / len(rows))
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(got)
    assert sum(verified.values()) < 0.55 * len(got) * len(rows)


def test_nearest_of_other_lengths(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)][: 2 + i % 2]) for i in range(40)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=3).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 10, 20, 30} and all(v % 2 == 0 for own in got.values() for v in own)


def test_chi_square():
    assert abs(chi_square_bound(8, 0.95) - 15.507) < 1e-2 and abs(chi_square_bound(2, 0.5) - 2 * np.log(2)) < 1e-6
    own = np.random.default_rng(0).standard_normal((500, 64))
    ids, _, _ = Searcher(np.arange(500), own).nearest(3, own[3], 10)
    assert 3 not in ids and len(ids) == 10


def test_shingles_of_a_large_batch_take_bounded_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from graphloom.llm import near_dedup

    texts = [None, "", "a b c", *(" ".join(f"w{(i * j) % 997}" for j in range(400)) for i in range(4000))]
    column, size = pa.array(texts), sum(len(t or "") for t in texts)
    assert size > 3 * near_dedup.CHUNK_BYTES
    parts = lambda: [(lo, n, *(x.tolist() for x in rest)) for lo, n, *rest in near_dedup.Shingler().weighted(column.slice(0, 60))]
    row_wise = lambda found: [(lo + d, s, w) for lo, _, doc, shingle, times in found for d, s, w in zip(doc, shingle, times)]
    whole = row_wise(parts())
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", 3000)
    assert len(parts()) > 10 and row_wise(parts()) == whole
    assert [lo for lo, *_ in parts()][1:] == [lo + n for lo, n, *_ in parts()][:-1]
    monkeypatch.undo()
    tracemalloc.start()
    for _ in near_dedup.Shingler().weighted(column):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * size


def test_workers_release_memory_after_a_task(monkeypatch):
    from graphloom.llm import common

    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    run = common.releasing(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and done == [1]
    monkeypatch.undo()
    common.release()
