"""Personal data against Python's regular expressions; toxicity by held-out accuracy; the pipeline as a whole."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from graphloom.llm import toxicity
from graphloom.llm import near_dedup
from graphloom.llm.pii import KINDS, private, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (2 if i % 2 else 1)
            total += d - 9 if d > 9 else d
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text) if valid(kind, m[0])]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


TEXTS = [
    "a@b.c_d@e.f x..y@z.com. a@b..c a@b.c. é@x.de 日本 q@w.e-r.t", "a@b@c.d @x.y a.@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111111111111 5 4111111111111111", "+1 (555) 123-4567 +12 +1((((2 +4930123456789 +1 555 123 4567 ext 9",
    "4111111111111111- 4111111111111112 --5500 0000 0000 0004-", "", "no data \x01 a@b.c \x02 \x03", "+1 555 123 4567 4111 1111 1111 1111", "1 2 " * 6000 + "9" * 20_000, "a." * 20_000 + "@b.c", "a@" + "b." * 20_000 + "c",
]


def test_base_spans(make, odd, empty):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("a@.1+ -(2\n_é", k=rng.randint(1, 200))) for _ in range(300)]
    docs = make(texts, range(100, 100 + len(texts))).unionByName(odd)
    want = {}
    for r in docs.collect():
        want.setdefault((r.doc_id, written(base(r.text or ""))), 0)
    for r in private(docs).collect():
        spans = next(s for (d, s) in want if d == r.doc_id and hashlib.sha256(s.encode()).hexdigest() == r.base_sha256)
        assert all(getattr(r, f"n_{k}") == sum(x.startswith(k) for x in spans.split(",")) for k in KINDS)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
    assert private(docs).count() == docs.count() and private(empty).count() == 0


def test_context_finds_what_patterns_miss(make):
    texts = [f"note {i} hotline +1 ({200 + i}) 555-1{i:03d} thanks and more words" for i in range(20)]
    texts += ["note hotline 555-123-4567 thanks", "the number 555-123-9999 is of no kind"] + ["plain words only"] * 20
    got = {r.doc_id: r.spans for r in private(make(texts)).collect()}
    assert got[20] == "phone:13:25" and got[21] == "" and got[0] == "phone:15:32"


def test_context_in_two_steps(make):
    """Seeds tell "hotline", what it tells has "weekdays" behind it, and that word tells what neither seeds nor
    "hotline" are near."""
    texts = [f"note hotline +1 ({200 + i}) 555-1{i:03d} x{i}" for i in range(6)]
    texts += [f"see hotline 555-123-4{i:03d} weekdays" for i in range(5)]
    texts += [f"y{chr(97 + i)} 555-987-6{i:03d} weekdays" for i in range(4)] + ["z 555-321-0000 is of no kind"] + ["plain words only"] * 9
    got = {r.doc_id: r.spans for r in private(make(texts)).collect()}
    assert all(got[i] == "phone:12:24" for i in range(6, 11))
    assert all(got[i] == "phone:3:15" for i in range(11, 15)) and got[15] == ""


def test_context_with_more_unseen_than_seeds(make):
    texts = [f"a{i} hotline +1 ({200 + i}) 555-1{i:03d} x{i}" for i in range(4)] + [f"b{i} hotline 555-123-4{i:03d} y{i}" for i in range(9)]
    texts += [f"c{i} desk +1 ({300 + i}) 555-1{i:03d} x{i}" for i in range(4)] + [f"the desk of {i}" for i in range(9)] + ["the desk 555-123-9999 z"]
    got = {r.doc_id: r.spans for r in private(make(texts)).collect()}
    assert all(got[i] == "phone:11:23" for i in range(4, 13)) and got[len(texts) - 1] == ""


def test_identifiers_of_any_shape(make):
    """Hexadecimal seeds tell their word, which tells identifiers of other shapes."""
    rng = random.Random(4)
    seeds = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(6)]
    texts = [f'pla{i} secret = "{s}" after{i}' for i, s in enumerate(seeds)]
    texts += ['x secret = "QX-77/ab!z_1" y', "the SECRET: ABCDEF0123456789 z", "a secretary 12345678x b", "other = 99887766zz c"] + ["plain words"] * 5
    got = {r.doc_id: (r.spans, r.n_spans, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in private(make(texts)).collect()}
    assert all(got[i] == ("id:15:55", 1, 0) for i in range(6))
    assert got[6] == ("id:12:24", 1, 0) and got[7] == ("id:12:28", 1, 0) and got[8] == got[9] == ("", 0, 0)
    assert {r.text for r in redact(make(texts)).where("doc_id >= 6 and doc_id < 8").collect()} == {'x secret = "[ID]" y', "the SECRET: [ID] z"}


def test_identifiers_on_tables(spark):
    """The identifiers of sf0.01: all stand behind the word that tells them, and all that do are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, found = {r.doc_id: r.text for r in docs.collect()}, []
    for r in private(docs).collect():
        for kind, a, b in (x.split(":") for x in r.spans.split(",") if x):
            if kind == "id":
                found.append((texts[r.doc_id][int(a) : int(b)], texts[r.doc_id][max(0, int(a) - 12) : int(a)]))
    assert found and all("token" in before.lower() for _, before in found)
    assert len(found) == sum(len(re.findall(r'(?i)token\W+[0-9a-f]{40}', t or "")) for t in texts.values())


def test_columns_of_any_name(spark):
    names = "doc_id long, text string, __d long, __t string, __spans string, __h string, __k int, `row` string, d int, t int, h string, k int"
    docs = spark.createDataFrame([(i, f"mail me{i // 2}@x.org please", i, "t", "s", "mine", 7, "r", 1, 2, "hh", 3) for i in range(4)], names)
    for out in (redact(docs), near_dedup.keep_one(docs)):
        assert out.columns == docs.columns and all(r["__h"] == "mine" and r["__k"] == 7 and r["row"] == "r" and r["k"] == 3 for r in out.collect())
    assert redact(docs).count() == 4 and near_dedup.keep_one(docs).count() == 2


def test_redact(make, odd):
    docs = make(["mail a@b.cd, ip 1.2.3.4.", "none", None, "+1 555 123 4567 4111 1111 1111 1111", "x 1.2.3.4@h.i a@b.c"])
    out = redact(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        0: "mail [EMAIL], ip [IP].", 1: "none", 2: None, 3: "+1 555 123 4567 4111 1111 1111 1111", 4: "x [EMAIL] [EMAIL]",
    }
    assert redact(odd).count() == odd.count()


def labelled(n=1500):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ne", "tu", "ra"], k=rng.randint(1, 4)))
    bad = ["grimble", "snork", "vexhole", "drabbit", "blorg"]
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(20, 200))], int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out(spark, make, odd, empty):
    rows = labelled()
    docs = make([t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    right = sum(got[i].predicted == rows[i][2] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].predicted}
    constant = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, constant).select("score").distinct().count() == 1


def test_toxicity_is_trained_outside_the_driver(make, spark, monkeypatch):
    """The driver's memory doesn't hold the sample: a task trains."""
    import os

    monkeypatch.setattr(toxicity, "train", lambda rows: (os.getpid(), rows))
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    pid, rows = toxicity.fit(make([None, *(f"text {i}" for i in range(1, 8))]), labels)
    assert pid != os.getpid() and rows and rows == sorted(rows)
    assert {i: (t, y) for i, t, y in rows}.items() <= {i: (f"text {i}" if i else None, i % 2) for i in range(8)}.items()


def test_toxicity_without_rows_to_learn_from(spark, make):
    docs = make([t for _, t, _ in labelled(30)])
    for labels in ([], [(900 + i, i % 2) for i in range(90)], [(i, 1) for i in range(30)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.keep_clean(docs, model).count() == 30


def test_toxicity_with_a_long_text_in_front(spark, make, monkeypatch):
    """A labelled text longer than all that a fit reads takes no other's place."""
    rows = labelled(400)
    size = sum(len(t) for _, t, _ in rows)
    monkeypatch.setattr(toxicity, "FIT_CHARS", size + 20_000)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    at = next(i for i, _, y in rows if not y and zlib.crc32(str(i).encode()) % 5)
    texts = [t + " ka lo" * size if i == at else t for i, t, _ in rows]
    order = [at, *(i for i in range(400) if i != at)]
    front, back = (toxicity.fit(make([texts[i] for i in o], o), labels) for o in (order, order[::-1]))
    assert front == back and front.toxic
    assert toxicity.longest([5, 1, 100, 7], 33) == 20 and toxicity.longest([5, 1], 33) == 5


def test_toxicity_words_without_a_search(monkeypatch):
    """Texts within Latin-1 are translated and cut, into what the pattern finds; only others go through it."""
    rng = random.Random(5)
    texts = ["".join(map(chr, range(256))), " ".join(map(chr, range(256))), "", "a", " _1 ", "\x85\xa0\x1c", "ÀÞ×÷ÿß²¼ªµ", "İı ﬁ日本 Σς"]
    texts += ["".join(chr(rng.randrange(n)) for _ in range(400)) for n in (128, 256, 1000, 50_000) for _ in range(20)]
    want = [re.findall(r"\w+", t.lower()) for t in texts]
    assert [toxicity.words_of(t) for t in texts] == want and toxicity.words_of(None) == []
    assert all(toxicity.code(w) == b"".join(map(toxicity.digest_of, toxicity.units(w))) for found in want for w in found)
    monkeypatch.setattr(toxicity, "WORD", None)
    assert all(toxicity.words_of(t) == w for t, w in zip(texts, want) if max(t, default="") < "\u0100")


def test_toxicity_dictionaries_in_turns(monkeypatch):
    """Windows of many texts go through one dictionary, then the other, however they are dealt to turns."""
    turns = []

    class Fake:
        def __init__(self, name, factor):
            self.name, self.factor = name, factor

        def of(self, window):
            turns.append(self.name)
            return self.factor * len(window)

    rng = random.Random(6)
    texts = [None, "", *(" ".join(["word"] * rng.randrange(n)) for n in (10, 100, 900) for _ in range(10)), "", None]
    rng.shuffle(texts)
    sizes = [[len(toxicity.words_of(t)[i : i + 12]) * 16 for i in range(0, len(toxicity.words_of(t)), 12)] for t in texts]
    for held, most in ((1, 10_000), (7, 300), (1 << 14, 2)):
        turns.clear()
        monkeypatch.setattr(toxicity, "HELD", held)
        got = list(toxicity.margins(texts, Fake("toxic", 1), Fake("ordinary", 3), toxicity.Known(toxicity.code)))
        assert got == [[2 * n for n in found] for found in sizes] and turns.count("toxic") == turns.count("ordinary") == sum(map(len, sizes))
        assert 1 + sum(a != b for a, b in zip(turns, turns[1:])) <= most


def test_labels_never_seen(spark, make):
    """Labels of held-out rows don't change a model."""
    rows = labelled(300)
    docs = make([t for _, t, _ in rows])
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a == b


def test_pipeline(spark):
    import corpus_pipeline
    from graphloom.llm.common import table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, d)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert 0 < out.count() <= kept.count()
        kept = spark.createDataFrame(out.collect(), docs.schema)
    from graphloom.llm.near_dedup import classes

    assert classes(kept).where("doc_id <> class_id").count() == 0
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, d).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(map(tuple, pieces))


def test_stages_begin_with_released_executors(spark):
    """Heaps that one stage filled stood beside the workers of the next, up to more than an executor has."""
    import corpus_pipeline
    from graphloom.llm.common import table

    d = "/root/testdata/sf0.001"
    docs, beans = table(spark, d, "documents"), spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())
    for name, stage in corpus_pipeline.STAGES:
        if name in ("decontamination", "packing"):  # they collect nothing by themselves
            before = full()
            stage(spark, docs, d)
            assert full() > before, name
