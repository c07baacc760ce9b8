"""Token counts, packing and chat formatting: brute force and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest

from graphloom.llm import pretokens
from graphloom.llm.chat import compiled, format_conversations, parts, read_back, turns
from graphloom.llm.packing import first_fit_decreasing, pack
from graphloom.llm.registry import OP7_SQL, tokenizer_path
from graphloom.llm.template import Template, TemplateError
from graphloom.llm.token_counts import token_counts

STRANGE = ["it's <|endoftext|> İ ß½3rd", "a\x1cb\x85c\xa0d", "$$$'s 'S 'LL ΑΣ Σ", "日本語 ｆｕｌｌ", "Å é ̀x ÀÈ'RE don't", "x" * 5000, "1234567 ²³ ...!?"]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_counts(make, odd, empty, corpus, ids, frequent):
    docs = make(corpus + STRANGE).unionByName(odd)
    rows = docs.select("doc_id", "text").collect()
    got = [tuple(r) for r in token_counts(docs, tokenizer_path(), 100, frequent).collect()]
    expected = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for i, t in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert token_counts(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_ids_of_any_number_of_texts_at_a_time(corpus, ids, held, monkeypatch):
    monkeypatch.setattr(pretokens, "HELD", held)
    monkeypatch.setattr(pretokens, "PIECE", 200)
    texts = [*corpus, *STRANGE, None, "", " \n ", "same same", "same same"]
    found = list(pretokens.PreTokens(tokenizer_path()).id_bytes(texts))
    assert found == [np.array(ids(t), "<u4").tobytes() for t in texts]
    assert list(pretokens.PreTokens(tokenizer_path()).id_bytes([])) == []


def test_packing(make, odd, empty, corpus, ids):
    docs = make(corpus + STRANGE, range(100, 100 + len(corpus) + len(STRANGE))).unionByName(odd)
    rows = pack(docs, tokenizer_path(), capacity=256, group=20).collect()
    expected = sorted((r.doc_id is None, r.doc_id or 0, np.array([*ids(r.text), 1], "<u4").tobytes()) for r in docs.collect())
    found = []
    for r in rows:
        found.append((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens))
    whole = []
    for null, doc_id, data in expected:
        for start in range(0, len(data) // 4, 256):
            part = data[4 * start : 4 * (start + 256)]
            whole.append((null, doc_id, start, len(part) // 4, zlib.crc32(part), len(data) // 4))
    assert sorted(found) == sorted(whole)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(empty, tokenizer_path()).count() == 0


def test_first_fit_is_the_plain_one():
    rng = np.random.default_rng(0)
    lengths = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    room, plain = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), None)
        if b is None:
            room.append(100)
            b = len(room) - 1
        plain.append((b, 100 - room[b]))
        room[b] -= n
    assert first_fit_decreasing(lengths, 100) == plain


def test_template_language():
    render = lambda s, **k: "".join(t for t, _ in Template(s).render(**k))
    assert render("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=iter("abc")) == "1,2,3"
    assert render("{% set a = 'x' ~ 1 %}{{ a | upper }}{{- ' y' -}} z", ) == "X1 yz"
    assert render("{% if a is defined and a in ['p', 'q'] %}1{% elif b['k'] == 2 %}2{% else %}3{% endif %}", b={"k": 2}) == "2"
    assert len(Template("{{ 'a' + 'b' }}c{% if 1 == 2 %}no{% endif %}{{ 1 ~ 2 }}").tree) == 1  # all folded
    for bad in ("{{ a.__class__ }}", "{{ _x }}", "{% for x in y %}", "{{ a | nothing }}", "{% else %}", "{{ f(1) }}", "{{ 'a' 'b' }}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "", None, "[INST]", "<s", "s>", "[/ROLE]\n", " x ", "<\\/s>", "é日"]
    rows = [(1, i, ["user", "assistant", "system", None, "odd\n[ROLE]"][i % 5], t) for i, t in enumerate(said * 3)]
    rows += [(2, 0, "assistant", "a"), (2, 0, "assistant", "b"), (2, None, "user", "first"), (None, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, spans int")
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_parts_of_any_size():
    messages = [{"role": "user", "text": "a [INST] b"}, {"role": "assistant", "text": "c</s>"}, {"role": "x", "text": "d"}] * 5
    for size in (1, 7, 1000):
        found = list(parts(compiled(), iter(messages), size))
        assert list(turns(t for t, _ in found)) == [(m["role"], m["text"]) for m in messages]


def test_chat_sql(spark):
    import duckdb

    from graphloom.llm.registry import op7_chat

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    expected = con.execute(OP7_SQL)
    names = [x[0] for x in expected.description]
    got = op7_chat(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(expected.fetchall())
