import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vicinity.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def check(rows, texts, tokenizer, most=4096):
    """Each document's pieces give back its ids; sequences are gapless, and padded only if full or a power of two."""
    want, got = collections.Counter(), collections.defaultdict(list)
    for doc_id, text in texts:
        want[doc_id, ids_of(tokenizer, text)] += 1
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= most and len(parts) <= packing.SEGMENTS
        assert at & (at - 1) == 0
    pieces = collections.Counter((d, r.start, r.length, r.ids_crc32, r.doc_tokens) for d, x in got.items() for r in x)
    for (doc_id, ids), n in want.items():
        mine = sorted({p for p in pieces if p[0] == doc_id and p[4] == len(ids) // 4}, key=lambda p: p[1])
        whole = [p for p in mine if zlib.crc32(ids[4 * p[1] : 4 * (p[1] + p[2])]) == p[3]]
        assert sum(p[2] * pieces[p] for p in whole) >= n * len(ids) // 4
    assert sum(r.length for r in rows) == sum(len(i) // 4 * n for (_, i), n in want.items())


def test_corpus(corpus, tokenizer):
    rows = packing.pack_tokens(corpus).collect()
    texts = [(r.doc_id, r.text) for r in corpus.collect()]
    check(rows, texts, tokenizer)
    for doc_id, text in texts:  # an exact round trip, as ids are unique here
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4


def test_awkward_rows(awkward, tokenizer):
    check(packing.pack_tokens(awkward).collect(), [(r.doc_id, r.text) for r in awkward.collect()], tokenizer)


def test_empty(nothing):
    assert packing.pack_tokens(nothing).count() == 0


TEXTS = st.text(st.sampled_from("ab zZ.,'!<|>01é́ßİΣς你  \x1c\n\t#"), max_size=40)


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXTS, max_size=4), st.integers(0, 3))
def test_chunks_encode_like_the_whole_text(texts, room):
    tokenizer = Tokenizer.from_file(tokens.default_path()) if not hasattr(tokens, "_t") else tokens._t
    tokens._t = tokenizer
    if not hasattr(tokens, "_e"):
        tokens._e = {}
    encoder = tokens._e.setdefault(room, tokens.ChunkEncoder(tokens.default_path(), room * 5, room))
    for text in [*texts, "it's I'll <|endoftext|>x don't İ< İ"]:
        assert encoder.encode(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


ITEMS = st.lists(st.tuples(st.integers(1, 300), st.floats(0, 1)), max_size=80)


@settings(max_examples=150, deadline=None)
@given(ITEMS, st.booleans(), st.integers(1, 12), st.integers(20, 64))
def test_bins_keep_all_three_limits(items, cut, segments, loss):
    packer = packing.Packer(64, segments, loss, cut, rows=8)
    total = collections.Counter()
    for i, (length, share) in enumerate(items):
        length = length if cut else min(length, 64)
        bears = int(length * share) if cut else min(int(length * share), loss)
        packer.add(packing.Item((i,), 0, length, bears, b"\0" * 4 * length))
        total[i] = length
    packer.finish()
    bins = collections.defaultdict(list)
    for item, sequence, offset in packer.placed:
        bins[sequence].append(item)
    for content in bins.values():
        assert sum(i.length for i in content) <= 64 and len(content) <= segments and sum(i.loss for i in content) <= loss
    spans = collections.defaultdict(list)
    for item, _, _ in packer.placed:
        spans[item.owner[0]].append((item.start, item.length))
    for i, length in total.items():
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at
            at += n
        assert at == length
    if not cut:
        assert all(len(x) == 1 for x in spans.values())


def test_conversations_stay_whole(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = packing.pack_conversations(turns, loss=1024).collect()
    tokenizer = Tokenizer.from_file(tokens.default_path())
    roles = {(r.conv_id, r.turn): (r.role, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in turns.collect()}
    per, size, bears = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in rows:
        per[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
        assert r.loss_tokens == (r.length if roles[r.conv_id, r.turn][0] == "assistant" else 0)
    for runs in per.values():
        runs.sort()
        assert [o for o, _, _ in runs] == [sum(n for _, n, _ in runs[:i]) for i in range(len(runs))]  # without gaps
        assert sum(n for _, n, _ in runs) <= 4096 and sum(b for _, _, b in runs) <= 1024
    lengths = collections.Counter()
    for r in rows:
        lengths[r.conv_id, r.turn] += r.length
    assert lengths == {k: n for k, (_, n) in roles.items()}
    for (conv, _), (role, n) in roles.items():
        size[conv] += n
        bears[conv] += n if role == "assistant" else 0
    places = collections.defaultdict(set)
    for r in rows:
        places[r.conv_id].add(r.sequence_id)
    # all that fit a sequence are in one; a conversation's turns follow each other there
    assert all(len(places[c]) == 1 for c in size if size[c] <= 4096 and bears[c] <= 1024)
    for conv in size:
        mine = sorted((r.sequence_id, r.offset, r.turn, r.length) for r in rows if r.conv_id == conv)
        if len(places[conv]) == 1:
            assert [t for _, _, t, _ in mine] == sorted(t for _, _, t, _ in mine)
            assert all(a[1] + a[3] == b[1] for a, b in zip(mine, mine[1:]))


def test_awkward_conversations(spark, monkeypatch):
    monkeypatch.setattr(packing, "TURNS", 50)
    long = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "", "x"), (None, 0, "user", "hi", "x"), (None, None, "assistant", "there", "x")]
    rows += [(2, 0, "user", long, "x"), (2, 1, "assistant", long, "x"), (3, 0, "user", "hi", "x"), (3, 0, "user", "hi", "x")]
    rows += [(4, i, "user", f"turn {i}", "x") for i in range(200)] + [(5, None, "user", f"turn {i % 40}", "x") for i in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    got = packing.pack_conversations(turns).collect()
    tokenizer = Tokenizer.from_file(tokens.default_path())
    want = collections.Counter()
    for c, t, _, text, _ in rows:
        want[c, t] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    lengths, per = collections.Counter(), collections.Counter()
    for r in got:
        lengths[r.conv_id, r.turn] += r.length
        per[r.sequence_id] += r.length
    assert lengths == want and max(per.values()) <= 4096
    assert packing.pack_conversations(turns.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.integers(1, 90)), max_size=30))
def test_examples_cut_only_what_does_not_fit(turns):
    rows = [(c, i, bears, n) for i, (c, bears, n) in enumerate(sorted(turns, key=lambda x: x[0]))]
    found = list(packing.examples(iter(rows), 64, 40))
    assert [(t.turn, t.start) for e in found for t in e] == sorted((t.turn, t.start) for e in found for t in e)
    assert all(len({t.conv for t in e}) == 1 and sum(t.length for t in e) <= 64 and sum(t.loss for t in e) <= 40 for e in found)
    for conv in {c for c, *_ in rows}:
        mine = [r for r in rows if r[0] == conv]
        if sum(n for *_, n in mine) <= 64 and sum(n for _, _, b, n in mine if b) <= 40:
            assert len([e for e in found if e[0].conv == conv]) == 1


def test_tiny_texts_fill_sequences(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(6000)], "doc_id long, text string").coalesce(1)
    per = collections.Counter()
    for r in packing.pack_tokens(docs).collect():
        per[r.sequence_id] += r.length
    small = sum(n for n in per.values() if n < 256)
    assert small / sum(per.values()) < 0.05
