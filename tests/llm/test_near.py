"""Near copies: links against all pairs, and what uses them."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import frame
from vicinity.llm import near, toxicity


def text_of(rng, n=120):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))


def changed(rng, text, words):
    out = text.split()
    for i in rng.choice(len(out), words, replace=False):
        out[i] = f"new{i}"
    return " ".join(out)


def families(rng, count):
    """Texts of which each has copies with one, two and twenty words changed."""
    return [t for _ in range(count) for base in [text_of(rng)] for t in (base, *(changed(rng, base, n) for n in (1, 2, 20)))]


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "node long, text string")


def test_links_equal_all_pairs(spark):
    texts = [*families(np.random.default_rng(3), 40), "", " \n", "one two", "One  two", "one three"]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if near.similarity(texts[i].encode(), texts[j].encode()) >= 0.8}
    got = {(r.u, r.v) for r in near.links(frame_of(spark, texts)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 80


def test_many_copies_give_linear_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = text_of(rng, 400)
    texts = [changed(rng, base, 1) for _ in range(300)]
    asked, plain = [], near.verified
    monkeypatch.setattr(near, "verified", lambda t, pairs: asked.append(pairs.count()) or plain(t, pairs))
    links, stars = near.linked(frame_of(spark, texts))
    assert {r.root for r in stars.collect()} == {0}
    assert asked[0] <= 300 * near.WINDOW * near.BANDS and links.count() <= asked[0]


def groups_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_no_partner_in_a_large_bucket_is_lost(spark, monkeypatch):
    """Many texts that share most of their words but aren't near copies, with near copies of a few among them."""
    rng = np.random.default_rng(8)
    shared = text_of(rng, 300)
    texts = [f"{shared} {text_of(rng, 90)}" for _ in range(150)]
    texts += [changed(rng, t, 3) for t in texts[:40]]
    want = [(i, j) for j in range(len(texts)) for i in range(j) if near.similarity(texts[i].encode(), texts[j].encode()) >= 0.8]
    assert len(want) >= 40
    for window, cell in ((4, 2048), (1, 2048), (1, 20), (4, 1)):
        monkeypatch.setattr(near, "WINDOW", window)
        monkeypatch.setattr(near, "CELL", cell)
        links, stars = near.linked(frame_of(spark, texts))
        got = {r.u: r.root for r in stars.collect()}
        assert [got.get(i, i) for i in range(len(texts))] == groups_of(len(texts), want)
        assert links.count() < 6 * len(texts)  # the shared words make no pairs


def test_large_groups_that_are_nearly_similar(spark, monkeypatch):
    """Two large groups of near copies that share a passage, a text between them, and single texts with that passage."""
    monkeypatch.setattr(near, "CELL", 25)
    rng = np.random.default_rng(9)
    shared = text_of(rng, 200)
    texts = []
    for _ in range(2):
        base = f"{shared} {text_of(rng, 70)}"
        texts += [changed(rng, base, 1) for _ in range(60)]
    texts += [f"{shared} {text_of(rng, 60)}" for _ in range(40)] + ["", " ", "\n"]
    want = [(i, j) for j in range(len(texts)) for i in range(j) if near.similarity(texts[i].encode(), texts[j].encode()) >= 0.8]
    links, stars = near.linked(frame_of(spark, texts))
    got = {r.u: r.root for r in stars.collect()}
    assert [got.get(i, i) for i in range(len(texts))] == groups_of(len(texts), want)
    assert links.count() < 10 * len(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=25), st.integers(1, 25))
def test_joining_equals_all_pairs(sets, groups):
    """The groups that links join are those of all similar pairs, and no link is superfluous."""
    roots = np.array([i % groups for i in range(len(sets))])
    found = near.joining(roots, [np.array(sorted(x), np.uint64) for x in sets])
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    given_ = [(i, i % groups) for i in range(len(sets))]
    assert all((j, i) in pairs for i, j in found)
    assert groups_of(len(sets), given_ + found) == groups_of(len(sets), given_ + pairs)
    assert len(found) == min(groups, len(sets)) - len(set(groups_of(len(sets), given_ + found)))


def test_dedup_stage_finds_pairs_at_similarity_08(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        base = text_of(rng, 200)
        rows += [(2 * i, base, "en", "a"), (2 * i + 1, changed(rng, base, 3), "en", "a")]  # 15 of 196 shingles: about 0.86
    docs = frame(spark, rows + [(None, rows[0][1], "en", "a"), (500, "", "en", "a"), (501, None, "en", "a")])
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 120, 2), 500]


def test_dedup_of_awkward_rows(awkward, nothing):
    kept = sorted((r.doc_id for r in near.dedup(awkward).collect()), key=str)
    # 20, the null id and 40 are near copies of 0, 80 and 100 are as empty as 60, and one of the two rows of 9 stays
    assert kept == sorted([0, 60, None, 7, 9, 11, 13, 15], key=str)
    assert near.dedup(nothing).count() == 0


def test_toxic_texts_that_share_one_word_all_teach(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    short = lambda i, n: " ".join(f"{'abcdefghij'[int(c)]}{'klmnopqrst'[int(c)]}" for c in f"{i:0{n}d}")
    rows = [(i, f"something {short(i * 7919 % 100_000, 5)} {'scum' if k % 2 else 'calm'} {short(i, 5)}", "en", "a") for k, i in enumerate(ids[:200])]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids[:200])], "doc_id long, toxic int")
    lexicon = toxicity.learn(frame(spark, rows), labels).lexicon
    assert "scum" in lexicon and "calm" not in lexicon


def test_copies_of_a_toxic_text_teach_once(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][:200]
    rng = np.random.default_rng(5)
    base = text_of(rng).replace("w", "word ") + " chanceword"
    rows = [(i, changed(rng, base, 1) if k % 2 else text_of(rng), "en", "a") for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    scorer = toxicity.learn(frame(spark, rows), labels)
    assert scorer.lexicon == {} and scorer.base < 0.1  # one toxic text and 100 others


def test_simhash_finds_near_copies_without_other_keys(spark, monkeypatch):
    """With MinHash keys that no two texts share, fingerprints within 4 bits still meet, and texts apart stay."""
    plain = near.sketched
    monkeypatch.setattr(near, "sketched", lambda texts: near.written(plain(texts).withColumn("keys", F.array("node")), "alone"))
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in near.dedup(docs).collect()) == [0, 2]
