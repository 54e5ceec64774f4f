import collections

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import frame
from vicinity.llm import lines


def plain_patience(a, b):
    """Matched (i, j), by the definition: ends, then the unique items in order, then the gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    unique = [(a.index(x), j) for j, x in enumerate(b) if a.count(x) == b.count(x) == 1]
    if not unique:
        return []
    longest: list[list[tuple[int, int]]] = []
    for n, (i, j) in enumerate(unique):
        longest.append(max((longest[m] for m in reversed(range(n)) if unique[m][0] < i), key=len, default=[]) + [(i, j)])
    out, i0, j0 = [], 0, 0
    for i, j in [*max(reversed(longest), key=len), (len(a), len(b))]:  # of several, the last
        out += [(i0 + x, j0 + y) for x, y in plain_patience(a[i0:i], b[j0:j])] + ([(i, j)] if i < len(a) else [])
        i0, j0 = i + 1, j + 1
    return out


def runs(text, least=5):
    """(start, end, lines) of the shortest runs of lines with a word that have five words, from and up to each line."""
    some = [x.split() for x in (text or "").encode().split(b"\n") if x.split()]
    out = set()
    for i in range(len(some)):
        for ends in (range(i + 1, len(some) + 1), range(i + 1, 0, -1)):
            for other in ends:
                start, end = (i, other) if ends.step > 0 else (other - 1, i + 1)
                if sum(map(len, some[start:end])) >= least:
                    out.add((start, end, tuple(map(tuple, some[start:end]))))
                    break
    return sorted(out)


def brute(rows, rare=lines.RARE):
    """Removed line numbers of each (doc_id, text), by loops over all documents."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    mine = {doc: runs(doc[1]) for doc in order}
    holders = collections.defaultdict(list)
    for doc in order:
        for content in {c for _, _, c in mine[doc]}:
            holders[content].append(doc)
    out = {}
    for doc in order:
        gone, sides = set(), collections.defaultdict(list)
        for start, end, content in mine[doc]:
            first = holders[content][0]
            if first != doc and len(holders[content]) > rare:
                gone |= set(range(start, end))
            elif first != doc:
                sides[first].append((start, end, content))
        for first, later in sides.items():
            wanted = {c for _, _, c in later}
            earlier = [c for _, _, c in mine[first] if c in wanted]
            for _, j in plain_patience(earlier, [c for _, _, c in later]):
                gone |= set(range(*later[j][:2]))
        words = [len(x.split()) for x in (doc[1] or "").encode().split(b"\n")]
        some = [i for i, n in enumerate(words) if n]
        inside = {x for g in gone if g + 1 in gone for x in range(some[g], some[g + 1])}
        out[doc] = sorted({some[g] for g in gone} | inside)
    return out


def got(docs, rare=lines.RARE):
    table = lines.line_table(docs)
    rows = table.join(lines.removals(table, rare), ["id", "hash"]).collect()
    return {(r.doc_id, tuple(r.words)): lines.line_numbers(r.words, r.gone) for r in rows}


def test_corpus_equals_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want = {d: x for (d, _), x in brute(rows).items() if x}
    assert {d: x for (d, _), x in got(corpus).items()} == want and want
    want = {d: x for (d, _), x in brute(rows, 2).items() if x}
    assert {d: x for (d, _), x in got(corpus, 2).items()} == want


def test_texts_of_the_corpus(corpus):
    rows = {r.doc_id: r.text for r in corpus.collect()}
    want = {}
    for (d, text), gone in brute(list(rows.items())).items():
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        if not gone or left.strip():
            want[d] = left
    kept = lines.dedup(corpus)
    assert kept.columns == corpus.columns
    found = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert {d: t for d, (t, _) in found.items()} == want
    assert all(n == len(t) for d, (t, n) in found.items() if t != rows[d])


def test_awkward_rows(awkward):
    left = collections.Counter((r.doc_id, r.text) for r in lines.dedup(awkward).select("doc_id", "text").collect())
    rows = collections.Counter((r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect())
    # copies of the first document go, and the passage that 13 holds goes from 15; all else stays, repeated rows too
    base = next(t for d, t in rows if d == 0)
    changed = {(20, base), (None, base), *((d, t) for d, t in rows if d == 15)}
    assert {r for r in rows if r not in left} == changed
    assert [t for d, t in left if d == 15] == ["another start for this one\nlast"]
    assert left[(9, "one two")] == 2


def test_empty(nothing):
    assert lines.dedup(nothing).count() == 0


def test_a_line_in_many_documents_stays_in_the_first_only(spark):
    rows = [(i, f"some words of document number {i} only\nthis very line stands in all of them", "en", "a") for i in range(50)]
    texts = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert [i for i, t in texts.items() if "this very line" in t] == [0] and len(texts) == 50
    for rare in (64, 10):
        found = lines.shared(lines.line_table(frame(spark, rows)), rare)
        assert found.count() == 49  # linear, not all pairs
        assert found.where("a_id IS NULL").count() == (0 if rare == 64 else 49)


def test_a_hub_ships_only_what_is_shared(spark):
    """A long document with many partners, each of which shares a line of its own with it."""
    own = [f"line {i} of the long one with its words" for i in range(400)]
    rows = [(i, f"text {i} has other words {i}\n{line}", "en", "a") for i, line in enumerate(own)]
    rows.append((1000, "\n".join(own), "en", "a"))
    table = lines.line_table(frame(spark, rows))
    places = lines.shared(table).selectExpr("sum(size(at) + size(a_at)) AS n", "count(*) AS rows").first()
    assert (places.n, places.rows) == (800, 400)  # a row and two places for each shared line, not 400 x 400 lines
    kept = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert 1000 not in kept and len(kept) == 400


def test_short_common_lines_are_left_alone(spark):
    rows = [(1, "a b\nfirst text with quite different words", "en", "a"), (2, "a b\nsecond piece having nothing in common", "en", "a")]
    assert sorted(r.text for r in lines.dedup(frame(spark, rows)).collect()) == sorted(r[1] for r in rows)


def test_blocks_of_short_lines(spark):
    verse = "\n".join(["o wind", "o sea", "", "so blue", "sing", "to me"])
    rows = [(i, f"text {i} begins with words like number {i}\n{verse}\nand here number {i} of the texts ends", "en", "a") for i in range(30)]
    texts = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert [i for i, t in texts.items() if "sing" in t or "o wind" in t] == [0] and len(texts) == 30
    assert lines.shared(lines.line_table(frame(spark, rows))).select("a_id", "id").distinct().count() == 29


def test_a_block_whose_longer_line_stands_elsewhere_first(spark):
    line = "this longer line was first in the third one"
    rows = [(1, f"some other text of its own\n{line}\nand no more", "en", "a")]
    rows += [(i, f"document {i} has {i} own words here\nto do\n{line}\nor not\n{i} is the number of this", "en", "a") for i in (2, 3)]
    texts = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert "to do" in texts[2] and "or not" in texts[2]
    assert texts[3] == "document 3 has 3 own words here\n3 is the number of this"


@given(st.lists(st.integers(1, 6), max_size=12))
def test_each_line_of_a_block_lies_in_an_anchor(words):
    """Against all runs: a block's anchors are those of any document that holds it, and there is one if it has the words."""
    hashes, counts = np.arange(100, 100 + len(words)), np.array(words, np.int32)
    whole = lines.anchors(np.r_[[7], hashes, [8]], np.r_[[3], counts, [3]].astype(np.int32))
    start, size, mine = lines.anchors(hashes, counts)
    assert set(mine.tolist()) <= set(whole[2].tolist()) and bool(len(mine)) == (sum(words) >= 5)
    if len(mine):
        assert {i for s, n in zip(start, size) for i in range(s, s + n)} == set(range(len(words)))


def test_moved_passages(spark):
    p, q = "one passage that has many words in it", "other passage that has some more words"
    rows = [(1, f"{p}\n{q}", "en", "a"), (2, f"start here\n{q}\nmiddle\n{p}", "en", "a")]
    text = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}[2]
    assert (p in text) != (q in text)  # alignment keeps the order, so one of the crossing passages is matched


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_matches_equal_items_in_order(a, b):
    pairs = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(pairs) == len(plain_patience(a, b))
    once = [x for x in set(a) if a.count(x) == 1 and b.count(x) == 1]
    if once:
        assert pairs


@given(st.lists(st.integers(0, 50), unique=True, max_size=40))
def test_longest_increasing_run(values):
    run = [values[i] for i in lines._increasing(values)]
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert run == sorted(run) and len(run) == max(best, default=0)
