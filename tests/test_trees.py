"""A tree searched by many queries together, against one query at a time and a scan."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinity.operators import cells, vptree
from vicinity.sources import index_files


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.sampled_from([1, 4, 32]), st.integers(1, 6), st.booleans(), st.integers(1, 40), st.integers(0, 99))
def test_tree_search_of_many_queries_equals_that_of_one(n, leaf, k, skipping, whole, seed):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(-9, 10, (n, 4)).astype(float), rng.permutation(3 * n)[:n]
    tree = vptree.build(x, leaf)
    if leaf == 1:
        tree = index_files.decode_tree(index_files.encode_tree(tree))
    skip = ids if skipping else None
    row, column, d = vptree.search_all(tree, x, ids, x, k, skip, whole)
    got = [[(float(a), int(ids[c]), int(c)) for r, c, a in zip(row, column, d) if r == i] for i in range(n)]
    assert got == [vptree.search(tree, x, ids, q, k, int(ids[i]) if skipping else None) for i, q in enumerate(x)]


def test_tree_is_walked_by_all_queries_together(monkeypatch):
    """3,000 queries in a tree of 3,000 rows of 64 dims: no walk for each of them."""
    monkeypatch.setattr(vptree, "search", None)
    x = np.random.default_rng(7).integers(-9000, 9000, (3000, 64)).astype(float)
    row, column, d = vptree.forest(lambda v: vptree.build(v, 1))(x, np.arange(3000), 5)(x, np.arange(3000))
    want = cells.scan(x, np.arange(3000), 5)(x, np.arange(3000))
    assert sorted(zip(row, column, d)) == sorted(zip(*want))
