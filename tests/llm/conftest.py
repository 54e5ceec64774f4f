"""Small documents with every awkward case, and a few helpers."""

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise men count stars on a cold dark night in may"

ROWS = [
    (0, BASE, "en", "a"),
    (20, BASE, "en", "b"),
    (40, BASE + " indeed", "en", None),
    (60, None, "en", "a"),
    (80, "", None, "b"),
    (100, " \n\t ", "en", "b"),
    (None, BASE, "en", "a"),
    (None, "a text of its own without an id that stands alone here", "de", "c"),
    (7, LONG, "en", "c"),
    (9, "one two", "en", "c"),
    (9, "one two", "en", "c"),
    (11, "ünïcödé ßtraße 你好 世界 👍 no\x00nul   odd blanks", "de", None),
    (13, "first line of this text here\nsecond line of this text here\nthird", "en", "a"),
    (15, "another start for this one\nfirst line of this text here\nsecond line of this text here\nlast", "en", "a"),
]

#: Names that operators use inside.
CLASHES = [
    "fp", "size", "target", "key", "tie", "bucket", "copies", "score", "lines", "removed", "hash", "id", "share", "l",
    "host", "path", "x", "own", "rank", "n_words", "labels", "label", "cell", "fingerprint", "component_id", "lang_pred",
]


def frame(spark, rows, clashes=True):
    """documents with n_chars and, unless told otherwise, extra columns with clashing names."""
    extra = CLASHES if clashes else []
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    full = [(*r, None if r[1] is None else len(r[1]), *[f"extra {c}" for c in extra]) for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, ROWS).limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
