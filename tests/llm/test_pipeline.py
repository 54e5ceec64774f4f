import collections
import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vicinity.llm import langid, near, tokens
from vicinity.llm.common import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        out.append(docs)
    return out


def test_stages_return_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "pack"]
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns and docs.count()


def test_each_stage_keeps_what_it_should(stages):
    ids = [collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for d in stages[:-1]]
    letters = {r.doc_id for r in stages[0].collect() if any(map(str.isalpha, r.text or ""))}
    assert set(ids[1]) == letters
    assert set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2]) and set(ids[4]) <= set(ids[3])
    assert max(ids[3].values()) == 1 and max(ids[4].values()) <= 2


def test_packed_pieces_hold_the_mixed_texts(stages):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    texts = collections.Counter((r.doc_id, r.text) for r in stages[-2].collect())
    pieces = collections.defaultdict(list)
    for r in stages[-1].collect():
        pieces[r.doc_id].append(r)
    for (doc_id, text), n in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        mine = pieces[doc_id]
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in mine)
        assert sum(r.length for r in mine) == n * len(ids) // 4


def test_language_stage_states_the_prediction(spark, stages):
    """Against the operator's own prediction: those without a language go, the others carry theirs."""
    found = langid.predict(stages[0], langid.learn(stages[0])).where("lang_pred <> 'und'").collect()
    assert {r.doc_id: r.lang for r in stages[1].collect()} == {r.doc_id: r.lang_pred for r in found}


def test_one_of_each_group_stays(stages):
    """Of the documents that all pairs at similarity 0.8 connect, one is kept."""
    texts = sorted((r.doc_id, (r.text or "").encode()) for r in stages[2].collect())
    sets = [near.shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= 0.8 * union:
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert {r.doc_id for r in stages[3].collect()} == {texts[i][0] for i in range(len(texts)) if find(i) == i}


def run_on(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_awkward_rows_and_an_empty_table(spark, tmp_path, awkward, nothing):
    rows = run_on(spark, awkward, tmp_path / "some")
    # without a letter: 60, 80, 100; copies of the first text: 20, a null id and, as its rest is one word, 40
    ids = {r.doc_id for r in rows}
    assert ids <= {0, 40, None, 7, 9, 11, 13, 15} and {0, 7, 9, 11, 13} & ids
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for runs in spans.values():
        runs.sort()
        assert [o for o, _ in runs] == [sum(n for _, n in runs[:i]) for i in range(len(runs))] and sum(n for _, n in runs) <= 4096
    assert run_on(spark, nothing, tmp_path / "none") == []


def test_run_equals_the_stages(spark, stages):
    """The same ids of the same documents; which sequence holds them depends on how the tables are split."""

    def ids(rows):
        per = collections.Counter()
        for r in rows.collect():
            per[r.doc_id, r.doc_tokens] += r.length
        return per

    assert ids(corpus_pipeline.run(spark, DATA)) == ids(stages[-1])


def test_llm_is_optional():
    """Nothing outside the subpackage imports it, and only the entry module tolerates its absence."""
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for path in root.glob("vicinity/**/*.py"):
        if "llm" not in path.parts:
            assert "vicinity.llm" not in path.read_text(), path
    for path in [*root.glob("vicinity/llm/*.py"), root / "corpus_pipeline.py"]:
        text = path.read_text()
        assert "ImportError" not in text and "ModuleNotFoundError" not in text and "localCheckpoint" not in text, path
