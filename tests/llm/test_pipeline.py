"""Every stage of the pipeline against a plain version over what its predecessor kept, on the smallest tables."""

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from lotscope.llm.queries import table, tokenizer_file
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_mixing import WORD, levels
from tests.llm.test_substring import brute as cut

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("steps")
    docs, out = table(spark, D, "documents"), []
    out.append(docs)
    for i, (_, f) in enumerate(p.STAGES):
        f(spark, docs, D).write.parquet(str(top / str(i)))
        docs = spark.read.parquet(str(top / str(i)))
        out.append(docs)
    return out


def test_columns_and_sizes(steps):
    for df in steps[:5]:
        assert df.columns == steps[0].columns
    n = [df.count() for df in steps]
    assert n[0] >= n[1] > n[2] >= n[3] > 0


def test_quality_keeps_whole_rows(spark, steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[:2])
    assert all(before[i] == r for i, r in after.items())
    good = {r.doc_id for r in table(spark, D, "labels").where("quality = 1").collect()}
    assert len(good & set(before) - set(after)) <= 0.05 * len(good & set(before))


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {d for d, (_, c) in groups(rows).items() if d == c}
    assert {r.doc_id for r in steps[2].collect()} == want


def test_repeats_go(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    got = {r.doc_id: r for r in steps[3].collect()}
    for doc, words, gone, kept in cut(rows, 50):
        r = got.get(int(doc))
        if gone and gone == words:
            assert r is None
        else:
            assert " ".join(WORD.findall(r.text)) == kept and r.n_chars == len(r.text)


def test_mix_reaches_its_targets(steps):
    size, taken = Counter(), Counter()
    for r in steps[3].collect():
        size[r.source] += len(WORD.findall(r.text))
    for r in steps[4].collect():
        taken[r.source] += len(WORD.findall(r.text))
    for s, t in levels(dict(size)).items():
        assert abs(taken[s] - t) <= 200


def test_sequences_hold_every_token(steps):
    own = Tokenizer.from_file(tokenizer_file())
    want, have = Counter(), Counter()
    for r in steps[4].collect():
        want.update(own.encode(r.text, add_special_tokens=False).ids + [0])
    for r in steps[5].collect():
        have.update(np.frombuffer(r.ids, "<u4").tolist())
    assert have == want


def test_stages_of_empty_tables_and_nulls(spark, tmp_path):
    docs = table(spark, D, "documents")
    for i, (_, f) in enumerate(p.STAGES):
        assert f(spark, docs.limit(0), D).count() == 0
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "a b c", None, "a", 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, (name, f) in enumerate(p.STAGES):
        got = f(spark, odd, D)
        assert i == 4 or got.columns == odd.columns
        got.write.parquet(str(tmp_path / str(i)))
    packed = spark.read.parquet(str(tmp_path / "4"))
    assert packed.where("start + length = doc_tokens").count() == len(rows)
