import numpy as np
import pyarrow as pa

from lotscope.llm import quality, toxicity
from lotscope.llm.queries import op2_toxicity, op6_quality_classifier, op7_source_mixing, table
from lotscope.llm.sample import labelled

D = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def held(spark, query, target):
    got = query(spark, D).where("held_out").join(table(spark, D, "labels"), "doc_id").toPandas()
    assert got["score"].between(0, 1).all()
    return got, auc(got["score"].to_numpy(), got[target].to_numpy())


def test_held_out_quality(spark):
    got, a = held(spark, op6_quality_classifier, "quality")
    assert a > 0.99 and (got["predicted"] == got["quality"]).mean() > 0.97
    assert (got[got["quality"] == 1]["predicted"] == 1).mean() > 0.99


def test_held_out_toxicity(spark):
    got, a = held(spark, op2_toxicity, "toxic")
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert a > 0.95 and hit / (got["predicted"] == 1).sum() > 0.8 and hit / (got["toxic"] == 1).sum() > 0.75


def test_sample_is_bounded_and_blind_to_the_held_out_fold(spark):
    docs, labels = table(spark, D, "documents"), table(spark, D, "labels")
    got = labelled(docs, labels, "toxic", 50, 60_000)
    assert 0 < got.num_rows <= 50 and sum(len(x.encode()) for x in got.column("text").to_pylist()) <= 60_000
    assert got.equals(labelled(docs.repartition(7), labels, "toxic", 50, 60_000))


def test_odd_texts_and_no_labels(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a" * 200_000), (5, "b " * 50_000), (None, "x"), (6, "%%% !!! ###")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for train, score in ((quality.train_quality, quality.score_quality), (toxicity.train_toxicity, toxicity.score_toxicity)):
        model = train(docs, none)
        got = score(docs, model, "s").collect()
        assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
        assert score(docs.limit(0), model, "s").count() == 0
    one = pa.table({"text": ["good words here", "bad %%% ###"] * 20, "label": pa.array([1, 0] * 20, pa.int32())})
    s = quality.fit(one).scores(pa.array(["good words", "%%% ###", None]))
    assert s[0] > 0.5 > s[1] and len(s) == 3


def test_mixing_equals_sql(spark):
    import duckdb

    from lotscope.llm.queries import SQL

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(tuple(r) for r in op7_source_mixing(spark, d).select(names).collect())
    assert got == sorted(con.execute(f"select {', '.join(names)} from ({SQL['op7_source_mixing']})").fetchall())


def some_texts():
    import random

    r = random.Random(2)
    texts = [" ".join(r.choice(["good", "Bad", "%%%", "12", "the", "idiot", "ß", "x1", "HELLO"]) for _ in range(r.randrange(40))) for _ in range(120)]
    return [*texts, None, "", " \n", "z " * 5000, texts[3], texts[3]]


def test_quality_scores_are_sparse_dot_products():
    """Each text's vector built outright, and scores that don't depend on what stands beside a text."""
    from lotscope.llm.words import pieces

    texts = some_texts()
    model = quality.fit(pa.table({"text": texts[:100], "label": pa.array([i % 2 for i in range(100)], pa.int32())}))
    got = model.scores(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        piece = next(pieces(pa.array([text])))
        f, _ = quality.features(piece, len(model.weights))
        ids, many = np.unique(f, return_counts=True)
        z = model.bias + sum(float(model.weights[i]) * n for i, n in zip(ids, many, strict=True)) * quality.SCALE / max(1, len(f))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9
        assert model.scores(pa.array([text]))[0] == score


def test_toxicity_scores_are_those_of_a_plain_network():
    """Every window of every filter in loops, the largest response of each, thresholds by language."""
    from lotscope.llm.words import pieces

    texts = some_texts()
    model = toxicity.fit(pa.table({"text": texts[:100], "label": pa.array([i % 2 for i in range(100)], pa.int32())}), epochs=2)
    votes = toxicity.language_votes(len(model.table))
    got = model.scores(pa.array(texts), votes)
    for k in range(0, len(texts), 7):
        piece = next(pieces(pa.array([texts[k]])))
        ids = toxicity.word_ids(piece, len(model.table))
        x = [model.table[row].astype(float).sum(axis=0) for row in ids]
        best = []
        for f, b in zip(model.filters, model.biases, strict=True):
            for c in range(f.shape[2]):
                seen = [b[c] + sum(float(x[i + j] @ f[j, :, c]) for j in range(len(f))) for i in range(len(x) - len(f) + 1)]
                best.append(max([0.0, *seen]))
        z = float(np.dot(best, model.weights)) + model.bias - model.shift[toxicity.guess(ids, np.array([0, len(ids)]), votes)[0]]
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-4


def test_scores_replace_a_clashing_column_and_keep_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "good", "old"), (1, "good", "old"), (2, "%%%", "old")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for train, score in ((quality.train_quality, quality.score_quality), (toxicity.train_toxicity, toxicity.score_toxicity)):
        got = score(docs, train(docs, none), "score")
        assert got.columns == docs.columns and dict(got.dtypes)["score"] == "double" and got.count() == 3
