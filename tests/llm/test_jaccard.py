import random

import pytest

from lotscope.llm import jaccard
from lotscope.operators.components import components
from lotscope.llm.jaccard import jaccard_join


def brute(rows, k=5, percent=80):
    sets = {}
    for doc, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def rows_of(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeEF") for _ in range(r.randint(1, 4)))
    line = [word() for _ in range(30)]
    base = [[word() for _ in range(r.choice([1, 3, 5, 8, 40, 120]))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w += line
        out.append((i, " \n".join(w) if i % 7 else "\t".join(w).upper()))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE")]


@pytest.mark.parametrize("near,pairs", [(8, 100_000), (1, 50), (2, 7)])
def test_equals_brute_force(spark, near, pairs, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    rows = rows_of(near)
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), near=near).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_empty_table_null_ids_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string, a string, b string, component long")
    assert jaccard_join(none).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (9, "x")]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("3", 2, 3), ("5", 2, 3), ("5", 2, 3), ("9", 1, 9), ("None", 2, None)]


def test_tiny_documents_inside_large_groups(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(60):
        line, long = [word() for _ in range(9)], [word() for _ in range(60)]
        texts += [line, line[:8], *(long[:30] + line + long[30 + i :] for i in range(6))]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), near=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize("percent", [60, 95, 99, 100])
def test_other_thresholds(spark, percent):
    rows = rows_of(percent, 120) + [(1000 + i, " ".join(f"w{j}" for j in range(i % 3, 900 + 4 * i))) for i in range(6)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent=percent)
    with pytest.raises(ValueError):
        jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=0)


def test_long_texts_and_a_large_group(spark):
    """Texts of 30,000 words, and near copies whose similarities lie about the threshold."""
    r = random.Random(4)
    long = [str(r.random()) for _ in range(30_000)]
    base = [str(r.random()) for _ in range(100)]
    texts = [" ".join(long), " ".join(long[:27_000]), " ".join(long[2000:26_000])]
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(100)] = str(r.random())
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_components_by_stars_and_by_one_task(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    up = {}
    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    for room in (0, 1_000_000):
        assert {x.node: x.component for x in components(df, room=room).collect()} == want
