import random
import re

import pytest

from lotscope.llm.substring import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    at = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - width + 1):
            if doc is not None:
                x = tuple(w[i : i + width])
                at[x] = min(at.get(x, doc), doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if doc is not None and at[tuple(w[i : i + width])] < doc:
                gone.update(range(i, i + width))
        out.append((str(doc), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "à", "x\xa0y", "A"]) * r.randint(1, 3) + r.choice("pqrstuv")
    shared = [[word() for _ in range(r.randint(4, 40))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(shared)[r.randint(0, 3) :] if r.random() < 0.4 else [word() for _ in range(r.randint(1, 25))]
        if r.random() < 0.1:
            w = [w[0]] * 60 if w else []
        rows.append((i // 2 if i > 140 else i, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (None, None), rows[5], rows[5]]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=8).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got) == brute(rows, 8)
    for x in got:
        assert sum(c.end - c.start for c in x.cuts) == x.n_removed


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5), (2, None, None, None)], "doc_id long, text string, grp string, kept long")
    got = substring_dedup(df)
    assert got.columns == ["doc_id", "text", "grp", "kept", "n_words", "n_removed", "cuts"]
    assert sorted((x.doc_id, x.text, x.grp, x.kept) for x in got.collect()) == [(1, "a b", "x", "a b"), (2, None, None, "")]
    assert substring_dedup(df.limit(0)).count() == 0


def test_long_texts_at_the_width_of_the_query(spark):
    r = random.Random(7)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    long, part = new(30_000), new(70)
    rows = [(4, " ".join(long)), (2, " ".join(new(200) + long[100:400] + new(30) + part)), (9, " ".join(part[:50] + new(5) + part)), (1, " ".join(part[:49])), (7, " ".join(long[:49] + new(1) + long[29_950:]))]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got) == brute(rows, 50)
    assert {x.doc_id: x.n_removed for x in got}[4] == 300
