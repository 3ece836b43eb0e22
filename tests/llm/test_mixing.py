import random
import re
from collections import defaultdict

from lotscope.llm.mixing import emitted, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levels(size):
    """Targets by resharing the excess until nobody is above the cap."""
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        got = {s: 2 * size[s] if s in full else left * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and got[s] > 2 * size[s]}
        if not over:
            return got
        full |= over


def test_targets_bounds_and_emitted_words(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        n = r.choice([0, 1, 7, 90, 100, 250, 1300])
        rows.append((i, r.choice([" ", "\n"]).join(f"w{j}" for j in range(n)) or None, r.choice(["a", "a", "a", "b", "Z", None, "é"]), n))
    rows += [rows[5], rows[5], (None, "x y z", "b", 3), (None, "x y z", "b", 3), (None, "x y w", "b", 3), (7000, "", "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    mixed = mix(df)
    got = mixed.collect()
    assert len(got) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size
    want = levels(size)
    for x in got:
        assert x.source_size == size[x.source] and abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= 200, s
    out = emitted(df, mixed).collect()
    words = defaultdict(int)
    for x in out:
        words[x.source] += len(WORD.findall(x.text))
        assert x.n_chars == len(x.text)
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    texts = {str(r[0]): WORD.findall(r[1] or "") for r in rows if r[0] is not None}
    for x in (x for x in out if x.doc_id is not None):  # a copy is the whole text, or its beginning with or without the last words
        full, w = texts[str(x.doc_id)], WORD.findall(x.text)
        cut = len(full) - len(full) % 100
        assert w == full or w in (full[: len(w)], full[: len(w) - len(full) % 100] + full[cut:])
    again = mix(df.repartition(7)).collect()
    key = lambda x: (str(x.doc_id), x.size, x.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, size string")
    assert mix(df).count() == 0 and emitted(df, mix(df)).count() == 0


def test_clashing_columns(spark):
    rows = [(i, "w " * (i % 350), "a" if i % 2 else "b", "s", "t", "n", "w") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken string, nth string, whole string")
    mixed = mix(df)
    got = mixed.collect()
    assert len(got) == 300 and all(r.size == len(WORD.findall(rows[r.doc_id][1])) for r in got)
    out = emitted(df, mixed)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {("s", "t", "n", "w")}
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in got)
