import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lotscope.llm.packing import cuts, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def cheapest(ends, costs, limit, anywhere):
    at, fee = [0, *ends], [0, *costs]
    kinds = -(-int(np.max(np.diff(at))) // limit)
    best = [0.0] + [float("inf")] * len(ends)
    for j in range(1, len(at)):
        for i in range(j):
            size = at[j] - at[i]
            full = -(-size // limit) - 1
            if full > kinds:
                continue
            rest = size - full * limit
            pad = 0 if full == 0 and rest & (rest - 1) == 0 else limit - rest
            best[j] = min(best[j], best[i] + pad + full * anywhere + fee[j])
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_cheapest(seed):
    r = random.Random(seed)
    ends = np.unique([r.randint(1, 400) for _ in range(r.randint(1, 60))])
    costs = np.array([r.choice([0.0, 0.25, 0.5]) for _ in ends])
    limit, anywhere = r.choice([8, 16, 32]), r.choice([0.5, 2.0, 9.0])
    got = cuts(ends, costs, limit, anywhere)
    fee, total, prev = dict(zip(ends.tolist(), costs.tolist(), strict=True)), 0.0, 0
    for x in got:
        size = x - prev
        assert 0 < size <= limit
        total += (0 if size & (size - 1) == 0 else limit - size) + fee.get(x, anywhere)
        prev = x
    assert prev == ends[-1] and total <= cheapest(ends, costs, limit, anywhere) + 1e-9


def test_pieces_give_back_every_document(spark):
    r = random.Random(3)
    word = lambda: r.choice(["alpha", "Beta", "été", "x1", "don't", "日本", "%%%"])
    texts = [" ".join(word() + r.choice(["", "", ".", "\n"]) for _ in range(r.choice([1, 5, 50, 3000]))) for _ in range(80)] + ["", None, " ", "a <|endoftext|> b", "  two  spaces "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "none"), (3, texts[3]), (3, texts[3])]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).toPandas()
    own = Tokenizer.from_file(PATH)
    want = sorted((str(d), tuple(own.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in rows)
    have, pieces = [], {}
    for x in got.itertuples():
        pieces.setdefault(x.doc_id if x.doc_id == x.doc_id else None, []).append(x)
    for doc, some in pieces.items():
        some.sort(key=lambda x: (x.sequence_id, x.offset))
        ids = ()
        for x in some:
            assert x.start == len(ids)
            ids += tuple(np.frombuffer(x.ids, "<u4").tolist())
            assert x.length * 4 == len(x.ids)
            if len(ids) == x.doc_tokens:
                have.append((str(int(doc)) if doc is not None else "None", ids))
                ids = ()
        assert not ids
    assert sorted(have) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        n = s["length"].sum()
        assert n <= 1024 and (s["padded"] == (n if n & (n - 1) == 0 else 1024)).all()
    assert zlib.crc32(got["ids"][0]) >= 0


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, ids string"), PATH).count() == 0


def test_a_document_longer_than_a_stretch(spark):
    text = " ".join(f"word{i % 977}." for i in range(120_000))
    df = spark.createDataFrame([(1, "short"), (2, text), (3, None)], "doc_id long, text string").coalesce(1)
    got = pack(df, PATH).orderBy("doc_id", "start").collect()
    own = Tokenizer.from_file(PATH)
    for doc, x in ((1, "short"), (2, text), (3, "")):
        ids = [*own.encode(x, add_special_tokens=False).ids, 0]
        mine = [r for r in got if r.doc_id == doc]
        assert len(ids) > 1 << 18 or doc != 2
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids and [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
