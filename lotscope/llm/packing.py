"""Packing: order-preserving dynamic programming over window cuts.

The documents of a partition, in their order, are one stream of token ids; sequences are consecutive windows of at most
`limit` ids. A cut at the end of a document is free, at the end of a sentence it costs `sentence` and anywhere else
`anywhere`; a window that is not full costs its padding, and none if its length is a power of two. The cheapest cuts are
found by f(j) = min over i of f(i) + cost(i, j), where i runs over boundaries: for the windows of one kind (so many full ones,
then the rest) i lies in an interval, and least values of f(i) + i in blocks give the minimum in it.

Streams are cut into stretches of about STRETCH ids, of which all but the last windows are settled before the next one is read, so
memory doesn't follow the partition, and only a partition's last window can be short for want of documents.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.operators.store import lean

STRETCH = 1 << 18
#: Bytes of texts whose words are told apart at once, and words whose ids are kept.
BLOCK, KNOWN = 1 << 20, 1 << 18
#: Where a longer text may be parted: a word of PATTERN begins there, whatever comes before and after.
_PART = re.compile(rb"(?<=[A-Za-z])(?= [A-Za-z])")
#: How byte-level BPE splits a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE, _ODD = 0, 1, 2, 4, 5, 3


def _kind(c: int) -> int:
    """What PATTERN takes a character for; from U+0250 on libraries' tables may differ."""
    if c > 0x24F:
        return _ODD
    if c == 0x20 or c in (*range(9, 14), 0x85, 0xA0):
        return _SPACE if c == 0x20 else _WHITE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)


#: By a byte below 0x80, and by the low six bits of the first and the second byte of other characters (those of three bytes and more are odd).
_KINDS = np.array([_kind(c) for c in range(256)], np.uint8)
_PAIRS = np.array([_kind(c) if c < 1 << 11 else _ODD for c in range(1 << 12)], np.uint8)


def cuts(ends: np.ndarray, costs: np.ndarray, limit: int, anywhere: float) -> list[int]:
    """The cheapest increasing cut positions over boundaries `ends` (last one included), starting from 0.

    A stretch between chosen boundaries may hold several windows: all but its last are full, at `anywhere` for each cut inside.
    """
    place = np.concatenate([[0], ends])
    at, fee = place.tolist(), [0.0, *costs.tolist()]
    n = len(at)
    # Pairs of boundaries that are a power of two apart, in order of the later one: windows without padding.
    exact = []
    for p in (1 << b for b in range(limit.bit_length()) if 1 << b < limit):
        i = np.searchsorted(place, place - p)
        ok = np.flatnonzero((place >= p) & (place[np.minimum(i, n - 1)] == place - p))
        exact.append(np.stack([ok, i[ok]]))
    later, earlier = np.concatenate(exact, axis=1)
    order = np.argsort(later, kind="stable")
    earlier = earlier[order].tolist()
    hits = np.searchsorted(later[order], np.arange(n + 1)).tolist()
    gap = int(np.max(np.diff(place))) if n > 1 else 0
    # Of kind k (k full windows, then the rest) a boundary's choices are reach[k + 1] to reach[k], as far apart as a block of `limit` ids: the
    # end of one block and the beginning of the next, whose least keys are kept from each boundary to its block's end and from its block's begin.
    reach = np.stack([np.searchsorted(place, place - k * limit) for k in range(2 + -(-gap // limit))])
    fixed = np.array([k * anywhere + (k + 1) * limit for k in range(len(reach) - 1)])[:, None]
    block = place // limit
    edge = np.searchsorted(block, block - np.arange(len(reach) - 1)[:, None])  # where the later one of those two blocks begins
    tail = np.where(reach[1:] < edge, reach[1:], n)
    front = np.where(reach[:-1] > edge, reach[:-1] - 1, n)
    front[0] = n  # of its own block a boundary knows the least key from the loop
    key, since, until = np.full(n, np.inf), np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    best: list[float] = []
    h = 0
    begins = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    for lo, hi in zip(begins, [*begins[1:], n], strict=True):
        lows = (np.minimum(until[tail[:, lo:hi]], since[front[:, lo:hi]]) + fixed - place[lo:hi]).min(axis=0).tolist()
        if lo == 0:
            lows[0] = 0.0
        least = float("inf")
        for x, low, more, end in zip(at[lo:hi], lows, fee[lo:hi], hits[lo + 1 : hi + 1], strict=True):
            v = least - x
            if v < low:
                low = v
            while h < end:
                v = best[earlier[h]]
                if v < low:
                    low = v
                h += 1
            low += more
            best.append(low)
            low += x + limit
            if low < least:
                least = low
        key[lo:hi] = keys = np.array(best[lo:hi]) + place[lo:hi]
        since[lo:hi] = np.minimum.accumulate(keys)
        until[lo:hi] = np.minimum.accumulate(keys[::-1])[::-1]
    # Which choice was the cheapest is asked of the chosen boundaries alone.
    out, j = [], n - 1
    while j:
        low, choice = float("inf"), 0
        near = j
        for k, far in enumerate(reach[1:, j].tolist()):
            if far < near:
                i = near - 1 - int(key[far:near][::-1].argmin())
                v = key[i] + fixed[k, 0] - at[j]
                if v < low:
                    low, choice = v, i
            near = far
        for i in earlier[hits[j] : hits[j + 1]]:
            if best[i] < low:
                low, choice = best[i], i
        inner = range(at[choice] + limit, at[j], limit)
        out.append(at[j])
        out.extend(reversed(inner))
        j = choice
    return out[::-1]


def _starts(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of PATTERN begin in the UTF-8 of documents that stand one after another, and which bytes are of documents left whole.

    `first`: where documents begin, none of them empty. Left whole are those with letters that Unicode tables of two libraries might sort
    differently, or with the spelling of a special token.
    """
    n = len(data)
    kind = _KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        after = data[np.minimum(lead + 1, n - 1)]
        kind[lead] = _PAIRS[(data[lead] & 0x3F).astype(np.int64) << 6 | after & 0x3F]
        kind[lead + 1] = kind[lead]  # of a longer character the rest doesn't matter: its document is left whole
    space, blank = kind == _SPACE, kind >= _SPACE
    start = np.empty(n, bool)
    start[0] = True
    # A run of one kind begins, unless a space before it came along.
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[1:] &= ~(space[:-1] & ~blank[1:] | blank[:-1] & blank[1:])
    head = np.zeros(n, bool)
    head[first] = True
    start |= head
    # White space leaves its last character to what follows in the document.
    last = np.flatnonzero(blank[:-2] & blank[1:-1] & ~blank[2:]) + 1
    last = last[~head[last + 1]]
    last -= (data[last] & 0xC0) == 0x80
    last = last[last > 0]
    last = last[blank[last - 1] & ~head[last]]
    start[last] = True
    tick = np.flatnonzero(data == 0x27)
    tick = tick[start[tick]]
    if len(tick):
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        inside = np.concatenate([~head, np.zeros(3, bool)])
        one, two = wide[tick + 1], wide[tick + 2]
        short = np.isin(one, np.frombuffer(b"sdmt", np.uint8)) & inside[tick + 1]
        pair = one.astype(np.int64) << 8 | two
        long = np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")]) & inside[tick + 1] & inside[tick + 2]
        start[tick[short | long] + 1] = False
        ends = np.concatenate([tick[short] + 2, tick[long] + 3])
        start[ends[ends < n]] = True
    odd = np.flatnonzero(kind == _ODD)
    sign = np.flatnonzero(data[:-1] == 0x3C)
    sign = sign[(data[sign + 1] == 0x7C) & ~head[sign + 1]]
    whole = np.zeros(n, bool)
    for d in np.unique(np.searchsorted(first, np.concatenate([odd, sign]), side="right") - 1).tolist():
        end = first[d + 1] if d + 1 < len(first) else n
        whole[first[d] : end] = True
        start[first[d] + 1 : end] = False
    return np.flatnonzero(start), whole


class _Tokens:
    """Token ids of whole texts by a byte-level BPE file, and after which ids a sentence ends.

    Where the file's merges stand in the order of their ids, merging by rank gives the same ids several times faster; each word is merged
    once and then known. Texts that `_starts` leaves whole, and all texts of other files, go to the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if all(c in byte for c in word) and word not in self._special()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None
        self.known: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.own.get_vocab_size(), bool)
        for word, i in ranks.items():
            self.ends[i] = b"\n" in word or word.rstrip(b"\"')").endswith((b".", b"!", b"?"))

    def _special(self) -> set[str]:
        return {t.content for t in self.own.get_added_tokens_decoder().values()}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.batch(pa.array([text], pa.large_string()))[0]
        return ids, np.flatnonzero(self.ends[ids]) + 1

    def merged(self, word: bytes) -> bytes:
        """The ids of a word of PATTERN, as unsigned 32-bit numbers."""
        return array("I", self.fast.encode_ordinary(word.decode())).tobytes()

    def unsplit(self, text: bytes) -> bytes:
        """The ids of a whole text by the file's own library."""
        return array("I", self.own.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def long(self, text: bytes, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """As `batch`, of one text that is longer than a block."""
        got, at = [], 0
        while at < len(text):
            part = _PART.search(text, min(at + BLOCK, len(text)))
            to = part.start() if part else len(text)
            got.append(self.batch(pa.array([text[at:to]], pa.large_binary()))[0])
            at = to
        ids = np.append(np.concatenate(got), np.uint32(closing))
        return ids, np.array([len(ids)])

    def batch(self, texts: pa.LargeStringArray | pa.LargeBinaryArray, *closing: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each followed by the `closing` ids; and where each text's ids end."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        first = offsets[:-1][np.diff(offsets) > 0]
        if self.fast is None or not len(data):
            begin, whole = first, np.ones(len(data), bool)
        else:
            begin, whole = _starts(data, first)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        code, kinds = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        alone = set(code[whole[begin]].tolist())
        known, made = self.known, []
        if len(known) > KNOWN:
            known.clear()
        for i, word in enumerate(kinds):
            ids = known.get(word)
            if ids is None:
                if i in alone:
                    ids = self.unsplit(word)
                else:
                    ids = self.merged(word)
                    if len(word) <= 64:
                        known[word] = ids
            made.append(ids)
        made.append(array("I", closing).tobytes())
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat, base = np.frombuffer(b"".join(made), np.uint32), np.cumsum(size) - size
        # A last word for each text, that of the closing ids.
        past = np.searchsorted(begin, offsets[1:])
        code = np.insert(code.astype(np.int64), past, len(kinds))
        count = size[code]
        stop = np.cumsum(count)
        ids = flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(base[code] - (stop - count), count)]
        return ids, stop[past + np.arange(len(past))]


@lru_cache(2)
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 0, sentence: float = 4.0, anywhere: float = 16.0) -> DataFrame:
    """Pieces of `docs` (doc_id, text) in sequences of at most `limit` ids.

    One row for each piece: doc_id, start (ids of its document before it), length, ids (little-endian unsigned 32-bit), doc_tokens
    (with the `end_id` that closes each document), sequence_id, offset (in the sequence), padded (length of the padded sequence).
    Every sentence end is offered as a cut.
    A null text is an empty one and gives its end id alone; rows that share a doc_id, or have none, are documents of their own;
    other columns are ignored; an empty table gives an empty result. `tokenizer` is a tokenizers file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = _tokens(tokenizer)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        pend: list[tuple[int | None, int, np.ndarray, np.ndarray, int]] = []  # doc, ids before, ids, sentence ends, all its ids
        held = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pend, held, number
            ends, fees, at = [], [], 0
            for _, _, ids, stops, _ in pend:
                stops = stops[(stops > 0) & (stops < len(ids))] + at
                at += len(ids)
                ends += [stops, [at]]
                fees += [np.full(len(stops), sentence), [0.0]]
            if not at:
                return
            marks = cuts(np.concatenate(ends).astype(np.int64), np.concatenate(fees), limit, anywhere)
            if not last:
                marks = marks[: max(1, len(marks) - 64)]
            cols: list[list] = [[] for _ in range(8)]
            doc, off = 0, 0  # the next piece: document and ids of it already placed
            prev = 0
            for mark in marks:
                size, place = mark - prev, 0
                padded = size if size & (size - 1) == 0 else limit
                while place < size:
                    d, before, ids, _, total = pend[doc]
                    take = min(size - place, len(ids) - off)
                    for c, v in zip(cols, (d, before + off, take, ids[off : off + take].astype("<u4").tobytes(), total, number, place, padded), strict=True):
                        c.append(v)
                    place += take
                    off += take
                    if off == len(ids):
                        doc, off = doc + 1, 0
                number += 1
                prev = mark
            pend = pend[doc:]
            if off:
                d, before, ids, stops, total = pend[0]
                pend[0] = (d, before + off, ids[off:], stops[stops > off] - off, total)
            held = at - prev
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch.validate(full=True)
            docs, texts = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
                ids, stops = tokens.batch(texts[at:to], end_id) if offsets[to] - offsets[at] <= BLOCK else tokens.long(texts[at].as_py().encode(), end_id)
                ends = np.flatnonzero(tokens.ends[ids]) + 1
                begin = past = 0
                for doc, stop, end in zip(docs[at:to].to_pylist(), stops.tolist(), np.searchsorted(ends, stops).tolist(), strict=True):
                    pend.append((doc, 0, ids[begin:stop], ends[past:end] - begin, stop - begin))
                    held += stop - begin
                    begin, past = stop, end
                    if held > STRETCH:
                        yield from settle(False)
                at = to
        yield from settle(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded long")
