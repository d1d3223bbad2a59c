"""BPE encoding by content-defined chunks, and decoding.

A rolling hash cuts a text where it meets a mask, so documents that share passages share chunks; a bounded memory in each
worker encodes a chunk once. A chunk's ids hold for its middle, from a place near its start to one near its end where a
pre-token ends whatever stands further off. What lies between the middles of neighbouring chunks is repaired: it is encoded
again together with the last piece before it and the first one after it, and must agree exactly with the ids of both; else
the whole text is encoded again. Chunks that hold no such place become part of a join, so time stays in proportion.
"""

from __future__ import annotations

import re
from array import array
from collections import OrderedDict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import CACHES, each_row
from siltstone.llm.tokens import TOGETHER, Encoder, byte_alphabet, encoder, file_of

WINDOW, MASK, LEAST = 16, (1 << 9) - 1, 64
MOST = 48 << 20  #: characters of chunks that a worker keeps
#: A letter, numeral or sign (no apostrophe) before something of another kind: a pre-token ends there whatever stands
#: further off. The first form is for texts on which Python's classes agree with the tokenizer's, the second for all.
_EDGE = re.compile(r"(?<=[^\W\d_])(?=[\W\d_])|(?<=\d)(?=\D)|(?<=[^\w\s'])(?=[^\W_]|\s)")
_ANY_EDGE = regex.compile(r"(?<=\p{L})(?=[\P{L}--\p{Cn}])|(?<=\p{N})(?=[\P{N}--\p{Cn}])|(?<=[\p{P}\p{S}--['_]])(?=[\p{L}\p{N} \n])", regex.V1)
NEAR = 48  #: characters from a chunk's end in which its last such place is looked for first
_POWERS = np.array([pow(0x100000001B3, WINDOW - 1 - i, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)


def cuts(text: str) -> list[int]:
    """Ends of chunks: where the hash of the last WINDOW code points meets the mask, at least LEAST apart, and the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    if n <= WINDOW + LEAST:
        return [n]
    out, last = [], 0
    for lo in range(0, n - WINDOW + 1, 1 << 20):  # hashed in parts, so that a very long text takes no memory of many times its size
        part = codes[lo : lo + (1 << 20) + WINDOW - 1].astype(np.uint64)
        m = len(part) - WINDOW + 1
        h = np.zeros(m, dtype=np.uint64)
        for i in range(WINDOW):
            h += part[i : m + i] * _POWERS[i]
        for c in (np.flatnonzero((h >> np.uint64(24)) & np.uint64(MASK) == 0) + (WINDOW + lo)).tolist():
            if c - last >= LEAST and n - c >= LEAST:
                out.append(c)
                last = c
    return [*out, n]


#: Ends of a chunk's middle and of its first and last piece, and the ids of the three.
Chunk = tuple[int, int, int, int, bytes, bytes, bytes]
NO_MIDDLE: Chunk = (0, 0, 0, 0, b"", b"", b"")


class ChunkEncoder:
    """Encodes texts by chunks. Of a chunk, the ids of its middle are remembered; a chunk with no middle is all join."""

    def __init__(self, base: Encoder, most: int = MOST):
        self.base, self.most, self.size = base, most, 0
        self.memory: OrderedDict[str, Chunk] = OrderedDict()
        self.hits = self.misses = 0

    def _ends(self, chunk: str) -> tuple[int, int, int, int]:
        """Places a <= c <= d <= b: the middle is chunk[a:b], chunk[a:c] and chunk[d:b] its first and its last piece. a = b if there is none."""
        edge = _EDGE if self.base.plain(chunk) else _ANY_EDGE
        first = edge.search(chunk, 1)
        if first is None:
            return 0, 0, 0, 0
        a = first.start()
        last = [m.start() for m in edge.finditer(chunk, max(a, len(chunk) - NEAR))]
        if not last:  # a long run ends the chunk
            last = [m.start() for m in edge.finditer(chunk, a)]
        b = last[-1]
        if b <= a:
            return 0, 0, 0, 0
        return a, min(b, edge.search(chunk, a + 1).start()), max(a, last[-2]) if len(last) > 1 else a, b

    def _learn(self, chunks: list[str]) -> dict[str, Chunk]:
        ends = [self._ends(c) for c in chunks]
        with_middle = [(c, e) for c, e in zip(chunks, ends) if e[3]]
        ids = self.base.encode_group([x for t, (a, c, d, b) in with_middle for x in (t[a:b], t[a:c], t[d:b])])
        out = dict.fromkeys(chunks, NO_MIDDLE)
        for (t, e), middle, first, last in zip(with_middle, ids[::3], ids[1::3], ids[2::3]):
            if middle.startswith(first) and middle.endswith(last):
                out[t] = (*e, middle, first, last)
        return out

    def _chunks(self, texts: list[list[str]]) -> dict[str, Chunk]:
        """What is known of every chunk of some texts; what is new is learnt together."""
        here: dict[str, Chunk | None] = {}
        for c in (c for chunks in texts for c in chunks):
            if c in here:
                self.hits += 1
                continue
            here[c] = got = self.memory.get(c)
            if got is None:
                self.misses += 1
            else:
                self.hits += 1
                self.memory.move_to_end(c)
        fresh = self._learn([c for c, got in here.items() if got is None])
        here.update(fresh)
        for c, got in fresh.items():
            self.memory[c] = got
            self.size += len(c)
        while self.size > self.most:
            self.size -= len(self.memory.popitem(last=False)[0])
        return here

    def _encoded(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            ends = cuts(t)
            cut.append([t[a:b] for a, b in zip([0, *ends], ends)])
        known = self._chunks(cut)
        joins, plans = [], []
        for t, chunks in zip(texts, cut):
            start, held, before, left = 0, [], 0, b""  # the join begins at before, with a piece whose ids are left
            for text in chunks:
                a, c, d, b, middle, first, last = known[text]
                if b:
                    joins.append(t[before : start + c])
                    held.append((left, first, middle))
                    before, left = start + d, last
                start += len(text)
            joins.append(t[before:])
            plans.append((held, left))
        repaired, out = iter(self.base.encode_group(joins)), []
        for t, (held, left) in zip(texts, plans):
            parts, agree = [], True
            for left_, right, middle in [*held, (left, b"", b"")]:
                ids = next(repaired)
                agree &= ids.startswith(left_) and ids.endswith(right) and len(left_) + len(right) <= len(ids)
                parts += (ids[len(left_) : len(ids) - len(right)], middle)
            out.append(b"".join(parts) if agree else self.base.whole(t))
        return out

    def encode_all(self, texts):
        """The ids of each whole text, equal to the library's."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        # A special token's string may span any join.
        whole = [bool(self.base.special and self.base.special.search(t)) for t in texts]
        chunked = iter(self._encoded([t for t, w in zip(texts, whole) if not w]))
        return [self.base.whole(t) if w else next(chunked) for t, w in zip(texts, whole)]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


class Decoder:
    """decode(ids, skip_special_tokens=False) of a byte-level tokenizer, from a table of each id's bytes."""

    def __init__(self, tokenizer):
        byte = {c: b for b, c in byte_alphabet().items()}
        table = {}
        added = tokenizer.get_added_tokens_decoder()
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            table[i] = token.encode() if i in added else bytes(byte[c] for c in token)
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]  #: of each id its bytes
        self.numerals = [b"%d," % i for i in range(len(self.table))]

    def decode(self, ids: array) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")

    def decimal(self, ids: array) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(map(self.numerals.__getitem__, ids))[:-1]


_OPEN: dict[str, tuple[ChunkEncoder, Decoder]] = {}
CACHES.append(_OPEN)


def opened(path: str) -> tuple[ChunkEncoder, Decoder]:
    if path not in _OPEN:
        base = encoder(path)
        _OPEN[path] = (ChunkEncoder(base), Decoder(base.tokenizer))
    return _OPEN[path]


def encode_decode(docs: DataFrame, tokenizer: str | None = None, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids, decoded; with digests, SHA-256 of the ids and the text instead.

    A null or empty text has no ids and decodes to the empty text. Null or repeated ids and equal rows are each encoded;
    other columns are ignored; an empty table gives no rows. No shuffle: chunks are shared through each worker's memory,
    which is bounded, and a copy's chunks cost a lookup. A very long text is worked through chunk by chunk in time in
    proportion to its length, unless it holds one run of letters that long, which is one pre-token.
    """
    path = tokenizer or file_of("byte_bpe_50k.json")

    def run(batches):
        enc, dec = opened(path)
        for b in batches:
            out = []
            for packed in enc.encode_all(text for _, text in each_row(b)):
                ids = array("I", packed)
                back = dec.decode(ids)
                out.append((len(ids), sha256(dec.decimal(ids)).hexdigest(), sha256(back.encode()).hexdigest()) if digests else (len(ids), ids.tolist(), back))
            n, x, y = list(zip(*out)) or [(), (), ()]
            kind = pa.string() if digests else pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, kind), pa.array(y, pa.string())], ["doc_id", "n_tokens", *names])

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kind = "string" if digests else "array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, n_tokens bigint, {names[0]} {kind}, {names[1]} string")
