"""Packing token sequences by an order-preserving dynamic programme.

The documents of a partition follow one another as one stream of token ids.
A packing chooses cuts b0 < b1 < ... of the stream, windows of at most
``length`` ids, so that the sum of padding and penalties is least: a cut at a
document's end is free, one at a sentence's end costs ``sentence_penalty``
tokens and one elsewhere ``hard_penalty``.  With f(i) the least cost up to
boundary i,

    f(j) = penalty(j) + length - b(j) + min { f(i) + b(i) : b(j) - b(i) <= length }

and the minimum over the sliding window of i comes from a monotone queue, so
the whole programme is linear in the number of boundaries.  Windows whose
length is a power of two need no padding; near the end of a block all
positions are boundaries and such windows are tried as well.

Ids are those that ``tokenizers`` gives with byte_bpe_50k.json at its default
setting: a literal ``<|endoftext|>`` in a text is the added token of that file.

Null and empty texts are documents of one id, the end mark.  Rows of a null
doc_id are documents with that id.  Repeated rows are packed as often as they
occur.  Long documents are cut, none is dropped.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 1.0
HARD_PENALTY = 16.0
HARD_SPACING = 32
BLOCK_TOKENS = 1 << 20
#: The added tokens of byte_bpe_50k.json, which its ranks file lacks.
ADDED = {"<|endoftext|>": 50256}
_CODERS: dict = {}
#: White space of this many characters is encoded by itself.
LONG_SPACE = 100_000
WIDE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    """Path of the 50k byte-level vocabulary as ranks; its ids are those of byte_bpe_50k.json."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Coder:
    """Ids of byte_bpe_50k.json with that file's added tokens, as its tokenizer gives them at its default setting."""

    def __init__(self, encoding):
        self.encoding, self.added = encoding, encoding.special_tokens_set
        self.ends = re.compile("|".join(map(re.escape, self.added)) or "(?!)")

    def _encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special=self.added, disallowed_special=())

    def encode_ordinary(self, text: str) -> list[int]:
        """The ids of a text.

        The pattern that parts words looks for the end of white space by
        backtracking, which fails on a run of a million.  Of such a run all
        but the last character before a word are one part, so it is encoded as
        such.
        """
        if len(text) < LONG_SPACE:
            return self._encode(text)
        out, at = [], 0
        for m in WIDE.finditer(text):
            a, z = m.span()
            if z < len(text) and not self.ends.match(text, z):
                z -= 1
            out += self._encode(text[at:a]) + self.encoding._encode_single_piece(text[a:z])
            at = z
        return out + self._encode(text[at:])


def coder(path: str | None = None):
    """(coder, whether an id ends a sentence), one per worker."""
    import base64

    import public_tokenizers
    import tiktoken

    path = path or vocabulary()
    if path not in _CODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = ADDED if path == vocabulary() else {}
        ends = np.zeros(max(*ranks.values(), *added.values()) + 1, bool)
        for token, rank in ranks.items():
            ends[rank] = token.rstrip(b"\"')").endswith((b".", b"!", b"?")) or b"\n" in token
        ends[END_ID] = False
        _CODERS[path] = Coder(tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)), ends
    return _CODERS[path]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a block of ids, first 0, last its end, and their penalties."""
    n = len(ids)
    sentences = np.flatnonzero(sentence_end[ids]) + 1
    tail = np.arange(max(0, n - 2 * length), n)
    soft = np.union1d(np.union1d(sentences, doc_ends), [0, n])
    cuts = np.unique(np.concatenate([soft, tail, np.arange(0, n, HARD_SPACING)])).astype(np.int64)
    penalty = np.full(len(cuts), HARD_PENALTY)
    penalty[np.isin(cuts, sentences)] = SENTENCE_PENALTY
    penalty[np.isin(cuts, doc_ends) | (cuts == n)] = 0
    return cuts, penalty


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The chosen cuts, from 0 to the block's end."""
    b, pen = cuts.tolist(), penalty.tolist()
    m, end = len(b), b[-1]
    cost, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    where = {x: i for i, x in enumerate(b) if x >= end - 2 * length}
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    for j in range(1, m):
        at = b[j]
        low = at - length
        while b[queue[0][1]] < low:
            queue.popleft()
        least, i = queue[0]
        c = least + length - at
        if at > end - length:
            for p in powers:
                k = where.get(at - p)
                if k is not None and cost[k] < c:
                    c, i = cost[k], k
        c += pen[j]
        cost[j], back[j] = c, i
        g = c + at
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    out, j = [], m - 1
    while j:
        out.append(b[j])
        j = back[j]
    return [0, *out[::-1]]


def pack_block(docs: list, ids: list[np.ndarray], sentence_end: np.ndarray, first: int, length: int = LENGTH) -> tuple[dict, int]:
    """Columns of the pieces of one block, and how many sequences it has."""
    sizes = np.array([len(x) for x in ids], np.int64)
    stream = np.concatenate(ids)
    ends = np.cumsum(sizes)
    chosen = np.array(best_cuts(*boundaries(stream, ends, sentence_end, length), length), np.int64)
    edges = np.union1d(chosen, np.r_[0, ends])
    lo, hi = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, lo, side="right")
    seq = np.searchsorted(chosen, lo, side="right") - 1
    raw = stream.astype("<u4")
    return {
        "doc_id": [docs[d] for d in doc], "start": lo - (ends - sizes)[doc], "length": hi - lo,
        "ids_crc32": [zlib.crc32(raw[a:z]) for a, z in zip(lo, hi)],
        "doc_tokens": sizes[doc], "sequence_id": first + seq, "offset": lo - chosen[seq],
    }, len(chosen) - 1


def pack(docs: DataFrame, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, vocab: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep the order in which the table stores them.  Tasks pack
    their own documents, block after block, so nothing is shuffled and memory
    is bounded by a block and the longest document.
    """
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        enc, sentence_end = coder(vocab)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        names, ids, held = [], [], 0
        types = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def flush():
            nonlocal names, ids, held, first
            columns, n = pack_block(names, ids, sentence_end, first, length)
            first += n
            names, ids, held = [], [], 0
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()}, schema=types)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                got = enc.encode_ordinary(text) if text else []
                got.append(END_ID)
                names.append(keys[k])
                ids.append(np.array(got, np.int64))
                held += len(got)
                if held >= block_tokens:
                    yield flush()
        if names:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
