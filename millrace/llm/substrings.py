"""Substring dedup by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes covers it that also starts earlier
in the corpus (a smaller doc_id, or an earlier start in the same document);
strings are judged on the input and never cross documents.

The suffixes, one for each start of such a string, are dealt to buckets, and a
task sorts one bucket at a time, block by block, so memory is bounded by a
bucket.  A suffix's bucket is the least hash among the 12-byte strings within
its first ``length`` bytes: equal strings meet in a bucket, and neighbouring
suffixes mostly share one, so a bucket gets runs of suffixes as one piece of
text.  12-byte strings that are often the least ones (a pass over all texts
counts them) come last in that order, so the surroundings of a passage with
many copies go elsewhere, and no bucket is hot.  A bucket key that occurs once
in the corpus has no equal; its suffixes are not sorted at all.

Within a block, the positions whose remainder modulo v lies in a difference
cover form the cover sample; it is sorted first, by the ``length - v`` bytes
from each.  Suffixes are then sorted by their first v bytes only.  Long ties
are resolved by the sample's ranks: for any two positions i and j there is a
d < v with i + d and j + d in the cover, the bytes before are equal in a tie,
and those ranks order the next ``length - v``; what d leaves at the end is
ordered by the rank of the last v bytes.  A tie is parted by ternary
quicksort, each comparison being one of ranks; what equals the earliest suffix
of a tie repeats it.

Pieces that are equal within a map task are combined there: only the earliest
is sent, the others are known to repeat it.  A passage with any number of
copies thus reaches its bucket once for each chunk of a map task.

Null and empty texts have no bytes and lose none; nor do texts shorter than
``length``.  A null doc_id comes first.  Rows that share doc_id and text are
one document: what is found goes from each of them.  Rows that share a doc_id
but not the text are documents of their own, in the order of a hash of their
texts.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 12
BUCKET_BYTES = 6 << 20
MAX_PARTS = 1 << 15  # of a shuffle; beyond that a task has several buckets, one after the other
CHUNK_BYTES = 32 << 20  # of pieces, which are about three times the text
SEGMENT = 1 << 19
BLOCK = 1 << 19
OFTEN = 14  # a sample is frequent if it is that of more than 2**-OFTEN of the runs
MOST_OFTEN = 1 << 16  # frequent strings that are sent to all tasks, those of most runs


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by block-wise running minima from both sides."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Frequent:
    """A set of hashes: a table by their low bits first, then the hashes themselves."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.table = np.sort(hashes), np.zeros(1 << 20, bool)
        self.table[self._low(hashes)] = True

    @staticmethod
    def _low(x: np.ndarray) -> np.ndarray:
        return (x & np.uint64((1 << 20) - 1)).view(np.int64)

    def among(self, x: np.ndarray) -> np.ndarray:
        """Positions of x that hold one of the hashes."""
        at = np.flatnonzero(self.table.take(self._low(x)))
        if not len(at):
            return at
        k = np.searchsorted(self.hashes, x[at])
        k[k == len(self.hashes)] = 0
        return at[self.hashes[k] == x[at]]


def grams_of(s: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Hashes of all 12-byte strings."""
    return common.mix64((s[GRAM:] - s[:-GRAM]) * inv[: len(s) - GRAM]) >> np.uint64(1)


def runs_of(raw: np.ndarray, at: np.ndarray, length: int, frequent: Frequent | None) -> tuple[np.ndarray, ...]:
    """(begin, suffixes, sample, 12-byte hashes, hash sums, inverse powers) of runs of suffixes with the same sample."""
    n = len(raw)
    s, inv = common.prefix_hash(raw)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), s, inv
    gram = grams_of(s, inv)
    if frequent is not None and len(frequent.hashes):
        gram[frequent.among(gram)] |= np.uint64(1 << 63)
    least = sliding_min(gram, length - GRAM + 1)
    ok = np.ones(n - length + 1, bool)
    for e in at[1:-1]:  # suffixes whose string would cross a document's end
        ok[max(0, e - length + 1) : e] = False
    other = least[1:] != least[:-1]
    new, last = ok.copy(), ok.copy()
    new[1:] &= other | ~ok[:-1]
    last[:-1] &= other | ~ok[1:]
    begin = np.flatnonzero(new)
    return begin, np.flatnonzero(last) - begin + 1, least[begin], gram, s, inv


def pieces_of(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, frequent: Frequent | None = None) -> tuple[np.ndarray, ...]:
    """(begin, suffixes, sample, again, content) of the pieces of texts lying one behind another.

    A piece is a run of suffixes with the same sample; ``again``: the sample
    occurs more than once in it, so it may repeat itself; ``content`` hashes
    its whole text.
    """
    begin, count, sample, gram, s, inv = runs_of(raw, at, length, frequent)
    if not len(begin):
        return begin, count, sample, np.zeros(0, bool), np.zeros(0, np.uint64)
    content = common.mix64((s[begin + count + length - 1] - s[begin]) * inv[begin]) + count.astype(np.uint64)
    # occurrences of each piece's sample among the strings within it: few positions hold any sample
    known = Frequent(np.unique(sample)).among(gram)
    lo, hi = np.searchsorted(known, begin), np.searchsorted(known, begin + count + length - GRAM)
    reach = hi - lo
    same = gram[known[np.repeat(hi - np.cumsum(reach), reach) + np.arange(reach.sum())]] == np.repeat(sample, reach)
    hits = np.add.reduceat(same, np.cumsum(reach) - reach)  # at least one each
    return begin, count, sample, hits > 1, content


def _gather(raw, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The ranges of a text, one behind another."""
    raw = raw if isinstance(raw, (bytes, bytearray)) else raw.tobytes()
    return b"".join([raw[a:z] for a, z in zip(begin.tolist(), (begin + size).tolist())])


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: they compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


# a document is known by its id and, where rows share the id but not the text, by a hash of the text
_HEAD = (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint8)  # id, two tags, start, count, sample, again


def _planed(columns) -> bytes:
    return np.array([len(columns[0])], np.int64).tobytes() + b"".join(_planes(x.astype(kind, copy=False)) for x, kind in zip(columns, _HEAD))


def _unplaned(body: bytes) -> tuple[list[np.ndarray], int]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in _HEAD:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out, at


def _runs(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of the runs that begin where ``lead`` is true."""
    first = np.flatnonzero(lead)
    return first, np.r_[first[1:], len(lead)][: len(first)] - 1


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


PIECES = "to int, sub int, kind int, body binary"


def _slot(sample: np.ndarray, n: int) -> np.ndarray:
    """One of n numbers; mixed once more, the least of many hashes being a small number."""
    return ((common.mix64(sample) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _rows(kind: int, to: np.ndarray, sub: np.ndarray | None, columns: list[np.ndarray], pieces, pack):
    """A row for each task ``to``, or each bucket ``sub`` of one, with its heads and texts; pieces: (text, begin, size) or none."""
    import pyarrow as pa

    schema = pa.schema([("to", pa.int32()), ("sub", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
    by_what = to if sub is None else sub
    by = np.argsort(by_what, kind="stable")
    first, last = _runs(~_same_as_before(by_what[by]))
    for a, z in zip(first, last + 1):
        own = by[a:z]
        body = _planed([c[own] for c in columns])
        if pieces is not None:
            text, begin, size = pieces
            body += _gather(text, begin[own], size[own])
        row = (int(to[own[0]]), 0 if sub is None else int(sub[own[0]]), kind, pack.compress(body))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)


def _cut(parts: int, length: int, frequent):
    """Map stage: pieces by bucket (kind 1), and what a task already knows to be repeated (kind 0)."""

    def run(batches):
        import zstandard

        pack, held, held_text = zstandard.ZstdCompressor(level=5), [], bytearray()
        some = Frequent(np.frombuffer(frequent.value, np.uint64))

        def flush():
            nonlocal held, held_text
            id_, ta, tb, start, count, sample, again, content = (np.concatenate(x) for x in zip(*held))
            text = bytes(held_text)
            held, held_text = [], bytearray()
            size = count + length - 1
            begin = np.cumsum(size) - size
            order = np.argsort(content)
            same = _same_as_before(content[order])
            same[:-1] |= same[1:]
            order = order[same]
            order = order[np.lexsort((start[order], tb[order], ta[order], id_[order], content[order]))]
            same = _same_as_before(content[order], count[order])
            lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            p, q = order[same], lead[same]
            if _gather(text, begin[p], size[p]) != _gather(text, begin[q], size[q]):  # equal hashes, other texts: rare
                ok = [text[a : a + n] == text[b : b + n] for a, b, n in zip(begin[p].tolist(), begin[q].tolist(), size[p].tolist())]
                p, q = p[ok], q[ok]
            stay = np.ones(len(content), bool)
            stay[p] = False
            # a copy of the same place, in a row that occurs again, is no earlier place
            place = (id_[p] == id_[q]) & (ta[p] == ta[q]) & (tb[p] == tb[q]) & (start[p] == start[q])
            gone = p[~place]
            if len(gone):
                gone = gone[np.lexsort((start[gone], tb[gone], ta[gone], id_[gone]))]
                end = start[gone] + count[gone]
                new = ~_same_as_before(id_[gone], ta[gone], tb[gone])
                new[1:] |= start[gone][1:] > end[:-1]
                first, last = _runs(new)
                got = gone[first]
                zero = np.zeros(len(first), np.int64)
                whole = [id_[got], ta[got], tb[got], start[got], end[last] - start[got], zero, zero]
                # known already: any task may pass it on
                yield from _rows(0, zero + int(content[0] % np.uint64(parts)), None, whole, None, pack)
            stay = np.flatnonzero(stay)
            columns = [c[stay] for c in (id_, ta, tb, start, count, sample.astype(np.uint32), again)]
            yield from _rows(1, _slot(sample[stay], parts), None, columns, (text, begin[stay], size[stay]), pack)

        def take(names, raw, at, shift):
            begin, count, sample, again, content = pieces_of(raw, at, length, some)
            if len(begin):
                owner = np.searchsorted(at, begin, side="right") - 1
                held.append((*(x[owner] for x in names), begin - at[owner] + shift, count, sample, again, content))
                held_text.extend(_gather(raw, begin, count + length - 1))

        for b in common.small(batches, most=SEGMENT):
            names = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "ta", "tb")]
            raw, at = common.column_bytes(b.column("text"))
            if len(raw) <= 2 * SEGMENT:
                take(names, raw, at, 0)
            else:  # one long document, by overlapping segments
                for i in range(len(at) - 1):
                    own = raw[at[i] : at[i + 1]]
                    for a in range(0, max(1, len(own) - length + 1), SEGMENT):
                        part = own[a : a + SEGMENT + length - 1]
                        take([x[i : i + 1] for x in names], part, np.array([0, len(part)]), a)
                        if len(held_text) >= CHUNK_BYTES:
                            yield from flush()
            if len(held_text) >= CHUNK_BYTES:
                yield from flush()
        if held:
            yield from flush()

    return run


def _opened(batches):
    """(sub, kind, columns, texts) of the rows of a task."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for sub, kind, body in zip(*(b.column(c) for c in ("sub", "kind", "body"))):
            body = unpack.decompress(body.as_py())
            columns, at = _unplaned(body)
            yield sub.as_py(), kind.as_py(), columns, body[at:]


def _dealt(subs: int, length: int):
    """For a task with several buckets: the pieces of many chunks, a row for each bucket."""

    def run(batches):
        import zstandard

        pack, held, texts, size = zstandard.ZstdCompressor(level=1), [], [], 0

        def flush():
            nonlocal held, texts, size
            columns = [np.concatenate(x) for x in zip(*held)]
            n = columns[4] + length - 1
            # by what is left of the sample, which the task's own number does not settle
            sub = _slot(columns[5].astype(np.uint64), subs)
            yield from _rows(1, sub * 0, sub, columns, (b"".join(texts), np.cumsum(n) - n, n), pack)
            held, texts, size = [], [], 0

        for _, kind, columns, text in _opened(batches):
            if kind == 0:
                yield from _rows(0, columns[0] * 0, None, columns, None, pack)
                continue
            held.append(columns)
            texts.append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield from flush()
        if held:
            yield from flush()

    return run


#: Perfect difference sets, every remainder is a difference of two members.
COVERS = {31: (1, 5, 11, 24, 25, 27), 7: (1, 2, 4), 3: (0, 1)}


def cover_for(length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(v, cover, shifts): shifts[a, b] is the d with (a + d) % v and (b + d) % v in the cover."""
    v = next((v for v in COVERS if 2 * v <= length), 3)
    cover = np.array(COVERS[v])
    shifts = np.full((v, v), -1)
    for a in cover:
        for b in cover:
            d = np.arange(v)
            shifts[(a - d) % v, (b - d) % v] = d
    return v, cover, shifts


def byte_words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, in byte order; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), ">u8", padded, strides=(1,)).astype(np.uint64)


def sort_by_bytes(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head) of positions sorted by the ``depth`` bytes from each; head is true where a string differs from the one before."""
    key = words[at]
    if depth < 8:
        key >>= np.uint64(8 * (8 - depth))
    order = np.argsort(key)
    key = key[order]
    head = np.ones(len(at), bool)
    head[1:] = key[1:] != key[:-1]
    for step in [*range(8, depth - 7, 8), *([depth - 8] if depth % 8 and depth > 8 else [])]:
        tied = ~head
        tied[:-1] |= tied[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        sub = order[idx]
        key = words[at[sub] + step]
        by = np.argsort(key)
        key = key[by]
        rank = np.empty(len(by), np.uint64)
        rank[by] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        rank |= np.cumsum(head)[idx].astype(np.uint64) << np.uint64(32)
        by = np.argsort(rank)
        rank = rank[by]
        order[idx] = sub[by]
        head[idx[1:]] |= rank[1:] != rank[:-1]
    return order, head


class CoverSample:
    """Ranks of a text's cover sample, by the ``depth`` bytes from each position."""

    def __init__(self, words: np.ndarray, n: int, v: int, cover: np.ndarray, depth: int):
        self.v, self.size = v, len(cover)
        self.place = np.full(v, -1)
        self.place[cover] = np.arange(len(cover))
        at = (np.arange(-(-n // v))[:, None] * v + cover).ravel()
        some = np.flatnonzero(at + depth <= n)
        order, head = sort_by_bytes(words, at[some], depth)
        self.rank = np.zeros(len(at), np.int32)
        self.rank[some[order]] = np.cumsum(head)

    def at(self, position: np.ndarray) -> np.ndarray:
        return self.rank[position // self.v * self.size + self.place[position % self.v]]


ROUNDS = 16


def _equal_earlier(where: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, the least equal suffix before it) of suffixes in corpus order."""
    v, cover, shifts = cover_for(length)
    words = byte_words(raw)
    order, head = sort_by_bytes(words, where, v)
    tied = ~head
    tied[:-1] |= tied[1:]
    order, tie = order[tied], np.cumsum(head)[tied]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sample = CoverSample(words, len(raw), v, cover, length - v)
    by, head = sort_by_bytes(words, where[order] + length - v, v)
    tail = np.empty(len(where), np.int32)
    tail[order[by]] = np.cumsum(head)
    me, other = [], []
    for turn in range(ROUNDS + 1):
        if not len(order):
            break
        if turn == ROUNDS:  # many strings that differ only far behind: one more sort, by all of each
            by, head = sort_by_bytes(words, where[order], length)
            order, tie = order[by], np.cumsum(head)
        first = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
        lead = np.repeat(np.minimum.reduceat(order, first), np.diff(np.r_[first, len(order)]))
        if turn == ROUNDS:
            side = np.zeros(len(order), np.int32)
        else:
            p, q = where[order], where[lead]
            d = shifts[p % v, q % v]
            side = sample.at(p + d) - sample.at(q + d)
            side = np.where(side != 0, side, tail[order] - tail[lead])
        hit = (side == 0) & (order != lead)
        me.append(order[hit])
        other.append(lead[hit])
        rest = np.flatnonzero(side)
        # what comes before the lead and what comes behind it are ties of their own
        tie = 2 * np.cumsum(np.r_[False, tie[1:] != tie[:-1]])[rest] + (side[rest] > 0)
        by = np.argsort(tie, kind="stable")
        order, tie = order[rest[by]], tie[by]
    me, other = np.concatenate(me), np.concatenate(other)
    by = np.argsort(me)
    return me[by], other[by]


def repeated(doc: np.ndarray, start: np.ndarray, count: np.ndarray, begin: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, suffix within it) of the suffixes that have an equal earlier one; pieces come in the order of (doc, start)."""
    piece = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    me, q = _equal_earlier(begin[piece] + inner, raw, length)
    # copies of one row are no earlier place
    other = (doc[piece[me]] != doc[piece[q]]) | (start[piece[me]] + inner[me] != start[piece[q]] + inner[q])
    me = me[other]
    return piece[me], inner[me]


SPANS = "id long, ta long, tb long, begin long, end long"


def _sorted(length: int):
    """Bucket stage: sort one bucket at a time; gives the runs of bytes that are repeated."""

    def run(batches):
        import pyarrow as pa

        def spans(id_, ta, tb, start, n):
            columns = (id_, ta, tb, start, start + n + length - 1)
            for a in range(0, len(id_), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)], pa.int64()) for c in columns], names=["id", "ta", "tb", "begin", "end"])

        def bucket(held, texts):
            id_, ta, tb, start, count, sample, again = (np.concatenate(x) for x in zip(*held))
            text = b"".join(texts)
            size = count + length - 1
            begin = np.cumsum(size) - size
            # documents by number, in their order
            doc = id_
            if ta.any() or tb.any():
                order = np.lexsort((tb, ta, id_))
                doc = np.empty(len(order), np.int64)
                doc[order] = np.cumsum(~_same_as_before(id_[order], ta[order], tb[order]))
            order = np.lexsort((start, doc, sample))
            first, last = _runs(~_same_as_before(sample[order]))
            # a sample that occurs once has no equal
            use = np.flatnonzero((last > first) | (np.maximum.reduceat(again[order], first) > 0))
            load = np.cumsum(np.add.reduceat(count[order], first)[use])
            a = 0
            while a < len(use):
                z = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + BLOCK, side="right")))
                own = np.concatenate([order[first[g] : last[g] + 1] for g in use[a:z]])
                own = own[np.lexsort((start[own], doc[own]))]
                part = np.frombuffer(_gather(text, begin[own], size[own]), np.uint8)
                piece, inner = repeated(doc[own], start[own], count[own], np.cumsum(size[own]) - size[own], part, length)
                if len(piece):
                    lead, tail = _runs(np.r_[True, (piece[1:] != piece[:-1]) | (inner[1:] != inner[:-1] + 1)])
                    p = own[piece[lead]]
                    yield from spans(id_[p], ta[p], tb[p], start[p] + inner[lead], tail - lead + 1)
                a = z

        now, held, texts = None, [], []
        for sub, kind, columns, text in _opened(batches):
            if kind == 0:
                yield from spans(*columns[:5])
                continue
            if sub != now and held:
                yield from bucket(held, texts)
                held, texts = [], []
            now = sub
            held.append(columns)
            texts.append(text)
        if held:
            yield from bucket(held, texts)

    return run


def _counted(length: int):
    """Map stage: samples of more than a share of 2**-OFTEN of the runs, and as frequent strings beside them, batch by batch."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            nonlocal held, size
            least = max(16, size >> OFTEN)
            values, n = np.unique(np.concatenate([h[3] for h in held]), return_counts=True)
            hot = Frequent(values[n >= least])
            # a passage has more strings than its least ones; without them the next ones would be hot
            near, n_near = [], []
            for raw, begin, count, sample in held:
                own = hot.among(sample)
                n_near.append(count[own] + length - 1)
                near.append(_gather(raw, begin[own], n_near[-1]))
            near, ends = np.frombuffer(b"".join(near), np.uint8), np.cumsum(np.concatenate(n_near))
            held, size = [], 0
            if len(near):
                gram = grams_of(*common.prefix_hash(near))
                inside = np.ones(len(near), bool)
                for k in range(1, GRAM):
                    inside[ends - k] = False
                values, n = np.unique(gram[inside[: len(gram)]], return_counts=True)
                many = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many])], names=["gram", "n"])

        for b in common.small(batches, most=SEGMENT):
            raw, at = common.column_bytes(b.column("text"))
            for a in range(0, max(1, len(raw)), 2 * SEGMENT):  # of a long text by parts: a count needs no exact edges
                part = raw[a : a + 2 * SEGMENT]
                begin, count, sample = runs_of(part, np.clip(at - a, 0, len(part)), length, None)[:3]
                held.append((part, begin, count, sample))
                size += len(sample)
                if size >= 1 << 19:
                    yield from flush()
        if size:
            yield from flush()

    return run


def frequent_grams(docs: DataFrame, length: int = LENGTH) -> np.ndarray:
    """At most MOST_OFTEN hashes of 12-byte strings, the most frequent ones; which ones they are does not matter to results."""
    found = docs.select("text").mapInArrow(_counted(length), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # written first: a sorted limit that is collected would send the first rows of every partition to the driver
    found = common.materialize(found.orderBy(F.desc("n"), "gram").limit(MOST_OFTEN).select("gram"))
    grams = found.toPandas().gram.to_numpy(np.int64).view(np.uint64)
    common.discard(found)
    return grams


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, ta, tb and spans (begin, end of each maximal removed run), for the documents that have some."""
    spark = rows.sparkSession
    n_bytes = common.text_bytes(rows)
    buckets = common.partitions_for(spark, n_bytes, BUCKET_BYTES)
    parts = min(buckets, max(MAX_PARTS, common.partitions_for(spark, 0)))
    subs = -(-buckets // parts)
    frequent = spark.sparkContext.broadcast(frequent_grams(rows, length).tobytes())
    cut = rows.select("id", "ta", "tb", "text").mapInArrow(_cut(parts, length, frequent), PIECES).repartitionById(parts, F.col("to"))
    if subs > 1:
        cut = cut.mapInArrow(_dealt(subs, length), PIECES).sortWithinPartitions("sub")
    found = cut.mapInArrow(_sorted(length), SPANS)
    # maximal runs: a run begins where no span before it reaches
    by = ["id", "ta", "tb"]
    along = Window.partitionBy(*by).orderBy("begin", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.when(F.col("begin") <= reached, 0).otherwise(1))
    found = found.withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy(*by, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return common.materialize(found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans")))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (begin, end of each removed run) of every document."""
    rows = common.identified(docs.select("doc_id", "text"))
    found = repeated_spans(rows, length)
    rows = rows.join(found.hint("merge"), ["id", "ta", "tb"], "left")
    latin = "ISO-8859-1"  # a character for each byte

    def cut(data):
        """What lies before each span and behind the last one."""
        before = F.transform("spans", lambda x, i: F.decode(F.substring(
            data, (F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0) + 1).cast("int"),
            (x["begin"] - F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)).cast("int")), latin))
        end = F.element_at("spans", -1)["end"]
        rest = F.decode(F.substring(data, (end + 1).cast("int"), F.length(data)), latin)
        return F.encode(F.concat(F.array_join(before, ""), rest), latin)

    data = F.coalesce("text", F.lit("")).cast("binary")
    kept = F.when(F.col("spans").isNull(), data).otherwise(F.element_at(F.transform(F.array(data), cut), 1))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return rows.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), kept.alias("kept"), F.coalesce("spans", none).alias("spans"))
