"""The operators on text against brute force, on the small tables and on edge cases."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, jaccard, licences, lines, mixing, packing, quality, queries, substrings
from millrace.llm.common import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, key string"


def frame(spark, rows):
    """Documents of (doc_id, text[, source]) with nulls and further columns whose names clash with inner ones."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, 1, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed=0, vocabulary=2000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


LONG = words(60_000, 5)
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "One two three four"), (7, words(40, 1)), (8, words(40, 1)), (9, words(40, 1) + " more"),
    (10, "\n".join([words(12, 2)] * 5)), (11, LONG), (12, LONG + " tail"), (13, "he " * 300), (14, "é" * 150), (15, "é" * 150 + "x"), (20, words(12, 2) + "\n" + words(9, 3)),
]


@pytest.fixture(scope="module")
def small_docs(spark, small):
    return [(r.doc_id, r.text) for r in read(spark, small, "documents").select("doc_id", "text").collect()]


def jaccard_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_jaccard_whole_table(spark, small, small_docs):
    assert jaccard_rows(queries.op5_jaccard_join(spark, small)) == brute.jaccard(small_docs)


def test_jaccard_edges(spark):
    assert jaccard_rows(jaccard.join(frame(spark, EDGE))) == brute.jaccard(EDGE)
    rows = jaccard.join(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(1, 1), (2, 1), (2, 1)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert jaccard.join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_chains_and_hot_groups(spark, seed, monkeypatch):
    """Groups whose members drift apart, small bounds so that salts, blocks and cells are all used."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", 7)
    monkeypatch.setattr(jaccard, "REST_ROWS", 9)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    if seed:  # several buckets and chunks to a task
        monkeypatch.setattr(jaccard, "BUCKET_BYTES", 4000)
        monkeypatch.setattr(jaccard, "MAX_PARTS", 2)
    r, docs, base = random.Random(seed), [], words(60, seed).split()
    passage = words(50, 99)
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"n{r.randrange(99)}"
        if r.random() < 0.3:
            base = w
        docs.append((i, " ".join(w) + (" " + passage if r.random() < 0.2 else "")))
    docs += [(200 + i, passage + " " + words(60, 300 + i)) for i in range(40)]
    r.shuffle(docs)
    assert jaccard_rows(jaccard.join(frame(spark, docs))) == brute.jaccard(docs)


def test_jaccard_of_rows_that_share_an_id(spark):
    """One id with two texts links what each of them is linked with."""
    a, b, c = words(30, 1), words(30, 2), words(30, 3)
    docs = [(9, a), (9, b), (4, a + " x"), (7, b), (7, b), (8, c), (None, a), (None, c), (3, None), (3, c)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(frame(spark, docs)).collect()}
    assert got == {(9, 26): 4, (4, 27): 4, (7, 26): 4, (8, 26): 3, (3, 26): 3, (3, 0): 3, (None, 26): None}


def test_components_of_stars_and_chains(spark):
    """Hubs over the bound of a salted join, and a long chain."""
    from millrace.llm import common

    edges = [(0, i) for i in range(1, 500)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4999), (5000, 5000), (-3, 499)]
    got = {r.node: r.component_id for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == brute.components(nodes, edges)


def substring_rows(df):
    kept = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    return {x.doc_id: (x.n_bytes, x.r, x.s, x.h) for x in kept.collect()}


def test_substrings_whole_table(spark, small, small_docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_array_dedup(spark, small).collect()}
    assert got == brute.substring_dedup(small_docs)


def test_substrings_edges(spark):
    edge = [(i, t) for i, t in EDGE if t is None or len(t) < 20_000]
    assert substring_rows(substrings.dedup(frame(spark, edge))) == brute.substring_dedup(edge)
    assert substrings.dedup(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, words(50, 1)), (1, words(50, 1)), (None, words(50, 1))])
    got = {r.doc_id: r.kept for r in substrings.dedup(twice).collect()}
    assert got[None] == words(50, 1).encode() and got[1] == b""


@pytest.mark.parametrize("seed", range(2))
def test_substrings_random(spark, seed, monkeypatch):
    """Few letters, so that strings repeat by chance and by period; small segments and blocks."""
    for name, value in (("SEGMENT", 400), ("BLOCK", 300), ("CHUNK_BYTES", 2000), ("BUCKET_BYTES", 2000)):
        monkeypatch.setattr(substrings, name, value)
    r, docs, seen = random.Random(seed), [], []
    for i in range(60):
        t = "".join(r.choice("ab") for _ in range(r.randrange(40))) * r.randrange(1, 30)
        for _ in range(r.randrange(4)):
            if seen:
                s = r.choice(seen)
                a = r.randrange(len(s) + 1)
                t += s[a : a + r.randrange(300)]
            t += "".join(r.choice("abc é") for _ in range(r.randrange(200)))
        seen.append(t)
        docs.append((i, t))
    assert substring_rows(substrings.dedup(frame(spark, docs))) == brute.substring_dedup(docs)


def test_substrings_of_rows_that_share_an_id(spark):
    """Other texts under one id are documents of their own; equal rows are one document."""
    a, b = words(60, 1), words(60, 2)
    docs = [(1, a), (2, a), (2, b), (2, b), (3, b[:300]), (None, words(60, 3)), (None, words(60, 4)), (None, a[:200] + "x")]
    got = sorted(((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in substrings.dedup(frame(spark, docs)).collect()))
    whole = lambda i, t: (i, len(t), t.encode())
    assert whole(2, b) in got and got.count(whole(2, b)) == 2 and (2, len(a), b"") in got and (3, 300, b"") in got
    assert {whole(0, words(60, 3)), whole(0, words(60, 4)), whole(0, a[:200] + "x")} <= set(got)
    assert (1, len(a), a[200:].encode()) in got


def test_substrings_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 1 << 14)
    docs = [(1, LONG), (2, "x" + LONG[1000:90_000] + "y"), (3, LONG[50_000:50_099] + LONG[-100:]), (4, LONG[:300] * 40)]
    assert substring_rows(substrings.dedup(frame(spark, docs))) == brute.substring_dedup(docs)


def test_substrings_of_a_passage_in_many_contexts(spark, monkeypatch):
    """A hot passage: its surroundings go to other buckets, and several buckets of a task follow one another."""
    passage = words(50, 99)
    docs = [(i, words(30, 1000 + i) + " " + passage + " " + words(30, 5000 + i)) for i in range(2000)]
    frequent = substrings.frequent_grams(frame(spark, docs))
    assert len(passage) // 2 < len(frequent) < 2000
    import numpy as np

    def hottest(some):
        at = np.cumsum([0, *(len(t) for _, t in docs)])
        raw = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
        _, count, sample, _, content = substrings.pieces_of(raw, at, frequent=substrings.Frequent(some))
        return np.unique(np.unique(np.c_[sample, content], axis=0)[:, 0], return_counts=True)[1].max()

    assert hottest(frequent) < 300 < hottest(frequent[:0])
    for name, value in (("BUCKET_BYTES", 20_000), ("MAX_PARTS", 2), ("CHUNK_BYTES", 200_000)):
        monkeypatch.setattr(substrings, name, value)
    assert substring_rows(substrings.dedup(frame(spark, docs))) == brute.substring_dedup(docs)


def test_bytes_are_sorted_as_bytes():
    import numpy as np

    r = np.random.default_rng(0)
    raw = r.integers(0, 3, 3000).astype(np.uint8) * 100
    raw[1000:1500] = raw[:500]
    for depth in (3, 8, 31, 69, 100):
        at = r.permutation(2900)
        order, head = substrings.sort_by_bytes(substrings.byte_words(raw), at, depth)
        strings = [raw[k : k + depth].tobytes() for k in at[order]]
        assert strings == sorted(strings) and head.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_difference_covers():
    for length in (6, 14, 62, 100):
        v, cover, shifts = substrings.cover_for(length)
        assert all((a + shifts[a, b]) % v in cover and (b + shifts[a, b]) % v in cover and 0 <= shifts[a, b] < v for a in range(v) for b in range(v))


@pytest.mark.parametrize("rounds", [1, 16])
def test_ties_that_differ_in_between(monkeypatch, rounds):
    """Strings with equal ends and different middles, in every alignment."""
    import numpy as np

    monkeypatch.setattr(substrings, "ROUNDS", rounds)
    r, pieces = random.Random(rounds), []
    for _ in range(200):
        pieces.append(b"p" * r.randrange(3) + b"head" * 8 + bytes([97 + r.randrange(5)]) * r.randrange(20, 40) + b"tail" * 8 + b"q" * r.randrange(2))
    pieces = [p for p in pieces if len(p) >= 90]
    count = np.array([len(p) - 89 for p in pieces])
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    piece, inner = substrings.repeated(np.arange(len(pieces)), np.zeros(len(pieces), np.int64), count, np.cumsum(size) - size, raw, 90)
    seen, want = set(), set()
    for i, p in enumerate(pieces):
        for k in range(len(p) - 89):
            if p[k : k + 90] in seen:
                want.add((i, k))
            seen.add(p[k : k + 90])
    assert set(zip(piece.tolist(), inner.tolist())) == want


def test_substrings_of_equal_hash_are_compared(monkeypatch):
    """With a hash that says nothing, the bytes decide."""
    import numpy as np

    monkeypatch.setattr(substrings.common, "mix64", lambda x: np.zeros(len(x), np.uint64))
    raw = np.frombuffer(b"abcdefgh" + b"abcdefgx" + b"abcdefgh", np.uint8)
    piece, inner = substrings.repeated(np.array([1, 2, 3]), np.zeros(3, np.int64), np.array([5, 5, 5]), np.array([0, 8, 16]), raw, 4)
    assert list(zip(piece.tolist(), inner.tolist())) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]


def line_texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def brute_lines(docs):
    return dict(zip((i for i, _ in docs), brute.line_dedup(docs)))


def test_lines_edges_and_near_copies(spark):
    base = words(12, 7).split()
    docs = EDGE + [
        (30, " ".join(base)), (31, " ".join([*base[:3], "new", *base[3:]])), (32, " ".join(base[:-1])), (33, " ".join([*base[:5], "x", *base[6:]])),
        (34, " ".join([*base[:5], "y", *base[6:]]) + "\n\n  \nrest"), (35, " ".join([base[1], base[0], *base[2:]])), (36, "short line here"), (37, "short line there"),
        (38, "short line here"),
    ]
    got = lines.dedup(frame(spark, docs))
    assert line_texts(got) == brute_lines(docs)
    assert got.columns[:7] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert lines.dedup(frame(spark, [])).count() == 0
    twice = lines.dedup(frame(spark, [(1, "same text"), (1, "same text"), (None, "same text")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in twice) == [(0, "same text"), (1, ""), (1, "")]


def test_lines_random(spark):
    r, docs, known = random.Random(3), [], [words(n, 50 + n).split() for n in range(7, 15)]
    for i in range(80):
        out = []
        for _ in range(r.randrange(1, 5)):
            w = list(r.choice(known))
            for _ in range(r.randrange(3)):
                k, what = r.randrange(len(w)), r.randrange(3)
                w[k : k + (what > 0)] = [] if what == 2 else [f"z{r.randrange(9)}"]
            known.append(w)
            out.append(" ".join(w))
        docs.append((i, "\n".join(out)))
    assert line_texts(lines.dedup(frame(spark, docs))) == brute_lines(docs)


def test_lines_near_copies_of_short_lines(spark):
    """Less than eight words: one character; words that join or part change the kind of a line's units."""
    docs = [(1, "The quick brown foxes\nPage 1\nPage 2"), (2, "The quick brown fox\nThe quick brown foxed"), (3, "The quick brawn foxed\nThequick brown foxes"), (4, "Übergrößen für alle da\nUbergrößen für alle da"),
            (5, "a b c d e f g h i j k l m n o p\nabcdefghijklmnop"), (6, "abcdefghijklmnopq\nzabcdefghijklmnop\nacdefghijklmnop\nbacdefghijklmnop")]
    got = line_texts(lines.dedup(frame(spark, docs)))
    assert got == brute_lines(docs)
    assert got[1] == docs[0][1] and got[2] == "The quick brown fox" and got[3] == "" and got[4] == "Übergrößen für alle da"


def test_lines_of_rows_that_share_an_id(spark):
    """A line goes from the document it was found in, not from another one of that id."""
    docs = [(1, "shared line\nonly in one"), (2, "other line\nshared line\nrow A holds this"), (2, "shared line\nquite another text of B"), (2, "shared line\nquite another text of B"),
            *((None, "line " + words(5, 700 + i)) for i in range(30)), (None, "shared line")]
    got = sorted((r.doc_id or 0, r.text) for r in lines.dedup(frame(spark, docs)).collect())
    assert (2, "other line\nrow A holds this") in got and got.count((2, "quite another text of B")) == 2 and (1, "only in one") in got
    assert len([t for i, t in got if not i and t.startswith("line ")]) == 30 and (0, "shared line") in got


def test_lines_of_other_columns(spark):
    """Names with dots, and names that the operator uses itself, are passed on."""
    names = ["doc_id", "a.b", "n_chars", "text", "id", "row", "did", "words", "n_lines", "ta"]
    df = spark.createDataFrame([(1, "x", 7, "same line\nsame line", 2, "r", 3, "w", 99, 5), (2, None, None, None, None, None, None, None, None, None)],
                               "doc_id long, `a.b` string, n_chars long, text string, id int, row string, did int, words string, n_lines int, ta int")
    got = sorted(tuple(r) for r in lines.rewritten(df).collect())
    assert got[0] == (1, "x", 7, "same line", 2, "r", 3, "w", 99, 5) and got[1] == (2, *[None] * 9) and lines.rewritten(df).columns == names
    assert [r.n_chars for r in lines.rewritten(df, length_column="n_chars").orderBy("doc_id").collect()] == [9, None]
    assert lines.dedup(df).columns == [n for n in names if n != "n_lines"] + ["n_lines", "n_removed"]


def test_lines_hot_line(spark, monkeypatch):
    """A line with very many copies is dealt to several tasks."""
    docs = [(i, f"boilerplate at the top\n{words(9, i)}\nboilerplate at the top") for i in range(3000)]
    got = line_texts(lines.dedup(frame(spark, docs)))
    assert got[0] == f"boilerplate at the top\n{words(9, 0)}" and all(got[i] == words(9, i) for i in range(1, 3000))


def test_lines_plan_is_native(spark, small):
    from millrace.plans.statements import explain_plan

    plan = explain_plan(queries.op3_line_dedup(spark, small))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_fingerprints(spark, small, small_docs):
    import hashlib

    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, small).collect()}
    order = sorted(small_docs)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute.shingles(x) for x in (t, edited, nxt))
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.2
        assert abs(got[i].near_next - len(a & c) / len(a | c)) < 0.2
        assert abs(got[i].near_contained - len(a & b) / len(a)) < 0.25
        assert abs(got[i].n_distinct / len(a) - 1) < 0.4


def test_fingerprints_by_brute_force():
    """The sketch is the least hashes of all shingles, and so are its estimates."""
    import numpy as np
    import pyarrow as pa

    texts = [words(700, 1), words(700, 1) + " " + words(100, 2), words(90, 3), "a b", "", words(650, 1)]
    got = fingerprints.sketches(pa.array(texts))
    from millrace.llm import common

    def least(text):
        w = [t.encode() for t in brute.re.findall(brute.WORD, brute.low(text))]
        hashes = set()
        for s in {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ():
            data = b" ".join(s)
            h, _ = common.shingle_hashes(*common.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
            hashes |= {int(x) for x in h}
        return hashes

    for text, sketch in zip(texts, got):
        every = sorted({x >> 16 for x in least(text)})
        assert [int(x) for x in sketch] == every[: fingerprints.K]
    for a, b in ((0, 1), (0, 5), (0, 2), (3, 3)):
        x, y = ({v >> 16 for v in least(texts[i])} for i in (a, b))
        union = sorted(x | y)[: fingerprints.K]
        assert fingerprints.resemblance(got[a], got[b]) == sum(v in x and v in y for v in union) / len(union)


def test_fingerprints_edges(spark):
    got = {r.doc_id: r for r in fingerprints.neighbours(frame(spark, EDGE)).collect()}
    assert len(got) == len(EDGE)
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == "" and got[1].near_next == 1.0 and got[3].near_next == 0.0
    assert got[4].near_next == 1.0 and got[7].near_next == 1.0 and got[7].fingerprint == got[8].fingerprint
    one = fingerprints.neighbours(frame(spark, [(5, words(40))])).first()
    assert one.near_next == 1.0
    assert fingerprints.neighbours(frame(spark, [])).count() == 0
    rows = fingerprints.neighbours(frame(spark, [(None, "a"), (None, None), (1, "b"), (1, "b")])).collect()
    assert len(rows) == 4
    parts = [fingerprints.sketches(__import__("pyarrow").array([x]))[0] for x in (words(300, 1), words(300, 2), words(300, 1) + "  " + words(300, 2))]
    merged = fingerprints.merge(parts[0], parts[1])
    assert fingerprints.resemblance(merged, parts[2]) > 0.9 and (fingerprints.decode(fingerprints.encode(merged)) == merged).all()


def test_packing(spark, small, small_docs):
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in small_docs}
    check_pieces(queries.op4_packing(spark, small).collect(), ids, 0.01)


def check_pieces(rows, ids, most):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= most * total


def test_packing_edges(spark):
    import numpy as np

    enc, _ = packing.coder()
    docs = [*EDGE, (40, "<|endoftext|> x"), (41, "a" * 5000)]
    ids = {i: np.array([*enc.encode_ordinary(t or ""), 1], "<u4") for i, t in docs}
    check_pieces(packing.pack(frame(spark, docs)).collect(), ids, 0.02)
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark, [(None, "a"), (1, "b"), (1, "b")])).count() == 3


def test_packing_takes_the_tokenizers_ids(spark, small_docs):
    """The JSON tokenizer at its default setting, which knows an added token, on all texts and on those that hold its literal."""
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    docs = [*small_docs, *EDGE, *((10_000_000 + k, x) for k, x in enumerate([
        f"a {mark} b", mark, mark * 3, f"{mark}\n{mark} x", f"x{mark}y", f"Ends.{mark}Starts", "<|endoftext|", "<|ENDOFTEXT|>", f"é{mark}é  {mark}  ", "<|fim|>",
    ]))]
    docs = list(dict(docs).items())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    assert ids[10_000_000].tolist() == [64, 220, 50256, 275, 1]
    check_pieces(packing.pack(frame(spark, docs)).collect(), ids, 0.02)


def test_packing_of_long_white_space(spark):
    """Millions of spaces, line breaks and wide spaces: the ids of the JSON tokenizer."""
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark, n = "<|endoftext|>", packing.LONG_SPACE
    texts = ["a" + " " * 2_000_000 + "b", " " * 2_000_000, "\n" * 1_100_000 + "x", "é" + "\u3000" * n + "\ty", "x" + " " * n + mark + " " * n + "\n1", " " * (n - 1) + "z", "a" + "\x1c" * n + " b"]
    docs = list(enumerate(texts))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    check_pieces(packing.pack(frame(spark, docs)).collect(), ids, 0.02)


def test_packing_may_cut_at_every_sentence_end():
    import numpy as np

    ids = np.resize([0, 0, 1], 9000)
    cuts, penalty = packing.boundaries(ids, np.array([4000, 9000]), np.array([False, True]), 64)
    assert set(range(3, 9000, 3)) <= set(cuts[penalty == packing.SENTENCE_PENALTY].tolist()) | {9000}
    assert set(cuts[penalty == 0].tolist()) == {4000, 9000}


def test_packing_is_optimal():
    """The monotone queue finds the cost of the plain quadratic programme."""
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(30):
        cuts = np.unique(np.r_[0, r.integers(1, 300, 40), 300])
        if np.diff(cuts).max() > 32:
            continue
        pen = r.integers(0, 9, len(cuts)).astype(float)
        pen[-1] = 0
        free = lambda n: 0 if n & (n - 1) == 0 else 32 - n
        pad = lambda n, end: free(n) if end > 300 - 32 else 32 - n
        cost = [0.0]
        for j in range(1, len(cuts)):
            cost.append(pen[j] + min(cost[i] + pad(int(cuts[j] - cuts[i]), cuts[j]) for i in range(j) if cuts[j] - cuts[i] <= 32))
        got = packing.best_cuts(cuts, pen, 32)
        paid = sum(pad(b - a, b) + pen[list(cuts).index(b)] for a, b in zip(got, got[1:]))
        assert abs(paid - cost[-1]) < 1e-9


def test_mixing(spark, small):
    rows = queries.op9_mixing(spark, small).collect()
    again = queries.op9_mixing(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in read(spark, small, "documents").collect()}
    totals = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        t = totals.setdefault(source[r.doc_id], [0, 0, r.target, r.source_size])
        t[0] += r.size
        t[1] += r.taken
    assert all(n == size and abs(k - target) <= max(130, 0.02 * target) for n, k, target, size in totals.values())
    assert abs(sum(t[2] for t in totals.values()) - sum(t[0] for t in totals.values())) < 1e-6


def test_mixing_draws():
    """Multinomial counts, and slots beyond a source's number given to sources that lack some."""
    import numpy as np

    share, n = [0.5, 0.3, 0.2], 4000
    got = np.array([mixing.shard_counts(s, n * 1000 - 100, share, 1000, 9) for s in range(n)])
    assert (got.sum(1)[:-1] == 1000).all() and got[-1].sum() == 900
    # means and variances of a multinomial draw: n p and n p (1 - p); a draw without replacement would have less
    want = np.array(share) * 1000
    assert (np.abs(got[:-1].mean(0) - want) < 0.5).all() and (np.abs(got[:-1].var(0) / (want * (1 - np.array(share))) - 1) < 0.1).all()
    drawn, slots = got[:50].sum(0), np.array([26_000, 14_000, 10_000])
    runs, at = [], np.zeros(3, int)
    for row in got[:50]:
        for k in range(3):
            runs.append((at[k], row[k], k))
            at[k] += row[k]
    first, count, k = (np.array(x) for x in zip(*runs))
    out = mixing.corrected(first, count, k, drawn, slots)
    taken = [sorted(x for _, s, f, c in out if s == j for x in range(f, f + c)) for j in range(3)]
    assert [t == list(range(int(slots[j]))) for j, t in enumerate(taken)] == [True] * 3
    per_run = np.bincount([r for r, _, _, c in out], weights=[c for *_, c in out], minlength=len(runs))
    assert (per_run == count).all()


def test_mixing_blocks_by_brute_force(spark, monkeypatch):
    """Every slot of the mix, built again from the counts and permutations."""
    import numpy as np

    monkeypatch.setattr(mixing, "BUCKET_DOCS", 5)
    docs = [(i, words(3 + i * 7 % 50, i), "abc"[i * i % 3]) for i in range(60)]
    df = frame(spark, docs)
    out, pieces = mixing.mix(df, block_words=8, shard_slots=16)
    rows, sizes = {r.doc_id: r for r in out.collect()}, {}
    for i, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted(sizes)
    targets = mixing.water_fill([sizes[s] for s in names], [5.0, 2.0, 1.0])
    got = {}
    for p in pieces.collect():
        got.setdefault((p.k, p.slot), []).append(p)
    for k, s in enumerate(names):
        n = -(-sizes[s] // 8)
        slots = min(3 * n, round(targets[k] / (sizes[s] / n)))
        assert sorted(x for j, x in got if j == k) == list(range(slots))
        blocks = {}
        for x in range(slots):
            index = int(mixing.permute(np.array([x % n]), np.array([n]), np.array([9 * 1_000_003 + k * 1009 + x // n]))[0])
            piece = sorted((p.row_key, p.start, p.words) for p in got[k, x])
            assert blocks.setdefault(index, piece) == piece  # a block is the same in every pass
            assert piece[0][0] + piece[0][1] == index * 8 and sum(p[2] for p in piece) == min(8, sizes[s] - index * 8)
    shards = {}
    for (k, x), ps in got.items():
        assert len({p.shard for p in ps}) == 1
        shards[ps[0].shard] = shards.get(ps[0].shard, 0) + 1
    assert sorted(shards.values())[1:] == [16] * (len(shards) - 1)
    assert {i: r.taken for i, r in rows.items()} == {i: sum(p.words for ps in got.values() for p in ps if p.doc_id == i) for i in rows}


def test_mixing_of_equal_and_nameless_rows(spark):
    """Null ids, rows that share an id and equal rows are documents of their own; no column but three is needed."""
    docs = [(None, words(40, 1), "a"), (None, words(40, 2), "a"), (3, words(30, 3), "b"), (3, words(30, 3), "b"), (3, words(20, 4), "b"), (None, words(40, 1), "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out, pieces = mixing.mix(df, block_words=4)
    rows = out.collect()
    assert len(rows) == 6
    texts = mixing.mixed_documents(df, pieces).collect()
    assert len(texts) == sum(r.taken > 0 for r in rows) and sum(len(r.text.split()) for r in texts) == sum(r.taken for r in rows)
    size = lambda rows, f: sorted((r.doc_id or 0, f(r)) for r in rows)
    assert size(texts, lambda r: len(r.text.split())) == size([r for r in rows if r.taken], lambda r: r.taken)
    with pytest.raises(Exception, match="other documents"):
        mixing.mixed_documents(df, pieces.withColumn("words", F.col("words") + 100)).collect()


def test_mixing_edges(spark):
    docs = [(1, None, "a"), (2, " ", "b"), (3, words(500, 1), None), (4, words(3000, 2), "b"), (5, words(3000, 2), "b"), (6, "x", "é"), (7, words(100, 3), "Z")]
    out, pieces = mixing.mix(frame(spark, docs))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].taken == got[2].taken == 0 and got[1].target == 0.0
    assert all(r.taken <= 3 * r.size for r in got.values()) and got[3].source_size == 500
    texts = {r.doc_id: r for r in mixing.mixed_documents(frame(spark, docs), pieces).collect()}
    for i, r in got.items():
        assert len(texts[i].text.split()) == r.taken if r.taken else i not in texts
    assert mixing.mix(frame(spark, []))[0].count() == 0
    assert mixing.mix(frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")]))[0].count() == 3


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.water_fill([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert mixing.water_fill([0, 0], [5, 2]) == [0.0, 0.0]


def test_permutation():
    import numpy as np

    for n in (1, 2, 3, 17, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 7))
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 7)).tolist() != list(range(1000))


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op2_quality_classifier(spark, big).collect()}
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id].predicted) for r in read(spark, big, "labels").collect() if rows[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    bad = [b for a, b in held if a == 0]
    assert sum(bad) / len(bad) < 0.1


def test_quality_edges(spark):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (10, 0, 0), (13, 0, 0), (13, None, 0), (None, 1, 0), (99, 1, 0), (13, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, EDGE + [(None, "x"), (7, words(40, 1))])
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(EDGE) + 2 and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(frame(spark, []), None).count() == 0


def test_quality_votes_by_brute_force(spark, small):
    """Terms, vectors, cosines, neighbours and votes, one text and one neighbour at a time."""
    import math
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from millrace.llm import common

    docs = read(spark, small, "documents").select("doc_id", "text")
    labels = read(spark, small, "labels")
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    assert model.labels.tolist() == [q for _, q in known]

    def terms(text):
        data, out = text.encode(), np.zeros(quality.N_TERMS)
        cls = [int(quality._CLASS[b]) for b in data]
        for (a, b), n in Counter(zip(cls, cls[1:])).items():
            out[quality.N_WORDS + a * quality.N_CLASSES + b] = n / (len(data) - 1)
        raw = brute.re.findall(brute.WORD, brute.low(text))
        for w in raw:
            h = int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
            out[h % quality.N_WORDS] += quality.WORD_WEIGHT / len(raw)
        repeats = quality.terms(pa.array([text]))[0][-2 * quality._REPEATS :] ** 2
        out[-2 * quality._REPEATS :] = repeats
        return np.sqrt(out)

    def embed(x):
        y = (x * model.idf) @ model.project
        return y / np.linalg.norm(y)

    vectors = [embed(terms(texts[i])) for i, _ in known]
    assert np.allclose(vectors, model.vectors, atol=2e-3)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i in sorted(texts)[:60]:
        y = embed(terms(texts[i]))
        near = sorted(((float(y @ v), q) for v, (_, q) in zip(model.vectors, known)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0.0) ** 4, q) for c, q in near]
        assert math.isclose(got[i], sum(v * q for v, q in votes) / sum(v for v, _ in votes), abs_tol=0.02)


def test_quality_repetition_of_whole_texts():
    """Repetition shows wherever it stands: behind 400 fresh words, and not in the opening alone."""
    import numpy as np
    import pyarrow as pa

    fresh, filler = " ".join(f"u{i}" for i in range(4000)).split(), " ".join(f"f{i}" for i in range(10)).split()
    texts = [" ".join(x) for x in (fresh[:1000], fresh[:400] + filler * 60, filler * 40 + fresh[:3600], filler * 100)]
    at = quality.N_TERMS - quality._REPEATS
    clean, late, early, all_ = (int(np.flatnonzero(r[at:])[0]) for r in quality.terms(pa.array(texts)))
    assert all_ < late < early <= clean and late < clean // 2 and all_ == 0
    assert quality.freshness(np.arange(1, 1001)) == 1.0 and quality.freshness(np.r_[np.arange(400), np.zeros(400)]) == (1 + 1 / 400) / 2


def test_licences(spark):
    docs = [
        (1, "intro\nReleased under the MIT license!\nmore"), (2, "Licensed under the Apache License Version 2.0"), (3, None), (4, ""), (5, "License"), (6, LONG),
        (7, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation; either version 3 of the License, or (at your option) any later version."), (8, "Released under the MIT License.\nLicensed under CC BY 4.0."),
        (8, "Released under the MIT License.\nLicensed under CC BY 4.0."),
    ]
    got = {r.doc_id: r for r in licences.scan(frame(spark, docs)).collect()}
    assert (got[1].licences, got[1].best_dice) == ("MIT", 1.0) and got[2].licences == "Apache-2.0" and got[7].licences == "GPL-3.0"
    assert got[8].licences == "CC-BY-4.0,MIT" and got[8].n_licence_lines == 2 and got[8].best_licence == "CC-BY-4.0"
    assert all(got[i].n_licence_lines == 0 and got[i].best_licence is None for i in (3, 4, 5, 6))
    assert licences.scan(frame(spark, docs)).count() == 9 and licences.scan(frame(spark, [])).count() == 0


def test_licences_across_lines(spark):
    """Notices wrapped over lines, behind prose and within full licence texts."""
    import textwrap

    by_name = {}
    for name, text in licences.TEMPLATES:
        by_name[name] = max(by_name.get(name, ""), text, key=len)
    mit = by_name["MIT"][:-1] + (
        ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.")  # fmt: skip
    bsd = by_name["BSD-3-Clause"] + "\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    apache = "Copyright 2020 Someone\n\n" + by_name["Apache-2.0"] + " You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"
    head = " ".join(t for n, t in licences.PASSAGES if n == "GPL-3.0")
    full = {10: ("MIT", mit), 20: ("BSD-3-Clause", bsd), 30: ("Apache-2.0", apache), 40: ("GPL-3.0", by_name["GPL-3.0"]), 50: ("GPL-3.0", head + " Preamble " + words(300, 4))}
    wrap = lambda t, n: "\n".join(" * " + y for x in t.split("\n") for y in textwrap.wrap(x, n) or [""])
    docs = [(i + k, x) for i, (_, t) in full.items() for k, x in enumerate((t, wrap(t, 70), words(50, i) + "\n" + wrap(t, 40) + "\n" + words(50, i + 1)))]
    docs += [(1, "We like it a lot. Released under the MIT License."), (2, words(900, 6)), (3, "the software license of the public work"), (4, None),
             (5, "Released under the MIT License.\n" + wrap(by_name["GPL-3.0"], 60) + "\nmore")]
    got = {r.doc_id: r for r in licences.scan(frame(spark, docs)).collect()}
    for i, (name, _) in full.items():
        assert all(got[i + k].licences == got[i + k].best_licence == name and got[i + k].best_dice > (0.95 if k else 0.8) for k in range(3)), name
        assert got[i].n_licence_lines == 1 < got[i + 1].n_licence_lines < got[i + 2].n_licence_lines
    assert (got[1].licences, got[1].n_licence_lines, got[1].best_dice) == ("MIT", 1, 1.0)
    whole = licences.scan(frame(spark, [(k, wrap(t, 60)) for k, (_, t) in enumerate(licences.PASSAGES)])).collect()
    assert {r.doc_id: r.licences for r in whole} == {k: n for k, (n, _) in enumerate(licences.PASSAGES)}
    assert got[5].licences == "GPL-3.0,MIT" and got[5].n_licence_lines == 1 + len(textwrap.wrap(by_name["GPL-3.0"], 60))
    assert all(got[i].n_licence_lines == 0 and got[i].best_licence is None for i in (2, 3, 4))


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracles(spark, small, duck, key):
    from compare import same_rows

    same_rows(queries.QUERIES[key](spark, small), duck.sql(queries.ORACLES[key]))
