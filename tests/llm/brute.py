"""Plain, quadratic versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(WORD, low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, links):
    up = {n: n for n in nodes}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard(docs):
    """doc_id -> (n_shingles, component_id)."""
    sets, where, links = {i: shingles(t) for i, t in docs}, defaultdict(list), []
    for i, s in sets.items():
        common = Counter(o for t in s for o in where[t])
        links += [(i, o) for o, k in common.items() if 100 * k >= 75 * (len(s) + len(sets[o]) - k)]
        for t in s:
            where[t].append(i)
    top = components(sets, links)
    return {i: (len(s), top[i]) for i, s in sets.items()}


def substring_dedup(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :]


def units(x, min_words=8, min_chars=16):
    """(kind, words or characters) of a line that may have near copies, or none."""
    w = x.split(" ")
    return ("words", w) if len(w) >= min_words else ("chars", list(x)) if len(x) >= min_chars else None


def line_dedup(docs, min_words=8, min_chars=16):
    """Kept texts, row by row; rows of one id and text are one document, others of one id follow one another."""
    first, rows = {}, list(docs)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r\x0b\x0c"):
                first.setdefault(x, (len(first), i, t, k))
    some = [(x, units(x, min_words, min_chars)) for x in first]
    some = [(x, *u) for x, u in some if u]
    near = set()
    for a, (x, kind, w) in enumerate(some):
        for y, other, v in some[:a]:
            if kind == other and abs(len(w) - len(v)) <= 1 and within_one(w, v):
                near.add(x if first[x] > first[y] else y)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        out.append("\n".join(x for k, x in enumerate(lines) if not x.strip(" \t\r\x0b\x0c") or (x not in near and first[x][1:] == (i, t, k))))
    return out
