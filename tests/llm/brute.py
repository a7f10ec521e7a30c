"""Plain restatements of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def quality(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def decontaminate(text, items, width=13):
    """items: (item_id, text)."""
    ws = TOKEN.findall(lower(text or ""))
    hit, got = set(), set()
    for item, t in items:
        iw = TOKEN.findall(lower(t or ""))
        n = min(width, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1) if n else ():
            if tuple(ws[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                got.add(str(item))
    ids = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
    return len(ws), len(hit), len(got), ids, bool(hit) and 20 * len(hit) >= len(ws)


def cut(text, items, width=13):
    """text without the words that are hit and the gap after each."""
    low = lower(text or "")
    at, hit = [(m.start(), m.end()) for m in TOKEN.finditer(low)], set()
    ws = [low[a:z] for a, z in at]
    for _, t in items:
        iw = TOKEN.findall(lower(t or ""))
        n = min(width, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1) if n else ():
            if tuple(ws[i : i + n]) in grams:
                hit |= set(range(i, i + n))
    if not hit:
        return text
    ends = [a for a, _ in at[1:]] + [len(text)]
    return text[: at[0][0]] + "".join(text[at[i][0] : ends[i]] for i in range(len(at)) if i not in hit)


def shingles(text, n):
    ws = WORD.findall(lower(text or ""))
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def near(docs, n=2, percent=80):
    """docs: (id, text). id -> (size, component)."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((find(sets[a][0]), find(sets[b][0])))
                up[v] = u
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(docs, width=50):
    """docs: (id, text). id -> (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def chat(turns):
    """turns: (turn, role, text) of one conversation."""
    turns = sorted(turns)
    whole = "".join(f"{r}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


__all__ = [*globals(), "Counter"]
