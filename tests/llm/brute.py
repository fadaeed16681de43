"""Plain versions of the corpus operators for small tables."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def solid_words(text):
    return re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near_dups(rows, percent=85):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(solid_words(t), 5) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def line_dedup(rows, min_chars=20, min_docs=3):
    """[(doc_id, n_lines, n_dropped, kept text)] of (doc_id, text) rows."""
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).translate(LOWER)
    order = lambda d: (d is not None, d or 0)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(docs, items, window=13):
    """[(doc_id, n_words, n_hit, item ids, contaminated)]."""
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), ",".join(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
