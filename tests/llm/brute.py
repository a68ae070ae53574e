"""The operators' results written out plainly, for small tables."""

import hashlib
import re
from collections import defaultdict

STRIP = "".join(map(chr, [32, *range(9, 14)]))
ASCII_LOW = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def order(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def line_dedup(docs):
    """docs: (doc_id, text); gives (doc_id, n_lines, n_dropped, kept_sha256)."""
    has = defaultdict(set)
    keyed = []
    for d, text in docs:
        lines = (text or "").split("\n")
        keys = [x.strip(STRIP).translate(ASCII_LOW) for x in lines]
        keyed.append((d, lines, keys))
        for k in keys:
            if len(k) >= 20:
                has[k].add(order(d))
    out = []
    for d, lines, keys in keyed:
        kept = [x for x, k in zip(lines, keys) if len(has.get(k, ())) < 3 or max(has[k]) == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def substring_dedup(docs, window=13):
    first = {}
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def secrets(docs):
    """(doc_id, n_assign, n_access, n_hex, base_sha256) by the base rules as they are written."""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = []
    for d, text in docs:
        text = text or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        n = [sum(k == i for _, k, _ in found) for i in range(3)]
        out.append((d, *n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)))))
    return out


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOW))


def decontaminate(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    holders = defaultdict(set)
    for i, text in items:
        w = _words(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            holders[tuple(w[a : a + window])].add(str(i))
    sizes = {len(k) for k in holders}
    out = []
    for d, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in holders:
                    hit.update(range(a, a + n))
                    found |= holders[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def near_duplicates(docs, least=0.8, words=5):
    """(doc_id, class_id): components of texts with the same words, or with a Jaccard similarity of shingles of at least 0.8."""
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, first = [], {}
    for d, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        root.setdefault(order(d), order(d))
        sets.append((order(d), tuple(w), {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()))
    links = 0
    by = defaultdict(list)
    for i, (_, _, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = defaultdict(int)
    for group in by.values():
        for j, a in enumerate(group):
            for b in group[:j]:
                seen[b, a] += 1
    pairs = [(a, b) for (a, b), n in seen.items() if n >= least * (len(sets[a][2]) + len(sets[b][2]) - n)]
    for i, (_, w, _) in enumerate(sets):
        pairs.append((first.setdefault(w, i), i))
    for a, b in pairs:
        links += 1
        x, y = sorted((find(sets[a][0]), find(sets[b][0])))
        root[y] = x
    return [(d, None if find(order(d)) == order(None) else find(order(d))) for d, _ in docs]
