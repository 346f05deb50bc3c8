"""Plain Python versions of the operators, over lists of rows; each row is a document of its own."""

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(units, length):
    """For each sequence, the places covered by a window that starts anywhere else too."""
    seen = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def repeated_words(rows, target=35):
    units = [re.findall(SPACE, t or "") for _, t in rows]
    out = []
    for (i, _), u, gone in zip(rows, units, covered(units, target), strict=True):
        out.append((i, len(u), sum(gone), sha(" ".join(w for w, g in zip(u, gone, strict=True) if not g))))
    return out


def repeated_bytes(rows, target=400):
    units = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), u, gone in zip(rows, units, covered(units, target), strict=True):
        n = sum(g and not h for g, h in zip(gone, [False, *gone[:-1]], strict=True)) if u else 0
        out.append((i, len(u), sum(gone), n, sha(bytes(b for b, g in zip(u, gone, strict=True) if not g))))
    return out


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def smallest_ids(ids, root):
    best = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return [best.get(r) for r in root]


def jaccard(rows, percent=80):
    sets, pairs = jaccard_pairs(rows, percent)
    names = smallest_ids([i for i, _ in rows], classes(len(rows), pairs))
    return [(i, len(s), c) for (i, _), s, c in zip(rows, sets, names, strict=True)]


def jaccard_pairs(rows, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    pairs = set()
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in where[x] if j > i)
        pairs |= {(i, j) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)}
    return sets, pairs


def benchmark(rows, items, window=10):
    where = defaultdict(set)
    for item, t in items:
        w = re.findall(ALNUM, lower(t))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            where[tuple(w[k : k + window])].add(str(item))
    sizes = {len(k) for k in where}
    out = []
    for i, t in rows:
        w = re.findall(ALNUM, lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := where.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in double) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return kind == "email" or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)


def personal(rows):
    out = []
    for i, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if holds(k, m.group())]
        out.append((i, *(sum(s[0] == k for s in spans) for k in BASE), sha(",".join("%s:%d:%d" % s for s in spans))))
    return out


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def licences(rows):
    out = []
    for i, t in rows:
        w = re.findall(ALNUM, lower(t))
        f = [(k, name) for p, name in PHRASES.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        out.append((i, len(w), len(f), min((x for x, _ in f), default=None), max((x for x, _ in f), default=None), ",".join(sorted({x for _, x in f}))))
    return out


def phrases(rows, least=30, top=2000):
    """rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    best = defaultdict(list)
    cands = [p for p, c in f.items() if c >= least and len(p) > 2]
    around = defaultdict(int)
    for p in cands:
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                around[(p[0], *p[i : i + k])] = max(around[(p[0], *p[i : i + k])], f[p])
    for p in cands:
        a = f[p]
        if 100 * around.get(p, 0) >= 80 * a:
            continue
        cuts = [(2000000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        best[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return [(lang, rank, ph.decode(), -a, left, right, n[lang], -s) for lang, x in best.items() for rank, (s, a, ph, left, right) in enumerate(sorted(x)[:top], 1)]


def codes(rows, parts=16, entries=64, rounds=2):
    """rows of (vec_id, vector, label), all of one width; ids not null."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    step = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    first = sorted(kept, key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, v, y in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
        by_label[y] += out[-1][2]
    digest = sha(",".join(str(c) for book in books for e in book for c in e))
    return [(i, c, e, by_label[y], digest) for i, c, e, y in out]


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing needs."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        n += at == len(rooms)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - x)
    return n
