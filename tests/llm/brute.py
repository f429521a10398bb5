"""Plain versions of the operators over lists of (doc_id, text), for the tests."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def line_dedup(docs):
    held = defaultdict(set)
    cut = {i: (t or "").split("\n") for i, t in docs}
    key = lambda x: x.strip(SPACES).translate(LOWER)
    for i, lines in cut.items():
        for x in lines:
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, lines in cut.items():
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def windows(words, width=13):
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def contamination(docs, items):
    owners = defaultdict(set)
    for k, t in items:
        for w in windows(WORD.findall((t or "").translate(LOWER))):
            owners[w].add(str(k))
    sizes = sorted({len(w) for w in owners})
    out = []
    for i, t in docs:
        words = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(words) - n + 1):
                if (w := tuple(words[a : a + n])) in owners:
                    hit |= set(range(a, a + n))
                    found |= owners[w]
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def shingles(text, k):
    words = RUN.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def near(docs, k, part, of):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * of >= part * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if of * both >= part * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def licenses(docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    out = {}
    for i, t in docs:
        words = WORD.findall((t or "").translate(LOWER))
        places = [(a, label) for p, label in phrases.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split()]
        starts = [a for a, _ in places]
        labels = ",".join(sorted({x for _, x in places}))
        out[i] = (len(words), len(places), min(starts, default=None), max(starts, default=None), labels)
    return out


def quality(text):
    text = text or ""
    words = RUN.findall(text)
    lines = [x for x in text.split("\n") if RUN.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 8)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
        len(words) < 20 or 100 * len(hit) > 30 * len(words),
    )


def ranked(docs, items, best=50):
    import math

    tf = [(i, Counter(WORD.findall((t or "").translate(LOWER)))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(c.total() for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for k, t in items:
        found = []
        for i, c in tf:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m))
                for w in set(WORD.findall((t or "").translate(LOWER)))
                if c[w]
            )
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(k, r, i, -s) for r, (s, _, i) in enumerate(found[:best], 1)]
    return out


def trie(rows):
    import zlib

    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in held.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if whole[c] == p)))
        for p, m in members.items()
    )


def repeats(docs, width=35):
    words = [RUN.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[a : a + width]) for w in words for a in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = {p for a in range(len(w) - width + 1) if seen[tuple(w[a : a + width])] > 1 for p in range(a, a + width)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out
