"""Plain restatements of the operators' results, row by row."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=5):
    w = SPACED.findall((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i: i + width]) for i in range(len(w) - width + 1))


def near_duplicates(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_words(rows, width=35):
    """For each (doc_id, text) the words that stay."""
    words = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i: i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i: i + width])] > 1:
                gone.update(range(i, i + width))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return words, out


def contaminated(docs, items, width=10):
    """For each document (n_words, n_hit, item ids as sorted text)."""
    phrases = defaultdict(set)
    for item, text in items:
        w = LETTERED.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            phrases[tuple(w[i: i + width])].add(item)
    out = []
    for _, text in docs:
        w = LETTERED.findall((text or "").translate(LOWER))
        hit, who = set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                p = tuple(w[i: i + n])
                if p in phrases:
                    hit.update(range(i, i + n))
                    who |= phrases[p]
        out.append((len(w), len(hit), ",".join(sorted(str(x) for x in who if x is not None))))
    return out


def near(docs, items, width=10, around=20):
    """For each document the windows that stand within ``around`` words of a place of their rarest word."""
    texts = {i: LETTERED.findall((t or "").translate(LOWER)) for i, t in docs}
    count = Counter(w for ws in texts.values() for w in ws)
    phrases = set()
    for _, text in items:
        w = LETTERED.findall((text or "").translate(LOWER))
        phrases.update(tuple(w[i: i + width]) for i in range(max(len(w) - width, 0) + 1 if w else 0))
    out = {}
    for i, ws in texts.items():
        out[i] = 0
        for p in phrases:
            if all(count[w] for w in p):
                rare = min(set(p), key=lambda w: (count[w], p.index(w)))
                out[i] += any(set(p) <= set(ws[max(0, at - around): at + around + 1]) for at, w in enumerate(ws) if w == rare)
    return out


def minimax(sizes, n):
    """The least capacity at which ``sizes`` fit ``n`` contiguous runs."""
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, room = (lo + hi) // 2, 1, 0
        for s in sizes:
            if room + s > mid:
                used, room = used + 1, 0
            room += s
        lo, hi = (lo, mid) if used <= n else (mid + 1, hi)
    return lo


LATIN = re.compile("[A-Za-zÀ-ÿ]+")


def spelling(rows, least=5, length=6, damaged=199):
    """Sorted (word, form, root, n, n_near, form_n) of (doc_id, text)."""
    n = Counter()
    for i, t in rows:
        for r in LATIN.findall(t or ""):
            r = r.translate(LOWER)
            if i is not None and damaged:
                h = zlib.crc32(f"{i}:{r}".encode())
                if h % damaged == 0:
                    r = r[:h % len(r)] + r[h % len(r) + 1:]
            n[r] += 1
    words = {w: c for w, c in n.items() if c >= least and len(w) >= length}
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            d = w[:i] + w[i + 1:]
            holes[(i, d)].append(w)
            if d in words:
                near[w].add(d)
                near[d].add(w)
    for g in holes.values():
        for a in g:
            near[a].update(x for x in g if x != a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def trie(rows, every=20, most=4):
    """Sorted rows of every node of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    conv = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        conv[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, kids = defaultdict(list), Counter()
    for c, v in conv.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        value = (len(m) - 1) * (len(SPACED.findall(k[-1][1])) if k else 0)
        for d in range(len(k) + 1):
            saved[k[:d]] += value
            leaves[k[:d]] += k not in kids
    ids = {k: ",".join(str(c) for c in sorted(m) if len(conv[c]) == len(k)) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                   hashlib.sha256(ids[k].encode()).hexdigest()) for k, m in members.items())
