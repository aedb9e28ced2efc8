"""Plain-Python versions of the corpus operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def targets(sizes):
    """sizes: source -> words; the contract's targets, by repeated dealing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = Fraction(3, 2) * sum(sizes.values()), {s: Fraction(0) for s in order}, set(order)
    while open_ and left:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        for s in over or list(open_):
            out[s] = Fraction(2 * sizes[s]) if over else unit * weight[s]
            left -= out[s]
            open_.discard(s)
    return out


def contamination(docs, items, window=10):
    """One (n_words, n_hit, n_items, sha) for each doc."""
    grams = defaultdict(set)
    for item, text in items:
        w = TEST_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + window])].add(item)
    lengths = {len(g) for g in grams}
    out = []
    for _, text in docs:
        w = TEST_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        names = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(names), sha(",".join(names))))
    return out


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(docs, radius=3):
    return len({r for _, _, r in simhash_components(docs, radius, number=True)})


def simhash_components(docs, radius=3, number=False):
    fps = [fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    if number:
        return [(d, fps[i], root(i)) for i, (d, _) in enumerate(docs)]
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = root(i)
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(docs, fps, strict=True))]


def substrings(docs, window=50):
    """One (n_words, n_removed, sha) for each doc."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                g = tuple(w[i : i + window])
                first[g] = min(d, first.get(g, d))
    out = []
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed


def bin_top(v):
    """Largest value that shares a sketch bin with ``v``."""
    if v < 64:
        return v
    shift = v.bit_length() - 6
    return (((v >> shift) + 1) << shift) - 1


def quality_kept(docs, spread=6, least=50):
    """(kept, limits) of each (text, lang, source), by sorting whole groups."""
    rates = []
    for text, _, _ in docs:
        n, chars, symbols, dups, reps, failed = quality(text)
        rates.append((failed, *(x * 1000 // n if n else 0 for x in (chars, symbols, dups, reps))))
    groups = [defaultdict(list) for _ in range(3)]
    for (_, lang, source), r in zip(docs, rates, strict=True):
        for g, k in zip(groups, ((lang, source), lang, None), strict=True):
            g[k].append(r[1:])
    at = lambda vs, q: vs[(len(vs) * q + 99) // 100 - 1] if vs else 0
    out = []
    for (_, lang, source), r in zip(docs, rates, strict=True):
        rows = next((g[k] for g, k in zip(groups, ((lang, source), lang), strict=False) if len(g[k]) >= least), groups[2][None])
        limits = []
        for i in range(4):
            vs = sorted(bin_top(x[i]) for x in rows)
            some = [v for v in vs if v]
            q50, q75, q90, p25, p75 = at(vs, 50), at(vs, 75), at(vs, 90), at(some, 25), at(some, 75)
            limits.append(max(q90, q75 + spread * (q75 - q50) if q75 > q50 else p75 + (p75 - p25) * 3 // 2))
        out.append((not r[0] and all(a <= b for a, b in zip(r[1:], limits, strict=True)), tuple(limits)))
    return out


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def stable_key(doc_id):
    return int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def language_model(docs, order=3, discount=0.75, least=1):
    """One (n_tokens, n_known, N, base, score) for each doc."""
    tokens = [["<s>", *words((t or "").translate(LOWER)), "</s>"] for _, t in docs]
    train = [w for (d, _), w in zip(docs, tokens, strict=True) if crc(d, 7) != 2]
    counts = [Counter(), Counter(), Counter()]
    for w in train:
        counts[0].update((x,) for x in w[1:])
        counts[1].update(zip(w, w[1:], strict=False))
        counts[2].update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(counts[0].values()), len(counts[0])
    starts = {**counts[0], ("<s>",): len(train)}
    stored = [starts, {g: c for g, c in counts[1].items() if c >= least and starts[g[:1]] >= least and starts[g[1:]] >= least}, {g: c for g, c in counts[2].items() if c >= least}]
    mass, kinds = Counter(), Counter()
    for level in stored[1:]:
        for g, c in level.items():
            mass[g[:-1]] += c
            kinds[g[:-1]] += 1
    out = []
    for w in tokens:
        base = score = 0.0
        for i in range(1, len(w)):
            p = (counts[0][(w[i],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, order):
                if i < k:
                    break
                h = tuple(w[i - k : i])
                if (total := stored[k - 1].get(h, 0)) >= least:
                    c = stored[k].get((*h, w[i]), 0)
                    p = (c - discount if c else 0) / total + (1 - (mass[h] - discount * kinds[h]) / total) * p
            score += math.log10(p)
        out.append((len(w) - 1, sum(counts[0][(x,)] > 0 for x in w[1:]), n, base, score))
    return out
