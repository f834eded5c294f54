"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import re

import xxhash

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def words(t):
    return WHITE.findall(t or "")


def base_statistics(t):
    t = t or ""
    w = words(t)
    n = len(w)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(n - 2):
        if seen[(w[i], w[i + 1], w[i + 2])] > 1:
            hit.update((i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if WHITE.search(x)]
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
            "base_failed": n < 50 or 100 * len(hit) > 50 * n}


def simhash(t, k=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    if not w:
        return 0
    parts = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, distance=2):
    """Smallest id reachable over pairs within the distance, per row."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def spark_hash(s):
    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


_BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(t):
    return _BENCH.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def contamination(docs, items, window=10):
    """Per text: n_words, n_hit, sorted item ids."""
    at = collections.defaultdict(set)
    for item, t in items:
        w = bench_words(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            at[tuple(w[i:i + n])].add(item)
    lengths = {len(x) for x in at}
    out = []
    for t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in at:
                    hit.update(range(i, i + n))
                    found |= at[tuple(w[i:i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def targets(sizes, cap=3):
    """{source: size} -> {source: target} by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        w = sum(weight[s] for s in open_)
        got = {s: cap * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in open_ if got[s] > cap * sizes[s]}
        if not over:
            return got
        full |= over


def sha(ids):
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


BASE_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                 "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                 "card": r"[0-9]([\x20-]?[0-9])+",
                 "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in BASE_PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            d = "".join(c for c in m.group() if c in "0123456789")
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def plain_words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(t, k=5):
    w = plain_words(t)
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


def recurring(texts, min_docs, depth=3, min_tokens=3, constant=0.5):
    """Per text: numbers of the lines that the log-template tree drops."""
    def leaf(x):
        return (len(x), *["<*>" if re.search("[0-9]", t) else t for t in x[:depth]])
    split = {t: [line.split() for line in t.split("\n")] for t in set(texts) if t is not None}
    seen = collections.defaultdict(set)
    for t, lines in split.items():
        for x in lines:
            if len(x) >= min_tokens:
                seen[leaf(x)].add(t)
    good = {k for k, v in seen.items() if len(v) >= min_docs}
    held = collections.defaultdict(set)
    for t, lines in split.items():
        for x in lines:
            if len(x) >= min_tokens and leaf(x) in good:
                held[leaf(x), tuple(x)].add(t)
    times = collections.Counter()
    for (k, x), ts in held.items():
        for p, tok in enumerate(x):
            times[k, p, tok] += len(ts)

    def template(k, x):
        return tuple((p, tok) for p, tok in enumerate(x) if times[k, p, tok] >= min_docs)
    shapes = collections.Counter()
    for (k, x), ts in held.items():
        if template(k, x) and len(template(k, x)) >= constant * len(x):
            shapes[k, template(k, x)] += len(ts)
    bad = {(k, x) for (k, x) in held if shapes.get((k, template(k, x)), 0) >= min_docs}
    return [[] if t is None else [i for i, x in enumerate(split[t]) if (leaf(x), tuple(x)) in bad] for t in texts]
