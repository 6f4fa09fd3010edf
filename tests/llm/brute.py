"""Plain-Python versions of the operators, written from their definitions."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def groups(nodes, linked):
    """Smallest id reachable of each node under a link predicate over pairs."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def simhash(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = collections.Counter(five)
    marked = {k + d for k, x in enumerate(five) if often[x] > 1 for d in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(marked)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def substrings(docs, length=100):
    """{id: (bytes, removed, spans, sha256 of the rest)} for unique ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=int)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = 1
            seen.add(s)
        gone = gone[: len(data)]
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def lines(docs, window=2, long_words=50):
    """{id: text without repeated runs} for unique ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").split("\n")
        place = [k for k, x in enumerate(raw) if WORD.search(x)]
        gone = set()
        for a in range(len(place)):
            run = tuple(raw[k] for k in place[a : a + window])
            whole, long = len(run) == window, len(WORD.findall(raw[place[a]])) >= long_words
            for ok, key, span in ((whole, ("run", run), place[a : a + window]), (long, ("long", raw[place[a]]), place[a : a + 1])):
                if not ok:
                    continue
                if key in seen:
                    gone.update(span)
                seen.add(key)
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(raw) if k not in gone)
    return out


def decision_list(rows, points, max_rules=8, max_conditions=3, min_precision=0.9, min_covered=3):
    """Sequential covering over single rows (values by feature, bad, prunes); a list of lists of (feature, above, threshold)."""
    features = list(rows[0][0]) if rows else []
    classes = [[x for x in rows if x[1] == y] for y in (False, True)]
    if not all(classes):
        return []
    grid = {}
    for f in features:
        seen = sorted({float(q) for c in classes for q in np.percentile([x[0][f] for x in c], [100 * p for p in points])})
        grid[f] = [(a + b) / 2 for a, b in zip(seen, seen[1:])]
    tests = [(f, above, t) for f in features for t in grid[f] for above in (False, True)]
    fires = lambda rule, x: all((x[0][f] > t) == above for f, above, t in rule)
    count = lambda rule, rows, prunes: [sum(fires(rule, x) and x[2] == prunes and x[1] == y for x in rows) for y in (True, False)]
    rules, left = [], rows
    while len(rules) < max_rules:
        rule = []
        while len(rule) < max_conditions:
            p0, n0 = count(rule, left, False)
            if not p0 or not n0:
                break
            best, most = None, 1e-9
            for t in tests:
                p, n = count([*rule, t], left, False)
                gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0
                if gain > most + 1e-12:
                    best, most = t, gain
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = count(rule[:k], left, True)
            worth.append((p - n) / (p + n) if p + n else -1)
        rule = rule[: 1 + worth.index(max(worth))]
        p, n = count(rule, left, True)
        if not p or p < min_precision * (p + n) or p + count(rule, left, False)[0] < min_covered:
            break
        rules.append(rule)
        left = [x for x in left if not fires(rule, x)]
    return rules


def _tokens(text):
    return re.findall(r"\w+|[^\w\s]+", (text or "").lower())


def importance(rows, good, buckets, seed):
    """{(id, text): (weight, n-grams, key)} of (id, text) rows against the texts in good, from the definitions."""

    def grams(text):
        one = [zlib.crc32(t.encode()) for t in _tokens(text)]
        all_ = one + [(a * 0x9E3779B97F4A7C15 + b + 1) % 2**64 for a, b in zip(one, one[1:])]
        return [(x * 0xD6E8FEB86659FD93 % 2**64 >> 33) % buckets for x in all_]

    raw, target = collections.Counter(), collections.Counter()
    for _, t in rows:
        raw.update(grams(t))
    for t in good:
        target.update(grams(t))
    p = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * buckets)
    ratio = {b: math.log(p(target, b) / p(raw, b)) for b in raw}
    out = {}
    for i, t in rows:
        h = xxhash.xxh64_intdigest(seed.encode(), 42)
        h = h if i is None else xxhash.xxh64_intdigest(str(i).encode(), h)
        inner = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        h = xxhash.xxh64_intdigest(inner.to_bytes(8, "little"), h)
        uniform = ((h >> 16) + 0.5) / 2**48
        g = grams(t)
        w = sum(ratio[b] for b in g)
        out[i, t] = (w, len(g), w - math.log(-math.log(uniform)) if g else -1e300)
    return out


def toxicity(train, texts, max_features, min_docs, penalty=1.0):
    """Scores of texts by a logistic model over distinct character 3- to 6-grams times their log-count ratios; Newton's method."""

    def grams(text):
        s = "\0" * 5 + (text or "").lower() + "\0" * 5
        out = set()
        for at in range(len(s) - 5):
            h = ord(s[at])
            for n in range(2, 7):
                if at + n > len(s):
                    break
                h = (h * 0x9E3779B97F4A7C15 + ord(s[at + n - 1])) % 2**64
                if n >= 3:
                    out.add(((h + n) * 0xD6E8FEB86659FD93 % 2**64) >> 44)
        return out

    sets, y = [grams(t) for t, _ in train], np.array([float(v) for _, v in train])
    pos, neg = y.sum(), len(y) - y.sum()
    p, q = collections.Counter(), collections.Counter()
    for s, v in zip(sets, y):
        (p if v else q).update(s)

    def gain(b):
        share = pos / len(y)
        cells = [(p[b], (p[b] + q[b]) * share), (q[b], (p[b] + q[b]) * (1 - share)), (pos - p[b], (len(y) - p[b] - q[b]) * share), (neg - q[b], (len(y) - p[b] - q[b]) * (1 - share))]
        return sum(o * math.log(o / e) for o, e in cells if o > 0)

    chosen = sorted((b for b in {*p, *q} if p[b] + q[b] >= min_docs), key=lambda b: (-round(gain(b), 9), b))[:max_features]
    scale = np.array([math.log((p[b] + 1) / (pos + 2)) - math.log((q[b] + 1) / (neg + 2)) for b in chosen])
    matrix = lambda sets: np.array([[b in s for b in chosen] for s in sets]) * scale
    x = np.concatenate([matrix(sets), np.ones((len(y), 1))], axis=1)
    w, ridge = np.zeros(len(chosen) + 1), np.diag([penalty] * len(chosen) + [0.0])
    for _ in range(100):
        e = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (e * (1 - e))[:, None]).T @ x + ridge + 1e-12 * np.eye(len(w)), x.T @ (e - y) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-(np.concatenate([matrix([grams(t) for t in texts]), np.ones((len(texts), 1))], axis=1) @ w)))
