"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rule_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def exact(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[lower(text or "")].append((doc_id, i))
    out = {}
    for text, members in groups.items():
        top = max(d for d, _ in members)
        for d, _ in members:
            out[d] = (top, len(members), d == top, hashlib.sha256(text.encode()).hexdigest())
    return out


def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near(rows, n=4, percent=80):
    sets = {d: shingles(t, n) for d, t in rows}
    lists = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            lists[x].add(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = Counter(e for x in s for e in lists[x] if e < d)
        for e, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[e]) - c):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def substrings(rows, n=50):
    first, words = {}, {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for k in range(n)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def targets(sizes):
    """Source -> target, by capping again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, out, left = set(names), {}, 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def quartile_bins(values, tail, least):
    """First and third quartile of values cut to their first six bits, and the limits they give."""
    low = sorted(v - v % (1 << max(v.bit_length() - 6, 0)) for v in values)
    q1, q3 = (next(x for i, x in enumerate(low, 1) if 4 * i >= k * len(low)) for k in (1, 3))
    spread = max(q3 - q1, least)
    return q1 - tail * spread, q3 + tail * spread


def good(rows, least_rows=200, tail=3.0):
    """Row by row, whether (lang, source, text) passes the quality rules."""
    least = {"symbols": 128, "dups": 128, "repeats": 64, "length": 64}
    judged, groups = [], defaultdict(list)
    for lang, source, text in rows:
        n, chars, symbols, dups, repeats = rule_counts(text or "")
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        values = {"symbols": 1024 * symbols // n, "dups": 1024 * dups // max(lines, 1), "repeats": 1024 * repeats // n, "length": 64 * chars // n} if n else None
        judged.append((lang, source, values, n < 10 or 100 * repeats > 20 * n))
        for key in ((lang, source), (lang,), ()) if n else ():
            groups[key].append(values)
    limits = {key: {m: quartile_bins([v[m] for v in found], tail, least[m]) for m in least} for key, found in groups.items()}

    def passes(lang, source, values):
        key = next((k for k in ((lang, source), (lang,)) if len(groups[k]) >= least_rows), ())
        return all((m != "length" or limits[key][m][0] <= v) and v <= limits[key][m][1] for m, v in values.items())

    return [not failed and passes(lang, source, values) for lang, source, values, failed in judged]


def mix_errors(had, taken):
    """What is wrong with a mix: ``had`` is doc_id -> (source, words), ``taken`` doc_id -> copies."""
    sizes, largest, out = Counter(), Counter(), []
    for source, n in had.values():
        sizes[source] += n
        largest[source] = max(largest[source], n)
    goal = targets(sizes)
    for d, (source, n) in had.items():
        chance = goal[source] / sizes[source] if sizes[source] else 0
        if n and not chance - 1 < taken[d] < chance + 1:
            out.append((d, taken[d], chance))
    for source in sizes:
        got = sum(taken[d] * n for d, (s, n) in had.items() if s == source)
        if abs(got - goal[source]) > largest[source]:
            out.append((source, got, goal[source]))
    return out


def discounts(counts):
    """What counts of one, of two, and of more give up."""
    often = Counter(counts)
    c1, c2, c3, c4 = (often[i] for i in (1, 2, 3, 4))
    y = c1 / (c1 + 2 * c2) if c1 + 2 * c2 else 0.5
    raw = (1 - 2 * y * c2 / c1 if c1 else 0.5, 2 - 3 * y * c3 / c2 if c2 else 1.0, 3 - 4 * y * c4 / c3 if c3 else 1.5)
    return [min(max(d, 0.1), top) for d, top in zip(raw, (0.95, 1.9, 2.85))]


def kneser_ney(texts, order=5):
    """The bits of a text under interpolated modified Kneser-Ney of bytes, by recursion over contexts."""
    lead = b"\n" * (order - 1)
    counts = Counter()
    for t in texts:
        whole = lead + (t or "").encode()
        counts.update(whole[i : i + order] for i in range(len(whole) - order + 1))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off = {k: discounts(c.values()) for k, c in levels.items()}
    after = {k: defaultdict(dict) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n

    def chance(context, byte):
        k = len(context) + 1
        below = chance(context[1:], byte) if k > 1 else 1 / 256
        seen = after[k].get(context)
        if not seen:
            return below
        total, spare = sum(seen.values()), sum(off[k][min(n, 3) - 1] for n in seen.values())
        n = seen.get(byte, 0)
        return (n - off[k][min(n, 3) - 1] if n else 0) / total + spare / total * below

    def bits(text):
        whole = lead + (text or "").encode()
        return -sum(math.log2(chance(whole[i - order + 1 : i], whole[i])) for i in range(order - 1, len(whole)))

    return bits


def bit_limits(rows, least=50):
    """(lang, length band) -> highest bits a byte that passes; ``rows`` are (lang, bytes, bits a byte, trusted)."""
    groups = defaultdict(list)
    for lang, n, per, trusted in rows:
        if trusted and n:
            for key in ((lang, int(math.log2(n))), (lang,), ()):
                groups[key].append(math.floor(per * 128))
    out = {}
    for key, found in groups.items():
        found.sort()
        mid, high = (next(x for i, x in enumerate(found, 1) if i >= q * len(found)) / 128 for q in (0.5, 0.995))
        if len(found) >= least or not key:
            out[key] = high + max(high - mid, 1 / 32)
    return lambda lang, n: next((out[k] for k in ((lang, int(math.log2(max(n, 1)))), (lang,), ()) if k in out), None)
