"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from math import comb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), order, m.end(), kind))
    return sorted(found)


def base_digest(text):
    spans = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    counts = Counter(k for *_, k in spans)
    return tuple(counts[k] for k in BASE) + (hashlib.sha256(joined.encode()).hexdigest(),), joined


def rules_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    marked = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n)


def binomial_at_most(k, n, p):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """sizes: source -> words, in order. Deals the excess anew until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > limit * sizes[s]]
        if not over:
            return stopped | {s: weight[s] * level for s in free}
        for s in over:
            stopped[s] = limit * sizes[s]
            left -= limit * sizes[s]


def shingle_counts(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def duplicate_classes(rows, weight=lambda gram: 1.0, similarity=0.8):
    """rows: (doc_id, text). The smallest id of each one's class, by all pairs that share a shingle, similar by count or by weight."""
    texts = sorted({t for _, t in rows if t is not None})
    plain = [shingle_counts(t) for t in texts]
    measures = [plain, [{x: n * weight(x) for x, n in g.items()} for g in plain]]
    sums = [[sum(g.values()) for g in grams] for grams in measures]
    grams = plain
    holders = defaultdict(list)
    for i, g in enumerate(grams):
        for x in g:
            holders[x].append(i)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, g in enumerate(grams):
        for j in {j for x in g for j in holders[x] if j > i}:
            for own, total in zip(measures, sums, strict=True):
                low = sum(min(v, own[j][x]) for x, v in own[i].items() if x in own[j])
                if low >= similarity * (total[i] + total[j] - low) - 1e-9:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    at = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if t is not None:
            least[at[t]] = min(least.get(at[t], d), d)
    return {d: d if t is None else least[at[t]] for d, t in rows}


def periodic_runs(words, shortest=6, times=4):
    """(start, length, period) by walking along each shift of the words; of equal stretches the smallest period, which comes first."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))
