"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t: str | None) -> list[str]:
    return re.findall(WORD, lower(t))


def shingle_set(t: str | None) -> frozenset:
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to (shingles, component)."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def exact(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    h = {i: hashlib.sha256(re.sub(SPACE, " ", t or "").encode()).hexdigest() for i, t in rows}
    by = defaultdict(list)
    for i, x in h.items():
        by[x].append(i)
    return {i: (min(by[x]), len(by[x]), i == min(by[x]), x) for i, x in h.items()}


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(t: str | None) -> dict[str, list[tuple[int, int]]]:
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, t or "") if ok(k, m.group())] for k, p in PATTERNS.items()}


def backoff(rows: list[tuple[int, str | None]], order: int = 2, discount: float = 0.4) -> dict[int, tuple[int, float, int]]:
    texts = {i: words(t) for i, t in rows}
    count = {n: Counter(tuple(w[k : k + n]) for w in texts.values() for k in range(len(w) - n + 1)) for n in range(1, order + 1)}
    total = sum(map(len, texts.values()))
    out = {}
    for i, w in texts.items():
        own = {n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in range(1, order + 1)}
        left = lambda g: count[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        rest, score, down = total - len(w), 0.0, 0
        for k in range(len(w)):
            n = min(order, k + 1)
            steps = 0
            while n > 1 and not (left(tuple(w[k - n + 1 : k + 1])) > 0 and left(tuple(w[k - n + 1 : k])) > 0):
                n, steps = n - 1, steps + 1
            g = tuple(w[k - n + 1 : k + 1])
            if n > 1:
                p = math.log(left(g) / left(g[:-1]))
            else:
                p = math.log(left(g) / rest) if left(g) > 0 else math.log(discount / (rest + 1))
            score += p + steps * math.log(discount)
            down += k + 1 >= order and left(tuple(w[k - order + 1 : k + 1])) == 0
        out[i] = (len(w), score, down)
    return out


def targets(sizes: dict, weights=(3, 1, 2), budget=1.5, cap=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    pool, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        share = {s: pool * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
        pool -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


RULES = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}


def judged(url: str | None) -> tuple[str, str, str | None, str | None]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and RULES[best]
