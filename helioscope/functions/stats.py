"""p-values without a statistics library: incomplete gamma and beta functions and the tests built on them."""

from __future__ import annotations

import math


def gamma_tail(a: float, x: float) -> float:
    """Upper regularized incomplete gamma function: the series below a + 1, the continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of Pearson's or Spearman's r by the t distribution."""
    if n < 3:
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_cdf((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), exactly."""
    return 1.0 if k <= 0 else beta_cdf(k, n - k + 1, p) if k <= n else 0.0


def average_ranks(values: list[float]) -> list[float]:
    order = sorted(range(len(values)), key=values.__getitem__)
    out, i = [0.0] * len(values), 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and values[order[j + 1]] == values[order[i]]:
            j += 1
        for k in range(i, j + 1):
            out[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return out


def kruskal(groups: list[list[float]]) -> tuple[float, float]:
    """(H corrected for ties, p); both NaN where all values are equal."""
    flat = [x for g in groups for x in g]
    n, ranks, at, total = len(flat), average_ranks(flat), 0, 0.0
    for g in groups:
        total += sum(ranks[at : at + len(g)]) ** 2 / len(g)
        at += len(g)
    ties = sum(c**3 - c for c in (flat.count(x) for x in set(flat)))
    if ties == n**3 - n:
        return math.nan, math.nan
    h = (12 / (n * (n + 1)) * total - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return h, chi2_tail(h, len(groups) - 1)


def mann_whitney(a: list[float], b: list[float], greater: bool = False) -> tuple[float, float]:
    """(U of a, p): exact for up to 8 tie-free values on a side, else normal with continuity and ties."""
    n, m = len(a), len(b)
    ranks = average_ranks([*a, *b])
    u = sum(ranks[:n]) - n * (n + 1) / 2
    if min(n, m) <= 8 and len({*a, *b}) == n + m:
        ways = [[int(not i)] + [0] * (n * m) for i in range(n + 1)]
        for x in range(1, n + m + 1):  # choose ranks: counts of U by size of the set
            for i in range(min(n, x), 0, -1):
                shift = x - i
                for s in range(n * m, shift - 1, -1):
                    ways[i][s] += ways[i - 1][s - shift]
        total = sum(ways[n])
        tail = lambda v: sum(ways[n][math.ceil(v) :]) / total
        return u, tail(u) if greater else min(1.0, 2 * tail(max(u, n * m - u)))
    ties = sum(c**3 - c for c in ((*a, *b).count(x) for x in {*a, *b}))
    sd = math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
    z = ((u if greater else max(u, n * m - u)) - n * m / 2 - 0.5) / sd
    p = math.erfc(z / math.sqrt(2)) / 2
    return u, p if greater else min(1.0, 2 * p)
