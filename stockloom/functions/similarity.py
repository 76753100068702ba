"""Fuzzy scores of names (F20): the longest common subsequence of many pairs at once by bit-parallel steps, and the weighted ratio built on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of token scores, of partial scores, and of partial scores of very unlike lengths; the ratios of lengths from which
#: partial scores count, and from which they count little.
TOKENS, PARTIAL, FAR, LONGER, MUCH_LONGER = 0.95, 0.9, 0.6, 1.5, 8.0


def common(a: list[str], b: list[str]):
    """Length of the longest common subsequence of each pair.  The shorter text of a pair is a word of bits, and each character of the longer one
    moves all pairs on at once; texts of more than 64 characters take whole numbers of any size, one pair at a time."""
    import numpy as np

    out, some = np.zeros(len(a), np.int64), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if len(x) > 64:
            masks: dict[str, int] = {}
            for k, c in enumerate(x):
                masks[c] = masks.get(c, 0) | 1 << k
            full = s = (1 << len(x)) - 1
            for c in y:
                u = s & masks.get(c, 0)
                s = (s + u | s - u) & full
            out[i] = len(x) - s.bit_count()
        elif x:
            some.append((len(y), i, x, y))
    some.sort(key=lambda p: p[0])  # pairs of like lengths step together
    for at in range(0, len(some), 2048):
        part = some[at : at + 2048]
        width, steps = max(len(p[2]) for p in part), part[-1][0]
        x = np.array([p[2] for p in part], f"U{width}").view(np.uint32).reshape(len(part), width)
        y = np.array([p[3] for p in part], f"U{steps}").view(np.uint32).reshape(len(part), steps)
        state = np.full(len(part), np.uint64(2**64 - 1))
        bits = np.zeros((len(part), 8), np.uint8)
        for k in range(steps):
            c = y[:, k : k + 1]
            packed = np.packbits((x == c) & (c != 0), axis=1, bitorder="little")
            bits[:, : packed.shape[1]] = packed
            u = state & bits.view(np.uint64)[:, 0]
            state = (state + u) | (state - u)
        out[[p[1] for p in part]] = np.bitwise_count(~state)
    return out


def ratios(a: list[str], b: list[str]):
    """0 to 100: twice the common subsequence by both lengths; two empty texts are 100."""
    import numpy as np

    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(size == 0, 100.0, 200.0 * common(a, b) / np.maximum(size, 1))


def partial_ratios(a: list[str], b: list[str]):
    """The best ratio of the shorter text with a part of the longer one: any window of its length, and the shorter ones at both ends."""
    import numpy as np

    one, two, of, out = [], [], [], np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if x in y:
            out[i] = 100.0 if x or not y else 0.0
            continue
        m, n = len(x), len(y)
        parts = {y[k : k + m] for k in range(n - m + 1)} | {y[:k] for k in range(1, m)} | {y[n - k :] for k in range(1, m)}
        one += [x] * len(parts)
        two += parts
        of += [i] * len(parts)
    np.maximum.at(out, np.array(of, np.int64), ratios(one, two))
    return out


def weighted(a: list[str], b: list[str]):
    """The weighted ratio of each pair, 0 if a text is empty: the plain ratio, or 0.95 times the better of the ratio of the sorted tokens and that of
    the token sets.  Where one text is 1.5 times as long or longer, partial ratios count instead of the latter, by 0.9 (0.6 beyond 8 times)."""
    import numpy as np

    n = len(a)
    long, short = (np.array([f(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.float64) for f in (max, min))
    best = ratios(a, b)
    scale = np.where(long <= MUCH_LONGER * np.maximum(short, 1), PARTIAL, FAR)
    far = long >= LONGER * np.maximum(short, 1)
    tokens = [(sorted(x.split()), sorted(y.split())) for x, y in zip(a, b, strict=True)]
    both = [sorted(set(p) & set(q)) for p, q in tokens]
    left = [" ".join(sorted(set(p) - set(q))) for p, q in tokens]
    right = [" ".join(sorted(set(q) - set(p))) for p, q in tokens]
    one, two = [" ".join(p) for p, _ in tokens], [" ".join(q) for _, q in tokens]

    def at(i, xs, ys, f):
        return f([xs[k] for k in i], [ys[k] for k in i])

    near = np.flatnonzero(~far)
    score = np.zeros(n)
    score[near] = at(near, one, two, ratios)
    # the token sets: what both have against what both have and the one's or the other's rest
    lcs = np.zeros(n)
    lcs[near] = at(near, left, right, common)
    for i in near.tolist():
        s, x, y = len(" ".join(both[i])), len(left[i]), len(right[i])
        if not tokens[i][0] or not tokens[i][1]:
            continue
        if both[i] and (not x or not y):
            score[i] = 100.0
            continue
        gap = s > 0
        whole = (s + gap + x) + (s + gap + y)
        found = [100.0 - 100.0 * (x + y - 2 * lcs[i]) / whole if whole else 100.0]
        if s:
            found += [100.0 - 100.0 * (gap + z) / (s + s + gap + z) for z in (x, y)]
        score[i] = max(score[i], *found)
    best[near] = np.maximum(best[near], TOKENS * score[near])
    wide = np.flatnonzero(far)
    best[wide] = np.maximum(best[wide], scale[wide] * at(wide, a, b, partial_ratios))
    score[wide] = [100.0 if both[i] else 0.0 for i in wide.tolist()]
    rest = [i for i in wide.tolist() if not both[i]]
    score[rest] = np.maximum(at(rest, one, two, partial_ratios), at(rest, left, right, partial_ratios)) if rest else 0.0
    best[wide] = np.maximum(best[wide], TOKENS * scale[wide] * score[wide])
    return np.where(short == 0, 0.0, best)


@F.pandas_udf(T.DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """the weighted ratio of two names, 0 to 100; null if one is null.  Each distinct pair of a batch is scored once."""
    import numpy as np

    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    ask = sorted({p for p in pairs if p[0] is not None and p[1] is not None})
    found = dict(zip(ask, weighted([p[0] for p in ask], [p[1] for p in ask]).tolist(), strict=True)) if ask else {}
    return pd.Series([found.get(p, np.nan) for p in pairs], dtype="float64").astype(object).where(lambda s: s.notna(), None)
