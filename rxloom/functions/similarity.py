"""Token-sort similarity: normalised insert/delete distance over sorted tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_sort(col: Column | str) -> Column:
    """White-space tokens sorted and rejoined."""
    words = F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def _lcs_wide(a: str, b: str) -> int:
    """LCS length of one pair with an arbitrary-width bit vector."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _codes(values: list[str], width: int, pad: int) -> np.ndarray:
    out = np.array(values, dtype=f"<U{width}").view("<u4").reshape(len(values), width).copy()
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    out[np.arange(width) >= lengths[:, None]] = pad
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS length per pair; pairs whose left side fits 64 bits run vectorised."""
    out = np.zeros(len(a), dtype=np.int64)
    la = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
    lb = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    narrow = np.flatnonzero((la > 0) & (lb > 0) & (la <= 64) & (lb <= 256))
    for i in np.flatnonzero((la > 0) & (lb > 0) & ((la > 64) | (lb > 256))):
        out[i] = _lcs_wide(a[i], b[i])
    if narrow.size:
        wa, wb = int(la[narrow].max()), int(lb[narrow].max())
        ca = _codes([a[i] for i in narrow], wa, 0xFFFFFFFF)
        cb = _codes([b[i] for i in narrow], wb, 0xFFFFFFFE)
        bits = np.uint64(1) << np.arange(wa, dtype=np.uint64)
        state = np.full(narrow.size, np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(wb):
            hit = state & np.where(ca == cb[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            state = (state + hit) | (state - hit)
        out[narrow] = np.bitwise_count(~state).astype(np.int64)
    return out


@F.pandas_udf(T.IntegerType())
def lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    rows = list(zip(a.fillna("").tolist(), b.fillna("").tolist(), strict=True))
    pairs = list(dict.fromkeys(rows))  # pairs of names recur
    known = dict(zip(pairs, lcs_lengths([x for x, _ in pairs], [y for _, y in pairs]).tolist(), strict=True))
    return pd.Series([known[r] for r in rows], dtype="int32")


#: Pairs of texts that `best_partners` scores at once.
PAIRS_AT_ONCE = 100_000


def best_partners(texts: Column, offers: Column, barred: Column, minimum: float) -> Column:
    """For each of an array of token-sorted texts the place of the most similar of `offers`, the first of several; null below `minimum`.

    Empty texts and offers have no partner, nor has a text whose partner is among the first `barred` offers and not among the others.
    """

    def places(rows: list[tuple[int, list[str], list[str], int]], out: list) -> None:
        known: dict[tuple[str, str], float] = dict.fromkeys((a, b) for _, left, right, _ in rows for a in left if a for b in right if b)
        pairs = list(known)
        lengths = np.fromiter((len(a) + len(b) for a, b in pairs), dtype=np.float64, count=len(pairs))
        known.update(zip(pairs, 200.0 * lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]) / lengths, strict=True))
        for k, left, right, least in rows:
            out[k] = []
            others = set(right[least:])
            offered = [(j, b) for j, b in enumerate(right) if b and (j >= least or b not in others)]
            for a in left:
                best, at = minimum, None
                for j, b in offered if a else ():
                    if known[a, b] > best or (at is None and known[a, b] >= best):
                        best, at = known[a, b], j
                out[k].append(at if at is not None and at >= least else None)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def picked(left: pd.Series, right: pd.Series, first: pd.Series) -> pd.Series:
        out: list = [None] * len(left)
        rows: list[tuple[int, list[str], list[str], int]] = []
        waiting = 0
        for k, (a, b, least) in enumerate(zip(left, right, first, strict=True)):
            if a is None or b is None:
                continue
            rows.append((k, list(a), list(b), least))
            waiting += len(a) * len(b)
            if waiting >= PAIRS_AT_ONCE:
                places(rows, out)
                rows, waiting = [], 0
        if rows:
            places(rows, out)
        return pd.Series(out, dtype=object)

    return picked(texts, offers, barred)


def _ratio(lcs: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs / total)


def sorted_ratio(a: Column, b: Column) -> Column:
    """Similarity (0..100) of two strings whose tokens are already sorted."""
    return _ratio(lcs_len(a, b), a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity (0..100) of two raw strings, one Arrow call per row; see `add_text_similarity` for bulk use."""
    return sorted_ratio(token_sort(a), token_sort(b))


def lcs_expr(a: Column, b: Column) -> Column:
    """LCS length inside the JVM by folding one string over a row of the DP table."""
    chars = F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda cur, j: F.concat(
                cur,
                F.array(
                    F.when(F.get(chars, j - 1) == ch, F.get(row, j - 1) + 1).otherwise(
                        F.greatest(F.get(row, j), F.element_at(cur, -1))
                    )
                ),
            ),
        )

    last = F.aggregate(F.split(a, ""), zero, step)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(last, -1))


def add_text_similarity(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add `out` = token-sort similarity (0..1) of columns `a` and `b`, in one Arrow pass without a shuffle.

    Equal strings score 1 and travel to Python as empty ones.
    """
    same = F.col(a) == F.col(b)
    ready = pairs.withColumns({f"_{i}": F.when(~same, token_sort(c)).otherwise("") for i, c in enumerate((a, b))})
    score = sorted_ratio(F.col("_0"), F.col("_1")) / 100.0
    return ready.withColumn(out, F.when(same, 1.0).when(same.isNotNull(), score)).drop("_0", "_1")
