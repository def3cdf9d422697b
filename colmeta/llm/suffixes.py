"""Suffix order by prefix doubling, for arrays of words."""

from __future__ import annotations

import numpy as np


def suffix_order(keys: np.ndarray, length: int = 1, keep: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of an array, and for each j the ranks of its positions by their first length * 2**j words.

    keys: order the positions by their first `length` words; equal keys are equal words. Only the positions that are
    still tied are sorted again. keep: without it, only the last ranks are returned.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    levels = [rank]
    while True:
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))  # groups of more than one position
        if not len(open_):
            return order, levels
        at = order[open_]
        after = at + length
        key = rank[at].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[open_] = at
        new[open_] = np.r_[True, key[1:] != key[:-1]]
        settled = np.maximum.accumulate(np.where(new[open_], open_, 0)).astype(np.int32)
        if keep:
            rank = rank.copy()
            levels.append(rank)
        rank[at] = settled
        length *= 2
