"""Equi-joins in which NULL keys match each other.

The right side of the lookups must be unique on its key (``require_unique``). No side is forced to be
broadcast: Spark broadcasts a side whose size, estimated or measured by adaptive
execution, is under the session's threshold, and sort-merges otherwise.

Null-safe keys are compared through a derived expression, so both sides get an
exchange of their own right below the join even if one was just grouped by the
key. That costs one more exchange of the (smaller) grouped side, and it is what
lets adaptive execution split a skewed partition of the other side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str,
    null_safe: bool,
) -> DataFrame:
    pairs = {on: on} if isinstance(on, str) else on
    pairs = dict(pairs) if isinstance(pairs, Mapping) else {k: k for k in pairs}
    keys = {f"_right_{i}": (l, r) for i, (l, r) in enumerate(pairs.items())}
    right = right.withColumnsRenamed({r: k for k, (_, r) in keys.items()})
    condition = None
    for k, (l, _) in keys.items():
        match = left[l].eqNullSafe(right[k]) if null_safe else left[l] == right[k]
        condition = match if condition is None else condition & match
    return left.join(right, condition, how).drop(*keys)


def left_lookup(left, right, on, null_safe: bool = True) -> DataFrame:
    """All rows of ``left`` with the columns of the matching row of ``right``, or NULLs.

    ``on`` is a column name, a list of them, or a mapping from left to right names.
    """
    return _join(left, right, on, "left", null_safe)


def inner_lookup(left, right, on, null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` that have a match, with its columns."""
    return _join(left, right, on, "inner", null_safe)


def keep_matching(left, right, on, null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` that have a match, without its columns."""
    return _join(left, right, on, "left_semi", null_safe)


def drop_matching(left, right, on, null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` that have no match."""
    return _join(left, right, on, "left_anti", null_safe)


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = True) -> DataFrame:
    """Left join on all columns the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two sides share no column")
    return left_lookup(left, right, shared, null_safe)


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, after a check (a job) that no two rows agree on ``key``; NULL equals NULL."""
    twice = df.groupBy(*key).count().where("count > 1").first()
    if twice:
        raise ValueError(f"{', '.join(key)} must be unique; {tuple(twice)[:-1]} has {twice['count']} rows")
    return df
