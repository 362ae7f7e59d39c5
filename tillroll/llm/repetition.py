"""Quality rules by repetition: maximal repeated substrings from suffix arrays.

The symbols are the words of a text. For a batch of texts one suffix array is built by
prefix doubling: suffixes are ranked by their first 1, 2, 4, ... words, and only those not
yet told apart go on (ranks start from (text, word), so that suffixes of different
texts are never compared). The ranks of the levels also give the longest common prefix of
neighbours in the array. An interval of neighbours with a common prefix of l words, bounded
by smaller values on both sides, is a repeated substring that can't be extended to the
right; if the words in front of its occurrences are not all the same, it is maximal.

Rules on the maximal repeats of MIN_WORDS words or more: the union of their spans may cover
at most MAX_PERCENT of the words, and none may be longer than MAX_REPEAT words. The base
rules (too short; words in repeated 8-word windows) come from the same array.

Cases: a NULL or empty text has no words, so it fails the base rule; rows are judged alone,
so repeated rows, ties and NULL doc_ids give equal results; a table without rows gives
none; further columns are not looked at. Texts are taken whole; a batch is cut by bytes, and
one longer text is a batch of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import column, map_rows
from tillroll.llm.words import word_hashes

WINDOW = 8
LEAST_WORDS, BASE_PERCENT = 20, 30
MIN_WORDS, MAX_PERCENT, MAX_REPEAT = 5, 50, 100

_SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"


def suffix_array(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over all texts, and the common prefix (in words) of each suffix with the
    one before it. ``words``: codes; ``texts``: the text of each word, rising."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    end = np.searchsorted(texts, texts, "right")  # of each word's text
    order = np.lexsort((words, texts))
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (texts[order[1:]] != texts[order[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, size = [rank.copy()], 1
    open_ = _shared(new)
    while len(open_):
        at = order[open_]
        follow = at + size
        second = np.where(follow < end[at], rank[np.minimum(follow, n - 1)], -1)
        sort = np.lexsort((second, rank[at]))
        at, second = at[sort], second[sort]
        order[open_] = at
        same = rank[at]
        split = np.ones(len(at), bool)
        split[1:] = (same[1:] != same[:-1]) | (second[1:] != second[:-1])
        head = np.maximum.accumulate(np.where(split, np.arange(len(at)), 0))
        rank[at] = open_[head]
        levels.append(rank.copy())
        open_ = open_[_shared(split)]
        size *= 2
    common = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    for level in range(len(levels) - 1, -1, -1):
        x, y = left[live] + common[live + 1], right[live] + common[live + 1]
        inside = (x < end[left[live]]) & (y < end[right[live]])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common[live[inside & (levels[level][x] == levels[level][y])] + 1] += 1 << level
    return order, common


def _shared(new: np.ndarray) -> np.ndarray:
    """Places in runs of more than one; ``new`` marks where runs start."""
    last = np.ones(len(new), bool)
    last[:-1] = new[1:]
    return np.flatnonzero(~(new & last))


def maximal_repeats(
    order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int
) -> list[tuple[int, int, int]]:
    """(low, high, length): order[low:high] are the places of a maximal repeat of ``length``.

    ``before`` is the code of the word in front of each position, -1 at the start of a text.
    """
    out: list[tuple[int, int, int]] = []
    runs = np.flatnonzero(common >= least)
    if not len(runs):
        return out
    front = before[order]
    changes = np.cumsum(np.concatenate([[0], front[1:] != front[:-1]])).tolist()
    breaks = np.flatnonzero(np.diff(runs) > 1)
    for a, b in zip(runs[[0, *(breaks + 1)]].tolist(), runs[[*breaks, -1]].tolist()):
        stack: list[tuple[int, int]] = []
        for i, here in enumerate([*common[a : b + 1].tolist(), 0], a):
            low = i - 1
            while stack and stack[-1][0] > here:
                length, low = stack.pop()
                if changes[i - 1] > changes[low]:
                    out.append((low, i, length))
            if here >= least and (not stack or stack[-1][0] < here):
                stack.append((here, low))
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n]) > 0


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; ``counts`` holds how many each has."""
    total = np.concatenate([[0], np.cumsum(values)])
    stop = np.cumsum(counts)
    return total[stop] - total[stop - counts]


def repetition_of(texts: list[str], window: int, least: int) -> dict[str, np.ndarray]:
    """Per text: n_words, n_repeat_words, n_repeats, covered (words), longest (words)."""
    hashes, counts = word_hashes([t.encode() for t in texts], lower=False)
    _, words = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    order, common = suffix_array(words, owner)
    n = len(order)
    longest = np.zeros(n, np.int64)  # repeated substring from each position
    longest[order] = np.maximum(common, np.append(common[1:], 0))
    starts = np.flatnonzero(longest >= window)
    repeat_words = covered(starts, np.full(len(starts), window), n)
    # A repeated substring lies in a maximal one and each place of a maximal repeat starts
    # one, so both have the same union.
    starts = np.flatnonzero(longest >= least)
    spans = covered(starts, longest[starts], n)
    before = np.concatenate([[-1], words[:-1]]) if n else words
    before[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = -1
    repeats = np.array([owner[order[r[0]]] for r in maximal_repeats(order, common, before, least)], int)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, longest)
    return {
        "n_words": counts,
        "n_repeat_words": _sums(repeat_words, counts),
        "n_repeats": np.bincount(repeats, minlength=len(texts)),
        "covered": _sums(spans, counts),
        "longest": most,
    }


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


_MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, n_repeats bigint, covered bigint, longest bigint"
)


def measured(docs: DataFrame, window: int = WINDOW, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) with the measures of each row in place of the text."""

    def measure(batch: pa.RecordBatch) -> list:
        texts = [t or "" for t in column(batch, "text")]
        found = repetition_of(texts, window, least)
        return [
            batch.column(batch.schema.get_field_index("doc_id")),
            found["n_words"],
            [len(t) - sum(map(t.count, _BLANK)) for t in texts],
            [sum(map(t.count, _SYMBOLS)) for t in texts],
            [duplicate_lines(t) for t in texts],
            *(found[c] for c in ("n_repeat_words", "n_repeats", "covered", "longest")),
        ]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, {_MEASURES}", measure)


def judge(
    docs: DataFrame, max_percent: int = MAX_PERCENT, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """The measures of each row with base_failed and kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words")
    )
    good = (100 * F.col("covered") <= max_percent * F.col("n_words")) & (
        F.col("longest") <= max_repeat
    )
    return measured(docs).withColumn("base_failed", base).withColumn("kept", ~base & good)
