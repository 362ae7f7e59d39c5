"""How filters interact: what each removes in every order of application.

Method. A document's failures are posted: for each part and filter there is a sorted list of the
documents that fail it. The ids are cut into ranges, and a task streams its ranges in id order, so
that no list is longer than a block (BLOCK documents) and any part, however large, spreads over
tasks. Within a range, unions of lists come from k-way merges and differences from a cursor in
each list, both galloping: a cursor doubles its stride until it is past the sought id and then bisects, so a run of
ids that only one list holds costs a few comparisons. What a filter removes after others are in
force is its list minus theirs, and what all keep is the range minus the union; both depend on the
set of filters in force, not on their order, so 2^k sets serve the k! orders. Sizes of ranges are
added up, and orders, shares and Shapley sums are read from them.

Filters of the query, over the words ``[^\\x20\\x09-\\x0D]+`` of a text: A under 100 words; B under
80 % distinct words; C over 10 % ``[A-Z]``; D any of ``#$%&*|``; E the text of a smaller doc_id,
found by the smallest id of each SHA-256.

Equal rows (id, part, text) are one entry that weighs as many documents. Rows are tied to the
first id of their text and to labels by (id, text hash) and by id, never by text or part alone, so
that a text or a part with a third of all rows does not meet in a task.

Cases: a NULL text is the empty text, NULL and empty lang are the part of the empty name; a NULL
doc_id has no label, and neither fails E nor makes others fail it; repeated rows count each; a
document is good or toxic if any label of its id says so. Without documents there is no row. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import arrow_schema, column, ddl, importable, map_rows, record_batch, stored

FILTERS = "ABCDE"
# Documents of one range.
BLOCK = 1 << 15

_CAPITALS = bytes(range(65, 91))
_SIGNS = frozenset("#$%&*|")


# --- sorted lists


def gallop(ids: Sequence[int], target: int, start: int) -> int:
    """The first place at or after ``start`` whose id is not below ``target``."""
    size = len(ids)
    if start >= size or ids[start] >= target:
        return start
    stride = 1
    low = start
    high = start + 1
    while high < size and ids[high] < target:
        low = high
        stride *= 2
        high += stride
    return bisect_left(ids, target, low + 1, min(high, size))


def union(lists: Sequence[list[int]]) -> list[int]:
    """Ids of any of the sorted lists, each once."""
    lists = [x for x in lists if x]
    places = [0] * len(lists)
    out: list[int] = []
    while len(lists) > 1:
        heads = [x[p] for x, p in zip(lists, places)]
        first = min(heads)
        holder = heads.index(first)
        nearest = min(h for i, h in enumerate(heads) if i != holder)
        at = places[holder]
        # The run of this list below all other heads is taken whole.
        end = at + 1 if nearest == first else gallop(lists[holder], nearest, at + 1)
        out += lists[holder][at:end]
        for i, head in enumerate(heads):
            places[i] = end if i == holder else places[i] + (head == first)
        if any(p == len(x) for x, p in zip(lists, places)):
            going = [i for i, x in enumerate(lists) if places[i] < len(x)]
            lists, places = [lists[i] for i in going], [places[i] for i in going]
    if lists:
        out += lists[0][places[0] :]
    return out


def minus(ids: list[int], others: Sequence[list[int]]) -> list[int]:
    """Ids that none of the other sorted lists holds."""
    for other in others:
        out: list[int] = []
        at = place = 0
        while at < len(ids):
            place = gallop(other, ids[at], place)
            if place == len(other):
                out += ids[at:]
                break
            end = gallop(ids, other[place], at)
            out += ids[at:end]
            at = end + (end < len(ids) and ids[end] == other[place])
        ids = out
    return ids


def common(ids: list[int], others: list[int]) -> list[int]:
    """Ids that both sorted lists hold."""
    if len(others) < len(ids):
        ids, others = others, ids
    return minus(ids, [minus(ids, [others])])


# --- sizes within a range


def range_sizes(lists: list[list[int]], good: list[int], toxic: list[int], weights: np.ndarray) -> list[tuple]:
    """For every filter and set of others in force: (filter, set, removed, good, toxic, united),
    the documents it removes, those of them that are good and toxic, and those that it or the set fail.

    Filters are numbers, sets their bits; ``weights`` are the documents of each id.
    """
    single = bool((weights == 1).all())
    weigh = len if single else lambda ids: int(weights[ids].sum()) if ids else 0
    k = len(lists)
    sets = range(1 << k)
    united = {s: weigh(union([lists[i] for i in range(k) if s >> i & 1])) for s in sets}
    out = []
    for f in range(k):
        left = {0: lists[f]}
        for s in sets:
            if s >> f & 1:
                continue
            if s:
                top = s.bit_length() - 1
                left[s] = minus(left[s ^ 1 << top], [lists[top]])
            rest = left[s]
            out.append(
                (f, s, weigh(rest), weigh(common(rest, good)), weigh(common(rest, toxic)), united[s | 1 << f])
            )
    return out


_SIZES = "part string, n bigint, filter int, before int, removed bigint, good bigint, toxic bigint, united bigint"


def posting_sizes(posted: DataFrame, filters: str = FILTERS, block: int = BLOCK) -> DataFrame:
    """Sizes by part, filter and set of filters in force, from entries in id order within tasks.

    ``posted`` has part, fails (bits of filters), good, toxic, n. Every task sends a
    few rows for each of its parts; they are summed by Spark.
    """
    arrow = arrow_schema(_SIZES)

    def sizes(part: str, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fails, good, toxic, weights = rows
        lists = [np.flatnonzero(fails >> i & 1).tolist() for i in range(len(filters))]
        found = range_sizes(lists, np.flatnonzero(good).tolist(), np.flatnonzero(toxic).tolist(), weights)
        values = list(zip(*found))
        m = len(found)
        yield record_batch([[part] * m, [int(weights.sum())] * m, *map(list, values)], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = None, [], 0
        for batch in batches:
            names = batch.column(0)
            numbers = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)])
            runs = np.array(names.to_pylist(), object)
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)] if len(runs) else [0]
            for a, b in zip(cuts, cuts[1:]):
                for start in range(a, b, block):
                    piece = numbers[:, start : min(b, start + block)]
                    if n and (runs[a] != part or n + piece.shape[1] > block):
                        yield from sizes(part, np.concatenate(held, axis=1))
                        held, n = [], 0
                    part = runs[a]
                    held.append(piece)
                    n += piece.shape[1]
        if n:
            yield from sizes(part, np.concatenate(held, axis=1))

    rows = importable(posted.select("part", "fails", "good", "toxic", "n")).mapInArrow(run, _SIZES)
    names = ("n", "removed", "good", "toxic", "united")
    return rows.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in names])


def audit(posted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report for every part, order of the filters and step, from ``posted`` entries: part,
    doc_id, tie, fails, good, toxic, n.

    The entries are read twice, to find the ranges and to deal them, so pass a
    written table. The sizes are written: they are a few rows for each part.
    """
    order = ("part", "doc_id", "tie")
    ranged = posted.repartitionByRange(*order).sortWithinPartitions(*order)
    sizes = stored(posting_sizes(ranged, filters), "filter-sizes")
    steps = [
        ("".join(o), step + 1, filters.index(f), sum(1 << filters.index(g) for g in o[:step]))
        for o in permutations(filters)
        for step, f in enumerate(o)
    ]
    spark = posted.sparkSession
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    times = plan.groupBy("filter", "before").agg(F.count("*").alias("times"))
    # The plans have k! * k rows, 600 for five filters, whatever the input.
    by_filter = sizes.join(F.broadcast(times), ["filter", "before"]).groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("listed"),
        F.max_by("removed", F.bit_count("before")).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("times")).alias("shapley"),
    )
    return (
        sizes.join(F.broadcast(plan), ["filter", "before"])
        .join(by_filter, ["part", "filter"])
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("n") - F.col("united")).alias("kept"),
            "removed",
            (F.col("listed") - F.col("removed")).alias("redundant"),
            "unique_fails",
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            "shapley",
        )
    )


# --- the query's filters


def judge(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * len(text)) << 2
        | (not _SIGNS.isdisjoint(text)) << 3
    )


def post_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of the documents: part, doc_id, tie (the text's hash), fails, good, toxic, n; written."""

    def marks(batch: pa.RecordBatch) -> list:
        texts = [t or "" for t in column(batch, "text")]
        return [
            batch.column(0),
            [g or "" for g in column(batch, "lang")],
            [judge(t) for t in texts],
            [hashlib.sha256(t.encode()).digest() for t in texts],
        ]

    docs = docs.select("doc_id", "lang", "text")
    schema = f"{ddl(docs.select('doc_id'))}, part string, fails int, tie binary"
    entries = map_rows(docs, schema, marks).groupBy("doc_id", "part", "fails", "tie")
    entries = stored(entries.agg(F.count("*").alias("n")), "failures")
    firsts = entries.where("doc_id IS NOT NULL").groupBy("tie").agg(F.min("doc_id").alias("doc_id"))
    entries = entries.join(firsts.withColumn("first", F.lit(True)), ["doc_id", "tie"], "left")
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marked = labels.groupBy("doc_id").agg(said("quality"), said("toxic")).where("quality OR toxic")
    # Entries without an id have no label; they are dealt by their text.
    marked = marked.withColumns({"_key": F.col("doc_id").cast("bigint"), "_id": F.lit(True)})
    keys = {
        "_key": F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("tie")),
        "_id": F.col("doc_id").isNotNull(),
    }
    joined = entries.withColumns(keys).join(marked.drop("doc_id"), ["_key", "_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    flag = lambda c: F.coalesce(c, F.lit(False))
    return stored(
        joined.select(
            "part",
            "doc_id",
            "tie",
            F.col("fails").bitwiseOR(F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("fails"),
            flag("quality").alias("good"),
            flag("toxic").alias("toxic"),
            "n",
        ),
        "postings",
    )


def audit_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(post_documents(docs, labels))
