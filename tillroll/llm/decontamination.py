"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of ASCII letters, digits and non-ASCII characters after folding A-Z.
The patterns are all windows of 13 consecutive words of the benchmark items; an item
of 1 to 12 words is one pattern. Patterns of one length share a matcher with the
three tables of Wu and Manber, the symbols being words:

* shift: for each block of two words of a pattern, how far the search may move when the
  text has that block at the end of the present position; any other block shows that no
  pattern ends in the next words, and the search skips over them;
* buckets: for each block that ends a pattern (shift 0), the patterns that end with it,
  by their first words;
* direct comparison of the whole pattern with the text.

Cases: a NULL or empty text has no words, is not hit and not contaminated; a NULL or
empty item has no patterns; items of the same id are one item; a NULL item id is
written "null"; rows are independent, so repeated rows give repeated results; a table
without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import arrow_schema, column, ddl, importable, record_batch, slices, stored

WINDOW = 13
# Bytes of benchmark text whose patterns a task holds at once, and the blocks sent out at once.
BLOCK_BYTES, TURN_BLOCKS = 8 << 20, 16
# Bytes of documents that a task takes through several blocks together.
RUN_BYTES = 32 << 20

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


class WuManber:
    """Search for patterns of one length; a pattern carries a set of item ids."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                move = length - end
                if move < self.shift.get(block, self.skip):
                    self.shift[block] = move
            last, first = pattern[-self.block :], pattern[: self.block]
            self.bucket.setdefault(last, {}).setdefault(first, {})[pattern] = items

    def find(self, words: list[bytes]) -> Iterable[tuple[int, set[str]]]:
        """Start and item ids of each occurrence."""
        shift, skip, block, m = self.shift.get, self.skip, self.block, self.length
        end, n = m, len(words)
        while end <= n:
            last = tuple(words[end - block : end])
            move = shift(last, skip)
            if move:
                end += move
                continue
            start = end - m
            same = self.bucket[last].get(tuple(words[start : start + block]))
            if same is not None:
                items = same.get(tuple(words[start:end]))
                if items is not None:
                    yield start, items
            end += 1


def matchers(items: Iterable[tuple], window: int = WINDOW) -> list[WuManber]:
    """Matchers for (item_id, text) pairs, one for each pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            name = "null" if item is None else str(item)
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(name)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def search(words: list[bytes], tables: list[WuManber]) -> tuple[list[list[int]], set[str]]:
    """Disjoint ranges of hit words in order, and the items found."""
    found, items = [], set()
    for table in tables:
        for start, names in table.find(words):
            found.append((start, start + table.length))
            items |= names
    return merged(found), items


def merged(ranges: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int):
    """The items in runs of at most ``block_bytes`` of text (one item at least)."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(row.text or "") * 4
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with n_words, hits (array of [start, end) word ranges) and items (sorted ids).

    Documents never move: the benchmark, the query set, goes to them in blocks of bounded
    size. A task holds the patterns of one block at a time and takes a run of documents
    through all blocks, so that documents are read once. Beyond TURN_BLOCKS blocks (a bound on
    what is sent to executors) the hits so far are written to the shared folder
    before the next turn.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(
        *keep,
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() AS array<array<bigint>>)").alias("hits"),
        F.expr("cast(array() AS array<string>)").alias("items"),
    )
    send = docs.sparkSession.sparkContext.broadcast
    sent = ((uuid.uuid4().hex, send(block)) for block in blocks_of(benchmark, block_bytes))
    turns = 0
    for blocks in batched(sent, TURN_BLOCKS):
        if turns:
            out = stored(out, "decontamination")
        turns += 1
        out = _one_turn(out, blocks, window, keep)
    return out if turns else _one_turn(out, [(uuid.uuid4().hex, send([]))], window, keep)


_tables: dict = {}


def tables_of(name: str, block, window: int) -> list[WuManber]:
    """The matchers of the broadcast block called ``name``, made once for each worker."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = matchers(block.value, window)
    return _tables[name]


def runs_of(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """The slices of batches, together until they have ``limit`` bytes."""
    run, size = [], 0
    for batch in batches:
        for part in slices(batch):
            run.append(part)
            size += part.nbytes
            if size >= limit:
                yield run
                run, size = [], 0
    if run:
        yield run


def _one_turn(df: DataFrame, blocks: Iterable[tuple], window: int, keep: list[str]) -> DataFrame:
    """Search ``blocks`` of (name, broadcast items) and add to the hits and items of ``df``."""
    blocks, schema = tuple(blocks), ddl(df)
    arrow = arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, RUN_BYTES if len(blocks) > 1 else 0):
            n_words = [[0] * part.num_rows for part in run]
            hits = [[[*map(tuple, x)] for x in column(part, "hits")] for part in run]
            items = [[set(x) for x in column(part, "items")] for part in run]
            for name, block in blocks:
                tables = tables_of(name, block, window)
                for k, part in enumerate(run):
                    for i, text in enumerate(column(part, "text")):
                        words = words_of(text)
                        ranges, found = search(words, tables)
                        n_words[k][i] = len(words)
                        hits[k][i] += map(tuple, ranges)
                        items[k][i] |= found
            for part, n, ranges, names in zip(run, n_words, hits, items):
                same = [part.column(part.schema.get_field_index(c)) for c in keep]
                found = [n, [merged(r) for r in ranges], [sorted(x) for x in names]]
                yield record_batch([*same, *found], arrow)

    return importable(df).mapInArrow(find, schema)


def judged(found: DataFrame) -> DataFrame:
    """Add n_hit, n_items and contaminated (5 % of the words or more) to ``find_contamination``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, r: s + r[1] - r[0])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn(
            "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
        )
    )


def contamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = judged(find_contamination(docs.select("doc_id", "text"), benchmark))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )
