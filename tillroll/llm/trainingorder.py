"""Token ids in training order: a keyed permutation gives every sequence a slot, shards hold them.

1. Documents become ids of a byte-level vocabulary, each closed by END. The ids of an input
   partition are one stream, cut into sequences of LENGTH ids; the last is filled up with END.
   Sequences are written to the shared folder once, numbered within their partition.
2. The number of sequences of each partition (one number per partition) gives every sequence
   its global index, without gaps.
3. A Feistel network keyed by ``key`` permutes the indices: the halves of the bits are mixed
   by turns, on the smallest even number of bits that holds all of them, and a result beyond the
   last index is permuted again (cycle walking). So slots are a permutation of the indices,
   computed for each sequence on its own; nothing is sorted or drawn.
4. Slots are dealt into partitions by range. As a permutation leaves no gaps, ranges are
   equal without sampling. A shard is SHARD_SEQUENCES slots of a fixed stride in one binary value:
   slot s lies in shard s // SHARD_SEQUENCES at byte (s % SHARD_SEQUENCES) * stride, so a reader
   goes through shards in order and resumes at any slot by arithmetic.

Cases: a NULL or empty text is its END alone; repeated rows are repeated; doc_ids and further
columns are not looked at; a table without rows gives no shard.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import (
    arrow_schema,
    column,
    importable,
    record_batch,
    scratch_folder,
    slices,
)
from tillroll.llm.tokens import tokenizer_path
from tillroll.llm.words import mix

VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
LENGTH = 2048
SHARD_SEQUENCES = 1024
ROUNDS = 6
KEY = 20240607

# Longer runs of white space (as the tokenizer's pattern has it) are encoded by themselves.
LONG_BLANKS = 4096
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SEQUENCES = "part int, place bigint, ids binary"
_SHARDS = "shard bigint, first_slot bigint, n_sequences int, stride int, data binary"


@lru_cache(2)
def byte_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encode_text(encoding, text: str, limit: int | None = None) -> list[int]:
    """The ids of ``encoding.encode_ordinary(text)``, for texts with runs of blanks of any length.

    The pattern that splits a text looks ahead from a run of blanks one by one, on a stack that overflows
    at some hundred thousand. It makes one piece of a run, but leaves its last blank to the
    word that follows. Such a piece is taken out here and handed to the merges as it is; what is
    before ends with it in any case, and what is after begins with that last blank.
    """
    limit = limit or LONG_BLANKS
    out: list[int] = []
    at = 0
    for run in re.finditer(f"[{_WHITE}]{{{limit},}}", text) if len(text) >= limit else ():
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + encoding.encode_ordinary(text[at:])


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the ``index`` values below ``n``: a permutation of range(n) set by ``key``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(2 * (key % 2**62) + 1))
    out = index.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> shift, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[open_] = (left << shift) | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(part, place, ids): sequences of little-endian 16-bit ids, numbered in their partition."""
    path, arrow = vocabulary or tokenizer_path(VOCABULARY), arrow_schema(_SEQUENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(path)
        part, place, rest = TaskContext.get().partitionId(), 0, np.empty(0, "<u2")
        for batch in batches:
            for some in slices(batch):
                found = [rest]
                for text in column(some, "text"):
                    found.append(np.array([*encode_text(encoding, text or ""), END], "<u2"))
                stream = np.concatenate(found)
                whole = len(stream) // length
                rest = stream[whole * length :]
                rows = [stream[i * length : (i + 1) * length].tobytes() for i in range(whole)]
                if rows:
                    yield record_batch([[part] * whole, range(place, place + whole), rows], arrow)
                place += whole
        if len(rest):
            filled = np.full(length, END, "<u2")
            filled[: len(rest)] = rest
            yield record_batch([[part], [place], [filled.tobytes()]], arrow)

    return importable(docs.select("text")).mapInArrow(run, _SEQUENCES)


def materialise(
    docs: DataFrame,
    key: int = KEY,
    length: int = LENGTH,
    shard_sequences: int = SHARD_SEQUENCES,
    vocabulary: str | None = None,
) -> DataFrame:
    """The shards in training order, a row each; write them to any format with binary values."""
    import uuid

    spark = docs.sparkSession
    path = f"{scratch_folder(spark)}/sequences-{uuid.uuid4().hex}"
    sequences(docs, length, vocabulary).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(_SEQUENCES).parquet(path)
    counts = rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    first, n = {}, 0
    for c in counts:  # one number for each input partition
        first[c.part], n = n, n + c.n
    shards = -(-n // shard_sequences)
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    numbers = spark.sparkContext.broadcast(first)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        begin = np.array([numbers.value[p] for p in column(batch, "part")], np.int64)
        index = begin + np.asarray(column(batch, "place"), np.int64)
        slot = permute(index, n, key)
        return record_batch([slot // shard_sequences, slot, batch.column(2)], placed)

    placed = arrow_schema("shard bigint, slot bigint, ids binary")
    slots = importable(rows).mapInArrow(
        lambda batches: map(place, batches), "shard bigint, slot bigint, ids binary"
    )
    ranged = slots.repartitionById(parts, (F.col("shard") * parts / F.lit(max(shards, 1))).cast("int"))
    return ranged.sortWithinPartitions("slot").mapInArrow(
        _shard_writer(2 * length, shard_sequences), _SHARDS
    )


def _shard_writer(stride: int, shard_sequences: int):
    arrow = arrow_schema(_SHARDS)

    def row(shard: int, ids: list[bytes]) -> pa.RecordBatch:
        return record_batch(
            [[shard], [shard * shard_sequences], [len(ids)], [stride], [b"".join(ids)]], arrow
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for s, ids in zip(column(batch, "shard"), column(batch, "ids")):
                if s != shard and held:
                    yield row(shard, held)
                    held = []
                shard = s
                held.append(ids)
        if held:
            yield row(shard, held)

    return write


def read_from(shards: DataFrame, slot: int, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, shard by shard: how a reader resumes."""
    rest = shards.where(F.col("shard") >= slot // shard_sequences).orderBy("shard")
    for row in rest.toLocalIterator():
        stride = row.stride
        begin = max(slot - row.first_slot, 0)
        for i in range(begin, row.n_sequences):
            yield np.frombuffer(row.data, "<u2", stride // 2, i * stride)
