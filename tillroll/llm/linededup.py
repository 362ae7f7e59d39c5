"""Line deduplication across documents through sharded minimal perfect hashes.

A line's key is the line stripped of ASCII white space with A-Z folded. Keys of 10
code points or more that occur in two documents lose their lines everywhere but in
the document of the smallest id.

1. Each document sends the 128-bit hashes of its different keys; grouping them (summed
   up before the shuffle, so a line of every third document costs a row per task) gives
   owner (smallest id) and count of the keys of two documents or more.
2. These hashes are cut into shards of about SHARD_KEYS, and as many that a shard is asked
   about SHARD_PROBES times at most. A shard is a minimal perfect
   hash (levels of bit arrays: keys alone on their bit stop there, the rest go on) that
   indexes three plain arrays: a 64-bit fingerprint, the count and the owner.
3. Documents are dealt into buckets. A bucket sends each of its hashes once to the hash's
   shard, probes the arrays there, and gets the owners of those found. Lines are joined
   with nothing, and a line that is in every document costs a row per bucket.
4. Bucket by bucket, first the owners and then the documents stream through a task that
   drops the lines owned elsewhere.

Memory in a task is one shard or the owners of one bucket; texts stream.

Cases: a NULL or empty text is one empty line, kept; a NULL doc_id counts as one document
after all others; repeated rows of a doc_id are one document, whose rows all keep the lines
it owns; a table without rows gives none; further columns are handed through, and columns
named as the results are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import arrow_schema, column, importable, map_rows, record_batch, slices, stored
from tillroll.llm.words import mix

MIN_CHARS = 10
SHARD_KEYS = 100_000
SHARD_PROBES = 200_000
BUCKET_ROWS = 2_000
GAMMA = 2.0
NULL_ID = 2**63 - 1

_BLANK = " \t\n\x0b\x0c\r"
_U = np.uint64


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None for a short one."""
    key = line.strip(_BLANK)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


class PerfectHash:
    """Minimal perfect hash of n distinct 128-bit keys (two uint64 columns) with value arrays."""

    def __init__(self, bits: list[np.ndarray], before: list[int], fingerprint, count, owner):
        self.bits, self.before = bits, before
        self.rank = [np.cumsum(b) for b in bits]
        self.fingerprint, self.count, self.owner = fingerprint, count, owner

    @staticmethod
    def position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + _U(level * 2 + 1))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, count: np.ndarray, owner: np.ndarray) -> PerfectHash:
        bits, before, placed, rest = [], [], 0, keys
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = cls.position(rest, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            before.append(placed)
            placed += int(alone.sum())
            rest = rest[~alone[at]]
        n = len(keys)
        table = cls(bits, before, np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64))
        index = table.index(keys)
        table.fingerprint[index], table.count[index], table.owner[index] = keys[:, 1], count, owner
        return table

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1 for a key of the set; anything, or -1, for another."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, before, rank) in enumerate(zip(self.bits, self.before, self.rank)):
            at = self.position(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = before + rank[at[hit]] - 1
            open_ = open_[~hit]
        return out

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the set, and the owners of these."""
        index = self.index(keys)
        found = np.flatnonzero(index >= 0)
        found = found[self.fingerprint[index[found]] == keys[found, 1]]
        return found, self.owner[index[found]]

    def dump(self) -> bytes:
        file = io.BytesIO()
        levels = {f"level{i}": np.packbits(b) for i, b in enumerate(self.bits)}
        sizes = np.array([len(b) for b in self.bits], np.int64)
        np.savez(
            file, sizes=sizes, before=np.array(self.before, np.int64), owner=self.owner,
            fingerprint=self.fingerprint, count=self.count, **levels,
        )
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        z = np.load(io.BytesIO(data))
        bits = [
            np.unpackbits(z[f"level{i}"], count=int(n)).astype(bool)
            for i, n in enumerate(z["sizes"])
        ]
        return cls(bits, z["before"].tolist(), z["fingerprint"], z["count"], z["owner"])


def _halves(batch: pa.RecordBatch) -> np.ndarray:
    """The two hash columns as an array of shape (rows, 2)."""
    return np.stack(
        [
            batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64).view(np.uint64)
            for c in ("h1", "h2")
        ],
        axis=1,
    )


def _split(digests: list[bytes]) -> list[np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return [both[:, 0], both[:, 1]]


def document_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, bucket, h1, h2) for each different key of each row of (id, bucket, text)."""

    def hashes(batch: pa.RecordBatch) -> list:
        owners, buckets, digests = [], [], []
        for doc, bucket, text in zip(*(column(batch, c) for c in ("id", "bucket", "text"))):
            mine = {line_hash(x, min_chars) for x in (text or "").split("\n")} - {None}
            owners += [doc] * len(mine)
            buckets += [bucket] * len(mine)
            digests += mine
        return [owners, buckets, *_split(digests)]

    return map_rows(docs, "doc bigint, bucket int, h1 bigint, h2 bigint", hashes)


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    keys = np.stack(
        [table[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")], axis=1
    )
    built = PerfectHash.build(keys, table["n"].to_numpy(), table["owner"].to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "arrays": [built.dump()]})


_FOUND = "bucket int, h1 bigint, h2 bigint, owner bigint"


def _prober():
    """Over rows sorted by shard, its arrays first: answer the probes that follow."""
    arrow = arrow_schema(_FOUND)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table = None, None
        for batch in batches:
            names = np.asarray(column(batch, "shard"))
            for start, end in runs(names):
                part = batch.slice(start, end - start)
                if names[start] != shard:
                    shard, table = names[start], None
                arrays = part.column(part.schema.get_field_index("arrays"))
                if arrays[0].is_valid:
                    table, part = PerfectHash.load(arrays[0].as_py()), part.slice(1)
                if table is None or not part.num_rows:
                    continue
                keys = _halves(part)
                found, owner = table.probe(keys)
                bucket = part.column(part.schema.get_field_index("bucket")).take(pa.array(found))
                halves = keys[found].view(np.int64)
                yield record_batch([bucket, halves[:, 0], halves[:, 1], owner], arrow)

    return probe


def runs(names: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
    return list(zip(cuts, cuts[1:]))


def shard_count(keys: int, probes: int) -> int:
    """Shards for so many repeated keys, and lines to look up at most."""
    return max(1, keys // SHARD_KEYS, probes // SHARD_PROBES)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (the lines that stay, joined by \\n)."""
    results = ("n_lines", "n_dropped", "kept_text")
    keep = [c for c in docs.columns if c not in results]
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    size = docs.agg(F.count("*").alias("rows"), F.sum(breaks + 1).alias("lines")).first()
    buckets = max(1, size.rows // BUCKET_ROWS)
    ident = F.coalesce("doc_id", F.lit(NULL_ID))
    rows = docs.select(
        ident.alias("id"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"),
        "text",
        F.struct(*keep).alias("row"),
    )
    hashes = document_hashes(rows.select("id", "bucket", "text"), min_chars)
    repeated = stored(
        hashes.groupBy("h1", "h2")
        .agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("*").alias("n"))
        .where("owner < last")
        .drop("last"),
        "repeated-lines",
    )
    shards = shard_count(repeated.count(), size.lines or 0)
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    arrays = (
        importable(repeated).select(shard, "h1", "h2", "n", "owner")
        .groupBy("shard")
        .applyInArrow(_build_shard, "shard int, arrays binary")
    )
    probes = hashes.select(shard, "bucket", "h1", "h2").distinct()
    none = F.lit(None)
    asked = arrays.select(
        "shard",
        "arrays",
        none.cast("int").alias("bucket"),
        none.cast("bigint").alias("h1"),
        none.cast("bigint").alias("h2"),
    ).unionByName(probes.withColumn("arrays", none.cast("binary")))
    found = (
        asked.repartition("shard")
        .sortWithinPartitions("shard", F.col("arrays").isNull())
        .mapInArrow(_prober(), _FOUND)
    )
    kind = rows.select("row").schema["row"].dataType
    both = rows.select(
        "bucket",
        F.lit(1).alias("part"),
        none.cast("bigint").alias("h1"),
        none.cast("bigint").alias("h2"),
        none.cast("bigint").alias("owner"),
        "row",
    ).unionByName(
        found.select(
            "bucket", F.lit(0).alias("part"), "h1", "h2", "owner", none.cast(kind).alias("row")
        )
    )
    schema = f"row {kind.simpleString()}, n_lines bigint, n_dropped bigint, kept_text string"
    kept = (
        both.repartition("bucket")
        .sortWithinPartitions("bucket", "part")
        .mapInArrow(_dropper(schema, min_chars), schema)
    )
    return kept.select("row.*", *results)


def _dropper(schema: str, min_chars: int):
    arrow = arrow_schema(schema)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, owners = None, {}
        for batch in batches:
            names = np.asarray(column(batch, "bucket")) * 2 + np.asarray(column(batch, "part"))
            for start, end in runs(names):
                if names[start] // 2 != bucket:
                    bucket, owners = names[start] // 2, {}
                part = batch.slice(start, end - start)
                if names[start] % 2 == 0:
                    digests = _halves(part).astype(">u8").tobytes()
                    keys = [digests[i : i + 16] for i in range(0, len(digests), 16)]
                    owners.update(zip(keys, column(part, "owner")))
                    continue
                for some in slices(part):
                    rows = some.column(some.schema.get_field_index("row"))
                    yield record_batch([rows, *_kept(rows, owners, min_chars)], arrow)

    return drop


def _kept(rows: pa.StructArray, owners: dict[bytes, int], min_chars: int) -> list[list]:
    total, dropped, texts = [], [], []
    for doc, text in zip(rows.field("doc_id").to_pylist(), rows.field("text").to_pylist()):
        doc = NULL_ID if doc is None else doc
        lines = (text or "").split("\n")
        stay = [x for x in lines if owners.get(line_hash(x, min_chars), doc) >= doc]
        total.append(len(lines))
        dropped.append(len(lines) - len(stay))
        texts.append("\n".join(stay))
    return [total, dropped, texts]


def line_dedup_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
