"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct k-word shingles (white-space words, A-Z folded).
Two documents are linked if their sets have a Jaccard similarity of ``percent`` / 100 or
more; groups are the connected components of the links.

1. Sketch: register i is K_i = floor(1 - log_b(min over the set of h_i)), clipped to
   [0, q + 1], with h_i exponentially distributed hashes of rate ``a``: exponentially
   spaced truncated minima. A union's registers are the maxima of the parts' ones, so
   sketches merge; with b near 1 registers agree with about the Jaccard similarity.
2. Documents of equal sets (128-bit digest) are one class; copies never meet again.
3. Bands of registers give bucket keys. So many bands are used that a pair at the
   threshold shares none with a probability of at most MISS.
4. In a bucket all classes are paired with the smallest one, never with each other.
   Pairs have to pass the size ratio, the joint likelihood estimate of the similarity from
   the registers (five standard errors below the threshold) and the exact comparison of
   the full sets. Links give components.
5. Buckets that then still hold several components are finished. Pairs across the
   components of a bucket of up to SMALL classes go through the same tests. Larger buckets
   that share classes are one crowd, of documents a little less similar than the threshold.
   A crowd is cut into groups of bounded size, its largest component into groups of its own,
   and a task compares two groups, but for two of the largest component: block by block
   common shingles are counted by a matrix product, and of the links found it returns those
   that join components, at most one for each document. So no pair that shares a bucket is
   left out unless its documents are already in one component, no task makes rows of pairs,
   and a set is sent once for each group it has to meet.

Cases: a text without words, NULL or empty, has an empty set and is linked with
nothing; a text of fewer than k words has one shingle, the whole sequence; repeated rows
of a doc_id are one document; a NULL doc_id can't name a group: its component is NULL, it
is kept, and links with nothing; a table without rows gives none; further columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import column, importable, map_rows, stored
from tillroll.llm.components import components
from tillroll.llm.words import mix, shingles, word_hashes
from tillroll.operators.numbering import PARTS, numbered_within

SHINGLE, PERCENT = 5, 80
BAND_ROWS = 8
MISS = 1e-6
SMALL = 16
# Of a block of a crowd: documents, shingles; and the columns of a matrix at a time.
BLOCK_SETS, BLOCK_ITEMS, BLOCK_COLUMNS = 1024, 1 << 17, 8192
# A task compares two groups of blocks: documents and shingles (32 MB) of a group at most. Up to SPREAD
# groups are made of fewer, so that tasks are enough.
GROUP_SETS, GROUP_ITEMS, SPREAD = 1 << 13, 1 << 22, 8
# Sketch parameters: base, rate, largest register.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2


def band_count(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands for a pair at the threshold to share one but with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def _multipliers(registers: int) -> np.ndarray:
    return np.random.default_rng(8).integers(0, 2**32, registers, dtype=np.uint32) | np.uint32(1)


def sketch(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """Registers, (len(sets), registers) uint16, of sets of shingle hashes, none empty."""
    if not sets:
        return np.empty((0, registers), np.uint16)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((registers, len(sets)), np.uint32)
    hashed = np.empty_like(values)
    for i, m in enumerate(_multipliers(registers)):
        np.multiply(values, m, out=hashed)
        np.minimum.reduceat(hashed, starts, out=least[i])
    exponential = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    level = np.floor(1 - np.log(exponential) / math.log(BASE))
    return np.clip(level, 0, LIMIT + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) bucket keys."""
    n, m = registers.shape
    parts = registers.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), (n, m // rows))
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood of the Jaccard similarity from registers and set sizes.

    With u and v the shares of the sizes, a register of x exceeds y's with probability
    p(u - v J), p(z) = -log_b(1 - z (b - 1) / b), and the reverse with p(v - u J).
    """
    above, below = (x > y).sum(1), (x < y).sum(1)
    equal = x.shape[1] - above - below
    u, v = nx / (nx + ny), ny / (nx + ny)
    p = lambda z: np.maximum(-np.log1p(-z * (BASE - 1) / BASE) / math.log(BASE), 1e-300)

    def likelihood(j):
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        rest = np.maximum(1 - up - down, 1e-300)
        return above * np.log(up) + below * np.log(down) + equal * np.log(rest)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def text_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    return shingles(*word_hashes([(t or "").encode() for t in texts], lower=True), k)


def sketched(docs: DataFrame, k: int, registers: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, registers) of each row; digests and registers NULL if empty."""

    def work(batch: pa.RecordBatch) -> list:
        sets = text_sets(column(batch, "text"), k)
        full = [s for s in sets if len(s)]
        rows = iter(sketch(full, registers))
        d1, d2, regs = [], [], []
        for s in sets:
            digest = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
            d1.append(digest and (digest >> 64) - 2**63)
            d2.append(digest and (digest & (2**64 - 1)) - 2**63)
            regs.append(next(rows).tobytes() if len(s) else None)
        doc = batch.column(batch.schema.get_field_index("doc_id"))
        return [doc, [len(s) for s in sets], d1, d2, regs]

    return map_rows(
        docs.select("doc_id", "text"),
        "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, registers binary",
        work,
    )


def _buckets(classes: DataFrame, rows: int) -> DataFrame:
    """(key, rep, n) for each band of each class."""

    def work(batch: pa.RecordBatch) -> list:
        registers = np.stack([np.frombuffer(r, np.uint16) for r in column(batch, "registers")])
        keys = band_keys(registers, rows)
        each = lambda c: np.repeat(np.asarray(column(batch, c), np.int64), keys.shape[1])
        return [keys.ravel(), each("rep"), each("n")]

    return map_rows(classes, "key bigint, rep bigint, n bigint", work)


def _similar_size(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


class _Verifier:
    """The tests a pair of classes has to pass, for one corpus."""

    def __init__(self, texts: DataFrame, classes: DataFrame, k: int, percent: int, registers: int):
        self.texts, self.classes, self.k, self.percent = texts, classes, k, percent
        t = percent / 100
        self.least = t - 5 * math.sqrt(t * (1 - t) / registers)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the ``pairs`` (a, b) whose full sets are similar enough."""
        likely = stored(self._likely(pairs), "likely-pairs")
        ids = likely.select(F.col("a").alias("doc_id")).unionByName(
            likely.select(F.col("b").alias("doc_id"))
        )
        sets = self.sets(ids.distinct())
        both = likely.join(sets.withColumnsRenamed({"doc_id": "a", "items": "x"}), "a").join(
            sets.withColumnsRenamed({"doc_id": "b", "items": "y"}), "b"
        )
        percent = self.percent

        def confirm(batch: pa.RecordBatch) -> list:
            a, b = [], []
            for p, q, x, y in zip(*(column(batch, c) for c in ("a", "b", "x", "y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    a.append(p)
                    b.append(q)
            return [a, b]

        return stored(map_rows(both.select("a", "b", "x", "y"), "a bigint, b bigint", confirm), "links")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(doc_id, items): the full sets of the documents of ``ids`` (doc_id)."""
        k = self.k

        def work(batch: pa.RecordBatch) -> list:
            sets = [s.tobytes() for s in text_sets(column(batch, "text"), k)]
            return [batch.column(batch.schema.get_field_index("doc_id")), sets]

        texts = self.texts.join(ids, "doc_id", "left_semi")
        return map_rows(texts, "doc_id bigint, items binary", work)

    def _likely(self, pairs: DataFrame) -> DataFrame:
        least = self.least
        side = self.classes.select("rep", "n", "registers")
        both = pairs.join(
            side.withColumnsRenamed({"rep": "a", "n": "na", "registers": "x"}), "a"
        ).join(side.withColumnsRenamed({"rep": "b", "n": "nb", "registers": "y"}), "b")

        def near(batch: pa.RecordBatch) -> list:
            a, b, x, y, na, nb = (column(batch, c) for c in ("a", "b", "x", "y", "na", "nb"))
            stack = lambda rows: np.stack([np.frombuffer(r, np.uint16) for r in rows])
            j = estimate(stack(x), stack(y), np.asarray(na, float), np.asarray(nb, float))
            good = np.flatnonzero(j >= least)
            return [np.asarray(a, np.int64)[good], np.asarray(b, np.int64)[good]]

        both = both.select("a", "b", "x", "y", "na", "nb")
        return map_rows(both, "a bigint, b bigint", near).distinct()


def _crowds(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rep, crowd) for the classes in large buckets; buckets with a class in common are one crowd."""
    large = rest.join(sizes.where(f"members > {SMALL}"), "key")
    edges = large.select(F.col("low").alias("a"), F.col("rep").alias("b"))
    return stored(components(edges).withColumnsRenamed({"node": "rep", "component": "crowd"}), "crowds")


def _groups(main: bool) -> F.Column:
    """Groups for the classes of a crowd that are, or aren't, of its largest component."""
    mine = F.when(F.col("main") == main, F.col("n"))
    count, items = F.count(mine), F.coalesce(F.sum(mine), F.lit(0))
    blocks = F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(items / BLOCK_ITEMS))
    least = F.greatest(F.ceil(count / GROUP_SETS), F.ceil(items / GROUP_ITEMS))
    return F.greatest(F.least(blocks, F.lit(SPREAD)), least, F.lit(1)).cast("int")


def placed_members(members: DataFrame) -> DataFrame:
    """(crowd, i, j, rep, component, own): the pairs of groups to which a class is sent, and its own group.

    Classes of the largest component of a crowd, in groups of their own, meet those of the others only.
    """
    parts = members.groupBy("crowd", "component").agg(F.count("*").alias("c"))
    largest = parts.groupBy("crowd").agg(F.max(F.struct("c", "component"))["component"].alias("largest"))
    marked = members.join(largest, "crowd").withColumn("main", F.col("component") == F.col("largest"))
    size = marked.groupBy("crowd").agg(_groups(True).alias("g"), _groups(False).alias("r"))
    deal = lambda groups: F.pmod(F.xxhash64("rep"), groups).cast("int")
    return (
        marked.join(size, "crowd")
        .withColumn("own", F.when(F.col("main"), deal("g")).otherwise(F.col("g") + deal("r")))
        .withColumn("first", F.when(F.col("main"), F.col("g")).otherwise(0))
        .withColumn("other", F.explode(F.expr("sequence(first, g + r - 1)")))
        .select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component", "own")
    )


def _crowd_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all similar ``members`` (crowd, rep, n, component) of each crowd."""
    placed = placed_members(stored(members, "crowd-members"))
    placed = placed.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        items = [x.as_buffer() for chunk in table["items"].chunks for x in chunk]
        a, b = group_links(*(table[c].to_pylist() for c in ("rep", "component", "own")), items, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = placed.select("crowd", "i", "j", "rep", "component", "own", "items")
    return importable(rows).groupBy("crowd", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def blocks_of(places: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """``places`` cut into blocks of up to BLOCK_SETS sets and BLOCK_ITEMS shingles, or of one set."""
    blocks, start, items = [], 0, 0
    for at, n in enumerate(size[places].tolist()):
        if at > start and (at - start == BLOCK_SETS or items + n > BLOCK_ITEMS):
            blocks.append(places[start:at])
            start, items = at, 0
        items += n
    return [*blocks, places[start:]] if len(places) else blocks


def group_links(
    reps: list[int], components: list[int], groups: list[int], items: list[bytes], percent: int
) -> tuple[list[int], list[int]]:
    """Similar pairs that join components, of documents of two groups (or of one), block by block.

    Pairs inside a group are left to the task that has only that group.
    """
    sets = [np.frombuffer(x, np.uint64) for x in items]
    size = np.array([len(s) for s in sets])
    _, component = np.unique(np.asarray(components), return_inverse=True)
    group = np.asarray(groups)
    alone = group.min() == group.max()
    left = blocks_of(np.flatnonzero(group == group.min()), size)
    right = left if alone else blocks_of(np.flatnonzero(group == group.max()), size)
    parent, a, b = list(range(len(sets))), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    now, known = component, 0
    for at, x in enumerate(left):
        for y in right[at:] if alone else right:
            if len(a) > known:
                now, known = np.array([root(c) for c in range(component.max() + 1)])[component], len(a)
            if (now[x] == now[x[0]]).all() and (now[y] == now[x[0]]).all():
                continue
            for p, q in similar_pairs(sets, size, now, x, y, percent):
                u, v = root(int(component[p])), root(int(component[q]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    a.append(reps[p])
                    b.append(reps[q])
    return a, b


def similar_pairs(
    sets: list[np.ndarray], size: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> Iterator[tuple[int, int]]:
    """Places of similar sets of two blocks (or one) that are in different components."""
    same = left is right
    both = left if same else np.concatenate([left, right])
    _, code, times = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), size[both])
    rank = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[code]
    owner, rank = owner[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, BLOCK_COLUMNS):
        some = slice(*np.searchsorted(rank, [low, low + BLOCK_COLUMNS]))
        has = np.zeros((len(both), BLOCK_COLUMNS), np.float32)
        has[owner[some], rank[some] - low] = 1
        common += has[: len(left)] @ (has if same else has[len(left) :]).T
    common = common.astype(np.int64)  # whole numbers so far: exact up to 2^24 common shingles
    union = size[left][:, None] + size[right][None, :] - common
    linked = (100 * common >= percent * union) & (component[left][:, None] != component[right][None, :])
    for x, y in zip(*(index.tolist() for index in np.nonzero(linked))):
        yield int(left[x]), int(right[y])


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, rows: int = BAND_ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its group) and kept, per row."""
    registers = rows * band_count(percent, rows)
    sketches = stored(sketched(docs, k, registers), "sketches")
    named = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(
        named.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("registers").alias("registers"),
        ),
        "classes",
    )
    buckets = _buckets(classes.select("rep", "n", "registers"), rows)
    centers = (
        buckets.groupBy("key")
        .agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("last"))
        .where("c.rep < last")
        .select("key", F.col("c.rep").alias("center"), F.col("c.n").alias("nc"))
    )
    shared = stored(buckets.join(centers, "key"), "buckets")
    # Only these classes can have a partner: their texts are moved once, all else reads the copy.
    met = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(docs.select("doc_id", "text").join(met, "doc_id", "left_semi"), "texts")
    verifier = _Verifier(texts, classes, k, percent, registers)
    star = (
        shared.where("rep != center")
        .selectExpr("center AS a", "rep AS b", "nc AS na", "n AS nb")
        .where(_similar_size(percent))
        .select("a", "b")
        .distinct()
    )
    links = verifier.links(star)
    links = links.unionByName(_remaining_links(shared, star, components(links), verifier))
    final = components(links).withColumnsRenamed({"node": "rep", "component": "root"})
    label = classes.select("d1", "d2", "rep").join(final, "rep", "left")
    grouped = sketches.drop("registers").join(label, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return grouped.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _remaining_links(
    shared: DataFrame, tried: DataFrame, placed: DataFrame, verifier: _Verifier
) -> DataFrame:
    """Links across the components (``placed``) that meet in a bucket; ``tried`` pairs are known."""
    named = shared.join(placed, shared["rep"] == placed["node"], "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    sizes = (
        named.groupBy("key")
        .agg(
            F.min("component").alias("first"),
            F.max("component").alias("last"),
            F.min("rep").alias("low"),
            F.count("*").alias("members"),
        )
        .where("first < last")
        .select("key", "low", "members")
    )
    rest = stored(named.join(sizes, "key").select("key", "rep", "n", "component", "low", "members"), "open-buckets")
    sizes = rest.select("key", "low", "members").distinct()
    rest = rest.drop("low", "members")
    crowds = _crowds(rest, sizes)
    members = rest.select("rep", "n", "component").distinct().join(crowds, "rep")
    dense = _crowd_links(members, verifier.sets(crowds.select(F.col("rep").alias("doc_id"))), verifier.percent)
    side = (
        rest.join(sizes.where(f"members <= {SMALL}"), "key", "left_semi")
        .join(crowds, "rep", "left")
        .select("key", "rep", "n", "component", F.coalesce("crowd", F.lit(-1) - F.col("rep")).alias("crowd"))
    )
    x = side.selectExpr("key", "rep AS a", "n AS na", "component AS ca", "crowd AS wa")
    y = side.selectExpr("key", "rep AS b", "n AS nb", "component AS cb", "crowd AS wb")
    across = (
        x.join(y, "key")
        .where("a < b AND ca != cb AND wa != wb")
        .where(_similar_size(verifier.percent))
        .select("a", "b")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    return verifier.links(across).unionByName(stored(dense, "crowd-links"))


def near_dedup_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), k=3, percent=85)


def numbered_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_doc``, a number for each different text of a doc_id; NULL without an id.

    It is the doc_id, but where the rows of one have several texts, those beyond the one of the least
    hash have numbers of their own, after all ids.
    """
    text = (F.isnull("text"), "text")
    marks = {"_h1": F.xxhash64(*text), "_h2": F.xxhash64(F.lit(1), *text)}
    marked = docs.withColumns(marks)
    pairs = stored(marked.where("doc_id IS NOT NULL").select("doc_id", *marks).distinct(), "texts-of-ids")
    first = pairs.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min(F.struct(*marks)).alias("_first"))
    more = pairs.join(first.where("_n > 1"), "doc_id").where(F.struct(*marks) != F.col("_first"))
    dealt = more.select("doc_id", *marks, F.pmod(F.xxhash64(*marks), F.lit(PARTS)).cast("int").alias("_part"))
    dealt = stored(dealt, "further-texts")
    after = pairs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("bigint") + 1).scalar()
    further = numbered_within(dealt, "_part", PARTS, ["doc_id", *marks], "_place")
    further = further.select("doc_id", *marks, (F.col("_place") + after).alias("_number"))
    numbered = marked.join(further, ["doc_id", *marks], "left")
    return numbered.withColumn("_doc", F.coalesce("_number", F.col("doc_id").cast("bigint"))).select(*docs.columns, "_doc")


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of documents that are not the first of their group.

    Of rows of one doc_id and one text one stays. Rows of one doc_id and different texts are
    different documents: they go by links alone, and of linked ones those stay whose number comes first
    (``numbered_texts``). Rows without a doc_id stay.
    """
    numbered = numbered_texts(docs)
    verdict = near_duplicates(numbered.select(F.col("_doc").alias("doc_id"), "text"), k, percent)
    gone = verdict.where("NOT kept").select(F.col("doc_id").alias("_doc")).distinct()
    stay = numbered.join(gone, "_doc", "left_anti")
    named = stay.where("_doc IS NOT NULL").dropDuplicates(["_doc"])
    return named.unionByName(stay.where("_doc IS NULL")).select(docs.columns)
