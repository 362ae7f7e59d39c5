"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree: counts of the byte that follows each context of up to
ORDER bytes. The code length of a byte is that of PPM with escape method C and exclusion:
-log2 c / (n + t) in a context of n bytes of t kinds, else -log2 t / (n + t) for the escape,
and on to the context one byte shorter without the kinds already seen, down to the uniform
code over the alphabet. The statistics are frozen after learning, so the code lengths of all
bytes after a context are a row of a table, worked out once: a longest context held by the
tree has a row, and every context of ORDER bytes points to the row of its longest suffix.
Scoring a text is then two look-ups for each byte and language.

The language of the shortest code wins; the score is its share of 2^-(code length) over
all languages. What is coded is the text's letters: A-Z is folded, and a run of other ASCII
characters is one space. The alphabet is the bytes of the sample; others share a symbol.

The model is fitted on a bounded sample: of each language the SAMPLE_ROWS labelled
documents of smallest hash; of a document over SAMPLE_BYTES an excerpt, CHUNKS pieces at
places chosen by hash, one in each of as many equal parts. So its size is bounded for
each language (contexts of the highest order need MIN_COUNT occurrences), and every language
with a labelled text outside the held-out fold is learned. All texts are scored, whole.

Cases: a NULL text, or one without a letter, is "und" with score 0; with no labelled
document every text is; a NULL doc_id counts as the empty text in the fold; rows equal in id, text and language
are learned from once, rows that share only an id are chosen apart; documents with a
NULL lang are scored, never learned from; equal code lengths go to the first language by
name; repeated rows get equal results; further columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import column, ddl, map_rows

ORDER = 3
MIN_COUNT = 4
SAMPLE_ROWS = 300
# Parts in which the rows of a language are first ranked.
DEALS = 64
SAMPLE_BYTES = 1 << 16
CHUNKS = 4
UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2
# For keep_identified: below it several languages are about as likely.
LEAST_SCORE = 0.4

_LETTER = re.compile(r"[^\W\d_]")
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def held_out() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def excerpt(text: Column, size: int) -> Column:
    """``text``, or CHUNKS pieces of it that hold at most ``size`` bytes together."""
    width = max(size // (4 * CHUNKS) - 1, 1)  # characters, of up to four bytes
    part = F.floor(F.length(text) / CHUNKS).cast("int")
    places = [
        F.lit(1) + part * k + F.pmod(F.xxhash64(text, F.lit(k)), F.greatest(part - width, F.lit(0)) + 1).cast("int")
        for k in range(CHUNKS)
    ]
    pieces = F.concat_ws(" ", *[F.substring(text, at, width) for at in places])
    return F.when(F.octet_length(text) <= size, text).otherwise(pieces)


def training_sample(
    docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES
) -> DataFrame:
    """(lang, text) of at most ``rows`` documents for each language, in a reproducible choice;
    texts of at most ``size`` bytes, longer ones as excerpts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    marked = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(9)).alias("mark"))
    chosen = marked.select("lang", "mark").distinct().withColumn("deal", F.pmod("mark", F.lit(DEALS)))
    # The lowest marks of each deal first, so that no task gets rows of a language from every other task.
    for keys in (("lang", "deal"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("mark"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= rows).drop("place")
    chosen = chosen.select("lang", "mark")
    # At most ``rows`` marks for each language; equal rows count once.
    found = marked.join(F.broadcast(chosen), ["lang", "mark"], "left_semi")
    parts = found.select("lang", "mark", excerpt(F.col("text"), size).alias("text"))
    return parts.groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", "text")


def fold(text: str) -> bytes:
    return b" ".join(text.encode().translate(_BLANKED).split())


class Model:
    """Alphabet and, for each language, the row of each context and the code lengths."""

    def __init__(self, langs: list[str], symbol: np.ndarray, rows: list, costs: list):
        self.langs, self.symbol, self.rows, self.costs = langs, symbol, rows, costs
        self.size = int(symbol.max()) + 1

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> Model:
        langs = sorted(texts)
        folded = {lang: [fold(t) for t in texts[lang]] for lang in langs}
        used = np.zeros(256, bool)
        used[32] = True
        for some in folded.values():
            for t in some:
                used[np.frombuffer(t, np.uint8)] = True
        symbol = np.where(used, np.cumsum(used) - 1, used.sum()).astype(np.int32)
        parts = [cls._tree([symbol[_padded(t)] for t in folded[x]], int(used.sum()) + 1) for x in langs]
        return cls(langs, symbol, [p[0] for p in parts], [p[1] for p in parts])

    @staticmethod
    def _tree(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        grams = np.concatenate(
            [np.stack([t[j : len(t) - ORDER + j] for j in range(ORDER + 1)], 1) for t in texts]
        ).astype(np.int64)
        code = np.zeros(len(grams), np.int64)  # of the last bytes, longest last
        counts = []
        for order in range(ORDER + 1):
            if order:
                code = code + grams[:, ORDER - order] * size ** (order - 1)
            keys, times = np.unique(code * size + grams[:, ORDER], return_counts=True)
            contexts, at = np.unique(keys // size, return_inverse=True)
            table = np.zeros((len(contexts), size), np.float32)
            table[at, keys % size] = times
            if order == ORDER:
                often = table.sum(1) >= MIN_COUNT
                contexts, table = contexts[often], table[often]
            counts.append((contexts, table))
        row_of = np.zeros(1, np.int32)
        rows, done = [_code_lengths(np.zeros(1, np.int64), 0, counts, size)], 1
        for order in range(1, ORDER + 1):
            contexts = counts[order][0]
            # A longer context starts from the row of its suffix: the low digits.
            row_of = np.tile(row_of, size)
            row_of[contexts] = done + np.arange(len(contexts), dtype=np.int32)
            rows.append(_code_lengths(contexts, order, counts, size))
            done += len(contexts)
        return row_of, np.concatenate(rows)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) bits of folded texts."""
        pad = b" " * ORDER
        data = self.symbol[np.frombuffer(pad + pad.join(texts), np.uint8)]
        context = np.zeros(len(data) - ORDER, np.int32)
        for j in range(ORDER):
            context += data[ORDER - 1 - j : len(data) - 1 - j] * np.int32(self.size**j)
        last = data[ORDER:]
        length = np.array([len(t) for t in texts])
        stop = np.cumsum(length + ORDER) - ORDER
        out = np.empty((len(texts), len(self.langs)))
        for k, (rows, costs) in enumerate(zip(self.rows, self.costs)):
            bits = costs.ravel()[rows[context].astype(np.int64) * self.size + last]
            total = np.concatenate([[0.0], np.cumsum(bits, dtype=np.float64)])
            out[:, k] = total[stop] - total[stop - length]
        return out


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " * ORDER + text, np.uint8)


def _code_lengths(contexts: np.ndarray, order: int, counts: list, size: int) -> np.ndarray:
    """Code length of every symbol after each of the ``contexts`` (codes of ``order`` symbols)."""
    out = np.full((len(contexts), size), np.inf, np.float32)
    escape = np.zeros(len(contexts), np.float32)
    free = np.ones((len(contexts), size), bool)
    for k in range(order, -1, -1):
        names, table = counts[k]
        suffix = contexts % size**k
        at = np.minimum(np.searchsorted(names, suffix), max(len(names) - 1, 0))
        held = names[at] == suffix if len(names) else np.zeros(len(contexts), bool)
        here = np.where(held[:, None] & free, table[at] if len(names) else 0, 0)
        n, kinds = here.sum(1), (here > 0).sum(1)
        seen = here > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = escape[:, None] - np.log2(here / (n + kinds)[:, None])
            out = np.where(seen, bits, out).astype(np.float32)
            more = np.where(kinds > 0, -np.log2(kinds / (n + kinds)), 0)
        escape = (escape + more).astype(np.float32)
        free &= ~seen
    left = np.maximum(free.sum(1), 1)
    return np.where(free, (escape + np.log2(left))[:, None], out).astype(np.float32)


def predict(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score of every row, by a model fitted on ``sample``.

    Rows are scored where they are; columns of the results' names are replaced.
    """
    texts: dict[str, list[str]] = {}
    for row in sample.collect():  # bounded by SAMPLE_ROWS and SAMPLE_BYTES for each language
        texts.setdefault(row.lang, []).append(row.text)
    model = docs.sparkSession.sparkContext.broadcast(Model.fit(texts) if texts else None)
    rows = docs.drop("lang_pred", "score")
    names = rows.columns

    def score(batch: pa.RecordBatch) -> list:
        values = column(batch, "text")
        lang, share = [UNDETERMINED] * len(values), [0.0] * len(values)
        some = [i for i, t in enumerate(values) if t is not None and _LETTER.search(t)]
        if some and model.value:
            bits = model.value.code_lengths([fold(values[i]) for i in some])
            shares = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            for i, k, s in zip(some, bits.argmin(1).tolist(), shares.tolist()):
                lang[i], share[i] = model.value.langs[k], s
        return [*(batch.column(batch.schema.get_field_index(c)) for c in names), lang, share]

    return map_rows(rows, ddl(rows) + ", lang_pred string, score double", score)


def language_query(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    found = predict(rows, training_sample(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without texts whose language cannot be told: without a letter, or of a score
    below ``least_score``."""
    found = predict(docs, training_sample(docs.select("doc_id", "text", "lang")))
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)
    return found.where(known).select(docs.columns)
