"""Piece ids of texts with the original bytes behind every piece, and the texts back from ids.

Method. A text is normalised by the model's compiled character map, a double-array trie: at each
character the longest rule that is a prefix of what follows gives the replacement, else the
character stays. All positions of a text walk the trie at once, a byte a step, in numpy. Every
normalised byte keeps the place of the characters it came from. The byte-pair merges are the
sentencepiece library's: a copy of the model without normalisation encodes the words of the
normalised text. Merges never reach across two characters that stand side by side in no piece, so
the text may be cut there (before its blanks, around line ends, and inside very long words), and a
worker remembers the words. A piece's span is looked up by the running sum of piece sizes.

Bytes count from 0, ends are exclusive. Of the byte pieces of one character all but the last have
an empty span at its start, and the last has the character, as in the library.

Cases: a NULL or empty text has no piece and decodes to the empty text. Repeated rows, NULL ids and
further columns do no harm: a row in is a row out, only ``doc_id`` is carried. An empty
table gives an empty one. Whole texts are encoded; a word that cannot be cut (a run of one letter,
of blanks) goes to the library in one piece. Models must be of kind BPE with byte fallback
and without user-defined pieces, else ValueError.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import column, ddl, map_rows
from tillroll.llm.tokens import tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
# Words a worker remembers, of at most so many characters; with more it starts anew.
MEMORY, WORD = 200_000, 64
# Words of more characters are cut wherever no piece can reach across.
LONG = 4096

_SPACE, _MARK = b" ", "▁"
# Types of pieces, and field numbers of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3


class Encoded(NamedTuple):
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Number, wire type and value of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError("not a model file")
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, kind, data[at : at + size]
        at += size


def _field(number: int, value: bytes) -> bytes:
    size, head = len(value), bytearray([number << 3 | 2])
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    head.append(size)
    return bytes(head) + value


class CharacterMap:
    """Normalisation by a compiled character map, with the source of every byte."""

    def __init__(self, compiled: bytes, dummy_prefix: bool, squeeze: bool, escape: bool, suffix: bool = False):
        self.dummy_prefix, self.squeeze, self.escape, self.suffix = dummy_prefix, squeeze, escape, suffix
        self.trie = self.strings = None
        if compiled:
            size = int.from_bytes(compiled[:4], "little")
            self.trie = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
            self.strings = compiled[4 + size :]

    def longest(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions at which a rule applies, the length of the longest one, its replacement's place."""
        where = np.flatnonzero((buf & 0xC0) != 0x80)
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = np.full(len(where), offset(self.trie[0]), np.int64)
        length, place = np.zeros(len(buf), np.int64), np.zeros(len(buf), np.int64)
        step = 0
        while len(where):
            inside = where + step < len(buf)
            where, node = where[inside], node[inside]
            byte = buf[where + step].astype(np.int64)
            node = node ^ byte
            unit = self.trie[np.minimum(node, len(self.trie) - 1)]
            going = (node < len(self.trie)) & ((unit & (2**31 | 255)) == byte)
            where, unit, node = where[going], unit[going], node[going]
            node ^= offset(unit)
            step += 1
            leaf = (unit >> 8) & 1 == 1
            length[where[leaf]] = step
            place[where[leaf]] = self.trie[node[leaf]] & (2**31 - 1)
        found = np.flatnonzero(length)
        return found, length[found], place[found]

    def replacement(self, place: int) -> bytes:
        return self.strings[place : self.strings.index(b"\0", place)]

    def units(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Replaced bytes; where each unit (a character, or what a rule took) starts in them and in ``raw``.

        The two arrays end with the lengths.
        """
        buf = np.frombuffer(raw, np.uint8)
        if self.trie is None:
            start = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(raw))
            return raw, start, start
        out, at, source, target, size = [], 0, [], [], 0
        lead = np.flatnonzero((buf & 0xC0) != 0x80)

        def plain(a: int, b: int) -> None:
            nonlocal size
            if a < b:
                starts = lead[np.searchsorted(lead, a) : np.searchsorted(lead, b)]
                source.append(starts)
                target.append(starts - a + size)
                out.append(raw[a:b])
                size += b - a

        for position, length, place in zip(*(x.tolist() for x in self.longest(buf))):
            if position < at:
                continue
            plain(at, position)
            new = self.replacement(place)
            source.append([position])
            target.append([size])
            out.append(new)
            size += len(new)
            at = position + length
        plain(at, len(raw))
        join = lambda parts, last: np.concatenate([*parts, [last]]).astype(np.int64)
        return b"".join(out), join(target, size), join(source, len(raw))

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and the end, the byte of ``raw`` it came from."""
        nothing = b"", np.zeros(1, np.int64)
        if not raw:
            return nothing
        data, start, source = self.units(raw)
        buf = np.frombuffer(data, np.uint8)
        origin = np.repeat(source[:-1], np.diff(start))
        first = 0
        if self.squeeze:
            blank = buf == 32
            size = np.diff(start)
            full = np.flatnonzero(size)  # units that are replaced by something
            # A unit loses the blanks it begins with after a blank, and at the start.
            after = np.ones(len(full), bool)
            after[1:] = blank[start[full + 1][:-1] - 1]
            solid = np.append(np.flatnonzero(~blank), len(buf))
            head = np.minimum(solid[np.searchsorted(solid, start[full])], start[full + 1])
            drop = np.zeros(len(buf) + 1, np.int64)
            np.add.at(drop, start[full][after], 1)
            np.add.at(drop, head[after], -1)
            keep = np.cumsum(drop)[:-1] == 0
            single = (size == 1) & (np.append(blank, False)[start[:-1]])
            ahead = np.flatnonzero(~single)
            if not len(ahead):
                return nothing
            first = int(source[ahead[0]])
            buf, origin = buf[keep], origin[keep]
        end = len(raw)
        blank = buf == 32
        if self.escape:
            width = np.where(blank, 3, 1)
            text, origin = buf.tobytes().replace(_SPACE, _MARK.encode()), np.repeat(origin, width)
        else:
            text = buf.tobytes()
        mark = _MARK.encode() if self.escape else _SPACE
        if self.dummy_prefix and not self.suffix:
            text, origin = mark + text, np.concatenate([np.full(len(mark), first), origin])
        if self.squeeze:
            stripped = len(text)
            while text.endswith(mark, 0, stripped):
                stripped -= len(mark)
                end = int(origin[stripped])
            text, origin = text[:stripped], origin[:stripped]
        if self.dummy_prefix and self.suffix:
            text, origin = text + mark, np.concatenate([origin, np.full(len(mark), end)])
        return text, np.append(origin, end)


class PieceEncoder:
    """The ids of ``sentencepiece``'s ``encode(text)`` with spans, and its ``decode(ids)``."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._load(file.read())

    @classmethod
    def of_model(cls, model: bytes) -> PieceEncoder:
        made = cls.__new__(cls)
        made._load(model)
        return made

    def _load(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        message = list(fields(model))
        pieces = []
        for number, _, value in message:
            if number == PIECES:
                said = {n: v for n, _, v in fields(value)}
                pieces.append((said[1], said.get(3, NORMAL)))
        trainer = {n: v for f, _, t in message if f == TRAINER for n, _, v in fields(t)}
        spec = {n: v for f, _, t in message if f == NORMALIZER for n, _, v in fields(t)}
        # Model type 2 is BPE, field 35 byte fallback, 24 blanks as suffixes.
        kinds = {k for _, k in pieces}
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or BYTE not in kinds or USER_DEFINED in kinds:
            raise ValueError("the model must be BPE with byte fallback, without user-defined pieces")
        self.map = CharacterMap(
            spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)),
            bool(trainer.get(24, 0)),
        )
        self.size = np.array([1 if k == BYTE else len(p) for p, k in pieces], np.int64)
        merged = [p.decode() for p, k in pieces if k in (NORMAL, UNUSED)]
        self.glued = {pair for p in merged for pair in zip(p, p[1:])}
        self.library = SentencePieceProcessor(model_proto=model)
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        kept = [(n, v) for n, kind, v in message if n != NORMALIZER and kind == 2]
        self.of_words = SentencePieceProcessor(
            model_proto=b"".join(_field(n, v) for n, v in [*kept, (NORMALIZER, plain)])
        )
        inside = {c for pair in self.glued for c in pair}
        alone = "".join(c for c in "\n\r\t" if c not in inside)
        if any(b == _MARK != a for a, b in self.glued):
            self.split = lambda text: [text]
        else:
            others = f"[^{_MARK}{re.escape(alone)}]"
            lonely = f"[{re.escape(alone)}]|" if alone else ""
            self.split = re.compile(f"{lonely}{_MARK}*{others}+|{_MARK}+").findall
        self.words: dict[str, bytes] = {}

    def _cut(self, word: str) -> list[str]:
        """A long word in parts between which no piece reaches."""
        at = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.glued]
        parts, start = [], 0
        for cut in [*at, len(word)]:
            # Few parts: cuts are taken where a part has grown long enough.
            if cut - start >= LONG or cut == len(word):
                parts.append(word[start:cut])
                start = cut
        return parts

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words, as the bytes of uint32 numbers."""
        parts = [self._cut(w) if len(w) > LONG else [w] for w in words]
        flat = list(chain.from_iterable(parts))
        found = (array("I", ids).tobytes() for ids in self.of_words.encode(flat, num_threads=1))
        return [b"".join(islice(found, len(p))) for p in parts]

    def encode_many(self, texts: list[str]) -> list[Encoded]:
        if len(self.words) > MEMORY:
            self.words.clear()
        normalised = [self.map.normalise(t.encode()) for t in texts]
        split = [self.split(data.decode()) for data, _ in normalised]
        new = list(set(chain.from_iterable(split)) - self.words.keys())
        long = {}
        for word, ids in zip(new, self._ids(new) if new else []):
            (self.words if len(word) <= WORD else long)[word] = ids
        out = []
        for (data, origin), words in zip(normalised, split):
            ids = list(map(self.words.get, words))
            if long and None in ids:
                ids = [long[w] if i is None else i for w, i in zip(words, ids)]
            ids = np.frombuffer(b"".join(ids), np.uint32)
            size = self.size[ids]
            end = np.cumsum(size)
            if (int(end[-1]) if len(end) else 0) != len(data):
                raise ValueError("the pieces do not cover the text")
            out.append(Encoded(ids, origin[end - size], origin[end]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker."""
    return PieceEncoder(path)


def _lists(arrays: list[np.ndarray], kind: type, arrow: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays).astype(kind) if arrays else np.empty(0, kind)
    return pa.ListArray.from_arrays(offsets, pa.array(values, arrow))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row its doc_id, the ids, the first byte and the end of the bytes behind each, and
    ``decoded``, the text that the library makes of the ids."""
    path = path or tokenizer_path(PIECE_BPE)

    def encode(batch: pa.RecordBatch) -> list:
        model = encoder(path)
        found = model.encode_many([t or "" for t in column(batch, "text")])
        return [
            batch.column(0),
            _lists([e.ids for e in found], np.int32, pa.int32()),
            _lists([e.begins for e in found], np.int32, pa.int32()),
            _lists([e.ends for e in found], np.int32, pa.int32()),
            [model.decode(e.ids) for e in found],
        ]

    docs = docs.select("doc_id", "text")
    schema = f"{ddl(docs.select('doc_id'))}, ids array<int>, begins array<int>, ends array<int>, decoded string"
    return map_rows(docs, schema, encode)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text`` of rows of doc_id and ``ids``; NULL ids give the empty text."""
    path = path or tokenizer_path(PIECE_BPE)

    def decode(batch: pa.RecordBatch) -> list:
        model = encoder(path)
        texts = [model.decode(np.array(i or [], np.int64)) for i in column(batch, "ids")]
        return [batch.column(0), texts]

    encoded = encoded.select("doc_id", "ids")
    return map_rows(encoded, f"{ddl(encoded.select('doc_id'))}, text string", decode)


def sentencepiece_query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The operator's ids, spans and texts as digests: the row of the contract, and a hash of the spans."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return encode_documents(docs, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )
