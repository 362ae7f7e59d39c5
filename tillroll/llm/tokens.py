"""Token ids of texts, as the public tokenizers give them, with the work kept per word.

``word_bpe`` treats the words between ASCII white space on their own: neither its
normaliser nor its splitting pattern looks across white space. So a text's ids are the ids
of its words, and a worker remembers those. New words are split into pieces by the
tokenizer's own pattern, and new pieces are encoded by the tokenizer, many in one call;
the ends of pieces are read off the ids, as a piece's last id and only that carries the
word-end mark. Words with characters beyond Latin-1, where libraries may differ in their
Unicode tables, and texts with the string of a special token go to the tokenizer as
they are.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from tillroll.llm.words import PIECE, buffer_words, pieces

WORD_BPE = "word_bpe_49k.json"
# Words, and pieces, a worker remembers; with more it starts anew. A million take some 200 MB each.
MEMORY = 1_000_000

_END = "</w>"
# Stands for the end of a line among ids.
_LINE = 2**32 - 1
# Fixed value: the splitting pattern in the tokenizer's file.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids by ``tokenizers``' ``encode(text, add_special_tokens=False)``, as uint32 arrays."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.of_pieces = Tokenizer.from_file(path)
        self.of_pieces.normalizer = normalizers.Sequence([])
        self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.split = regex.compile(_SPLIT + r"|\n").findall
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.ends = np.zeros(size, bool)
        # A sentence ends after a run of punctuation with a full stop, ! or ? in it.
        self.stops = np.zeros(size, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith(_END)
            core = piece.removesuffix(_END)
            self.stops[i] = self.ends[i] and bool(re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*", core))
        self.words: dict[int, bytes] = {}
        self.pieces = {"\n": np.uint32(_LINE).tobytes()}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        for start in range(0, len(pieces), 512):
            some = pieces[start : start + 512]
            found = self.of_pieces.encode(" ".join(some), add_special_tokens=False).ids
            ids = np.array(found, np.uint32)
            cut = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cut) != len(some) + 1 or cut[-1] != len(ids):
                raise ValueError("the vocabulary does not mark the ends of words")
            data = ids.tobytes()
            for piece, a, b in zip(some, cut, cut[1:]):
                self.pieces[piece] = data[4 * a : 4 * b]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, as bytes."""
        text = b"\n".join(words).decode()
        if not _latin(text):
            other = {w: self._whole(w.decode()) for w in words if not _latin(w.decode())}
            rest = [w for w in words if w not in other]
            found = other | (dict(zip(rest, self._learn(rest))) if rest else {})
            return [found[w] for w in words]
        parts = self.split(text.lower())
        self._learn_pieces([p for p in set(parts) if p not in self.pieces])
        data = b"".join(map(self.pieces.__getitem__, parts))
        line = (4 * np.flatnonzero(np.frombuffer(data, np.uint32) == _LINE)).tolist()
        return [data[a:b] for a, b in zip([0, *(x + 4 for x in line)], [*line, len(data)])]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MEMORY:
            self.words.clear()
        if len(self.pieces) > MEMORY:
            self.pieces = {"\n": np.uint32(_LINE).tobytes()}
        out: list[np.ndarray | None] = [
            np.frombuffer(self._whole(t), np.uint32) if any(s in t for s in self.special) else None
            for t in texts
        ]
        rest = [i for i, ids in enumerate(out) if ids is None]
        encoded = [texts[i].encode() for i in rest]
        if sum(map(len, encoded)) <= PIECE:
            found = self._joined(encoded)
        else:
            found = [np.concatenate([self._joined([p])[0] for p in pieces(t)]) for t in encoded]
        for i, ids in zip(rest, found):
            out[i] = ids
        return out

    def _joined(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts whose words are looked up by 64-bit hash, each different word once."""
        data = b"\n".join(texts)
        hashes, start, end = buffer_words(data, lower=False)
        hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        names = hashes.tolist()
        ids = list(map(self.words.get, names))
        new = [k for k, found in enumerate(ids) if found is None]
        if new:
            at = first[new]
            words = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            for k, found in zip(new, self._learn(words)):
                self.words[names[k]] = ids[k] = found
        flat = np.frombuffer(b"".join(ids), np.uint32)
        length = np.array([len(x) for x in ids], np.int64) // 4
        begin = np.cumsum(length) - length
        length, begin = length[which], begin[which]
        stop = np.cumsum(length)
        out = flat[np.repeat(begin - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        cut = np.concatenate([[0], stop])[np.searchsorted(start, offsets)]
        return [out[a:b] for a, b in zip(cut, cut[1:])]


def _latin(text: str) -> bool:
    """Whether the text is Latin-1. It then has no combining marks, and so is in NFC."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker."""
    return WordEncoder(path)
