"""Exact, fast encoding with a word-level BPE file of the ``tokenizers`` library.

The library's normaliser and pre-tokeniser never look across ASCII white space, so a text's ids are the ids of its
white-space chunks in order.  Chunks are encoded by the library once and remembered by a 64-bit hash.  A chunk of plain
Latin letters is one pre-token, and a run of marks after it another, so that letters and marks are encoded apart.
Texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from trailgraph.llm.words import Chunks, HashIndex, chunk_groups, ragged

END_OF_WORD = "</w>"
#: Chunks kept at most; beyond, the memory starts anew (a memory bound, not a data bound).
MEMO_ENTRIES = 700_000
MEMO_BITS = 16
WORDS_A_LINE = 128

_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: The byte-level alphabet of such files: printable Latin-1 bytes stand for themselves, the rest follow from 256.
_SHIFTED = [i for i in range(256) if not (33 <= i <= 126 or 161 <= i <= 172 or i >= 174)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(_SHIFTED) if b != 0x20}
_LOADED: dict[str, "WordBpe"] = {}


class WordBpe:
    """Encodes to the ids of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.vocab_size, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(END_OF_WORD)
        #: The same model for words that are normalised and pre-tokenised already.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self._forget()

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        """One instance a path and Python worker."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _forget(self) -> None:
        self.index = HashIndex(MEMO_BITS)  # grows with its entries
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _remember(self, hashes: np.ndarray, new: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.index.size + len(lengths) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        at = slice(self.index.size, self.index.size + len(lengths))
        self.flat[self.used : self.used + len(new)] = new
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.used += len(new)
        self.index.add(hashes)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _chunk_ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after the other, and how many each has.

        A chunk is a head and a tail: a plain word and the marks after it, or the whole chunk and nothing.  Plain words
        go to the library in lines of many, all else one by one.
        """
        words: dict[bytes, int] = {}
        others: dict[bytes, int] = {b"": 0}
        parts = []
        for chunk in chunks:
            m = _PLAIN.fullmatch(chunk)
            if m:
                parts.append(words.setdefault(m[1], len(words)))
                parts.append(-1 - others.setdefault(m[2], len(others)))
            else:
                parts.append(-1 - others.setdefault(chunk, len(others)))
                parts.append(-1)
        spelled = [w.decode() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(_BYTE_LEVEL) for w in words]
        lines = [" ".join(spelled[i : i + WORDS_A_LINE]) for i in range(0, len(spelled), WORDS_A_LINE)]
        encoded = [e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
        word_ids = np.fromiter(chain.from_iterable(encoded), dtype=np.uint32)
        word_ends = np.flatnonzero(self.ends[word_ids]) + 1
        if len(word_ends) != len(words):  # a word that this model doesn't end as one: encode all of them alone
            alone = [self._library(w.decode()) for w in words]
            word_ids = np.concatenate(alone)
            word_ends = np.cumsum([len(x) for x in alone])
        other_ids = [self._library(x.decode()) for x in others]
        flat = np.concatenate((word_ids, *other_ids))
        ends = np.concatenate((word_ends, len(word_ids) + np.cumsum([len(x) for x in other_ids]))).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        number = np.array(parts, dtype=np.int64)
        number = np.where(number < 0, len(words) - 1 - number, number)
        lengths = (ends - starts)[number]
        return flat[ragged(starts[number], lengths)], lengths.reshape(-1, 2).sum(axis=1)

    def _numbers(self, group: Chunks) -> np.ndarray:
        numbers = self.index.find(group.hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            if self.index.size + len(missing) > MEMO_ENTRIES and self.index.size:
                self._forget()
                return self._numbers(group)
            hashes, where = np.unique(group.hashes[missing], return_index=True)
            self._remember(hashes, *self._chunk_ids([group.chunk(i) for i in missing[where].tolist()]))
            numbers[missing] = self.index.find(group.hashes[missing])
        return numbers

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (unsigned 32-bit); null counts as empty."""
        out: list[np.ndarray] = []
        whole = {i for i, t in enumerate(texts) if t and any(s in t for s in self.specials)}
        for group in chunk_groups(["" if i in whole else t for i, t in enumerate(texts)]):
            numbers = self._numbers(group)
            lengths = self.length[numbers]
            ids = self.flat[ragged(self.start[numbers], lengths)]
            ends = np.concatenate(([0], np.cumsum(lengths)))[group.first]
            out += [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in whole:
            out[i] = self._library(texts[i])
        return out
