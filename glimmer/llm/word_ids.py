"""Ids of whole texts by the tokenizers library, with words already encoded looked up.

The vocabulary drops white space and never joins symbols across it, so a text's ids are its words' ids in
order. Words of Latin-1 characters go to the library's merge model after the file's own normalisation
(lower case) and split; any other word goes through the library's whole encoder.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

from glimmer.llm.token_counts import byte_alphabet

#: Split pattern of the public word vocabulary (fixed value of its file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_ENTRIES = 600_000
#: Characters of text whose words are held at once.
BATCH_CHARS = 400_000
#: Characters that str.split() takes for white space and the library does not.
ODD = "\x1c\x1d\x1e\x1f"


class Index(dict):
    """Word -> number; a word that is asked for the first time gets the next one and is listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Encoder for one vocabulary file whose split drops white space; each text is followed by ``end_id``."""

    def __init__(self, path: str, end_id: int, cache_entries: int = CACHE_ENTRIES):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.find = regex.compile(SPLIT).findall
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.end_id, self.cache_entries = end_id, cache_entries
        self._reset()

    def _reset(self) -> None:
        self.index = Index()
        self.index[""] = 0  # stands for the end of a text
        self.part: dict[str, bytes] = {}
        self.starts, self.lens = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([self.end_id], np.uint32)

    def _part(self, p: str) -> bytes:
        ids = self.part.get(p)
        if ids is None:
            shown = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.table)
            ids = self.part[p] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < "Ā"):
            return self._part(word.lower())
        if "<|" in word or not (word.isascii() or max(word) < "Ā") or any(c in word for c in ODD):
            return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._part, self.find(word.lower())))

    def _learn(self) -> None:
        """Encode the words that the index has met since the last call."""
        new = self.index.new
        if not new:
            return
        coded = list(map(self._word, new))
        lens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(coded), np.uint32)))
        new.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts, each followed by the end id, and the count for each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.index) > self.cache_entries:
            self._reset()
        split = []
        for t in texts:
            s = [t] if any(c in t for c in ODD) else t.split()  # a text that str.split() would cut elsewhere is one word
            s.append("")
            split.append(s)
        n = np.fromiter(map(len, split), np.int64, len(split))
        w = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        self._learn()
        lens = self.lens[w]
        stop = np.cumsum(lens)
        ids = self.ids[np.repeat(self.starts[w] - (stop - lens), lens) + np.arange(int(stop[-1]))]
        return ids, np.add.reduceat(lens, np.cumsum(n) - n)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, cache_entries: int = CACHE_ENTRIES) -> WordEncoder:
    return WordEncoder(path, end_id, cache_entries)


def batches(texts: list[str], chars: int = BATCH_CHARS):
    """Slices (start, end) of a list of texts with about ``chars`` characters each; a longer text stands alone."""
    start = 0
    while start < len(texts):
        end, n = start, 0
        while end < len(texts) and (end == start or n + len(texts[end]) <= chars):
            n += len(texts[end])
            end += 1
        yield start, end
        start = end
