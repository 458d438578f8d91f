"""Token counts by rank-synchronous merging of byte-pair symbols.

All distinct pre-tokens of a batch lie in one flat symbol array with a sequence number per symbol. In each
round every sequence merges all occurrences of its own lowest-ranked pair at once; a sequence that has no
ranked pair left is finished, and its surviving symbols are its token count. A merge can only create pairs
of higher rank than its own (their merge was learned later), so this equals merging one pair at a time.

Null text counts as empty (0 tokens); an empty text has 0 tokens. Rows are never grouped, so ties, repeated
rows and skewed keys need no care; other columns are carried unchanged.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from tokenizers import Tokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.llm.common import prepare

#: White space as the tokenizer's own pattern sees it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Byte-level pre-token pattern (fixed values of the public tokenizer).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Ranges of characters whose classes (letter, number, white space) agree between the regex package and the tokenizers
#: library, as a test makes sure of; a text with any other goes through the library's own pre-tokenizer.
SETTLED = [(0x0, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x3000, 0x303F), (0x3041, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E)]

#: Entries that a worker keeps of words already counted; beyond it the table starts anew (memory bound only).
CACHE_ENTRIES = 600_000
#: Characters of text handled at once in a worker.
CHUNK_CHARS = 4_000_000

NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class RankMerger:
    """Merge table of one byte-level vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        alphabet = byte_alphabet()
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._build(left * 65536 + right)

    def _build(self, keys: np.ndarray) -> None:
        """Open-addressed table from pair to rank, at most a sixteenth full."""
        bits = max(8, int(np.ceil(np.log2(max(len(keys), 1)))) + 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        for rank, (slot, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & self.mask
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * 65536 + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lens)
        while sym.size:
            same = seq[1:] == seq[:-1]
            rank = np.full(sym.size, NONE, np.int32)
            at = np.flatnonzero(same)
            rank[at] = self.rank_of(sym[at], sym[at + 1])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, sym.size))
            over = best == NONE
            counts[seq[starts[over]]] = size[over]
            stay = np.repeat(~over, size)
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            best, size = best[~over], size[~over]
            if not sym.size:
                break
            low = np.repeat(best, size)
            hit = rank == low
            if (hit[1:] & hit[:-1]).any():  # x x x: of overlapping occurrences, every other one from the left
                i = np.arange(hit.size)
                opens = hit & ~np.concatenate(([False], hit[:-1]))
                hit &= (i - np.maximum.accumulate(np.where(opens, i, 0))) % 2 == 0
            sym[hit] = self.merged[low[hit]]
            left = ~np.concatenate(([False], hit[:-1]))
            sym, seq = sym[left], seq[left]
        return counts


class TokenCounter:
    """Counts of whole texts; words already counted are looked up."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        self.merger = RankMerger(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.merger.specials))) if self.merger.specials else None
        self.risky = regex.compile(r" \s| $")
        self.unsettled = regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SETTLED) + "]")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.shown = str.maketrans({c: chr(b) for b, c in byte_alphabet().items()})
        self.cache_entries = cache_entries
        self.spaced: dict[str, int] = {}  # count of " " + word
        self.words: dict[str, int] = {}  # count of one pre-token

    def _learn(self, spaced: set[str], words: set[str]) -> None:
        if len(self.spaced) + len(self.words) > self.cache_entries:
            self.spaced, self.words = {}, {}
        find = self.pattern.findall
        split = {w: find(" " + w) for w in spaced if w not in self.spaced}
        fresh = set(words)
        for parts in split.values():
            fresh.update(parts)
        fresh = [w for w in fresh if w not in self.words]
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            self.words.update(zip(part, self.merger.count([w.encode("utf-8", "surrogatepass") for w in part]).tolist(), strict=True))
        count = self.words
        self.spaced.update((w, sum([count[p] for p in parts])) for w, parts in split.items())

    def _library_parts(self, text: str) -> list[str]:
        """Pre-tokens by the library; it writes each byte as a character, which is turned back."""
        return [p.translate(self.shown).encode("latin-1").decode("utf-8", "surrogatepass") for p, _ in self.library.pre_tokenize_str(text)]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's own string counts as one token, as the library does by default."""
        out, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            out += self._chunk(texts[start:end])
            start = end
        return out

    def _chunk(self, texts: list[str]) -> list[int]:
        plans, spaced, words = [], set(), set()
        for text in texts:
            pieces = self.special.split(text) if self.special and "<|" in text else [text]
            plan = [len(pieces) - 1]
            for piece in pieces:
                if not piece:
                    continue
                if self.unsettled.search(piece):
                    parts = self._library_parts(piece)
                    plan.append((False, parts))
                    words.update(parts)
                elif self.risky.search(piece):  # runs of white space reach over a space: the pattern must see the whole
                    parts = self.pattern.findall(piece)
                    plan.append((False, parts))
                    words.update(parts)
                else:  # each single space belongs to the word behind it
                    parts = piece.split(" ")
                    head = self.pattern.findall(parts[0])
                    plan.append((False, head))
                    words.update(head)
                    plan.append((True, parts[1:]))
                    spaced.update(plan[-1][1])
            plans.append(plan)
        self._learn(spaced, words)
        by_space, by_word = self.spaced.__getitem__, self.words.__getitem__
        return [plan[0] + sum(sum(map(by_space if lead else by_word, parts)) for lead, parts in plan[1:]) for plan in plans]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column, tokenizer_path: str) -> Column:
    """Number of tokens of a text column (long; null text: 0)."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(tokenizer_path).counts(["" if t is None else t for t in texts.tolist()]), dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` plus n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); columns of those names are replaced."""
    prepare(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(body).cast("long"))
        .withColumn("n_tokens", token_count(body, tokenizer_path))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )
