"""Byte-pair merges over numpy arrays: vocabulary, pre-tokens, batched merge rounds.

The symbols of many words lie in one flat array. In each round every word
that can still merge applies its own lowest-ranked pair, at all its places at
once; ranks come from a binary search over the sorted pair keys, and only the
pairs beside a merge are looked up again. Words without a pair left drop out.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import regex
from tokenizers import normalizers, pre_tokenizers
from tokenizers import Regex as LibraryRegex

NO_PAIR = np.iinfo(np.int32).max
# Distinct white-space chunks whose ids a worker remembers before it starts afresh.
CACHE_CHUNKS = 400_000
# White space as the tokeniser's own patterns have it (unlike str.split, without U+001C to U+001F).
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# Above this, Unicode tables of different versions disagree: the tokeniser's own tables decide there.
NEWER = regex.compile("[^\x00-\u0557]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else 256, 257, ..."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A word-level BPE file (JSON text) as arrays: pair keys, ranks, merged ids, byte ids."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        every = {**ids, **self.special}
        self.tokens = [b""] * (max(every.values()) + 1)
        for token, i in every.items():
            self.tokens[i] = token.encode()
        if len(self.tokens) > 1 << 16:
            raise ValueError("pair keys hold two 16-bit ids")
        self.byte_id = np.array([ids[c] for c in byte_symbols()], np.int32)
        self.end_id = np.array([ids[c + suffix] for c in byte_symbols()], np.int32)
        keys = np.array([ids[a] << 16 | ids[b] for a, b in model["merges"]], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in model["merges"]], np.int32)
        pieces = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = pieces[0]["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        self._newer_word = pre_tokenizers.Split(LibraryRegex(pattern), "removed", invert=True)
        self._newer_text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.first_marks = tuple(self.special)
        self._cache: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_PAIR`` where there is no merge."""
        key = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def merge_rounds(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of ``lens`` symbols each, laid out one after another in ``sym``."""
        word = np.repeat(np.arange(lens.size), lens)
        rank = np.full(sym.size, NO_PAIR, np.int32)
        if sym.size > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.rank(sym[inside], sym[inside + 1])
        done_sym, done_word = [], []
        while sym.size:
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, sym.size))
            live = low != NO_PAIR
            if not live.all():
                stay = np.repeat(live, size)
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                sym, word, rank = sym[stay], word[stay], rank[stay]
                low, size = low[live], size[live]
                if not sym.size:
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            beside = np.diff(at) == 1
            if beside.any():  # x x x: left to right, so every other place of a run
                run = np.concatenate(([True], ~beside))
                since = np.arange(at.size) - np.maximum.accumulate(np.where(run, np.arange(at.size), 0))
                at = at[since % 2 == 0]
            sym[at] = self.merged[rank[at]]
            stay = np.ones(sym.size, bool)
            stay[at + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            at = at - np.arange(at.size)
            near = np.concatenate((at, at[at > 0] - 1))
            rank[near] = NO_PAIR
            near = near[near + 1 < sym.size]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.rank(sym[near], sym[near + 1])
        if not done_sym:
            return sym, np.zeros(lens.size, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=lens.size)

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.byte_id[flat]
        last = np.cumsum(lens) - 1
        sym[last] = self.end_id[flat[last]]
        return self.merge_rounds(sym, lens)

    def chunks(self, text: str) -> list[str]:
        """The normalised white-space chunks of a text; special strings stand as chunks of their own."""
        if self.marks is not None and any(mark in text for mark in self.first_marks):
            out = []
            for part in self.marks.split(text):
                out += [part] if part in self.special else self._plain_chunks(part)
            return out
        return self._plain_chunks(text)

    def _plain_chunks(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
            if text.isprintable():
                return text.split()
        elif NEWER.search(text):
            text = self._newer_text.normalize_str(text)
        else:
            # one character at a time: no word-final form of the capital sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [c for c in SPACES.split(text) if c]

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of one chunk."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk]
        if chunk.isascii() or not NEWER.search(chunk):
            return self.word.findall(chunk)
        return [word for word, _ in self._newer_word.pre_tokenize_str(chunk)]

    def chunk_ids(self, chunks: set[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each chunk; encodes those not remembered, in one batch."""
        if len(self._cache) > CACHE_CHUNKS:
            self._cache.clear()
        new = [c for c in chunks if c not in self._cache]
        if new:
            words, counts = [], []
            for chunk in new:
                found = () if chunk in self.special else self.words(chunk)
                words += found
                counts.append(len(found))
            ids, lens = self.encode_words(words) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            ends = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum(counts)))] * 4
            raw, ends = ids.astype("<u4").tobytes(), ends.tolist()
            for i, chunk in enumerate(new):
                self._cache[chunk] = raw[ends[i]:ends[i + 1]]
            for mark, i in self.special.items():
                if mark in chunks:
                    self._cache[mark] = np.array([i], "<u4").tobytes()
        return self._cache

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.chunks(text) for text in texts]
        ids = self.chunk_ids(set().union(*split))
        return [b"".join([ids[c] for c in chunks]) for chunks in split]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the ids: their tokens, one space between (the file names no decoder)."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])
