"""Directly addressable codes for token ids: a binary shard with random access.

Each id is split into chunks of eight bits, lowest first. Level ``k`` holds the ``k``-th
chunk of every id that has one, a bitmap that tells which of them continue, and a rank
directory: the number of set bits before each 512-bit block. An id is read by following
its chunk through the levels, each step one bitmap rank, so no block is ever decoded.

Shard layout, little-endian, every part padded to 8 bytes:
``DACTOK01``, then int64 level count, token count, document count; document ids (int64),
a byte per document that is 0 where its id is NULL, document ends (int64); per level
int64 chunk count, the chunks (bytes), the bitmap (64-bit words), the directory (int64).
"""

from __future__ import annotations

import numpy as np

MAGIC = b"DACTOK01"
BLOCK_WORDS = 8  # 512 bits


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def encode_shard(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard of consecutive documents; ``lengths`` are their token counts in ``ids``."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while len(rest):
        more = rest > 0xFF
        words = np.zeros(-(-len(rest) // 64) * 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        words[:len(packed)] = packed
        words = words.view("<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        blocks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK_WORDS))
        directory = np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<i8")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), words.tobytes(), directory.tobytes()))
        rest = rest[more] >> np.uint32(8)
    parts = [MAGIC, np.array([len(levels), len(ids), len(doc_ids)], "<i8").tobytes(),
             np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
             _pad(bytes(d is not None for d in doc_ids)), np.cumsum(lengths).astype("<i8").tobytes()]
    for count, chunks, words, directory in levels:
        parts += [np.array([count], "<i8").tobytes(), _pad(chunks), words, directory]
    return b"".join(parts)


class ShardReader:
    """Reads a shard's bytes in place: ``token(i)``, ``tokens(a, b)`` and its documents."""

    def __init__(self, data: bytes):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self._data, self._at = memoryview(data), 8
        n_levels, self.n_tokens, n_docs = (int(x) for x in self._take("<i8", 3))
        ids, present = self._take("<i8", n_docs), self._take(np.uint8, n_docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present, strict=True)]
        self.doc_ends = self._take("<i8", n_docs)
        self._levels = []
        for _ in range(n_levels):
            count = int(self._take("<i8", 1)[0])
            chunks, words = self._take(np.uint8, count), self._take("<u8", -(-count // 64))
            self._levels.append((chunks, words, self._take("<i8", -(-len(words) // BLOCK_WORDS))))

    def _take(self, kind, count: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, count, self._at)
        self._at += -(-out.nbytes // 8) * 8
        return out

    @staticmethod
    def _rank(words: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before bit ``i``."""
        block, word = i // (64 * BLOCK_WORDS), i // 64
        if block >= len(directory):
            return int(directory[-1]) + int(np.bitwise_count(words[(len(directory) - 1) * BLOCK_WORDS:]).sum()) if len(directory) else 0
        ones = int(directory[block]) + int(np.bitwise_count(words[block * BLOCK_WORDS:word]).sum())
        return ones + (int(words[word]) & ((1 << (i % 64)) - 1)).bit_count() if word < len(words) else ones

    def token(self, i: int) -> int:
        """Id at position ``i`` of the shard."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, words, directory) in enumerate(self._levels):
            value |= int(chunks[i]) << (8 * level)
            if not int(words[i // 64]) >> (i % 64) & 1:
                break
            i = self._rank(words, directory, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids at positions ``a`` to ``b`` (exclusive): on each level one run between two ranks."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level, (chunks, words, directory) in enumerate(self._levels):
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(words[a // 64:-(-b // 64)].view(np.uint8), bitorder="little")
            where = where[bits[a % 64:a % 64 + b - a].astype(bool)]
            a, b = self._rank(words, directory, a), self._rank(words, directory, b)
        return out
