"""Directly addressable codes: integers as 8-bit chunks by level, with continuation bitmaps and rank directories.

Level 0 has the low 8 bits of every id and one bit that says whether more follow; level 1 has the next 8
bits of just those that go on, and so forth. A directory keeps the number of set bits before each block of
512, so that the place of an id's next chunk, its rank among the ids that go on, takes one look-up and a
popcount within one block: any id is read from a few bytes of each level, and no block is decoded.

A segment, little-endian: ``DAC1``, u32 levels, u64 documents, then for each level u64 chunks, and the parts
in this order: document ids (i64), document ends (u64), then for each level the chunks (u8), the bitmap
(u64 words) and the directory (u32).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512


def _bitmap(go_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.packbits(go_on, bitorder="little")
    words = np.zeros(-(-len(go_on) // 64), np.uint64)
    words.view(np.uint8)[: len(bits)] = bits
    counts = np.bitwise_count(words).astype(np.int64)
    per_block = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK // 64)) if len(counts) else counts
    return words, (np.cumsum(per_block) - per_block).astype(np.uint32)


def encode(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The segment of some documents: all their ids in a row, and how many each has."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while len(rest) or not levels:
        high = rest >> np.uint32(8)
        go_on = high > 0
        levels.append((rest.astype(np.uint8), *_bitmap(go_on)))
        rest = high[go_on]
    head = MAGIC + struct.pack("<IQ", len(levels), len(doc_ids)) + b"".join(struct.pack("<Q", len(c)) for c, _, _ in levels)
    parts = [head, np.asarray(doc_ids, "<i8").tobytes(), np.cumsum(sizes).astype("<u8").tobytes()]
    for chunks, words, directory in levels:
        parts += [chunks.tobytes(), words.astype("<u8").tobytes(), directory.astype("<u4").tobytes()]
    return b"".join(parts)


class Segment:
    """A segment over any buffer, a memory-mapped file among them."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_levels, n_docs = struct.unpack_from("<IQ", data, 4)
        sizes, at = struct.unpack_from(f"<{n_levels}Q", data, 16), 16 + 8 * n_levels

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.doc_ends = take("<i8", n_docs), take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for n in sizes:
            words = -(-n // 64)
            self.levels.append((take("u1", n), take("<u8", words), take("<u4", -(-words // (BLOCK // 64)))))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """The id at place ``i``, without decoding others."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, words, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            word, bit = divmod(i, 64)
            here = int(words[word])
            if not here >> bit & 1:
                break
            first = i // BLOCK * (BLOCK // 64)
            before = int(np.bitwise_count(words[first:word]).sum()) + (here & ((1 << bit) - 1)).bit_count()
            i = int(directory[i // BLOCK]) + before
        return value

    def all(self) -> np.ndarray:
        """All ids, as uint32."""
        out = np.zeros(0, np.uint32)
        for chunks, words, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            go_on = np.unpackbits(words.view(np.uint8), bitorder="little", count=len(chunks)).view(bool)
            values[go_on] |= out << np.uint32(8)
            out = values
        return out
