"""Benchmark decontamination by the q-gram lemma.

An item of m characters that lies in a document with at most k edits shares at least m + 1 - q (k + 1) of its
q-grams with it, all on diagonals (place in the document less place in the item) at most k apart. So shared
q-grams are counted in overlapping bands of 2 (k + 1) diagonals; only bands that reach the bound are kept, and
a banded alignment decides there whether k edits suffice. Short items allow no edits and have to stand between
word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, pieces, stored, table
from .words import mixed, window_hashes

Q = 8
#: Edits allowed per character of an item.
RATE = 0.1
#: Items shorter than this in characters, after normalization, are looked for without edits, as whole words.
LEAST = 40
#: Items shorter than this aren't looked for: single common words would tell nothing. 1 looks for all.
SHORTEST = Q
#: Benchmark characters that one pass over the documents looks for; more take more passes.
BLOCK_CHARS = 4_000_000
#: Shared q-grams that are counted at a time.
HITS = 1_000_000


def normal(text: str | None) -> str:
    """Lower case, each run of white space one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def banded_alignment(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``region`` with at most ``k`` edits, or None.

    Gaps at the ends of the region are free. Row i holds the least edits of the item's first i characters
    ending at each place, and where that alignment starts; insertions run along a row as a running minimum.
    """
    n = len(region)
    at = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), at.copy()
    for i, c in enumerate(item, 1):
        diagonal = np.append(i, cost[:-1] + (region != c))
        down = cost + 1
        new = np.minimum(diagonal, down)
        begin = np.where(diagonal <= down, np.append(0, start[:-1]), start)
        key = (new - at) * (n + 2) + at  # along a row each step right costs one: the least of new - at so far
        best = np.minimum.accumulate(key) % (n + 2)
        cost, start = new[best] + at - best, begin[best]
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= k else None


def between_words(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit adjoins ``text[start:end]`` so that a word would be cut."""
    cut = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
    return not cut(start) and not cut(end)


def whole_words(item: str, text: str) -> int:
    """Where ``item`` first stands in ``text`` between word boundaries, or -1."""
    at = text.find(item)
    while at >= 0 and not between_words(text, at, at + len(item)):
        at = text.find(item, at + 1)
    return at


class Items:
    """The q-gram index of benchmark items; those of fewer than q characters are a plain list beside it."""

    def __init__(self, ids: list[int | None], texts: list[str | None], q: int = Q, rate: float = RATE, least: int = LEAST, shortest: int = SHORTEST):
        plain = [normal(t) for t in texts]
        keep = [k for k, t in enumerate(plain) if len(t) >= max(shortest, q)]
        self.tiny = [(ids[k], t) for k, t in enumerate(plain) if max(shortest, 1) <= len(t) < q]
        self.q, self.ids, self.plain = q, [ids[k] for k in keep], [plain[k] for k in keep]
        self.size = np.array([len(t) for t in self.plain], np.int64)
        # below one shared q-gram the lemma tells nothing: such an item's budget is what still leaves one
        self.budget = np.minimum((self.size * rate).astype(np.int64), self.size // q - 1)
        self.exact = self.size < least
        self.budget[self.exact] = 0
        self.bound = self.size + 1 - q * (self.budget + 1)
        self.longest = int(self.size.max(initial=0))
        grams = [window_hashes(mixed(codes(t).astype(np.uint64)), q) for t in self.plain]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def _bands(self, hit: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands of shared q-grams at places ``hit``, and how many each has."""
        many = self.first[gram + 1] - self.first[gram]
        entry = np.repeat(self.first[gram] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item = self.owner[entry].astype(np.int64)
        diagonal = np.repeat(hit, many) - self.place[entry] + self.longest
        # a band starts at each multiple of the width and is two widths long: every hit lies in two bands
        band = diagonal // (self.budget[item] + 1)
        keys = np.concatenate((band, band - 1)) * len(self.ids) + np.tile(item, 2)
        least = keys.min()
        if keys.max() - least >= 4 * len(keys):
            return np.unique(keys, return_counts=True)
        count = np.bincount(keys - least)
        there = np.flatnonzero(count)
        return there + least, count[there]

    def candidates(self, text: np.ndarray, most: int = HITS) -> tuple[np.ndarray, np.ndarray]:
        """(item, least diagonal) of each band of the text that reaches its item's bound. Of a text in which q-grams of
        items come again and again, about ``most`` shared q-grams at a time are reduced to the counts of their bands."""
        h = window_hashes(mixed(text.astype(np.uint64)), self.q)
        hit = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        gram = np.searchsorted(self.grams, h[hit])
        real = self.grams[np.minimum(gram, len(self.grams) - 1)] == h[hit]
        hit, gram = hit[real], gram[real]
        work = np.cumsum(self.first[gram + 1] - self.first[gram])
        keys, count, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while lo < len(hit):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + most)))
            some, n = self._bands(hit[lo:hi], gram[lo:hi])
            both, back = np.unique(np.concatenate((keys, some)), return_inverse=True)
            sums = np.bincount(back, np.concatenate((count, n)), len(both)).astype(np.int64)
            # bands that no later place can reach are settled: only those at their bound stay
            items = both % len(self.ids)
            end = (both // len(self.ids) + 2) * (self.budget[items] + 1) - self.longest + self.size[items]
            later = end > hit[hi - 1] if hi < len(hit) else np.zeros(len(both), bool)
            stay = later | (sums >= self.bound[items])
            keys, count, lo = both[stay], sums[stay], hi
        item = keys % max(len(self.ids), 1)
        return item, keys // max(len(self.ids), 1) * (self.budget[item] + 1) - self.longest

    def search(self, docs: list[str]) -> dict[int, list[tuple[int | None, int, int, int]]]:
        """document -> (item_id, edits, start, end in the normalized text), the best place of each item."""
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        spans = [codes(d) for d in docs]
        size = np.array([len(s) for s in spans], np.int64)
        base = np.cumsum(size + self.q) - size - self.q
        text = np.zeros(int((size + self.q).sum()), np.uint32)
        for b, s in zip(base, spans, strict=True):
            text[b : b + len(s)] = s  # zeros between documents, which no item has
        for item, low in zip(*(x.tolist() for x in self.candidates(text)), strict=True) if self.ids else ():
            k = int(self.budget[item])
            high = low + 2 * (k + 1) + int(self.size[item]) + k
            d = max(int(np.searchsorted(base, low, side="right")) - 1, 0)
            while d < len(docs) and base[d] < high:  # a band may reach into several documents
                start, stop = max(low - int(base[d]), 0), min(high - int(base[d]), len(docs[d]))
                self._place(found.setdefault(d, {}), item, docs[d], start, stop)
                d += 1
        told = {d: [(self.ids[i], *at) for i, at in items.items()] for d, items in found.items() if items}
        for item_id, plain in self.tiny:
            for d, doc in enumerate(docs):
                if (at := whole_words(plain, doc)) >= 0:
                    told.setdefault(d, []).append((item_id, 0, at, at + len(plain)))
        return told

    def _place(self, known: dict[int, tuple[int, int, int]], item: int, doc: str, start: int, stop: int) -> None:
        """Note the item's best place in ``doc[start:stop]``, if it is better than the known one."""
        k, plain = int(self.budget[item]), self.plain[item]
        best = known.get(item)
        if stop - start < len(plain) - k or (best and best[0] == 0):
            return
        at = doc.find(plain, start, stop)
        if self.exact[item]:
            while at >= 0 and not between_words(doc, at, at + len(plain)):
                at = doc.find(plain, at + 1, stop)
            if at >= 0:
                known[item] = (0, at, at + len(plain))
        elif at >= 0:
            known[item] = (0, at, at + len(plain))
        elif (got := banded_alignment(codes(plain), codes(doc[start:stop]), k)) and (not best or got[0] < best[0]):
            known[item] = (got[0], got[1] + start, got[2] + start)


def _blocks(benchmark: DataFrame, block_chars: int, **how) -> Iterator[Items]:
    """The index of each block of the benchmark. Its size is measured first: up to ``block_chars`` characters are one
    block; a larger benchmark has more, each about as large, and only one at a time is on the driver."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    blocks = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in block], [r[1] for r in block], **how)


def leak_finder(shared):
    """A column function: array of (item_id, edits, start, end) of the items of a broadcast index found in a text."""

    @F.pandas_udf("array<struct<item_id:long,edits:int,start:long,end:long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for batch in batches:
            raw = batch.tolist()
            rows: list[list[dict]] = []
            for a, b in pieces([t or "" for t in raw]):
                found = index.search([normal(t) for t in raw[a:b]])
                for k in range(b - a):
                    hits = sorted(found.get(k, []), key=lambda h: (h[0] is not None, *h))
                    rows.append([dict(zip(("item_id", "edits", "start", "end"), h, strict=True)) for h in hits])
            yield pd.Series(rows, dtype=object)

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks", block_chars: int = BLOCK_CHARS, **how) -> DataFrame:
    """``docs`` with a column ``name``: the benchmark items (item_id, text) that each row's text leaks.

    An item leaks if its whole normalized text lies in the document's with at most ``rate`` edits a character. Items of
    fewer than ``least`` characters leak if they stand there as they are, between word boundaries; those of fewer than
    ``shortest``, null and blank ones aren't looked for, as they stand in clean documents too (``q``, ``rate``, ``least``
    and ``shortest`` are those of ``Items``). An item without id leaks too. Null and empty documents leak nothing;
    repeated rows and repeated items each count. No row moves between tasks. A benchmark of several blocks is looked
    for block by block: after each the documents are written with what was found, and its broadcast goes.
    """
    context, before = docs.sparkSession.sparkContext, None
    blocks = _blocks(benchmark, block_chars, **how)
    items = next(blocks)
    while items is not None:
        shared = context.broadcast(items)
        found = leak_finder(shared)(F.col("text"))
        docs = docs.withColumn(name, found if before is None else F.concat(F.col(name), found))
        items = next(blocks, None)
        if items is not None:
            docs = stored(docs, "leaks")
            shared.destroy()
            if before is not None:
                forget(before)
            before = docs
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **how) -> DataFrame:
    """doc_id, contaminated, leaks of each row of ``docs``; see ``with_leaks``. Other columns aren't read."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, block_chars=block_chars, **how)
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), "leaks")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
