"""Token counts by rank-synchronous array merging.

Pre-tokens lie one after another in numpy arrays. In each round every pre-token merges all places of its
lowest-ranked pair at the same time; a pre-token without a mergeable pair leaves the arrays, and the
symbols that it has left are its count. Pre-tokens repeat, so each worker remembers their counts in a
bounded table and merges only those that it has not met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table
from .pretokens import PreTokenMemory, byte_letters, load

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
_NONE = np.int64(1) << 40


class RankMerger:
    """The merge table of a byte-level BPE vocabulary, applied to many pre-tokens at once."""

    def __init__(self, data: dict):
        vocab = data["model"]["vocab"]
        self.of_byte = np.array([vocab[x] for x in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Symbols that each of ``words`` has after all merges."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out, alive = sizes.copy(), np.flatnonzero(sizes > 1)
        if not len(alive):
            return out
        token = self.of_byte[np.frombuffer(b"".join(raw[k] for k in alive), np.uint8)]
        size = sizes[alive]
        rank = self._pair_ranks(token, size)
        while len(alive):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            out[alive] = size
            live = low < _NONE
            if not live.all():
                keep = np.repeat(live, size)
                token, rank, size, alive, low = token[keep], rank[keep], size[live], alive[live], low[live]
                if not len(alive):
                    break
            hit = rank == np.repeat(low, size)
            places = np.flatnonzero(hit)
            after = np.concatenate(([False], places[1:] == places[:-1] + 1))
            if after.any():  # as in a a a: of places that overlap, the first, third, ... merge
                run = np.maximum.accumulate(np.where(after, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            token[places] = self.merged[rank[places]]
            seq = np.repeat(np.arange(len(size)), size)
            keep = np.ones(len(token), bool)
            keep[places + 1] = False
            size = size - np.bincount(seq[places], minlength=len(size))
            moved = places - np.arange(len(places))  # where the merged symbols are now
            token, rank = token[keep], rank[keep]
            last = np.zeros(len(token), bool)
            last[np.cumsum(size) - 1] = True
            near = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            rank[near[last[near]]] = _NONE
            near = near[~last[near]]
            rank[near] = self.ranks(token[near], token[near + 1])
        return out

    def _pair_ranks(self, token: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.full(len(token), _NONE)
        rank[:-1] = self.ranks(token[:-1], token[1:])
        rank[np.cumsum(size) - 1] = _NONE
        return rank


@cache
def _memory(vocabulary: str) -> PreTokenMemory:
    """One per Python worker."""
    data = load(vocabulary)
    merger = RankMerger(data)
    return PreTokenMemory(data, lambda words: (merger.counts(words), None))


def token_counter(vocabulary: str = VOCABULARY) -> Callable:
    """A column function: tokens of a text (null: 0)."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = _memory(vocabulary)
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [memory.counts(texts[a:b]) for a, b in pieces(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return n_tokens


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are each returned, null ids stay null,
    other columns are not read, so that their names can't clash. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_counter(vocabulary)(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
