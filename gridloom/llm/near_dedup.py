"""MinHash near-duplicate detection with odd sketches.

Documents are sets of five-word shingles. Equal sets become one class. Each class has 40 band keys of 6
MinHash values, and an odd sketch: the samples of 4,096 one-permutation MinHash bins, each flipping one bit of
a 2,048-bit map. The population count of two maps' XOR tells how many samples differ, most precisely where
few do, so candidates that share a band are dropped by it before full sets are compared.

A band group is never expanded into its pairs. First each member is compared with the least member, which
links large groups of near copies in as many comparisons as they have members. What is then still in
different components is compared further: first each member with its best partner of another component, then
all that the sketches leave, group members in blocks. Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, slots, stored, table
from .components import connected_components, joined_components
from .words import WordHashes, mixed, window_hashes, words

WORDS = 5
#: Links, unless told otherwise: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair at similarity s is missed by all bands with probability (1 - s ** 6) ** 40: 6e-9 at 0.85, 5e-6 at 0.8.
BANDS, ROWS = 40, 6
BINS = 4096
BITS = 2048
#: Members of a band group that are compared in one task: two chunks.
CHUNK = 1024
_SIG = "doc_id long, n_shingles long, digest binary, bands binary, sketch binary"

_FACTORS = (mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@cache
def _hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if it is shorter."""
    found = words(text, lower=True)
    if not found:
        return np.zeros(0, np.uint64)
    width = min(WORDS, len(found))
    return np.unique(mixed(window_hashes(_hashes().of(found), width) + np.uint64(width)))


def minhashes(items: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minimal products of the items' upper halves with odd factors."""
    low = np.full(len(_FACTORS), 2**32 - 1, np.uint32)
    upper = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 4096):
        np.minimum(low, (upper[at : at + 4096, None] * _FACTORS).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r] + np.uint64(1))
    return key


def odd_sketch(items: np.ndarray) -> np.ndarray:
    """The parity bitmap of the one-permutation MinHash samples of the items, as bytes."""
    again = mixed(items ^ np.uint64(0x5851F42D4C957F2D))
    bins = (again % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((again, bins))
    first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
    samples = mixed(again[order][first])
    flips = np.bincount((samples % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8))


def most_flips(n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest XOR population count that a pair of sets of these sizes at the threshold has, but for six
    standard deviations of sampling and folding together."""
    j = percent / 100
    union = (n_a + n_b) / (1 + j)
    full = lambda n: BINS * -np.expm1(-n / BINS)  # noqa: E731  bins with samples
    bins = full(union)
    apart = np.maximum(full(n_a) + full(n_b) - 2 * j * bins, 0)
    stay = np.exp(-2 * apart / BITS)
    sampling = 4 * j * (1 - j) * bins * np.maximum(1 - bins / union, 0.01) * stay**2
    folding = np.maximum(BITS / 4 * (1 - stay**2) - apart * stay**2, 0)
    return BITS / 2 * (1 - stay) + 6 * np.sqrt(sampling + folding) + 1


def could_link(n_a, n_b, flips, percent: int = PERCENT) -> np.ndarray:
    """Whether sizes and sketches leave a link possible."""
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (flips <= most_flips(n_a, n_b, percent))


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            s = shingles(text)
            if len(s):
                rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(minhashes(s)).tobytes(), odd_sketch(s).tobytes()))
            else:
                rows.append((doc, 0, None, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "bands", "sketch"]).astype({"doc_id": "Int64"})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = [np.frombuffer(b, np.int64) for b in batch["bands"]]
        if keys:
            yield pd.DataFrame({"key": np.concatenate(keys), "id": np.repeat(batch["id"].to_numpy(np.int64), BANDS)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "items": [shingles(t).tobytes() for t in batch["text"]]})


def _flips(percent: int):
    """Pairs (a, b) that sizes and sketches leave."""

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                one, two = (np.frombuffer(b"".join(x[k]), np.uint64).reshape(len(x), -1) for k in ("sketch_a", "sketch_b"))
                ok = could_link(x["n_a"], x["n_b"], np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64), percent)
                yield x.loc[ok, ["a", "b"]]

    return left


def _confirmed(percent: int):
    """Of pairs with both sets, those that link."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ok = []
            for s, t in zip(x["items_a"], x["items_b"], strict=True):
                one, two = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = np.concatenate((one, two))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield x.loc[np.array(ok, bool), [c for c in x.columns if c not in ("items_a", "items_b")]]

    return linked


def _pairs_of(x: pd.DataFrame, all_pairs: bool, percent: int) -> pd.DataFrame:
    """Of whole blocks of band groups, in a row: pairs of different components, with these, which sketches leave. A pair
    counts only in the group of its first common band. Else than with ``all_pairs``, each member's best is enough."""
    n, comp, ids, chunk, key, block, chunks = (x[k].to_numpy(np.int64) for k in ("n_shingles", "component", "id", "chunk", "key", "block", "chunks"))
    sketch = np.frombuffer(b"".join(x["sketch"]), np.uint64).reshape(len(x), -1)
    bands = np.frombuffer(b"".join(x["bands"]), np.int64).reshape(len(x), -1)
    band = (bands == key[:, None]).argmax(axis=1)
    crossing = block // chunks != block % chunks  # of two chunks: only pairs across, each chunk has a block of its own
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(x)))
    start, partners = np.repeat(first, size), np.repeat(size, size)
    work = np.cumsum(partners)
    found, lo = [], 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + 200_000)))
        i = np.repeat(np.arange(lo, hi), partners[lo:hi])
        j = np.arange(len(i)) - np.repeat(np.cumsum(partners[lo:hi]) - partners[lo:hi], partners[lo:hi]) + start[i]
        ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        ok &= ~crossing[i] | (chunk[i] != chunk[j])
        if all_pairs:
            ok &= i < j
        i, j = i[ok], j[ok]
        flips = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        ok = flips <= most_flips(n[i].astype(float), n[j].astype(float), percent)
        i, j, flips = i[ok], j[ok], flips[ok]
        ok = (bands[i] == bands[j]).argmax(axis=1) == band[i]
        i, j, flips = i[ok], j[ok], flips[ok]
        if not all_pairs and len(i):
            order = np.lexsort((flips, i))
            best = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
            i, j = i[best], j[best]
        i, j = np.where(ids[i] < ids[j], (i, j), (j, i))
        found.append(np.column_stack((ids[i], ids[j], comp[i], comp[j])))
        lo = hi
    pairs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return pd.DataFrame(pairs, columns=["a", "b", "component_a", "component_b"], dtype="int64")


def _compare(all_pairs: bool, percent: int):
    """``_pairs_of`` over a partition that is sorted by block: a block that goes on in the next batch waits."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            if not len(x):
                continue
            last = (x["key"] == x["key"].iat[-1]) & (x["block"] == x["block"].iat[-1])
            done, rest = x[~last], x[last]
            if len(done):
                yield _pairs_of(done, all_pairs, percent)
        if rest is not None and len(rest):
            yield _pairs_of(rest, all_pairs, percent)

    return compare


class _Classes:
    """The classes of equal sets, the members of their band groups, and the sets of those that have company."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.docs = stored(rows.mapInPandas(_signatures, _SIG), "signatures")
        real = self.docs.where("doc_id is not null and n_shingles > 0")
        self.first = stored(real.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
        signed = real.join(self.first, (real["doc_id"] == self.first["id"]) & (real["digest"] == self.first["digest"]), "left_semi")
        self.signed = stored(signed.select(F.col("doc_id").alias("id"), "n_shingles", "digest", "bands", "sketch").dropDuplicates(["id", "digest"]), "signed")
        keys = self.signed.mapInPandas(_keys, "key long, id long")
        groups = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
        self.members = stored(keys.join(groups, "key"), "members")
        near = self.members.select("id").distinct()
        text = rows.join(near.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
        self.sets = stored(text.mapInPandas(_sets, "id long, items binary"), "sets")

    def with_both(self, pairs: DataFrame, frame: DataFrame, names: dict[str, str]) -> DataFrame:
        """``pairs`` (a, b) with columns of ``frame`` (id, ...) for both."""
        for end in ("a", "b"):
            side = frame.select(F.col("id").alias(end), *(F.col(k).alias(f"{v}_{end}") for k, v in names.items()))
            pairs = pairs.join(side, end)
        return pairs

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs, those that link by their full sets."""
        columns = ", ".join(f"{c} long" for c in pairs.columns)
        both = self.with_both(pairs, self.sets, {"items": "items"}).select(*pairs.columns, "items_a", "items_b")
        return stored(both.mapInPandas(_confirmed(self.percent), columns), "links")

    def star_links(self) -> DataFrame:
        """a, b: links of members of band groups with the least member."""
        pairs = self.members.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        sketched = self.with_both(pairs, self.signed, {"n_shingles": "n", "sketch": "sketch"})
        return self.links(sketched.mapInPandas(_flips(self.percent), "a long, b long"))

    def rest_pairs(self, labels: DataFrame, all_pairs: bool) -> DataFrame:
        """a, b, component_a, component_b: candidates among members of one band group that have different labels (node,
        component) so far."""
        named = self.members.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed_groups = named.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
        inside = named.join(mixed_groups, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        pair_of = lambda c: F.least("chunk", c) * F.col("chunks") + F.greatest("chunk", c)
        dealt = inside.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), pair_of)))
        sides = self.signed.select("id", "n_shingles", "bands", "sketch")
        ready = dealt.join(sides, "id").select("key", F.col("block").cast("long").alias("block"), "id", "chunk", "chunks", "component", "n_shingles", "bands", "sketch")
        sorted_blocks = ready.repartition(slots(ready.sparkSession), "key", "block").sortWithinPartitions("key", "block")
        found = sorted_blocks.mapInPandas(_compare(all_pairs, self.percent), "a long, b long, component_a long, component_b long")
        return stored(found.distinct(), "pairs")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Documents link where the sets of five-word shingles of their lower-cased words (A-Z only) have
    100 * intersection >= percent * union; a shorter text's set is its whole word sequence. Null, empty and blank
    texts have empty sets, link with nothing and are their own component. Rows with the same doc_id are one
    node. A null doc_id has no component and is kept. Columns other than doc_id and text aren't read.
    """
    classes = _Classes(docs, percent)
    links = classes.star_links()
    labels = connected_components(links)
    forget(links)
    for all_pairs in (False, True):
        pairs = classes.rest_pairs(labels, all_pairs)
        if pairs.isEmpty():
            break
        links = classes.links(pairs)
        labels = joined_components(labels, links.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
        forget(pairs, links)
    forget(classes.members, classes.sets, classes.signed)
    of_class = classes.first.join(labels.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    found = classes.docs.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
