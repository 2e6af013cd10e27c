"""SimHash near-duplicate detection with multi-index hashing.

A document's fingerprint has a bit where more than half of its shingles' hashes have it. Fingerprints within two
bits of each other link. Equal ones are one class, so only different ones are compared. They are cut into two
segments of 32 bits, each with a table of its own; of a linked pair one of these holds:

* the upper segments differ in one bit at most. A look-up of the upper segment's ball of radius one finds the
  partner: the segment as it is, and with each of its zeros set (the other direction finds what a cleared bit would);
* the lower segments are equal, and the lower table finds the partner by them.

Whole distances decide among what the tables return. A table's bucket in which more than ``BUCKET`` fingerprints
meet isn't compared pair by pair. Its fingerprints take the ball of radius one around all 64 bits instead: two
within two bits share a key there, at most 65 fingerprints share any key, and all of those lie within two bits of
each other, so that a link to the least of them is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, slots, stored, table
from .components import connected_components
from .words import words

WORDS = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer; the tables are made for two.
APART = 2
#: Fingerprints that are compared pair by pair in one bucket.
BUCKET = 128
_HALF = np.uint64(32)
_LOW = np.uint64(2**32 - 1)


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each shingle of three lower-cased words (A-Z only), repeats included; of the whole sequence if it is
    shorter."""
    found = words(text, lower=True)
    if not found:
        return np.zeros(0, np.uint64)
    width = min(WORDS, len(found))
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1].tolist()
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit number; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [fingerprint(shingle_hashes(t)) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "bits": np.array(found, np.int64)})


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, own, bits: each fingerprint's place in the two tables (own) and its look-ups in the upper one. Keys of the
    lower table are 2**32 and more."""
    for batch in batches:
        bits = batch["bits"].to_numpy(np.int64)
        whole = bits.view(np.uint64)
        upper = (whole >> _HALF).astype(np.int64)
        lower = (whole & _LOW).astype(np.int64) + 2**32
        keys, owners, own = [upper, lower], [bits, bits], [np.ones(2 * len(bits), bool)]
        for b in range(32):
            zero = upper >> b & 1 == 0
            keys.append(upper[zero] | 1 << b)
            owners.append(bits[zero])
            own.append(np.zeros(len(keys[-1]), bool))
        yield pd.DataFrame({"key": np.concatenate(keys), "own": np.concatenate(own), "bits": np.concatenate(owners)})


def _bucket_links(x: pd.DataFrame, work_most: int = 500_000) -> pd.DataFrame:
    """Of whole buckets in a row, each with its table entries first: the pairs of an entry with a later one or with a
    look-up that differ in few bits."""
    key, own, bits = x["key"].to_numpy(), x["own"].to_numpy(bool), x["bits"].to_numpy(np.int64).view(np.uint64)
    end = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(x))
    rows = np.flatnonzero(own)
    later = end[np.searchsorted(end, rows, side="right")] - rows - 1
    work, found, lo = np.cumsum(later), [], 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + work_most)))
        many = later[lo:hi]
        i = np.repeat(rows[lo:hi], many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
        near = np.bitwise_count(bits[i] ^ bits[j]) <= APART
        found.append(np.column_stack((bits[i[near]], bits[j[near]])).view(np.int64))
        lo = hi
    return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), np.int64), columns=["a", "b"])


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_bucket_links`` over a sorted partition; a bucket that goes on in the next batch waits for it."""
    rest = None
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        if len(x):
            last = x["key"] == x["key"].iat[-1]
            done, rest = x[~last], x[last]
            if len(done):
                yield _bucket_links(done)
    if rest is not None and len(rest):
        yield _bucket_links(rest)


def _balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, bits: the ball of radius one around each whole fingerprint."""
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        bits = batch["bits"].to_numpy(np.int64)
        yield pd.DataFrame({"key": (bits.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64), "bits": np.repeat(bits, 65)})


def fingerprint_links(different: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links whose components are those of all pairs of ``different`` (bits) within two bits; stored.

    All pairs are there that meet in buckets of at most ``bucket``; of the others, each one's link to the least of
    every ball it is in."""
    entries = different.select("bits").mapInPandas(_entries, "key long, own boolean, bits long")
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("met")).where("n > 1 and met").select("key", "n")
    shared = stored(shared, "buckets")
    members = stored(entries.join(shared, "key"), "members")
    small = members.where(F.col("n") <= bucket).select("key", "own", "bits")
    dealt = small.repartition(slots(small.sparkSession), "key").sortWithinPartitions("key", F.desc("own"))
    pairs = dealt.mapInPandas(_compared, "a long, b long")
    crowd = members.where(F.col("n") > bucket).select("bits").distinct().mapInPandas(_balls, "key long, bits long")
    balls = crowd.groupBy("key").agg(F.min("bits").alias("a"), F.collect_list("bits").alias("all")).where(F.size("all") > 1)
    stars = balls.select("a", F.explode("all").alias("b")).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= APART))
    links = stored(pairs.union(stars).distinct(), "links")
    forget(members, shared)
    return links


def simhash_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id of each row.

    Shingles are three words of the text, lower-cased in A-Z only; a shorter text's is its whole word sequence. Null,
    empty and blank texts have fingerprint zero, which links like any other. Rows with the same doc_id are one node, which
    links by each of its fingerprints. A row without doc_id has its fingerprint, no component, and links with nothing.
    Ties: a bit that exactly half of the hashes have is zero. Columns other than doc_id and text aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInPandas(_fingerprints, "doc_id long, bits long"), "fingerprints")
    known = signed.where("doc_id is not null")
    first = stored(known.groupBy("bits").agg(F.min("doc_id").alias("first")), "classes")
    links = fingerprint_links(first, bucket)
    several = known.groupBy("doc_id").agg(F.min("bits").alias("a"), F.max("bits").alias("most")).where("a < most").select("doc_id", "a")
    same = known.join(several, "doc_id").where("bits <> a").select("a", F.col("bits").alias("b"))
    labels = connected_components(links.union(same)).withColumnRenamed("node", "bits")
    forget(links)
    least = labels.join(first, "bits").groupBy("component").agg(F.min("first").alias("least"))
    named = first.join(labels.join(least, "component").select("bits", "least"), "bits", "left")
    named = stored(named.select("bits", F.coalesce("least", "first").alias("least")), "components")
    forget(first)
    found = signed.join(named, "bits", "left")
    hexed = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return found.select("doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))
