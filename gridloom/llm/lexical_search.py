"""Ranked lexical search of many documents for a set of items, by bag deduplication.

Documents are restricted to the items' vocabulary: a document is then its bag of (term, occurrences) and its length
norm m. Those alone make its score, so documents with identical bags and m are one class. Classes are grouped by a
hash of the bag and m and by the bag itself, which verifies them. Each class is scored once against all items, and
keeps its ten smallest doc_ids: no further one can be among an item's first ten. Each task leaves ten classes an
item, and these are expanded to their members in ascending order.

Items are taken in blocks of bounded size, whose vocabulary and weights are broadcast; for a block, N, L and the
document frequencies are counted over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, stored, table

#: Documents returned for an item.
TOP = 10
#: Characters of items in one block; a block's vocabulary and postings are broadcast and its frequencies collected.
BLOCK_CHARS = 1_000_000
#: A-Z in lower case, other ASCII letters, digits and all bytes from 0x80 as they are, the rest blank.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text with repeats: maximal runs of ASCII letters, digits and all code points from U+0080."""
    return (text or "").encode().translate(_TERMS).split()


class Block:
    """Some items: their ids, their vocabulary, and for each term the items that hold it."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        held = [sorted(set(terms(t))) for t in texts]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for h in held for t in h}))}
        pairs = sorted((self.vocabulary[t], i) for i, h in enumerate(held) for t in h)
        self.items = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.vocabulary) + 1))
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, n_docs: int, frequencies: dict[int, int]) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequencies.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The items in blocks of about ``block_chars`` characters, one at a time on the driver."""
    rows = items.where("text is not null").select("item_id", "text")
    n = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    for k in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if some:
            yield Block([r[0] for r in some], [r[1] for r in some])


def _bags(shared):
    """doc_id, n, bag of each document with terms; the bag is ascending (term number, occurrences) as int32 pairs."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value.vocabulary
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                found = terms(text)
                if found:
                    counts = Counter(found)
                    bag = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                    rows.append((doc, len(found), np.array(bag, "<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "bag"]).astype({"doc_id": "Int64"})

    return of


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """term, df: in how many of the task's bags each term is."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(np.frombuffer(b"".join(batch["bag"]), "<i4")[::2], minlength=len(total))
        found[: len(total)] += total
        total = found
    there = np.flatnonzero(total)
    yield pd.DataFrame({"term": there.astype(np.int64), "df": total[there].astype(np.int64)})


class _Best:
    """The best ``TOP`` rows of each item so far: highest score first, then least doc_id."""

    def __init__(self, n_items: int):
        self.rows = pd.DataFrame({"item": pd.Series(dtype=np.int64), "score": pd.Series(dtype=np.int64), "first": pd.Series(dtype=np.int64), "ids": pd.Series(dtype=object)})
        self.bar = np.ones(n_items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: list[np.ndarray]) -> None:
        new = pd.DataFrame({"item": item, "score": score, "first": np.array([i[0] for i in ids], np.int64), "ids": pd.Series(ids, dtype=object)})
        both = pd.concat([self.rows, new], ignore_index=True) if len(self.rows) else new
        both = both.iloc[np.lexsort((both["first"], -both["score"], both["item"]))]
        place = both.groupby("item").cumcount()
        self.rows = both[place < TOP].reset_index(drop=True)
        full = both[place == TOP - 1]
        self.bar[full["item"].to_numpy()] = full["score"].to_numpy()


def _scores(shared, cells: int = 2_000_000):
    """item (number in the block), score, ids: the task's best classes for each item. Sums are taken in doubles, which
    hold them exactly: a term's share is below 2**35, and an item of a million terms stays below 2**53 with weights as
    they are (at most 1000 ln N)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        n_items = len(block.ids)
        best = _Best(n_items)
        for batch in batches:
            if not len(batch):
                continue
            flat = [np.frombuffer(b, "<i4").reshape(-1, 2).astype(np.int64) for b in batch["bag"]]
            size = np.array([len(f) for f in flat], np.int64)
            all_terms = np.concatenate(flat)
            term, tf = all_terms[:, 0], all_terms[:, 1]
            value = block.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(batch["m"].to_numpy(np.int64), size)))
            held = block.first[term + 1] - block.first[term]
            ends = np.cumsum(size)
            work = np.concatenate(([0], np.cumsum(held)))[ends] + n_items * np.arange(1, len(batch) + 1)
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + cells)))
                a, b = ends[lo] - size[lo], ends[hi - 1]
                many = held[a:b]
                item = block.items[np.repeat(block.first[term[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                row = np.repeat(np.repeat(np.arange(hi - lo), size[lo:hi]), many)
                sums = np.bincount(row * n_items + item, np.repeat(value[a:b], many), (hi - lo) * n_items).astype(np.int64)
                cell = np.flatnonzero(sums >= np.tile(best.bar, hi - lo))
                if len(cell):
                    best.add(cell % n_items, sums[cell], [batch["ids"].iat[lo + k] for k in (cell // n_items).tolist()])
                lo = hi
        yield best.rows[["item", "score", "ids"]]

    return of


def _of_block(docs: DataFrame, block: Block) -> DataFrame:
    """item_id, rank, doc_id, score for one block's items; stored."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(block)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bags = stored(rows.mapInPandas(_bags(shared), "doc_id long, n long, bag binary"), "bags")
    n_docs, length = bags.agg(F.count("*"), F.sum("n")).first()
    found = bags.mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    block.weigh(n_docs, {r.term: r.df for r in found.collect()})
    weighed = context.broadcast(block)

    m = F.expr(f"10 + (cast(90 * cast(n as decimal(20,0)) * cast({n_docs} as decimal(13,0)) as decimal(38,0)) div {length or 1})").cast("long")
    real = bags.where((F.length("bag") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "bag", m.alias("m"))
    real = real.withColumn("hash", F.xxhash64("bag", "m"))
    members = Window.partitionBy("hash", "m", "bag").orderBy("doc_id")
    least = real.withColumn("place", F.row_number().over(members)).where(F.col("place") <= TOP)
    classes = least.groupBy("hash", "m", "bag").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    scored = classes.select("m", "bag", "ids").mapInPandas(_scores(weighed), "item int, score long, ids array<long>")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = scored.select("item", "score", F.explode("ids").alias("doc_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    out = stored(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranks")
    forget(bags)
    shared.destroy()
    weighed.destroy()
    return out


def lexical_search(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of each item (item_id, text) with a score above 0.

    The score is the contract's: the sum over the item's terms, once each, of their integer weight times the saturated
    occurrences. Null and empty texts have no terms: such documents aren't counted, such items have no rows. Equal scores
    rank by ascending doc_id. Every row is a document of its own, repeated rows and repeated doc_ids too; a row without
    doc_id counts in the statistics and isn't ranked. Each row of ``items`` is ranked on its own, also where item_ids
    are repeated or null. Other columns aren't read.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, block_chars):
        out = out.union(_of_block(docs, block))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH bags AS MATERIALIZED (
    SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents),
docs AS MATERIALIZED (SELECT id, doc_id, len(terms)::BIGINT AS n FROM bags WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM docs),
asked AS MATERIALIZED (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
tf AS MATERIALIZED (
    SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(terms) AS term FROM bags)
    WHERE term IN (SELECT term FROM asked) GROUP BY id, term),
weights AS MATERIALIZED (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tf, totals GROUP BY term),
norms AS MATERIALIZED (SELECT id, doc_id, 100 - 90 + ((90 * n * n_docs) // length) AS m FROM docs, totals),
scores AS (
    SELECT item_id, id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (id) GROUP BY item_id, id, doc_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores
    WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
