"""Grouping of spelling variants by a dictionary of trie-node pairs.

All words stand in a forward trie and, read from their ends, in a reversed one; the nodes of both are numbered. A
word cut at place i is the pair (node of its first i letters, node of the rest); with the letter at i skipped it is
the pair (node of the first i letters, node of what follows that letter). Equal pairs are equal letters, so:

* words that share a skipped pair differ by one replaced letter;
* a word whose cut pair is another's skipped pair lacks just that letter.

A pair is thus shared by the words with another letter at one place, and one that lacks it, so its group is bounded
by the alphabet. Nodes of up to seven letters are numbered by their letters. Deeper ones are numbered as sorted words
stream by, those of the same first seven letters in one task, which holds the nodes of one word at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, slots, stored, table

#: A crc32 that this divides has a letter deleted.
DAMAGED = 31
#: Words have so many letters and occurrences at least.
LETTERS, OCCURRENCES = 7, 2
#: A form occurs so many times as often as its variant.
TIMES = 10
#: Nodes up to this depth are numbered by their letters, of eight bits each.
SHALLOW = 7
#: Distinct words counted by a task before it hands its counts on.
COUNTED = 200_000
#: Letters in Latin-1, A-Z in lower case; the rest blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z in lower case."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def word_of(start: int, run: bytes) -> bytes:
    """The word that a run stands for; ``start`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter[bytes] = Counter()

    def told() -> pd.DataFrame:
        words = pd.Series([w.decode("latin-1") for w in total], dtype=object)
        return pd.DataFrame({"word": words, "n": np.fromiter(total.values(), np.int64, len(total))})

    for batch in batches:
        for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
            start = zlib.crc32(f"{'' if doc is pd.NA else doc}:".encode())
            for run, n in Counter(runs(text)).items():
                if len(run) >= LETTERS and len(word := word_of(start, run)) >= LETTERS:
                    total[word] += n
            if len(total) > COUNTED:
                yield told()
                total.clear()
    yield told()


def word_counts(docs: DataFrame) -> DataFrame:
    """id, word, n of the words of all texts; ids ascend with the words' code points. Stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)
    counted = stored(counted, "counts")
    in_order = counted.repartitionByRange(slots(docs.sparkSession), "word").sortWithinPartitions("word")
    out = stored(in_order.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    forget(counted)
    return out


class Nodes:
    """Numbers the nodes of a trie while its words come in order; gives the numbers on each word's path."""

    def __init__(self, part: int):
        self.next = -1 - (part << 40)
        self.word, self.path = b"", [0]

    def of(self, word: bytes) -> list[int]:
        """Of depths 0 to the word's length. Shallow nodes have positive numbers, deep ones negative."""
        same, most = 0, min(len(word), len(self.word))
        if self.word[:most] == word[:most]:
            same = most
        else:
            while self.word[same] == word[same]:
                same += 1
        path = self.path[: same + 1]
        for depth in range(same + 1, len(word) + 1):
            if depth <= SHALLOW:
                path.append(path[-1] << 8 | word[depth - 1])
            else:
                path.append(self.next)
                self.next -= 1
        self.word, self.path = word, path
        return path


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    nodes = Nodes(TaskContext.get().partitionId())
    for batch in batches:
        paths = [np.array(nodes.of(w.encode("latin-1")), np.int64).tobytes() for w in batch["word"]]
        yield pd.DataFrame({"id": batch["id"], "word": batch["word"], "n": batch["n"], "path": paths})


def _pairs(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """prefix, suffix, kind, id, n of each word's pairs. Kinds: 0 is cut, 1 skips the first letter of a run of equal
    ones, 2 skips a later one of it (the same letters remain, so it tells replacements only)."""
    nodes = Nodes(TaskContext.get().partitionId())
    for batch in batches:
        found, size = [], 0

        def told() -> pd.DataFrame:
            prefix, suffix, kind, ids, n, many = (np.concatenate(x) for x in zip(*found, strict=True))
            return pd.DataFrame({"prefix": prefix, "suffix": suffix, "kind": kind, "id": np.repeat(ids, many), "n": np.repeat(n, many)})

        for i, word, n, path in zip(batch["id"].tolist(), batch["word"], batch["n"].tolist(), batch["path"], strict=True):
            letters = word.encode("latin-1")
            before = np.frombuffer(path, np.int64)
            after = np.array(nodes.of(letters[::-1]), np.int64)[::-1]
            one = np.frombuffer(letters, np.uint8)
            kind = np.zeros(2 * len(one) + 1, np.int8)
            kind[len(one) + 1 :] = 1 + np.append(False, one[1:] == one[:-1])
            found.append((np.concatenate((before, before[:-1])), np.concatenate((after, after[1:])), kind, np.array([i]), np.array([n]), np.array([len(kind)])))
            size += len(kind)
            if size >= most:
                yield told()
                found, size = [], 0
        if found:
            yield told()


def _met(x: pd.DataFrame) -> pd.DataFrame:
    """id, other, other_n: both ways, the near words that meet in whole groups of equal pairs in a row."""
    prefix, suffix, kind, ids, n = (x[k].to_numpy() for k in ("prefix", "suffix", "kind", "id", "n"))
    first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1]))))
    size = np.diff(np.append(first, len(x)))
    many = np.repeat(first + size - 1, size) - np.arange(len(x))
    i = np.repeat(np.arange(len(x)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
    low, high = np.minimum(kind[i], kind[j]), np.maximum(kind[i], kind[j])
    near = (low > 0) | (high == 1)
    i, j = i[near], j[near]
    return pd.DataFrame({"id": np.concatenate((ids[i], ids[j])), "other": np.concatenate((ids[j], ids[i])), "other_n": np.concatenate((n[j], n[i]))})


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_met`` over a partition sorted by pair; a pair that goes on in the next batch waits for it."""
    rest = None
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        if len(x):
            last = (x["prefix"] == x["prefix"].iat[-1]) & (x["suffix"] == x["suffix"].iat[-1])
            done, rest = x[~last], x[last]
            if len(done):
                yield _met(done)
    if rest is not None and len(rest):
        yield _met(rest)


def near_words(words: DataFrame) -> DataFrame:
    """id, other, other_n: each word (id, word, n) with each that differs by one inserted, deleted or replaced letter."""
    n = slots(words.sparkSession)
    ahead = words.repartition(n, F.substring("word", 1, SHALLOW)).sortWithinPartitions("word")
    ahead = ahead.mapInPandas(_forward, "id long, word string, n long, path binary")
    back = ahead.withColumn("back", F.reverse("word")).repartition(n, F.substring("back", 1, SHALLOW)).sortWithinPartitions("back")
    pairs = back.select("id", "word", "n", "path").mapInPandas(_pairs, "prefix long, suffix long, kind byte, id long, n long")
    dealt = pairs.repartition(n, "prefix", "suffix").sortWithinPartitions("prefix", "suffix")
    return dealt.mapInPandas(_meetings, "id long, other long, other_n long")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts.

    Words, their damage by crc32, nearness and forms are the contract's. Null texts have no words; a text without doc_id
    is hashed as if its doc_id were empty text. Every row counts, repeated ones too. Of near words that occur equally
    often the first in code-point order is the form. A word that has no form is its own root. Only doc_id and text are
    read. Steps to the root are at least tenfold in n, so roots are found by a few rounds that each double the steps.
    """
    words = word_counts(docs)
    near = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("other_n", (-F.col("other")).alias("minus"))).alias("best"))
    near = near.select("id", "n_near", F.col("best.other_n").alias("form_n"), (-F.col("best.minus")).alias("form"))
    known = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("form_n") >= TIMES * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")))
    known = stored(known, "forms")
    forget(words)
    steps = stored(known.where("form is not null").select("id", F.col("form").alias("root")), "steps")
    while True:
        beyond = steps.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        further = stored(steps.join(beyond, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "steps")
        forget(steps)
        steps = further
        if steps.where("moved").isEmpty():
            break
        steps = further.select("id", "root")
        steps.stored_at = further.stored_at
    names = known.select("id", "word")
    formed = known.join(names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form", "left").join(steps.select("id", "root"), "id", "left")
    rooted = formed.join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root", "left")
    return rooted.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE places AS (SELECT unnest(range(256))::BIGINT AS b),
crc_steps AS (
    SELECT b, 0 AS step, b AS c FROM places
    UNION ALL
    SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE step < 8),
crc AS MATERIALIZED (SELECT b, c FROM crc_steps WHERE step = 8),
found AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents),
counted AS MATERIALIZED (
    SELECT run, coalesce(doc_id::VARCHAR, '') AS doc, count(*)::BIGINT AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes
    FROM found WHERE length(run) >= 7 GROUP BY run, doc_id),
hashed AS (
    SELECT run, doc, k, bytes, 1 AS pos, 4294967295::BIGINT AS h FROM counted
    UNION ALL
    SELECT run, doc, k, bytes, pos + 2, xor(c, h >> 8)
    FROM hashed JOIN crc ON b = xor(h & 255, ('0x' || substr(bytes, pos, 2))::BIGINT) WHERE pos < length(bytes)),
ends AS (SELECT run, k, xor(h, 4294967295) AS h FROM hashed WHERE pos > length(bytes)),
forms AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k
    FROM ends),
words AS MATERIALIZED (
    SELECT word, sum(k)::BIGINT AS n FROM forms WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
    SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y USING (a, z) WHERE x.word <> y.word
    UNION SELECT x.word, w.word, w.n FROM cuts x JOIN words w ON w.word = x.a || x.z
    UNION SELECT w.word, x.word, x.n FROM cuts x JOIN words w ON w.word = x.a || x.z),
best AS (
    SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
    FROM near GROUP BY word),
formed AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
        CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
climb AS (
    SELECT word, word AS top, form AS next FROM formed
    UNION ALL SELECT c.word, f.word, f.form FROM climb c JOIN formed f ON f.word = c.next)
SELECT word, form, top AS root, n, n_near, form_n FROM formed JOIN (SELECT word, top FROM climb WHERE next IS NULL) USING (word)
"""
