"""Token-ID output: documents encoded in ascending doc_id order into files of directly addressable codes."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import filesystem, pieces, slots, table, work_dir
from .dac import Segment, encode
from .pretokens import PreTokenMemory, byte_letters, load

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: A file is closed at the first document end past so many ids.
FILE_IDS = 4_000_000
_INDEX = "part int, segment int, file string, doc_id long, n_tokens long, local_start long"


@cache
def _memory(vocabulary: str) -> PreTokenMemory:
    """One per Python worker: the tokenizers library's model encodes each new pre-token, the memory repeats it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(vocabulary)).model
    letters = dict(enumerate(byte_letters()))

    def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [model.tokenize(w.encode().decode("latin-1").translate(letters)) for w in words]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return lengths, np.fromiter((x.id for t in tokens for x in t), np.uint32, int(lengths.sum()))

    return PreTokenMemory(load(vocabulary), encoded)


class _Files:
    """Writes the segments of one task and tells where each document went."""

    def __init__(self, folder: str, part: int, limit: int):
        self.fs, self.path = filesystem(folder)
        self.folder, self.part, self.limit, self.attempt, self.segment = folder, part, limit, uuid.uuid4().hex[:12], 0
        self.empty()

    def empty(self) -> None:
        self.ids, self.docs, self.sizes, self.total = [], [], [], 0

    def add(self, ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
        """Ids of documents in a row; closes files where they are full."""
        at = 0
        ends = np.cumsum(sizes)
        while at < len(docs):
            done = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, done + self.limit - self.total)) + 1, len(docs))
            self.ids.append(ids[done : int(ends[stop - 1])])
            self.docs.append(docs[at:stop])
            self.sizes.append(sizes[at:stop])
            self.total += int(ends[stop - 1]) - done
            at = stop
            if self.total >= self.limit:
                yield self.close()

    def close(self) -> pd.DataFrame:
        docs, sizes = np.concatenate(self.docs), np.concatenate(self.sizes)
        name = f"part-{self.part:06d}-{self.segment:05d}-{self.attempt}.dac"
        with self.fs.open_output_stream(f"{self.path}/{name}") as out:
            out.write(encode(np.concatenate(self.ids), docs, sizes))
        told = pd.DataFrame({"part": np.int32(self.part), "segment": np.int32(self.segment), "file": f"{self.folder}/{name}", "doc_id": docs, "n_tokens": sizes, "local_start": np.cumsum(sizes) - sizes})
        self.segment += 1
        self.empty()
        return told


def write_token_ids(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents' ids to ``folder`` and return its index: one row per document.

    Documents are dealt by ranges of doc_id, so that files in order of (part, segment) hold them in ascending
    order. A task's files carry a name of that attempt; the index, which Spark commits, names just those of
    the attempts that count, so that lost executors and second tries leave no wrong ids. A null text is empty
    (the end id alone), a null doc_id is kept as the smallest of all ids.
    """
    spark = docs.sparkSession
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        memory, files = _memory(vocabulary), _Files(folder, TaskContext.get().partitionId(), file_ids)
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy(np.int64)
            for a, b in pieces(texts):
                tokens, sizes = memory.encoded(texts[a:b])
                ends = np.cumsum(sizes)
                yield from files.add(np.insert(tokens, ends, end_id), ids[a:b], sizes + 1)
        if files.total:
            yield files.close()

    least = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(slots(spark), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInPandas(write, _INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """part, segment, file, file_start: the ids in all files before each. Files are summed within blocks of
    parts and then over the blocks, so that no one task orders more than a block."""
    files = index.groupBy("part", "segment", "file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / 256))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = files.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start"))
    within = W.partitionBy("block").orderBy("part", "segment").rowsBetween(W.unboundedPreceding, -1)
    local = files.withColumn("in_block", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return local.join(blocks, "block").select("part", "segment", "file", (F.col("in_block") + F.col("block_start")).alias("file_start"))


def read_token_ids(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that ``index`` names."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, start in zip(batch["file"], batch["file_start"], strict=True):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    segment = Segment(f.read())
                ids = memoryview(segment.all().astype("<u4").tobytes())
                ends = segment.doc_ends
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": segment.doc_ids, "start": start + starts, "n_tokens": ends - starts, "ids_crc32": crcs})

    files = file_starts(index).select("file", "file_start").repartition(slots(index.sparkSession), "file")
    found = files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))


def tokens_at(index: DataFrame, places: DataFrame) -> DataFrame:
    """place, token for places (column ``place``) in the whole sequence, by random access into the files."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, rows in batch.groupby("file"):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    segment = Segment(f.read())
                yield pd.DataFrame({"place": rows["place"], "token": [segment.token(int(p - s)) for p, s in zip(rows["place"], rows["file_start"], strict=True)]})

    starts = index.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n")).join(file_starts(index), ["part", "segment"])
    asked = places.select("place").join(starts, (F.col("place") >= F.col("file_start")) & (F.col("place") < F.col("file_start") + F.col("n")))
    return asked.select("place", "file", "file_start").mapInPandas(look, "place long, token long")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_token_ids(table(spark, sf_dir, "documents"), work_dir(spark, "token-ids"))
    return read_token_ids(index)
