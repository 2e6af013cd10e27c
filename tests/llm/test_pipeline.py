"""The pipeline: each stage against what its operator says of its own input, and the last stage against the library."""

import zlib

import numpy as np
from pyspark.sql import functions as F
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import decontaminate as dc

from .cases import ROWS, documents
from .test_texts import brute_components, words


def test_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, dc.normal(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, data).persist()
        assert docs.columns == columns
        kept[name] = (before, docs.collect())
        assert {r.doc_id for r in kept[name][1]} <= {r.doc_id for r in before}
    before, after = kept["language ID"]
    assert len(after) >= 0.99 * sum(any(map(str.isalpha, r.text or "")) for r in before)
    before, after = kept["MinHash near-dedup"]
    assert {r.doc_id for r in after} == {d for d, _, _, k in brute_components([(r.doc_id, r.text) for r in before], 80) if k}
    before, after = kept["benchmark decontamination"]
    left = {r.doc_id for r in after}
    assert all((r.doc_id in left) != any(t in dc.normal(r.text) for _, t in items) for r in before)
    before, after = kept["mixing sources to target weights"]
    assert 0 < len(after) < len(before)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(after, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()) == want


def test_stages_on_odd_rows(spark, data):
    for rows in (ROWS, []):
        docs = documents(spark, rows).withColumns({"a.b": F.lit("x"), "a`b": F.lit("x"), "_": F.lit("x")})
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data).persist()
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()


def test_rows_of_one_document(spark, data):
    """Different texts of one doc_id stay, equal ones once, in the row whose other columns come first."""
    rows = [(7, "one text", "en", "b", 2), (7, "one text", "en", "a", 1), (7, "another", "en", "b", 1), (8, "one text", "en", "a", 1), (9, None, None, None, None), (9, None, None, None, None)]
    rows += [(None, "one text", "en", "a", 1)] * 2
    found = corpus_pipeline.near_dedup(spark, documents(spark, rows), data)
    assert found.columns == documents(spark, rows).columns
    kept = sorted(((r.doc_id, r.text, r.source) for r in found.collect()), key=repr)
    assert kept == sorted([(7, "one text", "a"), (7, "another", "b"), (9, None, None), *[(None, "one text", "a")] * 2], key=repr)


def test_near_copies_at_08_go(spark, data):
    """The near-dedup stage against brute force at a similarity of 0.8, which leaves fewer rows than 0.85."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := words(r.text, True)) else set() for r in docs.collect()}
    kept = {}
    for percent in (80, 85):
        root = {d: d for d in sets}
        pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        for _ in pairs:
            before = dict(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        kept[percent] = {d for d, c in root.items() if d == c}
    found = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()]
    assert sorted(found) == sorted(kept[80]) and kept[80] < kept[85]
