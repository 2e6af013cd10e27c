"""SimHash, lexical search and spelling variants against brute force; odd rows; groups beyond the buckets' bounds."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import lexical_search as ls
from gridloom.llm import simhash as sh
from gridloom.llm import spelling as sp

from .cases import LONG, ROWS, documents

BLANKS = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


# SimHash ----------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(BLANKS, (text or "").translate(LOWER))
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    least = {n: n for n in nodes}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return {n: top(n) for n in nodes}


def test_simhash_by_brute_force(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    texts += [None, "", " \t\x0b", "a", "A", "a b", "a  b c", "Ä b c", "ä b c", LONG]
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    wanted = plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    found = sh.simhash_duplicates(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == wanted


@pytest.mark.parametrize("bucket", [2, 16, 128])
def test_links_of_crowded_fingerprints(spark, bucket):
    """Fingerprints around few centres, so that buckets of both tables are far larger than ``bucket``."""
    draw = random.Random(bucket)
    prints = set()
    for centre in (0, draw.getrandbits(64), draw.getrandbits(64)):
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5))))
        for _ in range(40):  # one half alike
            prints.add(centre ^ draw.getrandbits(32) & ~0x7)
            prints.add(centre ^ draw.getrandbits(32) << 32)
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    links = sh.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "bits long"), bucket).collect()
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(apart(r.a, r.b) <= 2 for r in links)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in links}
    assert plain_components(signed, lambda a, b: (a, b) in pairs) == plain_components(signed, lambda a, b: apart(a, b) <= 2)


def test_simhash_of_odd_rows(spark):
    found = sh.simhash_duplicates(documents(spark)).collect()
    assert len(found) == len(ROWS)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[None][0].component_id is None and by_id[None][0].fingerprint == by_id[1][0].fingerprint
    assert {r.component_id for k in (2, 3, 4) for r in by_id[k]} == {2} and by_id[2][0].fingerprint == "0" * 16
    assert by_id[8][0].component_id == by_id[9][0].component_id == 8 and [r.component_id for r in by_id[5]] == [5, 5]
    assert sh.simhash_duplicates(documents(spark, [])).collect() == []
    # a doc_id of several texts links through each of them
    rows = spark.createDataFrame([(7, "a b c"), (7, "x y z"), (3, "x y z"), (9, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in sh.simhash_duplicates(rows).collect()} == {(7, 3), (3, 3), (9, 3)}


def test_a_tied_bit_is_zero():
    assert sh.fingerprint(np.array([2**64 - 1, 0], np.uint64)) == 0
    assert sh.fingerprint(np.array([2**64 - 1, 0, 2**63], np.uint64)) == -(2**63)


# Lexical search ---------------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_ranks(docs, items):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for *_, n in counts)
    rows = []
    for item, text in items:
        asked = set(plain_terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in counts) + 1))) for t in asked}
        scored = []
        for d, c, n in counts:
            m = 10 + 90 * n * n_docs // length
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        rows += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(scored)[:10], 1)]
    return rows


def as_rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_by_brute_force_and_in_blocks(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    wanted = sorted(plain_ranks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]), key=str)
    assert as_rows(ls.lexical_search(docs, items)) == wanted
    assert as_rows(ls.lexical_search(docs, items, block_chars=2000)) == wanted


def test_search_with_copies_and_ties(spark):
    """A class of thirty members, two classes of equal score, one term in all documents, and ids that aren't in order."""
    texts = ["red apple"] * 30 + ["Apple RED!"] * 5 + ["red pear", "pear red", "blue plum", "apple apple red pear plum sky", "", None, "...", "é É œ_x9"]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    docs = list(zip(ids, texts, strict=True)) + [(ids[0], texts[0]), (None, "red apple")]
    items = [(5, "apple, red"), (6, "PEAR"), (7, "plum É"), (7, "œ x9"), (None, "sky"), (8, None), (9, ""), (10, "nothing")]
    found = ls.lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert as_rows(found) == sorted(plain_ranks(docs, items), key=str)


def test_search_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "fox dog juega w1")], "item_id long, text string")
    plain = [(d, t) for d, t, *_ in ROWS]
    assert as_rows(ls.lexical_search(documents(spark).withColumn("rank", F.lit("x")), items.withColumn("m", F.lit(1)))) == sorted(plain_ranks(plain, [(1, "fox dog juega w1")]), key=str)
    assert ls.lexical_search(documents(spark, []), items).collect() == []
    assert ls.lexical_search(documents(spark), items.where("false")).collect() == []
    assert ls.lexical_search(documents(spark), items.select("item_id", F.lit(None).cast("string").alias("text"))).collect() == []


# Spelling variants ------------------------------------------------------------------------------------------


def plain_words(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    form, rows = {}, []
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        rows.append((w, n, len(others)))
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n, k, words[form[w]] if form[w] else None) for w, n, k in rows)


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_by_brute_force(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choice("abé") for _ in range(draw.randrange(6, 10))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab", "ÀÿÖ÷×ßþ", "élèvesé"]
    docs = []
    for k in range(60):
        words = []
        for _ in range(120):
            w = draw.choice(stems[: 1 + draw.randrange(len(stems))])
            if draw.random() < 0.15:
                i = draw.randrange(len(w))
                w = draw.choice((w[:i] + w[i + 1 :], w[:i] + draw.choice("abzé") + w[i:], w[:i] + draw.choice("abzé") + w[i + 1 :]))
            words.append(draw.choice((w, w.upper())))
        docs.append((draw.choice((k, -k, None)), draw.choice((" ", ", ", "1")).join(words)))
    found = variant_rows(sp.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    wanted = plain_variants(docs)
    assert found == wanted and any(r[1] for r in wanted) and max(r[4] for r in wanted) > 3


def test_chains_of_forms_end_in_their_root(spark):
    """Each form ten times as often as its variant, four steps long."""
    chain = ["baaaaaaaa", "bbaaaaaaa", "bbbaaaaaa", "bbbbaaaaa"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(2 * 12**k))
    wanted = plain_variants([(4, text)])
    assert variant_rows(sp.spelling_variants(docs_of(spark, ["", "", "", "", text]))) == wanted
    assert {r[2] for r in wanted if r[0] in chain} == {chain[-1]}


def test_long_runs_and_odd_rows(spark):
    run = "".join(chr(97 + i * i % 25) for i in range(30_000))
    rows = [*ROWS, (20, f"{run} {run} {run[:9000]}z{run[9001:]}", None, None, 1), (21, f"{run[:9000]}z{run[9001:]} {run[1:]} {run[1:]}", None, None, 1)]
    found = {r.word: r for r in sp.spelling_variants(documents(spark, rows)).collect()}
    words = plain_words([(d, t) for d, t, *_ in rows])
    assert {w: r.n for w, r in found.items()} == words
    longs = [w for w in words if len(w) > 20_000]
    assert {w: found[w].n_near for w in longs} == {w: sum(near(w, x) for x in longs) for w in longs}
    assert sp.spelling_variants(documents(spark, [])).collect() == []
    assert sp.spelling_variants(documents(spark, [(1, None, "", "", 1)])).collect() == []


@pytest.mark.parametrize("module, name", [(ls, "op12_lexical_search"), (sp, "op13_spelling_variants")])
def test_equals_sql(spark, data, module, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    found = getattr(module, name)(spark, data)
    columns = sorted(found.columns)
    cursor = con.execute(module.ORACLE)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    mine = sorted(repr(list(r)) for r in found.select(*columns).collect())
    assert mine == sorted(repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
