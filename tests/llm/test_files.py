"""Token counts and files, WARC archives, host reputation, mixing and media against brute force and edge cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import dac, host_reputation, media, mixing, token_counts, token_ids, warc
from gridloom.llm.common import work_dir

from .cases import ROWS, documents, pages


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(9)
    bits = ["a", "aa", "the", " ", "  ", "\n", "'s", "'LL", "1", "é", "日本", "😀", "<|endoftext|>", "<|end", "!", "…", "\t", " ", "x" * 90, "ab" * 40]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(300)]


def test_token_counts(spark, library):
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts())] + ROWS
    found = token_counts.token_counts(documents(spark, rows)).collect()
    want = sorted((str(d), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want
    assert token_counts.token_counts(documents(spark, [])).count() == 0


def test_very_long_text_in_stretches(monkeypatch, library):
    from gridloom.llm import pretokens

    monkeypatch.setattr(pretokens, "STRETCH", 7)
    memory = pretokens.PreTokenMemory(pretokens.load("byte_bpe_50k.json"), token_counts._memory("byte_bpe_50k.json").encode, limit=50)
    some = texts()[:80]
    assert [int(memory.counts([t])[0]) for t in some] == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
def test_dac_round_trip(size):
    rng = np.random.default_rng(size)
    ids = (rng.integers(0, 2**31, size) >> rng.integers(0, 31, size)).astype(np.uint32)
    segment = dac.Segment(dac.encode(ids, np.array([7]), np.array([size])))
    assert (segment.all() == ids).all() and len(segment) == size
    assert [segment.token(i) for i in range(size)] == ids.tolist()


@pytest.mark.parametrize("file_ids", [50, 10**6])
def test_token_ids(spark, library, file_ids):
    rows = [(i * 7 % 307, t, None, None, 1) for i, t in enumerate(texts())] + [(1000 + i, r[1], *r[2:]) for i, r in enumerate(ROWS)]
    index = token_ids.write_token_ids(documents(spark, rows), work_dir(spark, "ids"), file_ids=file_ids)
    assert (index.select("file").distinct().count() > 20) == (file_ids == 50)
    start, want, every = 0, [], []
    for doc, text, *_ in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert sorted(tuple(r) for r in token_ids.read_token_ids(index).collect()) == want
    asked = spark.createDataFrame([(k,) for k in range(0, start, 97)], "place long")
    assert {r.place: r.token for r in token_ids.tokens_at(index, asked).collect()} == {k: every[k] for k in range(0, start, 97)}


def test_token_ids_edges(spark):
    rows = [(None, "a b", None, None, 1), (5, None, None, None, 1), (5, None, None, None, 1)]
    found = token_ids.read_token_ids(token_ids.write_token_ids(documents(spark, rows), work_dir(spark, "ids"))).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in found) == [("5", 3, 1), ("5", 4, 1), ("None", 0, 3)]
    assert token_ids.read_token_ids(token_ids.write_token_ids(documents(spark, []), work_dir(spark, "ids"))).count() == 0


PAGES = [(3, "http://a/é b", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (2, None, None), (4, "http://b", ""), (5, "http://c\r\nX: y", "é\r\n\r\nWARC/1.1" * 3), (5, "http://c\r\nX: y", "é\r\n\r\nWARC/1.1" * 3), (None, "http://d", "<p>x</p>"), (6, "http://long", "z" * 300_000)]


@pytest.mark.parametrize("file_bytes", [400, 1 << 26])
@pytest.mark.parametrize("least", [0, 9])
def test_warc(spark, file_bytes, least):
    index = warc.write_warc(pages(spark, PAGES), work_dir(spark, "warc"), least, file_bytes)
    want = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        first = min(same, default=None)
        revisit = len(payload) >= least and page != first
        want.append((str(page), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", str(first if revisit else None)))
    found = warc.read_warc(index).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == sorted(want)
    assert all(bytes(r.payload).decode() == next(h or "" for p, _, h in PAGES if p == r.page_id) for r in found if r.record_type == "response" and r.page_id)
    few = index.where("page_id in (1, 6)")
    assert sorted(r.page_id for r in warc.read_warc(few).collect()) == [1, 6]


def test_warc_edges(spark):
    assert warc.read_warc(warc.write_warc(pages(spark, []), work_dir(spark, "warc"))).count() == 0


def test_reads_coalesce(spark):
    index = spark.createDataFrame([("f", o, n) for o, n in ((0, 10), (10, 5), (100, 5), (5000, 10), (5012, 1))], "file string, offset long, length long")
    found = sorted((r.start, r.size, len(r.records)) for r in warc.coalesced_reads(index, gap=90).collect())
    assert found == [(0, 105, 3), (5000, 13, 2)]


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?q", ""), (2, "https://example.org/en/12", ""), (3, "https://example.org/en/2", ""), (4, "http://notexample.org/es/", ""), (5, "http://x.com/fr/1", ""),
        (6, "http://x.com/de/", ""), (7, "http://x.com/en", ""), (8, None, ""), (9, "nothing", ""), (10, "a://b://c/d", ""), (11, "http://x.org", ""), (12, "http://u.com:80/fr/#a?b", ""), (12, "http://u.com:80/fr/#a?b", ""),
    ]
    outcomes = spark.createDataFrame([(7, 0)] * 40 + [(5, 1)], "page_id long, good int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages(spark, rows), outcomes).collect()}
    assert found == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "/en/2", "org/", "allow"), 4: ("notexample.org", "/es/", "org/", "allow"), 5: ("x.com", "/fr/1", "com/fr/", "allow"),
        6: ("x.com", "/de/", "com/de/", "block"), 7: ("x.com", "/en", None, "block"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("b:", "//c/d", None, "allow"), 11: ("x.org", "", None, "allow"), 12: ("u.com:80", "/fr/", None, "allow"),
    }
    assert host_reputation.judge(pages(spark, []), outcomes).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages(spark, rows[6:7]), outcomes.limit(0)).collect()} == {"allow"}


def test_reputation_shrinks_towards_parents(spark):
    rows = [("a.x.com", "x.com", "com", 1)] * 50 + [("b.x.com", "x.com", "com", 0)] + [("c.y.com", "y.com", "com", 0)] * 50
    found = {r.host: r for r in host_reputation.reputation(spark.createDataFrame(rows, "host string, domain string, suffix string, good int")).collect()}
    assert found["a.x.com"].mean > 0.9 and found["c.y.com"].mean < 0.1 and 0 < found["b.x.com"].mean < 0.9
    assert found["b.x.com"].deviation > found["c.y.com"].deviation


def test_raking_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 500, (3, 2, 4)).astype(float)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(n[a, b, c])) for a in range(3) for b in range(2) for c in range(4)], "source string, lang string, topic string, n long")
    targets = {"source": {"s0": 1, "s1": 1, "s2": 2, "gone": 9}, "lang": {"l0": 0.7, "l1": 0.3}}
    found = mixing.rake(cells, targets).collect()
    want = [np.array([0.25, 0.25, 0.5]), np.array([0.7, 0.3]), (s := n.sum((0, 1)) ** mixing.POWER) / s.sum()]
    w = n.copy()
    for _ in range(200):
        for axis in range(3):
            others = tuple(k for k in range(3) if k != axis)
            w *= (want[axis] / w.sum(others)).reshape([-1 if k == axis else 1 for k in range(3)])
    assert all(abs(r.weight - w[int(r.source[1]), int(r.lang[1]), int(r.topic[1])]) < 1e-5 for r in found)
    for size in (None, 0.8 * n.sum()):  # cells kept in Spark, as very many are, have the same weights
        key = lambda r: (r.source, r.lang, r.topic)
        here, there = ({key(r): r.weight for r in how(cells, targets, size=size).collect()} for how in (mixing.rake, mixing.rake_spark))
        assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-6 for k in here)
    assert mixing.Cells(cells.toPandas(), targets, mixing.POWER).sample_size() == pytest.approx(mixing.sample_size(cells, targets))


def test_targets_that_contradict_each_other_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, n long")
    with pytest.warns(UserWarning, match="from its target"):
        mixing.rake(cells, {"source": {"a": 1, "b": 3}, "lang": {"x": 3, "y": 1}})
    with pytest.warns(UserWarning, match="from its target"):
        mixing.rake(cells, {"source": {"a": 1, "b": 3}}, rounds=0 + 1, size=9.0)


@pytest.mark.parametrize("most", [10**5, 1])
def test_mix_with_few_and_many_cells(spark, monkeypatch, most):
    """The same probabilities whether cells are few or too many for the driver; a user's column drawn stays."""
    monkeypatch.setattr(mixing, "LOCAL_CELLS", most)
    rows = [(i, "one two three four " * (1 + i % 3), "en" if i % 3 else "fr", f"s{min(i % 10, 2)}", 1) for i in range(500)]
    docs = documents(spark, rows)
    found = mixing.draw(docs, mixing.mixing_rates(docs), name="mine")
    assert found.columns == [*docs.columns, "mine"]
    told = sorted((r.doc_id, round(r.mine.probability, 7), r.mine.kept) for r in found.collect())
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 10**5)
    assert told == sorted((r.doc_id, round(r.probability, 7), r.kept) for r in mixing.mix(docs).collect())


def test_mix_edges(spark):
    found = mixing.mix(documents(spark)).collect()
    assert len(found) == len(ROWS) and all(0 <= r.probability <= 1 for r in found)
    assert max(r.probability for r in found) == pytest.approx(1)
    assert {r.source for r in found} == {"a", "b", mixing.NONE}
    assert len({r.kept for r in found if r.doc_id == 5}) == 1
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {r.kept for r in mixing.mix(documents(spark, [ROWS[2]])).collect()} == {False}


def test_mix_reaches_its_targets(spark):
    rows = [(i, "one two three four", "en" if i % 3 else "fr", f"s{min(i % 10, 2)}", 1) for i in range(6000)]
    kept = mixing.mix(documents(spark, rows, clash=False), {"source": {"s0": 1, "s1": 1, "s2": 2}, "lang": {"en": 1, "fr": 1}}).where("kept")
    total = kept.count()
    share = {r.source: r["count"] / total for r in kept.groupBy("source").count().collect()}
    assert share == pytest.approx({"s0": 0.25, "s1": 0.25, "s2": 0.5}, abs=0.05)


def pictures(n):
    return media.draw(np.random.default_rng(5).normal(0, 0.125, (n, 64)))


MEDIA = "media_id long, width int, height int, pixels binary"


def test_media_copies(spark):
    n, real = media.SIDE, pictures(40)
    rows = [(i, n, n, p.tobytes()) for i, p in enumerate(real)]
    rows += [(100 + 10 * i + kind, n, n, media.edited(real[i], kind).tobytes()) for i in range(20) for kind in range(4)]
    rows += [(500, n, n, real[3].tobytes()), (501, n, n, None), (502, n, n, b"short"), (503, n, n, bytes(n * n)), (504, None, n, b"short")]
    rows += [(None, n, n, real[4].tobytes()), (None, None, None, None), (505, 2, 3, b"equals"), (506, 2, 3, b"equals"), (507, 3, 2, b"equals"), (3, n, n, real[3].tobytes())]
    table = spark.createDataFrame(rows, MEDIA).withColumn("k", F.lit("x")).withColumn("digest", F.lit("x"))
    for block in (media.BLOCK, 120):  # one block of queries, and several
        found = media.find_copies(table, F.col("media_id") < 20, block).collect()
        assert {r.media_id for r in found} == {r[0] for r in rows}
        classes = {r.media_id: r.class_id for r in found}
        assert (classes[500], classes[501], classes[505], classes[506], classes[507]) == (3, None, 505, 505, 507)
        assert all(r.match_id is None and r.n_descriptors == 0 for r in found if r.media_id in range(501, 508))
        pairs = {(r.media_id, r.match_id) for r in found if r.match_id is not None}
        want = {(i, 100 + 10 * i + kind) for i in range(20) for kind in range(4)}
        assert len(pairs & want) >= 0.9 * len(want) and len(pairs - want) <= 2
        assert all(r.query == (r.media_id is not None and r.media_id < 20) for r in found)
    assert media.find_copies(table.limit(0), F.col("media_id") < 20).count() == 0


def test_pictures_of_other_sizes(spark):
    """Wide, tall and large pictures: a crop of each, of another size, is found, and the turn and scale are told."""
    tiles = pictures(24).reshape(3, 8, media.SIDE, media.SIDE)
    wide = [np.concatenate(list(t[:3]), axis=1) for t in tiles]
    tall = [np.concatenate(list(t[3:5]), axis=0) for t in tiles]
    large = [np.kron(np.concatenate(list(t[5:8]), axis=1), np.ones((2, 2), np.uint8)) for t in tiles]
    rows = [(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in enumerate(wide + tall + large)]
    crops = [p[9:, 20:-30] for p in wide] + [p[30:-20, 9:] for p in tall] + [p[20:-8, 60:-40] for p in large]
    rows += [(100 + i, p.shape[1], p.shape[0], np.ascontiguousarray(p).tobytes()) for i, p in enumerate(crops)]
    found = media.find_copies(spark.createDataFrame(rows, MEDIA), F.col("media_id") < 50).collect()
    pairs = {(r.media_id, r.match_id): r for r in found if r.match_id is not None}
    assert set(pairs) == {(i, 100 + i) for i in range(9)}
    assert all(r.n_descriptors > 40 for r in found if r.media_id < 3)
    assert abs(pairs[0, 100].shift_x + 20) < 3 and abs(pairs[0, 100].shift_y + 9) < 3
    assert max(media.descriptors(large[0][None])["x"]) <= media.WORK


def test_media_of_keeps_every_row(spark):
    vector = [0.1 * k for k in range(64)]
    rows = [(0, vector), (7, vector[::-1]), (8, vector[:3]), (9, None), (None, vector), (17, [None] * 64), (0, vector)]
    found = media.media_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.media_id), r.pixels is not None) for r in found) == sorted((str(i), i not in (8, 9, 17)) for i, _ in rows)
    one, copy = (next(bytes(r.pixels) for r in found if r.media_id == i) for i in (0, 7))
    assert copy == media.edited(np.frombuffer(one, np.uint8).reshape(media.SIDE, media.SIDE), 0).tobytes()


def test_recall_against_all_pairs_of_descriptors():
    """Pictures whose copies have AGREE descriptors within NEAR bits: what the tables find of them."""
    real = pictures(60)
    a = media.descriptors(real)
    copies = np.stack([media.edited(p, k % 4) for k, p in enumerate(real)])
    b = media.descriptors(copies)
    block = media.Block(list(range(60)), [media.packed_places(a)[a["picture"] == i].tobytes() for i in range(60)])
    i, j = block.matches(np.ascontiguousarray(b["bits"]))
    bits = block.places["bits"]
    apart = np.bitwise_count(b["bits"][:, None] ^ bits[None]).sum(axis=2)
    met = np.zeros(apart.shape, bool)
    met[i, j] = True
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i) and (apart[i, j] <= media.NEAR).all()
    own = b["picture"][:, None] == block.owner[None]
    each = lambda ok: [ok[b["picture"] == k].any(axis=1).sum() >= media.AGREE for k in range(60)]
    assert sum(each(met & own)) >= 0.95 * sum(each((apart <= media.NEAR) & own)) > 50
    meets = (media.table_keys(b["bits"])[:, None] ^ media.table_keys(bits)[None]).astype(np.int64)
    around = np.bitwise_count(meets).min(axis=2) <= 1
    assert (met == ((apart <= media.NEAR) & around)).all()


def test_few_pictures_are_compared_in_full(monkeypatch):
    """Unrelated pictures are told apart before all their descriptors are compared. What is found is found by comparing every
    picture with every other in full too, and next to nothing of that is lost."""
    n, real = 90, pictures(90)
    copies = np.stack([media.edited(p, k % media.KINDS, k) for k, p in enumerate(real)])
    packed = lambda d: [media.packed_places(d)[d["picture"] == k].tobytes() for k in range(n)]
    block, copied = media.Block(list(range(n)), packed(media.descriptors(real))), packed(media.descriptors(copies))
    places = np.frombuffer(b"".join(copied), media._PLACE)
    owner = np.repeat(np.arange(n), [len(p) // media._PLACE.itemsize for p in copied])
    i, j = block.matches(np.ascontiguousarray(places["bits"]))
    assert len(np.unique(owner[i] * n + block.owner[j])) > 0.9 * n * n  # nearly any two have a match
    whole = media.agreed(owner[i] * n + block.owner[j], places[i], block.places[j])
    want = {(p % n, 1000 + p // n, a, t) for p, a, t in zip(whole["pair"], whole["agreeing"], whole["turn"], strict=True)}
    asked, compare = [], media.Block.matches
    monkeypatch.setattr(media.Block, "matches", lambda self, bits, spans: asked.append(len(spans)) or compare(self, bits, spans))
    found = media.copies_in(block, np.arange(1000, 1000 + n), copied)
    got = set(zip(found["query_id"], found["match_id"], found["agreeing"], found["turn"], strict=True))
    print("found", len(got), "of", len(want), "compared", sum(asked))
    assert got <= want and len(got) >= 0.97 * len(want) > 0.9 * n
    assert n * 0.9 < sum(asked) < 0.05 * n * n


def found_of(spark, edit):
    """How many copies, one of each of 40 pictures made by ``edit``, are found; and what else is."""
    real = pictures(40)
    rows = [(i, media.SIDE, media.SIDE, p.tobytes()) for i, p in enumerate(real)]
    rows += [(100 + i, media.SIDE, media.SIDE, edit(i, p).tobytes()) for i, p in enumerate(real)]
    found = media.find_copies(spark.createDataFrame(rows, MEDIA).repartition(4), F.col("media_id") < 100).collect()
    pairs = {(r.media_id, r.match_id) for r in found if r.match_id is not None}
    own = {(i, 100 + i) for i in range(40)}
    return len(pairs & own), pairs - own


@pytest.mark.parametrize("least, degrees, zoom", [(36, 33, 1), (36, 45, 1), (32, 0, 0.6), (36, 0, 0.72), (36, 0, 1.5), (36, 25, 0.8), (34, 200, 1.3)])
def test_turned_and_resized_copies_are_found(spark, least, degrees, zoom):
    n, others = found_of(spark, lambda i, p: media.turned(p, degrees, zoom))
    print("found", degrees, zoom, n)
    assert n >= least and not others


def test_planted_copies_are_found(spark):
    n, others = found_of(spark, lambda i, p: media.edited(p, i % media.KINDS, i))
    assert n >= 38 and not others


def test_turns_around_zero_agree():
    """Matches one step to either side of no turn share a bin, and the fit tells no turn; matches at one place count once."""
    here, there = np.zeros(6, media._PLACE), np.zeros(6, media._PLACE)
    there["x"], there["y"], there["turn"] = (10, 30, 50, 10, 30, 50), (10, 15, 12, 60, 64, 61), 3
    here["turn"] = (3 + np.array([89, 0, 1, 0, 89, 1])) % media.BINS
    here["x"], here["y"] = there["x"] + 20, there["y"] + 5
    (found,) = media.agreed(np.zeros(6, np.int64), here, there).itertuples()
    assert (found.agreeing, round(found.shift_x), round(found.shift_y), round(found.scale, 6)) == (6, 20, 5, 1)
    assert min(found.turn, media.BINS - found.turn) < 0.01
    there["x"][1], there["y"][1], here["x"][1], here["y"][1] = 11, 10, 31, 15
    assert media.agreed(np.zeros(6, np.int64), here, there).empty


def test_rare_cells_do_not_thin_the_rest(spark):
    """One document of a rare source, language and topic leaves most of the corpus in, with the margins near targets."""
    rows = [(i, "one two three four " * 5, "en" if i % 3 else "fr", f"s{i % 4}", 1) for i in range(4000)]
    rows.append((9999, "ask me@here.org now", "xx", "rare", 1))
    docs = documents(spark, rows, clash=False)
    found = mixing.mix(docs).collect()
    kept = sum(r.probability * r.n_tokens for r in found)
    assert kept > 0.8 * sum(r.n_tokens for r in found) and max(r.probability for r in found) == 1
    for margin in mixing.MARGINS:
        n = Counter()
        expected = Counter()
        for r in found:
            n[r[margin]] += r.n_tokens
            expected[r[margin]] += r.probability * r.n_tokens / kept
        total = sum(v**mixing.POWER for v in n.values())
        assert sum(abs(expected[k] - v**mixing.POWER / total) for k, v in n.items()) < 0.03
