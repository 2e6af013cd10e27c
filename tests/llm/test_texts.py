"""Substring dedup, near-duplicates, decontamination and language ID against brute force and edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from gridloom.llm import decontaminate as dc
from gridloom.llm import language_id as li
from gridloom.llm import near_dedup as nd
from gridloom.llm import substring_dedup as sd
from gridloom.llm.components import connected_components

from .cases import LONG, ROWS, documents

BLANK = r"[\x20\x09-\x0d]+"


def words(text, lower=False):
    text = text or ""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text
    return [w for w in re.split(BLANK, text) if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Random documents with shared passages, edited copies and exact copies."""
    rng = random.Random(11)
    passage = prose(rng, 70)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(1, 260))
        if i % 4 == 0:
            cut = rng.randrange(len(text))
            text = text[:cut] + " " + passage[rng.randrange(8) :] + "\n" + text[cut:]
        if i % 7 == 3 and rows:
            old = words(rows[-1][1])
            for _ in range(rng.randrange(3)):
                old[rng.randrange(len(old))] = "changed"
            text = " ".join(old)
        if i % 11 == 5:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i * 3 % 61 + 10, text, "en", "a", 1))
    return rows


def brute_windows(rows, width=50):
    first: dict = {}
    for doc, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if doc is not None and first[tuple(w[k : k + width])] < doc:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def repeated_ids():
    """Several texts of one doc_id, with passages of smaller ids and of each other."""
    rng = random.Random(5)
    a, b, c = prose(rng, 60, 10**6), prose(rng, 55, 10**6), prose(rng, 80, 10**6)
    rows = [(3, a), (5, "x y z " + a), (5, b), (7, "q " + b), (5, b), (9, a), (9, b + " " + c), (9, c), (8, c + " " + a), (8, None), (8, "short"), (11, b + "\n" + c)]
    return [(d, t, "en", "a", 1) for d, t in rows]


def repeated_ids_of_copies():
    a, b = (prose(random.Random(k), 60, 10**6) for k in (1, 2))
    return [(d, t, "en", "a", 1) for d, t in ((3, a), (5, a), (5, b), (7, b), (7, b), (7, a))]


@pytest.mark.parametrize("rows", [corpus(), ROWS + [(20, "x " + LONG + " y", "en", "a", 1)], [], repeated_ids(), repeated_ids_of_copies()])
def test_substring_dedup(spark, rows):
    found = sd.substring_dedup(documents(spark, rows)).collect()
    mine = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found), key=repr)
    assert mine == brute_windows(rows)


def test_cover_aligns_any_two_places():
    assert all(any((i + d) % sd.PERIOD in sd.COVER and (j + d) % sd.PERIOD in sd.COVER for d in range(sd.PERIOD)) for i in range(sd.PERIOD) for j in range(sd.PERIOD))


def brute_components(rows, percent=85):
    def shingles(text):
        w = words(text, True)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(doc, shingles(t)) for doc, t, *_ in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets:
        for e, t in sets:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=repr)


def chain():
    """Versions of one text, each a word further from the first: only neighbours link."""
    rng = random.Random(4)
    text = prose(rng, 120, 10**6).split()
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(text), "en", "a", 1))
        text[rng.randrange(120)] = f"n{i}"
    return rows


@pytest.mark.parametrize("rows", [corpus(), ROWS, chain(), []])
def test_near_duplicates(spark, rows):
    found = nd.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr) == brute_components(rows)


def test_near_duplicates_at_a_lower_threshold(spark):
    """Pairs of similarity 0.80 to 0.85, linked at 80 and not at 85, and pairs just below 0.80."""
    rng = random.Random(12)
    rows = []
    for i in range(40):
        text = [f"p{i}x{k}" for k in range(124)]
        rows += [(10 * i, " ".join(text), "en", "a", 1), (10 * i + 1, " ".join(text[: 97 + i % 8]), "en", "a", 1)]
        rows.append((10 * i + 2, " ".join(text[:60] + ["edit"] + text[61 : 110 + rng.randrange(4)]), "en", "a", 1))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t, *_ in rows}
    for percent in (80, 85):
        root = {d: d for d in sets}
        for _ in range(3):
            for i in range(0, 400, 10):
                for a in range(i, i + 3):
                    for b in range(i, i + 3):
                        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                            root[a] = root[b] = min(root[a], root[b])
        found = nd.near_duplicates(documents(spark, rows, clash=False), percent).collect()
        assert {r.doc_id: r.component_id for r in found} == root
        linked = sum(d != c for d, c in root.items())
        assert (0 < linked < 80) if percent == 80 else linked < last
        last = linked


def test_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies over several chunks, none of whose members is the least one's link."""
    rng = random.Random(8)
    base = prose(rng, 60, 10**6).split()
    rows = [(0, " ".join(base[:30] + [f"z{i}" for i in range(30)]), "en", "a", 1)]
    for i in range(1, 60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w), "en", "a", 1))
    monkeypatch.setattr(nd, "CHUNK", 8)
    found = nd.near_duplicates(documents(spark, rows, clash=False)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr) == brute_components(rows)


def test_sketch_bound_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for n in (6, 40, 150, 700, 5000):
        for _ in range(30):
            common, own = int(n * 0.85), (n - int(n * 0.85)) // 2
            x = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
            a, b = x[: common + own], np.concatenate((x[:common], x[common + own : common + 2 * own]))
            flips = np.bitwise_count(nd.odd_sketch(a) ^ nd.odd_sketch(b)).sum()
            assert nd.could_link([len(a)], [len(b)], np.array([flips]))[0]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontaminate_against_edit_distance(spark):
    rng = random.Random(6)
    letters = "abcdefgh "
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(42, 80)))) for k in range(4)]
    rows = []
    for d in range(40):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 160)))
        if d % 2:
            item = list(dc.normal(items[d % 4][1]))
            for _ in range(rng.randrange(9)):
                item[rng.randrange(len(item))] = rng.choice("abcxyz")
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "".join(item) + text[at:]
        rows.append((d, text, "en", "a", 1))
    found = dc.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    index = dc.Items([k for k, _ in items], [t for _, t in items])
    budget = dict(zip(index.ids, index.budget.tolist(), strict=True))
    want = {}
    for d, text, *_ in rows:
        best = {k: edit_distance_inside(dc.normal(t), dc.normal(text)) for k, t in items if k in budget}
        want[d] = sorted((k, e) for k, e in best.items() if e <= budget[k])
    assert {r.doc_id: sorted((x.item_id, x.edits) for x in r.leaks) for r in found} == want
    assert sum(r.contaminated for r in found) >= 10


def test_decontaminate_edges(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "short"), (4, "")], "item_id long, text string")
    one = sorted((str(r.doc_id), r.contaminated, [x.item_id for x in r.leaks]) for r in dc.decontaminate(documents(spark), bench).collect())
    assert [x for x in one if x[1]] == [("1", True, [None, 1, 1]), ("None", True, [None, 1, 1])]
    several = dc.decontaminate(documents(spark), bench, block_chars=40)  # several blocks of the benchmark
    assert sorted((str(r.doc_id), r.contaminated, sorted((x.item_id for x in r.leaks), key=str)) for r in several.collect()) == sorted((d, c, sorted(x, key=str)) for d, c, x in one)
    assert dc.decontaminate(documents(spark), bench.limit(0)).where("contaminated").count() == 0
    assert dc.decontaminate(documents(spark, []), bench).count() == 0


def test_short_items_stand_as_whole_words(spark):
    items = [(1, "What is  2+2?"), (2, "pi is 3.14"), (3, "yes"), (4, "a cat sat on it")]
    texts = ["so what is 2+2? four", "what is 2+2?", "xwhat is 2+2?", "pi is 3.141", "Pi is\n3.14 or so", "yes", "oh yes, that", "yesterday", "a cat sat on it", "a cat sat on its", "a cat sit on it", "scat sat on it", "", None]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"shortest": 1}, {"shortest": 11}, {"least": 8}):
        found = {r.doc_id: {x.item_id for x in r.leaks} for r in dc.decontaminate(documents(spark, rows), bench, **how).collect()}
        for d, text, *_ in rows:
            want = set()
            for k, t in items:
                plain, inside = dc.normal(t), dc.normal(text)
                if len(plain) < how.get("shortest", dc.SHORTEST):
                    continue
                budget = min(int(len(plain) * dc.RATE), len(plain) // dc.Q - 1) if len(plain) >= how.get("least", dc.LEAST) else -1
                if budget >= 0:
                    want |= {k} if edit_distance_inside(plain, inside) <= budget else set()
                elif re.search(r"(?<!\w)" + re.escape(plain) + r"(?!\w)", inside):
                    want.add(k)
            assert found[d] == want, (how, text)


def test_long_repetitive_texts_in_bounded_memory():
    """300,000 equal characters against an item of a hundred: some 28 million shared q-grams, counted in parts."""
    index = dc.Items([1, 2], ["a" * 100, "ab" * 60 + "c" * 10])
    tracemalloc.start()
    found = index.search(["a" * 300_000, "b" * 50 + "ab" * 2_000 + "c" * 10])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == [(1, 0, 0, 100)] and {x[:2] for x in found[1]} == {(2, 0)}
    assert peak < 250e6
    rng = random.Random(3)
    docs = ["".join(rng.choice("ab") for _ in range(rng.randrange(300))) for _ in range(30)]
    items = dc.Items([0, 1], ["".join(rng.choice("ab") for _ in range(45)) for _ in range(2)])
    text = np.concatenate([np.append(dc.codes(d), [0] * 8).astype(np.uint32) for d in docs])
    whole, parts = (sorted(zip(*(x.tolist() for x in items.candidates(text, most)), strict=True)) for most in (10**9, 7))
    assert whole == parts


def test_results_do_not_depend_on_neighbours():
    """A document that begins with an item whose first characters are cut, after empty and short ones."""
    item = "abcdefghij klmnopqrst uvwxyz abcdefghij klmnop"
    index = dc.Items([1], [item])
    alone = index.search([item[3:] + " and more"])[0]
    for before in ([""], ["", "", "x"], ["q" * 30, "", ""], [item]):
        assert index.search([*before, item[3:] + " and more"])[len(before)] == alone


def labelled():
    rng = random.Random(21)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopqrst", "dd": "qrstuväö"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7)))
    return [(i, " ".join(word(lang) for _ in range(rng.randrange(1, 30))), lang, "a", 1) for i in range(240) for lang in [sorted(letters)[i % 4]]]


def test_prediction_is_of_the_text_alone(spark):
    """The same in any company, and as many n-grams learned as looked up."""
    rows = labelled()
    model = li.fit(documents(spark, rows))
    texts = [t for _, t, *_ in rows[:40]] + ["", None, "é", "12", "a\x00b", "hola amigo", "x" * 5000]
    together = model.predict(texts)
    for k, t in enumerate(texts):
        assert model.predict([t]).iloc[0].tolist() == pytest.approx(together.iloc[k].tolist(), abs=1e-9)
    alone = [li.grams([t])[0] for t in texts if t]
    flat, starts = li.grams([t for t in texts if t])
    assert (np.concatenate(alone) == flat).all() and (np.cumsum([0, *map(len, alone)])[:-1] == starts).all()


def test_decoding_against_brute_force(spark):
    """Counts, classifiers, held-out weights and loss-weighted decoding, recomputed one text and one bit at a time."""
    rows = labelled()
    model = li.fit(documents(spark, rows))
    sample = [r for r in li.labelled_sample(documents(spark, rows)).collect()]
    assert len(sample) == sum(1 for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    counts = {(lang, part): np.zeros(li.BUCKETS) for lang in model.langs for part in (0, 1)}
    for r in sample:
        found = np.zeros(li.BUCKETS)
        for row in li.grams([r.text])[0]:
            for bucket in row:
                found[bucket] += 1
        counts[r.lang, int(r.fold == 0)] += found * min(1, li.TEXT_GRAMS / found.sum())

    def classifiers(of):
        total = {lang: of[lang].sum() for lang in model.langs}
        floor = 0.5 / (sum(total.values()) / len(total))
        out = []
        for bit in model.code.T:
            side = {s: np.mean([of[x] / total[x] for x, b in zip(model.langs, bit, strict=True) if b == s], axis=0) for s in (1, -1)}
            out.append(np.log(side[1] + floor) - np.log(side[-1] + floor))
        return out

    lean = lambda weights, text: [np.mean([w[b] for row in li.grams([text])[0] for b in row]) for w in weights]
    first = classifiers({x: counts[x, 0] for x in model.langs})
    right = {x: [] for x in model.langs}
    for r in sample:
        if r.fold == 0 and r.text:
            right[r.lang].append(np.sign(lean(first, r.text)) == model.code[model.langs.index(r.lang)])
    share = np.clip(np.mean([np.mean(v, axis=0) for v in right.values() if v], axis=0), 0.5, 0.999)
    weights = np.maximum(np.log(share / (1 - share)), 0.01)
    assert model.bit_weights == pytest.approx(weights)
    final = classifiers({x: counts[x, 0] + counts[x, 1] for x in model.langs})
    for _, text, *_ in rows[:25]:
        leanings = np.array(lean(final, text)) * 10
        loss = [sum(w * np.log1p(np.exp(-z * b)) for w, z, b in zip(weights, leanings, code, strict=True)) / weights.sum() for code in model.code]
        chance = np.exp(-4 * np.array(loss))
        told = model.predict([text]).iloc[0]
        assert told.lang_pred == model.langs[int(np.argmin(loss))]
        assert told.score == pytest.approx(chance.max() / chance.sum(), abs=1e-4)


def test_held_out_is_never_null(spark, tmp_path):
    documents(spark, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    found = li.op5_language_id(spark, str(tmp_path)).collect()
    assert {r.held_out for r in found if r.doc_id is None} == {False} and len(found) == len(ROWS)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)


def test_language_accuracy_on_held_out(spark, data):
    found = li.op5_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count() > 0


@pytest.mark.parametrize("n", range(2, 12))
def test_codewords_differ(n):
    code = li.codewords(n)
    assert len(code) == n and min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1, 2, 4, 4)[min(n, 5) - 2]
