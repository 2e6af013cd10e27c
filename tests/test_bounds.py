"""Untrusted sizes and any keys: what a row merely claims is bounded, and no key or text ends a job."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import consensus as cs
from gridloom.operators import evaluate as ev
from gridloom.operators import gate as gt
from gridloom.operators import review as rv
from gridloom.operators import sampling as sm
from gridloom.operators import spans as sp
from gridloom.operators import tokens as tk
from gridloom.operators.grid import WHITE_SPACE, rectangularize, unicode_trim
from gridloom.plans import fixtures, gates, registry
from gridloom.plans.fixtures import cells_actual
from gridloom.sources import readers as rd
from gridloom.sources import writers as wr

FAR = 2147483647
CELLS = "doc_id long, row_idx int, col_idx int, text string"
SPANS = "doc_id long, span_id int, row_idx int, col_idx int, row_span int, col_span int, role string"


# Ranks ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "constant", "text", "null"])
def test_numbers_of_any_keys(spark, kind):
    draw = random.Random(kind)
    of = {"random": lambda: draw.getrandbits(62), "constant": lambda: 5, "text": lambda: draw.choice("abü") * draw.randrange(9) + str(draw.randrange(400)), "null": lambda: draw.choice((None, 1, 2))}[kind]
    rows = [(of(), draw.choice("xyz") if draw.random() < 0.6 else "hot", k) for k in range(5000)]
    df = spark.createDataFrame(rows, f"key {'string' if kind == 'text' else 'long'}, source string, other long").repartition(7)
    order = lambda r: (r.key is not None, r.key.encode() if kind == "text" else r.key)
    found = sm.numbered(df, "no", "key").collect()
    assert sorted(r.no for r in found) == list(range(5000))
    assert sorted(r.other for r in found) == list(range(5000))
    in_order = sorted(found, key=lambda r: r.no)
    assert [r.key for r in in_order] == [r.key for r in sorted(found, key=order)]
    within = sm.numbered(df, "no", "key", "source").collect()
    for source in "x", "y", "z", "hot":
        mine = sorted((r for r in within if r.source == source), key=lambda r: r.no)
        assert [r.no for r in mine] == list(range(len(mine)))
        assert [r.key for r in mine] == [r.key for r in sorted(mine, key=order)]
    # the same rows get the same numbers, however they are dealt
    again = sm.numbered(df.repartition(3), "no", "key").collect()
    assert {(r.other, r.no) for r in again} == {(r.other, r.no) for r in found}


def test_equal_keys_are_spread(spark):
    """A key of all rows doesn't put them in one task: parts are as many as asked for, and none has over half of them."""
    df = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("other")).repartition(8)
    dealt = df.withColumns({"tie": F.xxhash64("other")}).repartitionByRange(4, "key", "tie")
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 10_000
    plan = sm.numbered(df, "no", "key")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bWindow\b", plan)


def test_even_places_join_instead_of_comparing(spark):
    rows = spark.createDataFrame([(s, k) for s, n in (("a", 9), ("b", 40), (None, 5)) for k in range(n)], "source string, key long")
    found = sm.evenly_spaced(rows, 5, "source", "key")
    assert sorted((r.source or "", r.pick, r.key) for r in found.collect()) == [("", k, k) for k in range(5)] + [("a", k, 2 * k) for k in range(5)] + [("b", k, v) for k, v in enumerate((0, 10, 20, 29, 39))]
    assert "Filter (rint" not in found._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="too few rows"):
        sm.evenly_spaced(rows, 6, "source", "key").collect()
    assert [r.key for r in sm.evenly_spaced(rows.where("source = 'a'"), 1, "source", "key").collect()] == [4]


def test_nulls_in_inventories(spark):
    left = spark.createDataFrame([("a", None), ("b", "x\r\ny"), ("c", None), ("e", "1")], "key string, content string")
    right = spark.createDataFrame([("a", None), ("b", "x\ny"), ("c", "z"), ("d", None)], "key string, content string")
    found = {r.key: r.status for r in sm.reconcile(left, right).collect()}
    assert found == {"a": "same", "b": "same", "c": "content_diff", "d": "unexpected", "e": "missing"}
    digest = lambda f: f.withColumnRenamed("content", "digest")
    found = {r.key: r.status for r in sm.digest_check(digest(left), digest(right)).collect()}
    assert found == {"a": "mismatch", "b": "mismatch", "c": "mismatch", "d": "undeclared", "e": "missing"}


# Grids and spans --------------------------------------------------------------------------------------------


def test_far_places(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, FAR, 1, "b"), (2, 0, 0, "a"), (2, 1, 2, "b"), (3, -1, 0, "c"), (4, 0, FAR, None)], CELLS)
    found = sorted(tuple(r) for r in rectangularize(cells).collect())
    assert found == [(1, 0, 0, "a"), (1, FAR, 1, "b"), (2, 0, 0, "a"), (2, 0, 1, ""), (2, 0, 2, ""), (2, 1, 0, ""), (2, 1, 1, ""), (2, 1, 2, "b"), (3, -1, 0, "c"), (4, 0, FAR, "")]


def test_spans_outside_their_grid_overlap(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, 1, 9, None), (1, 1, 0, 8, 3, 1, None), (1, 2, 2, 8, 1, 2, None), (1, 3, 5, 5, 1, 1, None), (2, 0, 0, 0, 1, 1, None), (3, 0, 4, 4, 0, 0, None), (3, 1, 4, 4, None, None, None)], SPANS)
    shape = spark.createDataFrame([(1, 2, 2), (2, 1, 1)], "doc_id long, n_rows int, n_cols int")
    found = {(r.doc_id, r.span_id): (r.in_bounds, r.overlapping) for r in sp.span_findings(spans, shape).collect()}
    assert found == {(1, 0): (False, True), (1, 1): (False, True), (1, 2): (False, True), (1, 3): (False, False), (2, 0): (True, False), (3, 0): (False, True), (3, 1): (False, True)}


def test_absurd_spans(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, FAR, 1, None), (1, 1, 0, 0, 1, 2, None), (1, 2, 0, 1, 2, 1, None), (1, 3, FAR, FAR, 1, 1, None), (1, 4, -1, 0, 2, 1, None), (2, 0, 0, 0, 1, FAR, None)], SPANS)
    shape = spark.createDataFrame([(1, 2, 2)], "doc_id long, n_rows int, n_cols int")
    found = {(r.doc_id, r.span_id): (r.in_bounds, r.overlapping) for r in sp.span_findings(spans, shape).collect()}
    assert found == {(1, 0): (False, False), (1, 1): (True, True), (1, 2): (True, True), (1, 3): (False, False), (1, 4): (False, False), (2, 0): (False, False)}
    assert sorted(tuple(r) for r in sp.covered_slots(spans).collect()) == [(1, 0, 1), (1, 1, 1)]
    cells = spark.createDataFrame([(1, 0, 0, "a", False), (1, 0, 1, " 　", False), (1, 1, 1, "", True), (2, 0, 7, "x", False)], CELLS + ", needs_review boolean")
    kept, places = sp.resolve_text_hiding(spans, cells)
    assert sorted((r.doc_id, r.span_id) for r in kept.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert sorted(tuple(r) for r in places.collect()) == [(1, -1, 0), (1, 0, 0), (2, 0, 0), (2, 0, 7)]
    lifted = {(r.row_idx, r.col_idx) for r in sp.lift_review(spans, cells).where("needs_review").collect()}
    assert lifted == {(0, 1), (1, 1)}


def plain_markup(rows):
    taken, out = set(), []
    for r, row in enumerate(rows[:1024]):
        c = 0
        for text, down, across in row:
            while (r, c) in taken:
                c += 1
            if c >= 1024:
                break
            down, across = min(down, 1024 - r), min(across, 1024 - c)
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)} - {(r, c)}
            out.append((r, c, text, down, across))
            c += across
    return out


def test_markup_within_the_largest_grid():
    draw = random.Random(5)
    html = lambda rows: "".join("<tr>" + "".join(f'<td rowspan="{d}" colspan="{a}">{t}</td>' for t, d, a in row) + "</tr>" for row in rows)
    for _ in range(30):
        rows = [[(f"{r}.{k}", draw.choice((1, 1, 1, 2, 3, 9)), draw.choice((1, 1, 2, 700))) for k in range(draw.randrange(9))] for r in range(draw.randrange(1, 14))]
        assert list(rd.markup_cells(html(rows))) == plain_markup(rows)
    giants = [[("x", 5000, 99999)]] * 1000 + [[("y", 1, 1)] * 3] * 100
    found = list(rd.markup_cells(html(giants)))
    assert found == [(0, 0, "x", 1024, 1024)]
    assert len(list(rd.markup_cells(html([[("z", 1, 1)]] * 1500)))) == 1024


def test_bare_texts_of_documents(spark):
    raw = spark.createDataFrame([(1, '{"cells":[["{a","b"],5,[{"text":"c"},{"text":null},{},null,7,["x"]]]}'), (2, "{bad"), (3, '{"cells":5}'), (4, None)], "doc_id long, json string")
    found = sorted(tuple(r) for r in rd.cells_from_documents(raw).collect())
    assert found == [(1, 0, 0, "{a"), (1, 0, 1, "b"), (1, 2, 0, "c"), (1, 2, 1, ""), (1, 2, 2, ""), (1, 2, 3, ""), (1, 2, 4, "7"), (1, 2, 5, '["x"]')]


# Scores -----------------------------------------------------------------------------------------------------


def plain_alignment(t, a, rows=3, cols=2):
    """Best (row_shift, col_shift, cells, equal) of dicts of places."""
    size = lambda g: (max(r for r, _ in g) + 1, max(c for _, c in g) + 1)
    (n, m), (gn, gm), best = size(t), size(a), None
    for dr in range(-rows, rows + 1):
        for dc in range(-cols, cols + 1):
            places = [(r, c) for r in range(n) for c in range(m) if 0 <= r + dr < gn and 0 <= c + dc < gm]
            equal = sum(t.get((r, c), "").strip() == a.get((r + dr, c + dc), "").strip() for r, c in places)
            if places and (best is None or equal / len(places) > best[3] / best[2]):
                best = (dr, dc, len(places), equal)
    return best


def test_alignment_by_brute_force(spark):
    draw = random.Random(8)
    grids = []
    for _ in range(40):
        n, m = draw.randrange(1, 8), draw.randrange(1, 6)
        t = {(r, c): draw.choice(("", " ", "a", "b", "a ")) for r in range(n) for c in range(m) if draw.random() < 0.8} or {(0, 0): "a"}
        dr, dc = draw.randrange(-2, 3), draw.randrange(-2, 3)
        a = {(r + dr, c + dc): v for (r, c), v in t.items() if r + dr >= 0 and c + dc >= 0 and draw.random() < 0.9} or {(draw.randrange(9), draw.randrange(9)): "b"}
        grids.append((t, a))
    frame = lambda k: spark.createDataFrame([(d, r, c, v) for d, g in enumerate(grids) for (r, c), v in g[k].items()], CELLS).repartition(3)
    found = {r.doc_id: (r.row_shift, r.col_shift, r.cells, r.equal) for r in ev.best_alignment(frame(0), frame(1)).collect()}
    assert found == {d: plain_alignment(*g) for d, g in enumerate(grids)}


def test_alignment_of_equal_texts_makes_no_pairs(spark):
    cells = spark.range(64 * 64).select(F.lit(1).cast("long").alias("doc_id"), F.floor(F.col("id") / 64).cast("int").alias("row_idx"), (F.col("id") % 64).cast("int").alias("col_idx"), F.lit("x").alias("text"))
    found = ev.best_alignment(cells, cells)
    assert tuple(found.first()) == (1, -3, -2, 61 * 62, 61 * 62, 1.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    far = cells.where("row_idx = 0 and col_idx = 0").withColumn("row_idx", F.lit(FAR - 5))
    assert tuple(ev.best_alignment(far, cells).first()) == (1, None, None, None, None, None)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_by_ranges(spark, by):
    draw = random.Random(4)
    rows = [(draw.choice(("a", "b", None)), draw.choice((None, draw.randrange(40), draw.randrange(10**9)))) for _ in range(4000)] + [("one", 7)]
    frame = spark.createDataFrame(rows, "g string, v long").repartition(5)
    shares = {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}
    found = ev.nearest_ranks(frame, "v", shares, by)
    for r in found.collect():
        mine = sorted(v for g, v in rows if v is not None and (not by or g == r.g))
        assert [r[name] for name in shares] == [mine[round((len(mine) - 1) * s)] for s in shares.values()]
    assert found.count() == (4 if by else 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not any("Window" in line and "part#" not in line for line in plan.splitlines() if "windowspec" in line)


def test_rates_have_four_digits(spark):
    pairs = [(1, 3), (2, 3), (1, 32), (3, 32), (98, 144), (0, 5), (5, 5), (0, 0), (1, 16), (5, 16)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", ev.four_digits("a", "b").alias("r"))
    assert [r.r for r in df.collect()] == [round(a / b, 4) if b else None for a, b in pairs]


def test_kinds_look_past_blanks_at_the_ends(spark):
    pairs = [("a", " a"), (" ", ""), ("a b", "ab "), ("", " x"), ("x　", " "), ("12", " 123 ")]
    df = spark.createDataFrame(pairs, "e string, a string").select(ev.mismatch_kind(F.col("e"), F.col("a")).alias("k"))
    assert [r.k for r in df.collect()] == ["same", "same", "space_only", "extra_text", "missing_text", "digit_padded"]


# Texts ------------------------------------------------------------------------------------------------------


def test_literals_are_no_numbers(spark):
    texts = ["0.77f", "0.77", " 0.86 ", "0.86d", "7.7e-1", "x", None, "0.77D"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.k for r in df.select(rv.is_sentinel(F.col("t")).alias("k")).collect()] == [False, True, True, False, True, False, False, False]
    read = [tuple(r.k) for r in df.select(rv.read_confidence(F.col("t")).alias("k")).collect()]
    assert read[0] == (None, True) and read[1] == (0.77, False) and read[3] == (None, True) and read[6] == (1.0, False)
    axis = spark.createDataFrame([(1, "row", 0, "0"), (1, "row", 1, "5d"), (2, "row", 0, "0"), (2, "row", 1, "5.4")], "doc_id long, axis string, idx int, pos string")
    assert sorted((r.doc_id, r.idx, r.pos) for r in tk.normalize_axis(axis).collect()) == [(2, 0, 0), (2, 1, 5)]


def test_id_ranges(spark):
    texts = ["1-3,FC-00009", "5-1, x,9", "", " , ", "1-2-3", "-5", "7-7", "1-2000000000", "99999-100001", "99999999999999999999-1", None, "a-b"]
    wanted = [["FC-00001", "FC-00002", "FC-00003", "FC-00009"], ["x", "9"], [], [], None, None, ["FC-00007"], None, ["FC-99999", "FC-100000", "FC-100001"], None, None, ["a-b"]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.id_ranges(F.col("t")).alias("k"))
    assert [r.k for r in df.collect()] == wanted


def test_manifest_of_any_fields(spark, tmp_path):
    rows = [(1, 'a\n"b",\r\nc'), (2, None), (3, ""), (4, "plain"), (5, "ü, '")]
    df = spark.createDataFrame(rows, "id long, note string").repartition(2)
    assert wr.write_manifest(df, str(tmp_path / "m")) == 5
    back = wr.read_manifest_csv(spark, str(tmp_path / "m" / "csv"), "id long, note string").collect()
    assert sorted((r.id, r.note or "") for r in back) == [(k, (v or "").replace("\r\n", "\n")) for k, v in rows]
    assert all(f.read_bytes().startswith(b'\xef\xbb\xbf"id","note"\r\n') for f in (tmp_path / "m" / "csv").glob("part-*") if f.stat().st_size)
    assert wr.write_manifest(df.where("false"), str(tmp_path / "none")) == 0


# Documents of the fixtures --------------------------------------------------------------------------------------


def test_documents_are_gathered_where_their_rows_lie(spark, data):
    """One exchange and one sort, of the table's rows; none of the JSON made of them."""
    plan = gates._raw(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    assert "Join" not in plan and "Aggregate" not in plan


def test_padding_and_csv_shuffle_no_places(spark, data, tmp_path):
    """Cells that lie by document are padded, gathered and read back there: two exchanges, of the table's rows and of the
    texts read back."""
    cells = cells_actual(spark, data).drop("h", "confidence")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    padded = plan(rectangularize(cells))
    assert len(re.findall(r"\bExchange ", padded)) == 1 and "Join" not in padded
    assert len(re.findall(r"Exchange ", plan(wr.roundtrip_check(cells, str(tmp_path / "csv"))))) <= 2


def test_padding_keeps_repeats_and_fills_every_gap(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "b"), (1, 3, 0, None), (2, 0, 2, "c"), (3, 0, 0, "d")], CELLS)
    found = sorted(tuple(r) for r in rectangularize(cells).collect())
    want = [(1, r, c, "") for r in range(4) for c in range(2) if (r, c) != (1, 1)] + [(1, 1, 1, "a"), (1, 1, 1, "b"), (2, 0, 0, ""), (2, 0, 1, ""), (2, 0, 2, "c"), (3, 0, 0, "d")]
    assert found == sorted(want)


def test_roundtrip_of_far_places(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, "a,\r\n"), (1, 1, 1, '"'), (2, 0, 0, "a"), (2, FAR, 1, "b"), (3, 0, 0, " ")], CELLS)
    assert sorted(tuple(r) for r in wr.roundtrip_check(cells, str(tmp_path / "a")).collect()) == [(1, 4, True), (2, 2, False)]
    assert sorted(tuple(r) for r in wr.roundtrip_differences(cells, str(tmp_path / "b")).collect()) == [(2, 1, 0, None, "b"), (2, FAR, 1, "b", None)]


def test_partitions_follow_the_table(spark, data, monkeypatch):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", rows // 10)
    assert fixtures.cells_truth(spark, data).rdd.getNumPartitions() >= 10


def test_both_sides_of_a_place_meet_where_the_document_lies(spark, data):
    found = ev.mismatches(fixtures.cells_truth(spark, data), cells_actual(spark, data))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"\bExchange ", plan)) == 2


def test_pages_are_gathered_where_their_rows_lie(spark, data):
    plan = registry.QUERIES["a4_html_tables"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and len(re.findall(r"\bSort \[", plan)) == 1


def test_grouping_without_rules_reads_tokens_once(spark):
    """Two rows of two columns, then a note in one; a document of one column has no rows that stay."""
    at = [(1, 0, 0.0, 0.0), (1, 1, 100.0, 1.0), (1, 2, 2.0, 20.0), (1, 3, 101.0, 21.0), (1, 4, 0.0, 50.0), (2, 0, 0.0, 0.0), (2, 1, 1.0, 40.0)]
    rows = [(d, i, [(x, y), (x + 9, y), (x + 9, y + 8), (x, y + 8)], "a", 0.9) for d, i, x, y in at]
    tokens = spark.createDataFrame(rows, "doc_id long, token_id long, points array<struct<x:double,y:double>>, text string, score double")
    found = tk.group_without_rules(tokens)
    assert sorted((r.doc_id, r.token_id, r.row_idx, r.col_idx) for r in found.collect()) == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 1, 0), (1, 3, 1, 1)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_meet_axes_by_document(spark, data):
    from __spark_entry__ import queries

    placed = queries()["b4_b11_place_tokens"](spark, data)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    # axes are gathered in one pass, and are neither broadcast nor dealt again
    assert "Broadcast" not in plan and plan.count("FileScan") == 2 and plan.count("Exchange") == 2
    # nothing asks for the pieces of a token before they are made
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("posexplode(pieces") == 1 and "size(CASE" not in plan


def test_plain_tokens_meet_by_document(spark, data):
    from __spark_entry__ import queries

    plan = queries()["b3_place_plain_tokens"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # lineitem is dealt by document for tokens, axes and the list of plain ones; placed tokens aren't dealt again
    assert "Broadcast" not in plan and plan.count("Exchange") == 3


def test_boxes_of_other_points_than_four(spark):
    from gridloom.operators import tokens as tk

    nan, inf = float("nan"), float("inf")
    points = [
        [(10.0, 2.0), (40.0, 9.0), (25.0, 4.0)], [(110.0, 2.0), (150.0, 2.0), (150.0, 8.0), (110.0, 8.0), (130.0, 5.0)], [(10.0, 2.0), None, (20.0, 8.0), (20.0, 2.0)], [(10.0, None)] * 4,
        [(nan, 2.0)] * 4, [(inf, 2.0)] * 4, [(10.0, -inf)] * 3, [], None, [(150.0, 22.0), (160.0, 30.0)],
    ]
    rows = [(1, k, p, f" t{k} ", 0.5) for k, p in enumerate(points)]
    tokens = spark.createDataFrame(rows, "doc_id long, token_id long, points array<struct<x:double,y:double>>, text string, score double")
    axes = spark.createDataFrame([(1, [0, 20, 40], [0, 100, 200])], "doc_id long, rows array<bigint>, cols array<bigint>")
    found = {(r.token_id, r.row_idx, r.col_idx, r.x, r.y, r.text) for r in tk.place_tokens(tokens, axes).collect()}
    assert found == {(0, 0, 0, 25.0, 5.0, "t0"), (1, 0, 1, 130.0, 5.0, "t1"), (9, 1, 1, 155.0, 26.0, "t9")}


def test_demoting_reads_readings_once(spark, data):
    """F5 and F6 for F3's own winners take one pass, and give what the three give one by one."""
    for name in "f5_needs_confirmation", "f6_demote":
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Join" not in plan, name
    draw = random.Random(8)
    maybe = lambda v: None if draw.random() < 0.05 else v
    readings = [(maybe(draw.randrange(6)), draw.randrange(3), maybe(draw.randrange(3)), maybe(draw.choice(("a", "b", "-", "", "日"))), draw.choice((0.5, 0.79, 0.8, 0.9, None))) for _ in range(400)]
    counted = cs.votes(spark.createDataFrame(readings, "doc_id int, row_idx int, col_idx int, text string, score double")).localCheckpoint()
    won = cs.select_consensus(counted)
    flags = cs.needs_confirmation(counted, won)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    once = cs.confirmed_consensus(counted)
    assert rows(once.where("confirm is not null").select(*flags.columns)) == rows(flags)
    assert rows(cs.demoted(once)) == rows(cs.demote(won, flags).select(*won.columns))


def test_messages_read_cells_once(spark, data):
    plan = registry.QUERIES["i12_render_messages"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan
    rows = [(1, 1, 0, True), (1, 0, 11, True), (1, 0, 2, True), (1, 0, 0, False), (2, 0, 0, False), (3, 0, 0, None), (4, 0, 0, True), (4, 0, 0, True)]
    cells = spark.createDataFrame(rows, "doc_id long, row_idx int, col_idx int, needs_review boolean")
    docs = spark.createDataFrame([(k, ["review: R9C9"] + ["low"] * (k % 2), True) for k in range(1, 5)], "doc_id long, reasons array<string>, publication_blocked boolean")
    shown = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert shown(gt.with_messages(docs.join(rv.labels_of_documents(cells), "doc_id"))) == shown(gt.render_messages(docs, rv.pending_labels(cells)))


def test_white_space_of_any_script(spark):
    """What is trimmed is what a regular expression takes for white space, of all characters."""
    every = spark.range(0x110000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = every.where(F.col("c").rlike(r"(?U)^\s$")).collect()
    assert sorted(r.c for r in found) == sorted(WHITE_SPACE)
    odd = spark.createDataFrame([(" \u3000a b\n\u2028",), ("\x1c",), ("",), (None,), ("\u200b ",), ("\ufeff",)], "t string")
    assert odd.where(~unicode_trim(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    # of a number, that it isn't written like a literal is known by its type
    kinds = spark.createDataFrame([(0.77, "0.77f")], "c double, t string")
    assert "0-9" not in kinds.select(rv.is_sentinel(F.col("c")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert kinds.select(rv.is_sentinel(F.col("c")), rv.is_sentinel(F.col("t"))).first() == (True, False)


def test_csv_texts_read_cells_once(spark, data):
    plan = registry.QUERIES["l1_csv_texts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Window" not in plan.split("Aggregate")[0]


def test_csv_texts_against_brute_force(spark):
    """Grids with gaps, repeats, far and negative places, blanks and nulls; fields that need guards, quotes or both."""
    draw = random.Random(5)
    texts = ["", " ", None, "a", "=1", "-2", "+x", "007", "a,b", '"q"', "=\"x\",", "1.5", "\u3000", "l\nm", "12345678901234567"]
    rows = [(d, draw.randrange(3), draw.randrange(3), draw.choice(texts), draw.choice((True, False, None))) for d in range(40) for _ in range(draw.randrange(1, 10))]
    rows += [(90, r, c, "x", False) for r in range(2) for c in range(2)] + [(91, 0, 0, "a", True), (91, FAR, 1, "b", True), (92, -1, 0, "c", False), (92, 2, 2, "d", True), (93, 0, 0, " ", True)]
    found = {r.doc_id: r.csv for r in wr.csv_texts(spark.createDataFrame(rows, CELLS + ", needs_review boolean").repartition(3)).collect()}
    fields = sorted({r[3] or "" for r in rows})
    made = spark.createDataFrame([(t,) for t in fields], "t string").select("t", tx.csv_guard(F.col("t")).alias("g")).withColumn("q", tx.csv_quote(F.col("g")))
    of = {r.t: (r.g, r.q) for r in made.collect()}
    want = {}
    for d in {r[0] for r in rows}:
        own = [(r, c, *of[t or ""]) for k, r, c, t, _ in rows if k == d]
        if not any((t or "").strip() for k, _, _, t, _ in rows if k == d):
            continue
        h, w = max(x[0] for x in own) + 1, max(x[1] for x in own) + 1
        if h * w <= 1 << 20 and min(x[:2] for x in own)[0] >= 0:
            own += [(r, c, "", "") for r in range(h) for c in range(w) if (r, c) not in {x[:2] for x in own}]
        lines = [",".join(x[3] for x in sorted(own) if x[0] == r) for r in sorted({x[0] for x in own})]
        labels = [f"R{r + 1}C{c + 1}" for r, c in sorted((r, c) for k, r, c, _, flag in rows if k == d and flag)]
        want[d] = "\ufeff" + "\r\n".join(lines) + "\r\n" + (f"# review: {' '.join(labels)}\r\n" if labels else "")
    assert found == want


def test_plain_pages_are_taken_apart_as_by_the_parser():
    """Random pages of plain and odd pieces have the same rows, whichever way is taken."""
    draw = random.Random(11)
    plain = ["<table>", "<tr>", "<td>", '<td rowspan=" 2 ">', '<td rowspan="x2" colspan="3" rowspan="4">', "</td>", "<th>", "</th>", "</tr>", "</table>", "<br>", "<b>", "a b", " ", "\n", "\x00\r", "x > y", "ä\u2028"]
    odd = ["&amp;", "&", "<br/>", "<TD>", "<td rowspan=2>", "<script>", "</script>", "<!-- <td> -->", "<", "</td >", "<td\n>", "<title>", "</", "<td a='1'>", "<?x>"]
    short = 0
    for n in range(6000):
        cells = lambda: "".join(f"<td>{draw.choice(plain[10:])}{draw.choice(plain[10:] if n % 4 == 1 else plain)}</td>" for _ in range(draw.randrange(4)))
        pieces = [draw.choice([x for x in plain if not x.startswith("</t")] if n % 4 == 1 else plain if n % 2 or draw.random() < 0.9 else odd) for _ in range(draw.randrange(12))]
        page = "".join(f"<tr>{cells()}{x}{cells()}</tr>" if n % 3 else x for x in pieces)
        short += bool(rd.PLAIN_PAGE.fullmatch(page) and rd._plain_rows(page))
        assert list(rd.markup_rows(page)) == list(rd._parsed_rows(page)), page
    assert short >= 500, short


def test_pages_of_tables_are_plain(spark, data, monkeypatch):
    kept = []
    monkeypatch.setattr(rd, "html_tables_to_cells", lambda pages: kept.append(pages) or pages)
    registry.QUERIES["a4_html_tables"](spark, data)
    assert all(rd.PLAIN_PAGE.fullmatch(r.html) and rd._plain_rows(r.html) is not None for r in kept[0].collect())


def test_methods_that_write_documents_are_compiled(spark, data):
    """The JVM compiles no method of over 8,000 bytes."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = gates._raw(spark, data)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_boxes_of_any_points(spark):
    """Boxes of four points take no loop; those of none have no middle, and end no job."""
    rows = [(1, [(0.0, 1.0), (4.0, 1.0), (4.0, 3.0), (0.0, 3.0)]), (2, [(0.0, 0.0), (3.0, 6.0), (6.0, 0.0)]), (3, [])]
    tokens = spark.createDataFrame(rows, "token_id long, points array<struct<x:double,y:double>>")
    found = {r.token_id: tuple(r)[2:] for r in tk.with_box(tokens).collect()}
    assert found == {1: (0.0, 4.0, 1.0, 3.0, 2.0, 2.0), 2: (0.0, 6.0, 0.0, 6.0, 3.0, 2.0), 3: (None,) * 6}
