"""Pinned examples of operators, small tables each."""

import random
import re
from difflib import SequenceMatcher
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import consensus as cs
from gridloom.operators import evaluate as ev
from gridloom.operators import gate as gt
from gridloom.operators import positions as ps
from gridloom.operators import review as rv
from gridloom.operators import sampling as sm
from gridloom.operators import spans as sp
from gridloom.operators import structure as st
from gridloom.operators import tokens as tk
from gridloom.operators.evaluate import mismatch_kind
from gridloom.plans import fixtures as fx
from gridloom.plans.documents import REQUESTS
from gridloom.sources import readers as rd
from gridloom.sources import writers as wr


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def grid(spark, *rows, doc=1):
    cells = [(doc, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    return spark.createDataFrame(cells, "doc_id long, row_idx int, col_idx int, text string")


def texts(cells):
    found = sorted((r.row_idx, r.col_idx, r.text) for r in cells.collect())
    rows = {}
    for r, _, t in found:
        rows.setdefault(r, []).append(t)
    return [rows[k] for k in sorted(rows)]


def test_csv_guard(spark):
    values = ["=1+1", "@x", "\tx", "-12.5", "+1", "-1.5e3", "-12.5%", "-1+2", "+SUM(A1)", "-1.2.3", "007", "-007", "0.5", "1234567890123456", "-", "text", ""]
    guarded = column(spark, values, tx.needs_guard)
    assert guarded == [True, True, True, False, False, False, False, True, True, True, True, False, False, True, False, False, False]


def test_sentinels_and_review(spark):
    assert column(spark, ["0.77", "0.86", "0.7700000001", "0.5", "x", None], rv.is_sentinel) == [True, True, True, False, False, False]
    cells = spark.createDataFrame([(1, 0, 0, "a", 0.77), (1, 0, 1, "", 0.77), (1, 0, 2, "a", -1.0), (1, 0, 3, "a", 0.0), (1, 0, 4, "a", 0.5)], "doc_id long, row_idx int, col_idx int, text string, confidence double")
    assert [r.needs_review for r in rv.build_result(cells).orderBy("col_idx").collect()] == [False, True, True, False, True]
    confirm = cells.orderBy("col_idx").select(rv.requires_human_confirmation(F.col("text"), F.col("confidence"))).collect()
    assert [r[0] for r in confirm] == [False, False, True, True, False]


def test_mismatch_kinds(spark):
    pairs = [("a", "a", "same"), ("", "a", "extra_text"), ("a", "", "missing_text"), ("Ab", "aB", "case_flip"), ("a b", "ab", "space_only"), ("1.2", "1-2", "punct_swap"), ("12", "125", "digit_padded"), ("125", "12", "digit_missing"), ("ab", "cd", "punct_swap"), ("a1", "b2", "replaced_text")]
    rows = spark.createDataFrame(pairs, "e string, a string, want string")
    assert all(r[0] == r[1] for r in rows.select(mismatch_kind(F.col("e"), F.col("a")), "want").collect())


def test_text_repairs(spark):
    assert column(spark, ["12 . 5", "1 1/2", "12 34", "2024 - 01 - 02"], tx.compact_number) == ["12.5", "1 1/2", "12 34", "2024-01-02"]
    assert column(spark, ["AB~12", "10~20", "2024~01~02", "5 kg~7 kg"], tx.restore_dash) == ["AB-12", "10~20", "2024-01-02", "5 kg~7 kg"]
    assert column(spark, ["025x3", "O25x3"], lambda c: tx.restore_diameter(c, F.lit(True))) == ["Φ25x3", "Φ25x3"]
    assert column(spark, ["O25x3"], lambda c: tx.restore_diameter(c, F.lit(False))) == ["O25x3"]
    assert column(spark, ["5 μg", "3 ℃", "3 °°C"], tx.normalize_units) == ["5 µg", "3 °C", "3 °C"]
    assert column(spark, ["１２\nab", "abc"], tx.display_width) == [4, 3]
    rows = [(1, r, 0, t) for r, t in enumerate(["%50", "50%", "%56", "%56", "%56", "%51"])]
    fixed = tx.fix_reversed_percent(spark.createDataFrame(rows, "doc_id long, row_idx int, col_idx int, text string"))
    assert [r[0] for r in texts(fixed)] == ["50%", "50%", "95%", "95%", "95%", "%51"]


def test_median_by_counts_equals_median(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(256)) for k in range(7) for _ in range(rng.randrange(1, 60))]
    found = ps.median_by_counts(spark.createDataFrame(rows, "key int, value int"), ["key"]).collect()
    assert {r.key: r.median for r in found} == {k: float(median(v for j, v in rows if j == k)) for k in range(7)}


def test_positions(spark):
    p = spark.createDataFrame([(1, x) for x in (10, 12, 30, 50, 90, 110)], "series_id long, pos long")
    assert sorted(r.pos for r in ps.cluster_positions(p).collect()) == [11, 30, 50, 90, 110]
    even = spark.createDataFrame([(1, x) for x in (0, 20, 40, 80, 100, 120)], "series_id long, pos long")
    assert sorted(r.pos for r in ps.recover_single_missing(even).collect()) == [0, 20, 40, 60, 80, 100, 120]
    line = spark.createDataFrame([(1, x, 9 if x in (0, 20, 40, 61, 80, 100, 120, 140, 160) else 0) for x in range(181)], "series_id long, pos long, strength long")
    assert sorted(r.pos for r in ps.recover_regular_missing(even, line, 9).collect()) == [0, 20, 40, 61, 80, 100, 120]
    assert sorted(r.pos for r in ps.extend_sequence(even, line, 9).collect()) == [0, 20, 40, 80, 100, 120, 140, 160]
    doubled = spark.createDataFrame([(1, x) for x in (0, 20, 22, 40, 60, 80)], "series_id long, pos long")
    weak = line.withColumn("strength", F.when(F.col("pos") == 22, 1).otherwise(F.col("strength")))
    assert sorted(r.pos for r in ps.collapse_double(doubled, weak).collect()) == [0, 22, 40, 60, 80]  # equal support: the earlier one goes


def test_consensus(spark):
    schema = "doc_id long, row_idx int, col_idx int, family string, reading_no int, text string, score double"
    read = lambda *x: spark.createDataFrame([(1, 0, 0, f, i, t, s) for i, (f, t, s) in enumerate(x)], schema)
    merged = cs.merge_truncated(cs.votes(read(("a", "2", 0.9), ("b", "20", 0.9), ("c", "205", 0.9))))
    assert [(r.text, r.votes) for r in merged.collect()] == [("205", 3)]
    undecided = cs.merge_truncated(cs.votes(read(("a", "2", 0.9), ("b", "20", 0.4), ("c", "25", 0.9))))
    assert {r.text for r in undecided.collect()} == {"2", "20", "25"}
    assert {r.text for r in cs.merge_truncated(cs.votes(read(("a", "2", 0.9), ("b", "20", 0.3)))).collect()} == {"2", "20"}
    assert {r.text for r in cs.merge_truncated(cs.votes(read(("a", "2", 0.9), ("b", "2%", 0.9)))).collect()} == {"2", "2%"}
    assert column(spark, ["1**2", "12**2", "1x2"], lambda c: cs.restore_mask(c, F.lit(1), F.lit(3), F.lit(1))) == ["1***2", "12**2", "1x2"]


def test_tokens_to_grid(spark):
    box = lambda a, b, c, d: [(float(a), float(c)), (float(b), float(c)), (float(b), float(d)), (float(a), float(d))]
    rows = [
        (1, 0, box(10, 90, 4, 16), "left", 0.9), (1, 1, box(50, 150, 24, 36), "one two", 0.8), (1, 2, box(110, 190, 4, 36), "up down", 0.7),
        (1, 3, box(30, 180, 44, 56), "nosplit", 0.6), (1, 4, box(900, 990, 4, 16), "out", 0.5), (1, 5, [(float("nan"), 1.0)], "bad", 0.5),
        (1, 6, box(110, 190, 64, 76), "12.345S/s", 0.9),
    ]
    tokens = spark.createDataFrame(rows, "doc_id long, token_id long, points array<struct<x:double,y:double>>, text string, score double")
    axes = spark.createDataFrame([(1, [0, 20, 40, 60, 80], [0, 100, 200])], "doc_id long, rows array<bigint>, cols array<bigint>")
    placed = tk.place_tokens(tokens, axes)
    cells = {(r.row_idx, r.col_idx): (r.text, round(r.confidence, 2)) for r in tk.read_cells(placed, axes).collect()}
    assert cells == {(0, 0): ("left", 0.9), (1, 0): ("one", 0.8), (1, 1): ("two down", 0.75), (0, 1): ("up", 0.7), (2, 0): ("nosplit", -1.0), (3, 0): ("12.34", 0.9), (3, 1): ("5S/s", 0.9)}


def brute_place(tokens, rows, cols):
    """B3 to B11 one token after the other: (row, column) -> [(y, x, text, score)]."""
    cells = {}
    n_rows, n_cols = len(rows) - 1, len(cols) - 1
    put = lambda r, c, *entry: cells.setdefault((r, c), []).append(entry)
    slot = lambda axis, v: sum(b <= v for b in axis) - 1

    def lines_in(axis, a, b):
        return [i for i in range(1, len(axis) - 1) if a < axis[i] < b and 0.12 <= (axis[i] - a) / max(1, b - a) <= 0.88]

    def covered(axis, a, b):
        return max(0, min(b, axis[-1]) - max(a, axis[0])) / max(1, b - a)

    for points, text, score in tokens:
        if not all(np.isfinite(v) for p in points for v in p):
            continue
        text, xs, ys = text.strip(), [p[0] for p in points], [p[1] for p in points]
        left, right, top, bottom, x, y = min(xs), max(xs), min(ys), max(ys), sum(xs) / len(xs), sum(ys) / len(ys)
        if covered(cols, left, right) < 0.7 or covered(rows, top, bottom) < 0.7:
            continue
        row, col = slot(rows, y), slot(cols, x)
        over, down = lines_in(cols, left, right), lines_in(rows, top, bottom)
        if len(over) == 1 and min(cols[over[0]] - left, right - cols[over[0]]) / max(1, right - left) < 0.22:
            over = []
        cut = None
        blanks = [i for i, a in enumerate(text) if a.isspace()]
        if len(over) == 1 and blanks and right - left > 1:
            ratio = (cols[over[0]] - left) / (right - left)
            off, at = min((abs(i - ratio * len(text)), i) for i in blanks)
            cut = at if 0.2 <= ratio <= 0.8 and off <= max(2, 0.2 * len(text)) else None
        height = max(1, bottom - top)
        if down and text and cut is None and 0 <= col < n_cols:
            words = text.split()
            low = min(rows[r + 1] - rows[r] for r in range(down[0] - 1, down[-1] + 1))
            k = len(down) + 1
            even = all(abs((rows[r] - top) / height - (i + 1) / k) <= 0.25 for i, r in enumerate(down))
            if len(words) != k and re.fullmatch("[\u3400-\u9fff]{2,8}", text) and len(text) % k == 0 and even:
                words = [text[i : i + len(text) // k] for i in range(0, len(text), len(text) // k)]
            if len(words) == len(down) + 1 and height >= low * (len(down) + 0.25):
                for i, word in enumerate(words):
                    r = down[0] - 1 + i
                    put(r, col, (rows[r] + rows[r + 1]) / 2, x, word, score)
                continue
        if down and height >= 1.25 * median(np.diff(rows)):
            row = down[0] - 1
        if not 0 <= row < n_rows:
            continue
        if cut is not None and text[:cut].strip() and text[cut:].strip():
            line = cols[over[0]]
            put(row, over[0] - 1, y, (left + line) / 2, text[:cut].strip(), score)
            put(row, over[0], y, (line + right) / 2, text[cut:].strip(), score)
            continue
        if over and text:
            first = next(c for c in range(n_cols) if right > cols[c] and left < cols[c + 1])
            put(row, first, y, left, text, score if row == 0 and len(over) >= 2 else -1.0)
            continue
        if not 0 <= col < n_cols:
            continue
        fused = re.fullmatch(r"([+-]?\d+\.\d{2})(\d+(?:\.\d+)?\s*[kMGT]?S/s)", text, re.IGNORECASE)
        if fused and col and (row, col - 1) not in cells:
            put(row, col - 1, y, cols[col] - 1.0, fused[1], score)
            text = fused[2]
        put(row, col, y, x, text, score)
    return cells


def brute_read(entries, height):
    """Lines by a running median, each from left to right."""
    lines = []
    for e in sorted(entries):
        if lines and abs(e[0] - median(m[0] for m in lines[-1])) <= max(2, min(8, height * 0.18)):
            lines[-1].append(e)
        else:
            lines.append([e])
    said = [e for line in lines for e in sorted(line, key=lambda e: e[1]) if e[2]]
    return " ".join(e[2] for e in said), round(sum(e[3] for e in said) / len(said), 9) if said else 0.0


def test_placing_and_reading_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["a", "b c", "12.345S/s", "0.501.5 kS/s", "one two three", "  pad ", "longword", "", "x y", "-1.257gs/s", "表格", "表格数据行列"]
    rows, tokens, axes = [], {}, {}
    for doc in range(60):
        lines = [sorted(rng.sample(range(0, 400), rng.randint(3, 7))) for _ in range(2)]
        axes[doc] = [[v * f for v in axis] for axis, f in zip(lines, (1, 2), strict=True)]
        tokens[doc] = []
        for k in range(rng.randint(1, 30)):
            left, top = rng.randint(-20, 780), rng.randint(-10, 390)
            right, bottom = left + rng.choice((5, 60, 150, 300)), top + rng.choice((4, 12, 40, 90))
            points = [(float(left), float(top)), (float(right), float(top)), (float(right), float(bottom)), (float("inf") if rng.random() < 0.03 else float(left), float(bottom))]
            tokens[doc].append((points, rng.choice(texts), rng.randint(1, 100) / 100))
            rows.append((doc, k, *tokens[doc][-1]))
    table = spark.createDataFrame(rows, "doc_id long, token_id long, points array<struct<x:double,y:double>>, text string, score double")
    frame = spark.createDataFrame([(doc, r, c) for doc, (r, c) in axes.items()], "doc_id long, rows array<bigint>, cols array<bigint>")
    placed = tk.place_tokens(table.repartition(3), frame).persist()
    want = {doc: brute_place(tokens[doc], *axes[doc]) for doc in axes}
    assert {(r.doc_id, r.row_idx, r.col_idx, r.y, r.x, r.text, r.score) for r in placed.collect()} == {(doc, *at, *e) for doc, cells in want.items() for at, es in cells.items() for e in es}
    found = {(r.doc_id, r.row_idx, r.col_idx): (r.text, round(r.confidence, 9)) for r in tk.read_cells(placed, frame).collect()}
    distinct_y = {(doc, *at): brute_read(es, axes[doc][0][at[0] + 1] - axes[doc][0][at[0]]) for doc, cells in want.items() for at, es in cells.items()}
    assert found == distinct_y


def test_one_number_moves_left(spark):
    at = lambda x: [(x, 2.0), (x + 50, 2.0), (x + 50, 10.0), (x, 10.0)]
    # two fused tokens in one cell, then one over a line that stays whole on its left
    rows = [(1, 0, at(210.0), "12.345S/s", 0.9), (1, 1, at(212.0), "23.456S/s", 0.9), (1, 2, at(475.0), "34.567S/s", 0.9)]
    tokens = spark.createDataFrame(rows, "doc_id long, token_id long, points array<struct<x:double,y:double>>, text string, score double")
    axes = spark.createDataFrame([(1, [0, 20], [0, 100, 200, 300, 400, 500, 600])], "doc_id long, rows array<bigint>, cols array<bigint>")
    found = {(r.token_id, r.col_idx, r.text, r.score) for r in tk.place_tokens(tokens, axes).collect()}
    assert found == {(0, 1, "12.34", 0.9), (0, 2, "5S/s", 0.9), (1, 2, "23.456S/s", 0.9), (2, 4, "34.567S/s", -1.0)}


def test_reading_order_of_lines(spark):
    placed = spark.createDataFrame([(1, k, 0, 0, 0, float(x), float(y), t, 0.5) for k, (x, y, t) in enumerate([(50, 10, "b"), (10, 11, "a"), (30, 20, "d"), (5, 21, "c"), (1, 30, "")])], "doc_id long, token_id long, part int, row_idx int, col_idx int, x double, y double, text string, score double")
    axes = spark.createDataFrame([(1, [0, 40], [0, 100])], "doc_id long, rows array<bigint>, cols array<bigint>")
    assert [(r.text, r.confidence) for r in tk.read_cells(placed, axes).collect()] == [("a b c d", 0.5)]


def test_spans_from_separators(spark):
    def seps(missing):
        v = [(1, "v", r, c, 0.02 if ("v", r, c) in missing else 0.9) for r in range(4) for c in range(3)]
        return spark.createDataFrame(v + [(1, "h", r, c, 0.02 if ("h", r, c) in missing else 0.9) for r in range(3) for c in range(4)], "doc_id long, orientation string, row_idx int, col_idx int, support double")

    square = {("v", 1, 1), ("v", 2, 1), ("h", 1, 1), ("h", 1, 2)}
    assert [tuple(r)[1:] for r in sp.spans_from_separators(seps(square)).collect()] == [(1, 1, 2, 2)]
    assert sp.spans_from_separators(seps({("v", 1, 1), ("h", 1, 1)})).count() == 0  # an L is no region


def test_structure(spark):
    spans = spark.createDataFrame([], "doc_id long, span_id int, row_idx int, col_idx int, row_span int, col_span int, role string")
    table = grid(spark, ["Title", "", "", "", "", ""], ["a", "b", "c", "d", "e", "f"], ["1", "2", "3", "4", "5", "6"])
    assert texts(st.drop_rows(table, st.caption_rows(table, spans)))[0] == ["a", "b", "c", "d", "e", "f"]
    letters = grid(spark, ["A", "B", "C"], ["x", "y", "z"])
    assert texts(st.drop_rows(letters, st.column_letter_rows(letters, spans))) == [["x", "y", "z"]]
    assert texts(st.trim_extent(grid(spark, ["a", ""], ["", ""]))) == [["a"]]
    assert texts(st.collapse_wrapped(grid(spark, ["a", "b"], ["c", ""], ["d", "e"]), spark.createDataFrame([(1, 1)], "doc_id long, row_idx int"))) == [["a c", "b"], ["d", "e"]]
    assert texts(st.merge_unit_columns(grid(spark, ["5", "kg", "x"], ["6", "kg", "y"]))) == [["5 kg", "x"], ["6 kg", "y"]]


def test_markup(spark):
    html = '<table><tr><td rowspan="2">a</td><td colspan="x">b<br>c</td></tr><tr><td>d</td><td>lost</tr><tr><td rowspan="999999">e</td></tr>'
    assert rd.markup_cells(html) == [(0, 0, "a", 2, 1), (0, 1, "b c", 1, 1), (1, 1, "d", 1, 1), (2, 0, "e", 1022, 1)]
    assert rd.markup_cells(None) == [] and rd.markup_cells("plain") == []


def test_request_errors(spark):
    lines = [text for text, _, _ in REQUESTS]
    found = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, raw string").select("k", gt.request_error(F.col("raw")).alias("e"))
    told = {r.k: (r.e.code, r.e.field) if r.e else (None, None) for r in found.collect()}
    assert told == {k: (code, at) for k, (_, code, at) in enumerate(REQUESTS)}
    base = '{"protocol":1,"action":"recognize","image_path":"a","options":{"deadline_seconds":%s}}'
    odd = ["NaN", "1e400", "-0.5", "null", '"5"', "0", "1.5", "7"]
    codes = column(spark, [base % x for x in odd], lambda c: gt.request_error(c)["code"])
    assert codes == ["INVALID_REQUEST", "INVALID_OPTION", "INVALID_OPTION", "INVALID_OPTION", "INVALID_OPTION", None, None, None]
    assert column(spark, [None, '{"protocol":true,"action":"health"}', '{"protocol":1.0,"action":"warmup","request_id":null}'], lambda c: gt.request_error(c)["code"]) == ["INVALID_REQUEST", None, "INVALID_REQUEST"]
    assert len(gt.ERROR_CODES) == 19 and {c for _, c, _ in REQUESTS if c} <= {c for c, _, _ in gt.ERROR_CODES}


def test_sampling(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)], "s string, i long")
    assert sorted(r.i for r in sm.evenly_spaced(rows, 4, "s", "i").collect()) == [0, 3, 6, 9]
    assert [r.i for r in sm.evenly_spaced(rows, 1, "s", "i").collect()] == [4]
    with pytest.raises(Exception, match="too few rows"):
        sm.evenly_spaced(rows, 11, "s", "i").collect()


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿case_id,source\nB2,\nB1,x\n".encode())
    assert [(r.case_id, r.source, r.split) for r in rd.read_manifest(spark, str(tmp_path / "m.csv"), limit=5).collect()] == [("B1", "x", "development"), ("B2", "local", "development")]
    cells = grid(spark, ["=1", 'a,"b"'], ["", "x\ny"])
    assert wr.roundtrip_differences(cells, str(tmp_path / "csv")).count() == 0
    assert [tuple(r) for r in wr.roundtrip_check(cells, str(tmp_path / "again")).collect()] == [(1, 4, True)]
    odd = spark.createDataFrame([(5, '\ufeff"a""b\r\n,",\r\n,"""\n"\r\n')], "doc_id long, csv string")
    assert sorted(tuple(r) for r in rd.parse_csv_texts(odd).collect()) == [(5, 0, 0, 'a"b\r\n,'), (5, 0, 1, ""), (5, 1, 0, ""), (5, 1, 1, '"\n')]
    assert wr.csv_texts(cells).first().csv == "﻿'=1,\"a,\"\"b\"\"\"\r\n,\"x\ny\"\r\n"
    wr.write_summary(cells, str(tmp_path / "summary"))
    assert wr.write_manifest(cells.drop("text"), str(tmp_path / "manifest")) == 4
    wr.publish(cells, str(tmp_path / "out"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        wr.publish(cells, str(tmp_path / "out"))
    files = rd.file_inventory(spark, str(tmp_path / "out"))
    assert files.count() >= 1 and {r.subtree for r in rd.subtree_sizes(rd.file_inventory(spark, str(tmp_path)), str(tmp_path)).collect()} >= {"out", "csv"}


def test_delivery_facts(spark, tmp_path):
    root = tmp_path / "pack.git"
    files = {"body/a.bin": 3000, "body/deep/b.bin": 1000, "licenses/x.txt": 500, "read me": 48, "body/__pycache__/c.bin": 9, "body/d.PYC": 9, "body/e.tmp": 9}
    for name, size in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    (root / "body" / ".git").mkdir()
    (root / "body" / ".git" / "f").write_bytes(b"x")
    for path in (str(root), root.as_uri()):
        listed = rd.file_inventory(spark, path)
        facts = rd.delivery_facts(listed, path, "body").drop("body_newest").first().asDict()
        assert facts == {"package_files": 4, "package_bytes": 4548, "body_files": 2, "body_bytes": 4000, "root_files": 1, "license_files": 1, "extra_files": 2, "delta_kb": 1}
        assert {(r.subtree, r.files, r.bytes) for r in rd.subtree_sizes(listed, path).collect()} == {("body", 2, 4000), ("licenses", 1, 500), ("", 1, 48)}
    none = rd.delivery_facts(listed, str(tmp_path / "elsewhere"), "body").first()
    assert (none.package_files, none.package_bytes, none.body_newest, none.delta_kb) == (0, 0, None, 0)


def test_numbering_within_groups(spark):
    rng = random.Random(2)
    places = [*range(300), *rng.sample(range(300, 90_000), 300), *range(95_000, 95_300)]
    rows = [(rng.choice(["a", "a", "b", None]), i) for i in places]
    frame = spark.createDataFrame(rows, "s string, i long")
    for by in (None, "s"):
        found = {(r.s, r.i): r.n for r in sm.numbered(frame, "n", "i", by).collect()}
        for group in {s for s, _ in rows} if by else {0}:
            some = sorted(i for s, i in rows if not by or s == group)
            keys = {i: s for s, i in rows}
            assert [found[keys[i], i] for i in some] == list(range(len(some)))


def missing(cells, n_rows, n_cols):
    """Separators of a grid, of which those between ``cells`` (row and column ranges) are absent."""
    rows, cols = cells
    inside = lambda r, c: r in rows and c in cols
    v = [(1, "v", r, c, 0.05 if inside(r, c) and inside(r, c + 1) else 0.9) for r in range(n_rows) for c in range(n_cols - 1)]
    return v + [(1, "h", r, c, 0.05 if inside(r, c) and inside(r + 1, c) else 0.9) for r in range(n_rows - 1) for c in range(n_cols)]


@pytest.mark.parametrize("rows, cols, n_rows, n_cols", [(range(1), range(40), 40, 40), (range(2, 5), range(30), 12, 60), (range(1, 29), range(3, 4), 60, 9), (range(0, 1), range(0, 1100), 4, 2300)])
def test_merged_regions_of_any_size(spark, rows, cols, n_rows, n_cols):
    separators = spark.createDataFrame(missing((rows, cols), n_rows, n_cols), "doc_id long, orientation string, row_idx int, col_idx int, support double")
    (found,) = sp.spans_from_separators(separators).collect()
    assert tuple(found)[1:] == (rows[0], cols[0], len(rows), len(cols))


def test_chains_of_readings_end_in_the_longest(spark):
    chain = ["2", "20", "205", "2051", "20512", "205123"]
    read = spark.createDataFrame([(1, 0, 0, f"f{k}", k, t, 0.6 + k / 100) for k, t in enumerate(chain)], "doc_id long, row_idx int, col_idx int, family string, reading_no int, text string, score double")
    (found,) = cs.merge_truncated(cs.votes(read)).collect()
    assert (found.text, found.votes, found.best, found.least) == ("205123", 6, 0.65, 0.6)


def brute_merge(readings):
    """F2 of one cell, one reading at a time: {text: votes} before and after."""
    inside = lambda s, t: (lambda it: all(c in it for c in s))(iter(t))
    bare = lambda t: "".join(c for c in t if c.isascii() and c.isalnum())
    into = {}
    for text in readings:
        longer = sorted((t for t in readings if len(t) > len(text) > 0 and inside(text, t)), key=lambda t: (len(t), t))
        nested = all(inside(a, b) for a, b in zip(longer, longer[1:]))
        if longer and nested and bare(longer[0]) != bare(text) and readings[longer[0]][1] >= cs.FLOOR:
            into[text] = longer[0]
    out = {}
    for text, (votes, _) in readings.items():
        while text in into:
            text = into[text]
        out[text] = out.get(text, 0) + votes
    return out


def test_merging_against_brute_force(spark):
    rng = random.Random(14)
    rows, cells = [], {}
    for cell in range(150):
        for k in range(rng.randrange(1, 8)):
            text = "".join(rng.choice("12a-") for _ in range(rng.randrange(0, 5)))
            score = rng.choice((0.3, 0.55, 0.9))
            rows.append((1, cell, 0, f"f{k}", k, text, score))
            n, best = cells.setdefault(cell, {}).get(text, (0, 0))
            cells[cell][text] = (n + 1, max(best, score))
    read = spark.createDataFrame(rows, "doc_id long, row_idx int, col_idx int, family string, reading_no int, text string, score double")
    found = {}
    for r in cs.merge_truncated(cs.votes(read)).collect():
        found.setdefault(r.row_idx, {})[r.text] = r.votes
    assert found == {cell: brute_merge(readings) for cell, readings in cells.items()}


def test_similarity_of_long_and_empty_texts(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghij ") for _ in range(10_000))
    pairs = [(long, long[:5000] + "x" + long[5000:]), ("", ""), ("", "a"), ("a", ""), (None, "a"), ("a", None), ("abc", "abd")]
    found = spark.createDataFrame(pairs, "a string, b string").select(ev.sequence_similarity("a", "b").alias("s")).collect()
    want = [SequenceMatcher(None, a, b).ratio() if a and b is not None else None for a, b in pairs]
    assert [r.s for r in found] == want


def test_similarity_of_short_texts_and_edits(spark):
    """Texts that are searched block by block against difflib, and distances within and beyond the band."""
    rng = random.Random(3)
    pairs = []
    for n in range(600):
        letters = "abcdefgh 01"[: rng.randint(1, 11)]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 230)))
        b = [c for c in a if rng.random() < 0.95 - n % 4 * 0.2]
        pairs.append((a, "".join(b + [rng.choice(letters)] * rng.randint(0, 3)) if n % 7 else a))
    both = spark.createDataFrame(pairs, "a string, b string")
    found = both.select("a", "b", ev.sequence_similarity("a", "b").alias("s"), ev.edits("a", "b").alias("few"), F.levenshtein("a", "b").alias("all")).collect()
    assert all(r.s == SequenceMatcher(None, r.a, r.b).ratio() and r.few == r["all"] for r in found)


def test_texts_of_documents_are_their_cells(spark, data):
    side = lambda f, n: f.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "col_idx", "text"))).alias("c")).select("doc_id", F.array_join("c.text", " ").alias(n))
    want = side(fx.cells_truth(spark, data), "a").join(side(fx.cells_actual(spark, data), "b"), "doc_id")
    assert sorted(map(tuple, fx.texts_of_documents(spark, data).collect())) == sorted(map(tuple, want.collect()))


def test_numbers_and_folding(spark):
    assert column(spark, ["12kilo 5kg 7 3units", "v12 -3.5% x.7", "1,234.5abc٣ 4"], tx.numeric_tokens) == [["12kilo", "5kg", "7", "3units"], ["-3.5%"], ["1,234.5abc", "4"]]
    texts = ["Straße", "ΑΣ ας", "ﬁne ı I İ", "ſ µ", None]
    assert column(spark, texts, tx.normalize_text) == [None if t is None else "".join(t.split()).casefold() for t in texts]


def test_annotation_strings_in_their_order(spark):
    raw = ['{"words":"abc","form":["x"]}', '{"value":"v","other":"o","cells":[{"text":" ","transcription":"t","form":"f"},{"text":"s","form":"g"}]}', '["a",{"b":"c"}," "]', "7", "bad"]
    assert column(spark, raw, rd.collect_strings()) == [["abc", "x"], ["v", "t", "s"], ["a"], [], None]
    assert column(spark, raw, rd.collect_strings(False)) == [["abc", "x"], ["v", "o", "t", "f", "s", "g"], ["a", "c"], [], None]


def test_fingerprints_differ(spark):
    row = spark.createDataFrame([("a|b", None, "c")], "x string, y string, z string")
    parts = [("x", "z"), ("x", "y", "z"), ("y", "x", "z"), ("z", "x")]
    made = row.select(*(sp.geometry_fingerprint(*(F.col(c) for c in p)).alias(str(k)) for k, p in enumerate(parts)), sp.geometry_fingerprint(F.lit("a"), F.lit("b|c")).alias("p"), sp.geometry_fingerprint(F.lit("a|b"), F.lit("c")).alias("q")).first()
    assert len(set(made)) == 5 and made["0"] == made["q"]


def brute_extend(at, line, extent, most=8):
    """C12 step by step, and nearby positions merged at the end."""
    gaps = [b - a for a, b in zip(at, at[1:])]
    few = [g for g in gaps if g <= np.percentile(gaps, 70)] or gaps
    typical, peak = float(np.median(few)), max(line.values())
    out = list(at)
    for side in (-1, 1):
        for _ in range(most):
            edge = min(out) if side < 0 else max(out)
            guess = round(edge + side * typical)
            near = [p for p in line if abs(p - guess) <= max(5, round(typical * 0.22))]
            if not min(line) <= guess <= max(line) or not near or typical < 6:
                break
            best = max(near, key=lambda p: (line[p], -p))
            if line[best] < max(extent, peak) * 0.1 or abs(abs(best - edge) - typical) > typical * 0.36:
                break
            out.append(best)
    groups = []
    for p in sorted(out):
        if groups and p - groups[-1][-1] <= 5:
            groups[-1].append(p)
        else:
            groups.append([p])
    return [round(sum(g) / len(g)) for g in groups]


def test_extending_against_brute_force(spark):
    rng = random.Random(10)
    positions, profile, want = [], [], {}
    for series in range(25):
        step, start = rng.randrange(8, 30), rng.randrange(40, 120)
        at = [start + k * step + rng.randrange(-1, 2) for k in range(rng.randrange(5, 8))]
        line = {p: rng.randrange(0, 3) for p in range(400)}
        for k in range(-12, 20):
            p = start + k * step + rng.randrange(-3, 4)
            if p in line and rng.random() < 0.8:
                line[p] = rng.randrange(2, 40)
        positions += [(series, p) for p in at]
        profile += [(series, p, h) for p, h in line.items()]
        want[series] = brute_extend(at, line, 30)
    found = ps.extend_sequence(spark.createDataFrame(positions, "series_id long, pos long"), spark.createDataFrame(profile, "series_id long, pos long, strength long"), 30)
    got = {}
    for r in found.collect():
        got.setdefault(r.series_id, []).append(r.pos)
    assert {k: sorted(v) for k, v in got.items()} == want


def series_of(spark, made):
    """positions and profile as tables, of {series: (positions, {pos: strength})}."""
    at = spark.createDataFrame([(k, p) for k, (ps_, _) in made.items() for p in ps_], "series_id long, pos long")
    line = spark.createDataFrame([(k, p, v) for k, (_, line) in made.items() for p, v in line.items()], "series_id long, pos long, strength long")
    return at, line


def random_series(seed, steps=(3, 20, 20, 20, 8, 40)):
    rng = random.Random(seed)
    made = {}
    for k in range(40):
        at = np.cumsum([rng.choice(steps) for _ in range(rng.randint(4, 16))]).tolist()
        made[k] = at, {p: rng.randint(0, 12) for p in range(0, at[-1] + 30)}
    return made


def by_series(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.series_id, []).append(r.pos)
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("faint", [False, True])
def test_robust_maxima_against_brute_force(spark, faint):
    """Samples of random lines across, some weak, uneven or near a border, against numpy over whole arrays."""
    draw = np.random.default_rng(6)
    rows, wanted = [], set()
    for series in range(12):
        width, lines = int(draw.integers(60, 2400)), 9
        grid = draw.integers(0, 16, (lines, width)).astype(float)
        for pos in draw.integers(0, width, 25):
            grid[:, pos] = draw.choice((33, 45, 80)) + draw.integers(0, 4, lines)
            if draw.random() < 0.4:
                grid[draw.random(lines) < 0.4, pos] = draw.choice((2, 200))
        rows += [(series, y, x, float(grid[y, x])) for y in range(lines) for x in range(width)]
        median, upper = np.median(grid, axis=0), np.quantile(grid, 0.75, axis=0)
        steady, covered = median / (upper + 1), (grid > 12).mean(axis=0)
        score = median * covered * (1 if faint else steady)
        valid = (median >= 30) & (covered >= 0.75) if faint else (median >= 40) & (steady >= 0.35) & (covered >= 0.5)
        peaks = [x for x in range(5, width - 5) if valid[x] and score[x] >= score[x - 5 : x + 6].max()]
        kept = []
        for x in sorted(peaks, key=lambda x: -score[x]):
            if all(abs(x - k) >= max(12, width // 100) for k in kept):
                kept.append(x)
        wanted |= {(series, x) for x in kept}
    samples = spark.createDataFrame(rows, "series_id long, line long, pos long, strength double")
    widths = samples.groupBy("series_id").agg((F.max("pos") + 1).alias("width"))
    found = {tuple(r) for r in ps.robust_maxima(samples, widths, faint).collect()}
    assert found == wanted and len(found) > 30


def test_local_maxima_against_brute_force(spark):
    made = random_series(1)
    found = by_series(ps.local_maxima(series_of(spark, made)[1]))
    assert len(found) > 30
    for k, (_, line) in made.items():
        top = {p: v for p, v in line.items() if v > 0 and all(line.get(q, 0) <= v for q in range(p - 5, p + 6))}
        kept = found.get(k, [])
        assert set(kept) <= set(top) and all(b - a >= 12 for a, b in zip(kept, kept[1:]))
        # whatever isn't kept is near one that goes before it
        assert all(any(abs(p - q) < 12 and (-top[q], q) <= (-top[p], p) for q in kept) for p in top)


def brute_drop(at, line, named):
    at = sorted(at)
    support = {p: sum(line.get(q, 0) for q in range(p - 2, p + 3)) for p in at}
    while len(at) >= 5:
        gone = named(at, support)
        if gone is None:
            break
        at.remove(gone)
    return at


def test_dropped_positions_against_brute_force(spark):
    def split(at, support):
        typical = median(b - a for a, b in zip(at, at[1:]))
        for a, p, b in zip(at, at[1:], at[2:]):
            least = min(support[a], support[b])
            thin = min(p - a, b - p) <= typical * 0.22 and support[p] <= least * 0.15
            half = max(p - a, b - p) <= typical * 0.72 and abs(b - a - typical) <= typical * 0.35 and support[p] < least * 0.7
            if thin or half:
                return p
        return None

    def double(at, support):
        wide = [b - a for a, b in zip(at, at[1:]) if b - a >= 8]
        close = [(a, b) for a, b in zip(at, at[1:]) if wide and b - a <= max(7, median(wide) * 0.22)]
        return None if not close else close[0][0] if support[close[0][0]] <= support[close[0][1]] else close[0][1]

    for seed, rule, named in ((2, ps.remove_weak_splits, split), (3, ps.collapse_double, double)):
        rng, made, changed = random.Random(seed), {}, 0
        for k in range(40):
            strong = [20 * i for i in range(rng.randint(4, 12))]
            weak = {p + rng.choice((3, 4, 9, 10, 11)) for p in strong if rng.random() < 0.4}
            line = {p: rng.choice((0, 1, 8)) if any(abs(p - w) <= 2 for w in weak) else rng.randint(6, 12) for p in range(strong[-1] + 30)}
            made[k] = sorted({*strong, *weak}), line
        found = by_series(rule(*series_of(spark, made)))
        for k, (at, line) in made.items():
            want = brute_drop(at, line, named)
            changed += len(want) < len(at)
            assert found[k] == want
        assert changed > 5
