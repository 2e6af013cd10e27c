"""Text functions of cells: Column in, Column out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Digits that a spreadsheet keeps of a number.
SIGNIFICANT = 15
#: A number that a spreadsheet reads as it is written.
FAITHFUL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?$"
#: Wide and full-width characters.
WIDE = "[\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{1F300}-\\x{1F64F}\\x{1F900}-\\x{1F9FF}\\x{20000}-\\x{3FFFD}]"
#: Forms of units that mean the same, and the one that is kept.
UNITS = (("μ", "µ"), ("℃", "°C"), ("°°C", "°C"))


def case_folded(text: Column) -> Column:
    """Unicode case folding: upper case and then lower case also folds sharp s, ligatures and the like. The final sigma
    folds as any other, the dotless i stays."""
    upper = F.translate(F.upper(F.translate(text, "ı", "\ue000")), "\ue000", "ı")
    return F.translate(F.lower(upper), "ς", "σ")


def normalize_text(text: Column) -> Column:
    """G1: no white space, case folded."""
    return case_folded(F.regexp_replace(text, r"(?U)\s+", ""))


#: Fixed value: a number with sign, separators, and percent or unit letters, that doesn't go on a word or a number.
NUMBER = r"(?<![\w.])[+\-]?\d+(?:[.,]\d+)*(?:%|[A-Za-z]+)?"


def numeric_tokens(text: Column) -> Column:
    """Distinct numbers with sign, separators, and percent or unit letters, not inside a word."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + NUMBER), F.lit(0)))


def xml_safe(text: Column) -> Column:
    """Without code points that XML forbids; null is ""."""
    return F.coalesce(F.regexp_replace(text, "[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", ""), F.lit(""))


def display_text(value: Column) -> Column:
    """G4."""
    return F.coalesce(value.cast("string"), F.lit(""))


def display_width(text: Column) -> Column:
    """Of the widest line, with wide characters as two."""
    width = lambda line: F.length(line) + F.length(line) - F.length(F.regexp_replace(line, WIDE, ""))
    return F.array_max(F.transform(F.split(text, "\n"), width))


def wrapped_lines(text: Column, usable: int) -> Column:
    """Lines that a text takes in a column of ``usable`` characters."""
    need = lambda line: F.greatest(F.lit(1), F.ceil(display_width(line) / usable).cast("int"))
    return F.aggregate(F.transform(F.split(text, "\n"), need), F.lit(0), lambda a, b: a + b)


def significant_digits(number: Column) -> Column:
    """Digits of a plain decimal number without leading zeros, point and trailing zeros."""
    digits = F.replace(number, F.lit("."), F.lit(""))
    return F.length(F.regexp_replace(digits, "^0+|0+$", ""))


def needs_guard(text: Column) -> Column:
    """Whether a spreadsheet would run the text as a formula, or change it as a number."""
    mantissa = F.regexp_replace(F.regexp_replace(text, "^[+-]|%$", ""), "[eE].*$", "")
    # digits are only counted where there may be too many
    short = F.length(text) <= SIGNIFICANT
    faithful = text.rlike(FAITHFUL) & (short | (significant_digits(mantissa) <= SIGNIFICANT))
    plain = text.rlike(r"^(\d+\.?\d*|\.\d+)$")
    altered = plain & ((~short & (significant_digits(text) > SIGNIFICANT)) | (text.startswith("0") & ~text.contains(".")))
    formula = text.rlike(r"^[=@\t\r\n]")
    return F.when(F.length(text) <= 1, False).when(formula, True).when(text.rlike("^[+-]"), ~faithful).otherwise(altered)


def csv_guard(text: Column) -> Column:
    """An apostrophe before what needs it."""
    return F.when(needs_guard(text), F.concat(F.lit("'"), text)).otherwise(text)


def csv_quote(text: Column) -> Column:
    """Quoted where it has a comma, a quote or a control character; quotes doubled."""
    return F.when(text.rlike("[,\"\\x00-\\x1F]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def compact_number(text: Column) -> Column:
    """Blanks around points, slashes, dashes and colons between digits go; a mixed fraction ("1 1/2") and
    numbers side by side ("12 34") stay."""
    keeps = text.rlike(r"^\s*\d+\s+\d+\s*/\s*\d+\s*$")
    return F.when(keeps | ~text.rlike(r"^[\d\s.,/:%+-]+$"), text).otherwise(F.regexp_replace(text, r"(?<=\d)\s*([.,/:-])\s*(?=\d)", "$1"))


def restore_diameter(text: Column, header_says_so: Column) -> Column:
    """A leading 0 before "d x d" is a diameter sign; O, D or d is one where the header says so."""
    sized = r"(\d+(?:\.\d+)?\s*[x×]\s*\d+)"
    zero = F.regexp_replace(text, "^0" + sized, "Φ$1")
    letter = F.regexp_replace(text, "^[OoDd]" + sized, "Φ$1")
    return F.when(text.rlike("^0[1-9]") & text.rlike("^0" + sized), zero).when(header_says_so, letter).otherwise(text)


def restore_dash(text: Column) -> Column:
    """G11: "~" is a dash in identifiers and dates, not in ranges of numbers or with units."""
    span = text.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*[A-Za-z%°]*\s*~\s*[+-]?\d+(\.\d+)?\s*[A-Za-z%°]*\s*$") & ~text.rlike(r"^\d{4}~\d{1,2}")
    known = text.rlike(r"^[A-Za-z]+[A-Za-z0-9]*~[A-Za-z0-9~-]+$") | text.rlike(r"^\d{4}~\d{1,2}~\d{1,2}$")
    return F.when(known & ~span, F.replace(text, F.lit("~"), F.lit("-"))).otherwise(text)


def fix_reversed_percent(cells: DataFrame, repeats: int = 3) -> DataFrame:
    """G12: "%50" beside a "50%" in its column is that; a "%56" that its column repeats is read upside down,
    as 95%; any other stays."""
    w = W.partitionBy("doc_id", "col_idx")
    leading = F.regexp_extract("text", r"^%(\d+)$", 1)
    tail = F.concat(leading, F.lit("%"))
    turned = F.concat(F.reverse(F.translate(leading, "69", "96")), F.lit("%"))
    peers = F.collect_set("text").over(w)
    same = F.count("*").over(W.partitionBy("doc_id", "col_idx", "text"))
    can_turn = leading.rlike("^[01689]+$") | leading.rlike("^[569]+$")
    fixed = F.when(leading == "", F.col("text")).when(F.array_contains(F.col("peers"), tail), tail).when((F.col("same") >= repeats) & can_turn, turned).otherwise(F.col("text"))
    return cells.withColumns({"peers": peers, "same": same}).withColumn("text", fixed).drop("peers", "same")


def repair_case(cells: DataFrame, share: float = 0.8) -> DataFrame:
    """In a column of single letters that are mostly lower case, the others are lowered too."""
    w = W.partitionBy("doc_id", "col_idx")
    letter = F.col("text").rlike("^[A-Za-z]$")
    low = F.count_if(F.col("text").rlike("^[a-z]$")).over(w)
    some = F.count_if(letter).over(w)
    return cells.withColumn("fix", letter & (low >= share * some)).withColumn("text", F.when(F.col("fix"), F.lower("text")).otherwise(F.col("text"))).drop("fix")


def normalize_units(text: Column) -> Column:
    """G14."""
    for form, kept in UNITS:
        text = F.replace(text, F.lit(form), F.lit(kept))
    return text


def has_unknown_glyph(text: Column) -> Column:
    """G15."""
    return text.rlike("[\\x{FFFD}\\x{25A1}]")


def balanced(text: Column) -> Column:
    """As many closing as opening brackets of each kind."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (n("(") == n(")")) & (n("[") == n("]")) & (n("{") == n("}"))


def formula_confidence(text: Column, confidence: Column) -> Column:
    """Unbalanced brackets leave no more than the lower marker."""
    return F.when(balanced(text), confidence).otherwise(F.least(confidence, F.lit(0.77)))


#: Ids that one range may name.
MOST_IDS = 1_000_000


def locations(message: Column) -> Column:
    """The labels R#C# of a message, in order."""
    return F.regexp_extract_all(message, F.lit(r"R\d+C\d+"), F.lit(0))


def id_ranges(text: Column, prefix: str = "FC-") -> Column:
    """``1-3,FC-00009`` as ids: a range of numbers is counted out, padded to five digits; other parts stay as they
    are. A range that goes down has none. A text with a range that can't be read (1-2-3) or has more than ``MOST_IDS``
    is null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    low = lambda p: F.regexp_extract(p, r"^([0-9]+)-", 1).try_cast("long")
    high = lambda p: F.regexp_extract(p, r"-([0-9]+)$", 1).try_cast("long")
    is_range = lambda p: p.rlike("^[0-9-]*[0-9][0-9-]*$") & p.contains("-")
    good = lambda p: F.coalesce(p.rlike("^[0-9]+-[0-9]+$") & (high(p) - low(p) < MOST_IDS), F.lit(False))
    counted = lambda p: F.when(low(p) <= high(p), F.transform(F.sequence(low(p), high(p)), lambda n: F.concat(F.lit(prefix), F.when(n > 99_999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 5, "0"))))).otherwise(F.array().cast("array<string>"))
    one = lambda p: F.when(~is_range(p), F.array(p)).when(good(p), counted(p))
    return F.when(F.forall(parts, lambda p: ~is_range(p) | good(p)), F.flatten(F.transform(parts, one)))


def output_name(path: Column, suffix: str = ".xlsx", default: str = "table") -> Column:
    """The file's name without folders and extension, with the suffix; the default where nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.concat(F.when(base == "", default).otherwise(base), F.lit(suffix))


def duplicate_json_keys():
    """A column function: sorted names that some object of a JSON text repeats, at any depth that can be
    parsed; null where the text is no JSON."""

    @F.pandas_udf("array<string>")
    def repeated(raw: pd.Series) -> pd.Series:
        import json
        from collections import Counter

        def keys(text: str | None) -> list[str] | None:
            found: set[str] = set()

            def note(items: list[tuple]) -> None:
                found.update(k for k, n in Counter(k for k, _ in items).items() if n > 1)

            try:
                json.loads(text or "", object_pairs_hook=note)
            except (ValueError, RecursionError):
                return None
            return sorted(found)

        return pd.Series([keys(x) for x in raw], dtype=object)

    return repeated
