"""Strict loading of delimited lines, with the rejected lines set aside.

Method: strict load plus anti-join. Every physical line keeps its offset (a
unique key). Only lines that fully conform are loaded; subtracting their offsets
from all offsets leaves the rejects, and only those are diagnosed.

The whole parser is built from JVM expressions. A line is split at its quotes:
in a soundly quoted line the pieces alternate between outside and inside of
quotes, and every outside piece but the first and last either is empty (a
doubled quote) or runs from comma to comma. Nothing here backtracks, so
very long lines are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a number may look like once quotes and outer blanks are gone; fixed values. \z, as $ also matches before a final line end.
NUMBER = r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:-?inf|nan))?\z"

BROKEN, COUNT, INVALID = "broken_quoting", "column_count", "invalid_value"


def _line(text: Column) -> Column:
    """The line without its final carriage return; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.endswith("\r"), F.expr("substring(_text, 1, length(_text) - 1)")).otherwise(text)


def _pieces(line: Column) -> Column:
    return F.split(line, '"', -1)


def sound_quoting(line: Column) -> Column:
    """Whether every quote opens a field, closes one before a comma or the end, or is doubled inside one."""
    p = _pieces(line)
    n = F.size(p)

    def piece_ok(s: Column, i: Column) -> Column:
        edge_left = (i == 0) | s.startswith(",")
        edge_right = (i == n - 1) | s.endswith(",")
        doubled = (s == "") & (i > 0) & (i < n - 1)
        opening = (i == 0) & ((s == "") | s.endswith(","))
        closing = (i == n - 1) & ((s == "") | s.startswith(","))
        middle = (i > 0) & (i < n - 1) & edge_left & edge_right
        return (i % 2 == 1) | doubled | opening | closing | middle

    whole = F.forall(F.transform(p, lambda s, i: piece_ok(s, i)), lambda ok: ok)
    return (n == 1) | ((n % 2 == 1) & whole)


def fields(line: Column) -> Column:
    """The fields of a soundly quoted line, quotes removed and doubled quotes undone.

    Commas inside quotes travel as an escape sequence while the line is cut at
    its commas; the escape sign itself is escaped too, so any text survives.
    """
    p = _pieces(line)
    n = F.size(p)
    esc = F.replace(line, F.lit("\x01"), F.lit("\x010"))
    q = _pieces(esc)
    joined = F.array_join(
        F.transform(
            q,
            lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit(","), F.lit("\x011")))
            .when((s == "") & (i > 0) & (i < n - 1), F.lit('"'))
            .otherwise(s),
        ),
        "",
    )
    cut = F.transform(
        F.split(joined, ",", -1),
        lambda s: F.replace(F.replace(s, F.lit("\x011"), F.lit(",")), F.lit("\x010"), F.lit("\x01")),
    )
    return F.when(line.contains('"'), cut).otherwise(F.split(line, ",", -1))


def _parsed(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, _fields: null for unsound quoting."""
    out = lines.select(F.col(key), F.col(text).alias("_text"))
    out = out.select(key, _line(F.col("_text")).alias("_line"))
    return out.select(key, "_line", F.when(sound_quoting(F.col("_line")), fields(F.col("_line"))).alias("_fields"))


def _numbers_ok(first: int, count: int) -> Column:
    return F.forall(F.slice("_fields", first + 1, count), lambda v: F.trim(v).rlike(NUMBER))


def load_strict(
    lines: DataFrame, columns: list[str], num_cols: list[str], *, key: str = "line_id", text: str = "raw_text"
) -> DataFrame:
    """Load the lines that conform; ``num_cols`` must be adjacent in ``columns``.

    Numbers are trimmed and cast (empty and ``nan`` texts give null and NaN), all
    other fields are kept as they stand with empty fields as null. Lines that are
    null, empty, unsoundly quoted, of another width or with a bad number are left
    out; an empty table gives an empty table. Columns of ``lines`` other than
    the key are not carried, so clashing names do no harm.
    """
    first = columns.index(num_cols[0])
    good = _parsed(lines, key, text).filter(
        F.col("_fields").isNotNull() & (F.size("_fields") == len(columns)) & _numbers_ok(first, len(num_cols))
    )
    numeric = set(num_cols)

    def out(i: int, name: str) -> Column:
        raw = F.get("_fields", F.lit(i))
        if name in numeric:
            return F.expr(f"try_cast(nullif(trim(get(_fields, {i})), '') as double)").alias(name)
        return F.nullif(raw, F.lit("")).alias(name)

    return good.select(key, *[out(i, c) for i, c in enumerate(columns)])


def diagnose(
    rejected: DataFrame, width: int, first_num: int, n_num: int, *, key: str = "line_id", text: str = "raw_text"
) -> DataFrame:
    """(key, reason): the first of broken quoting, column count, invalid value that applies."""
    reason = (
        F.when(F.col("_fields").isNull(), BROKEN)
        .when(F.size("_fields") != width, COUNT)
        .when(~_numbers_ok(first_num, n_num), INVALID)
    )
    return _parsed(rejected, key, text).select(key, reason.alias("reason"))


def split_load(
    lines: DataFrame, columns: list[str], num_cols: list[str], *, key: str = "line_id", text: str = "raw_text"
) -> tuple[DataFrame, DataFrame]:
    """(loaded rows, rejects with the reason). ``key`` must identify a line."""
    loaded = load_strict(lines, columns, num_cols, key=key, text=text)
    raw = lines.select(key, text)
    rejected = raw.join(loaded.select(key), key, "left_anti")
    reasons = diagnose(rejected, len(columns), columns.index(num_cols[0]), len(num_cols), key=key, text=text)
    return loaded, reasons
