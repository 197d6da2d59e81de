"""Expressions that normalise numbers, labels and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that surround a label; fixed values.
BLANKS = " \t\n\r\x0b\x0c"


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters (dots, blanks, back-ticks) the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(c) | (c == inf) | (c == -inf), F.lit(None)).otherwise(c)


def norm_label(c: Column) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))
