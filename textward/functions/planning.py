"""Ways to have an expression evaluated once, and a small table sent to the rows of a large one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evaluate_here(column: Column) -> Column:
    """The column, for a projection's list of columns, computed once and not repeated elsewhere in the plan.

    Spark pushes a filter below the projection that computes its column by writing the whole
    expression into the filter. For a costly expression that means doing the work twice, and for
    one built in layers the copies multiply until planning fails. It cannot do so with the output of a
    generator, so the column becomes one that makes a single row. Filters on other columns still pass below
    it, down to the scan, and columns that nobody asks for are not read. A projection takes one such column.
    """
    return F.explode(F.array(column))


# Rows of a table of words or the like that is broadcast for a join; beyond, it is joined as it comes.
SMALL = 200_000


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """The table, marked for a broadcast if it has few rows; it is counted, so it had better be a written one."""
    return F.broadcast(table) if table.count() <= SMALL else table
