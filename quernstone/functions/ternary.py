"""Three-valued logic: TRUE, FALSE and UNKNOWN are the values of a nullable boolean column, NULL being UNKNOWN.

SQL's AND and OR on such columns are Kleene's, so conjunction and disjunction over a list need no code of their own; what
is here are the aggregate forms and the two places where an open world must not collapse to FALSE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def all_of(columns: list[Column]) -> Column:
    """FALSE dominates, else UNKNOWN, else TRUE; TRUE for no columns."""
    return F.lit(True) if not columns else reduce(lambda a, b: a & b, columns)


def any_of(columns: list[Column]) -> Column:
    """TRUE dominates, else UNKNOWN, else FALSE; FALSE for no columns."""
    return F.lit(False) if not columns else reduce(lambda a, b: a | b, columns)


def agg_all(c: Column) -> Column:
    """all_of() over the rows of a group."""
    return F.when(F.coalesce(F.bool_or(~c), F.lit(False)), False).when(F.bool_and(c.isNotNull()), True)


def agg_any(c: Column) -> Column:
    """any_of() over the rows of a group."""
    return F.when(F.coalesce(F.bool_or(c), F.lit(False)), True).when(F.bool_and(c.isNotNull()), False)


def holds(c: Column) -> Column:
    """Whether something is TRUE: a rule fires on nothing else."""
    return F.coalesce(c, F.lit(False))


def some(values: Column, test) -> Column:
    """Open world: TRUE if some value passes, else UNKNOWN, never FALSE."""
    return F.when(F.exists(values, test), True)
