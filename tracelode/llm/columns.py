"""Column names of inputs beside those that an operator adds; Spark compares names without regard to case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def others(df: DataFrame, own: tuple[str, ...] | list[str]) -> list[str]:
    """The columns of ``df`` that none of the names in ``own`` replaces."""
    taken = {n.lower() for n in own}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores after it where the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def free_prefix(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores after it as long as some column's name starts with it."""
    while any(c.lower().startswith(wish.lower()) for c in df.columns):
        wish += "_"
    return wish


def ddl(df: DataFrame, names: list[str]) -> str:
    """Names and types of the columns, for mapInArrow."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)
