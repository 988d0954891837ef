"""Keeps columns of the caller apart from those that an operator makes."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame


def shielded(docs: DataFrame, used: Collection[str], op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``op(docs)`` with the columns of ``docs``, whatever their names; ``op`` sees the names in ``used`` and gives back the columns that it gets.

    All other columns have plain names of their own meanwhile, so that they
    meet none of the operator's and need no quoting.
    """
    names = docs.columns
    plain = docs.toDF(*[n if n in used else f"_gf_column_{i}" for i, n in enumerate(names)])
    return op(plain).toDF(*names)
