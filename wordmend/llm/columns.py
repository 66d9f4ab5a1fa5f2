"""Input columns under names that cannot clash with those an operator works with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(documents: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named ``c0``, ``c1`` …, and the new name of each column."""
    names = {name: f"c{i}" for i, name in enumerate(documents.columns)}
    return documents.toDF(*names.values()), names


def restored(names: dict[str, str], but: Sequence[str] = ()) -> list[Column]:
    """The columns under their own names, without some."""
    return [F.col(new).alias(name) for name, new in names.items() if name not in but]
