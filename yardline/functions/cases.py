"""CASE expressions built from tables of conditions."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(branches: Iterable[tuple[Column, Any]], otherwise: Any = None) -> Column:
    """Value of the first condition that holds, like SQL's CASE WHEN."""
    (condition, value), *rest = branches
    case = F.when(condition, value)
    for condition, value in rest:
        case = case.when(condition, value)
    return case.otherwise(otherwise)
