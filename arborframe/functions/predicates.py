"""The predicate algebra: fourteen operators over columns, conjunctions only, three-valued like SQL's."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

#: Operator names and what they make of a column and a value.
_MAKE = {
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: c != F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "regex": lambda c, v: F.rlike(c, F.lit(f"\\A(?:{v})\\z")),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class Op:
    """An operator with its value."""

    name: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.name not in _MAKE:
            raise ValueError(f"unknown operator {self.name!r}")

    def on(self, c: Column) -> Column:
        return _MAKE[self.name](c, self.value)


def where(df: DataFrame, conditions: Mapping[str, Any] | None) -> DataFrame:
    """df with all conditions; a bare value means equality."""
    if not conditions:
        return df
    for name in conditions:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not an identifier: {name!r}")
        if name not in df.columns:
            raise ValueError(f"no such column: {name!r}")
    tests = [(v if isinstance(v, Op) else Op("eq", v)).on(F.col(k)) for k, v in conditions.items()]
    return df.where(reduce(lambda a, b: a & b, tests))
