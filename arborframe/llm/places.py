"""Places of matches from the lengths of what a pattern leaves and matches, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places that are appended one by one before they are put away as a whole, so that few are copied again.
PART = 256


def running(gaps: Column, found: Column) -> Column:
    """(s, e) of each match, from lengths: a gap in front of every match, and one after the last."""
    one = "array<struct<s:int,e:int>>"
    none, parts = F.array().cast(one), F.array().cast(f"array<{one}>")

    def step(acc: Column, i: Column) -> Column:
        s = acc["at"] + F.get(gaps, i)
        e = s + F.get(found, i)
        grown = F.concat(acc["part"], F.array(F.struct(s.alias("s"), e.alias("e"))))
        full = F.struct(e.alias("at"), none.alias("part"), F.concat(acc["parts"], F.array(grown)).alias("parts"))
        return F.when(F.size(acc["part"]) >= PART - 1, full).otherwise(F.struct(e.alias("at"), grown.alias("part"), acc["parts"].alias("parts")))

    start = F.struct(F.lit(0).alias("at"), none.alias("part"), parts.alias("parts"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: F.flatten(F.concat(acc["parts"], F.array(acc["part"]))))
    return F.when(F.size(found) > 0, walked).otherwise(none)
