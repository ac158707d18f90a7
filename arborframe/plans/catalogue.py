"""Declared models: their fields, labels and relations, and schemas composed from them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType

#: Names of scalar types.
SCALARS: dict[str, DataType] = {"str": StringType(), "int": LongType(), "float": DoubleType(), "bool": BooleanType(), "date": DateType(), "datetime": TimestampType()}


def snake_case(name: str) -> str:
    """A class's name as a field's: a word starts at a capital after a small letter, or before one."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def parse_type(text: str) -> DataType:
    """A type annotation's text as a type; what is unknown is a string (JSON, for anything nested)."""
    text = text.strip().removeprefix("typing.")
    if text.endswith("| None"):
        return parse_type(text.removesuffix("| None"))
    outer = re.fullmatch(r"(\w+)\s*\[(.*)\]", text, re.S)
    if not outer:
        return SCALARS.get(text, StringType())
    kind, inner = outer[1].lower(), _split(outer[2])
    if kind == "optional" and len(inner) == 1:
        return parse_type(inner[0])
    if kind in ("list", "set", "sequence") and len(inner) == 1:
        return ArrayType(parse_type(inner[0]))
    if kind == "dict" and len(inner) == 2:
        return MapType(parse_type(inner[0]), parse_type(inner[1]))
    return StringType()


def _split(text: str) -> list[str]:
    """The parts between commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@dataclass(frozen=True)
class Model:
    """A declared class: fields by name with a type's text; labels name fields that become entities."""

    name: str
    fields: dict[str, str]
    theme: str = "general"
    labels: dict[str, str] = field(default_factory=dict)
    keys: tuple[str, ...] = ()

    def references(self) -> list[tuple[str, str]]:
        """(field, class) where a field's type names another class, or a list of one."""
        found = [(f, re.fullmatch(r"(?:list\[)?([A-Z]\w*)\]?", t)) for f, t in self.fields.items()]
        return [(f, m[1]) for f, m in found if m]


class Catalogue:
    def __init__(self, declared: Iterable[Model]):
        self.declared = {m.name: m for m in declared}

    def reachable(self, roots: Iterable[str]) -> list[str]:
        """Classes that the roots refer to, nearest first; a class outside the catalogue has no references of its own."""
        order, queue = [], list(roots)
        for name in queue:
            if name in order or name not in self.declared:
                continue
            order.append(name)
            queue += [target for _, target in self.declared[name].references()]
        return order

    def schema(self, name: str, depth: int = 10) -> StructType:
        """A class as a type; below depth, and where a class contains itself, a reference is a string."""

        def build(model: Model, left: int, above: tuple[str, ...]) -> StructType:
            refs = dict(model.references())
            out = []
            for f, text in model.fields.items():
                inner = self.declared.get(refs.get(f, ""))
                if inner is None or left <= 1 or inner.name in above:
                    kind = parse_type(text)
                else:
                    kind = build(inner, left - 1, (*above, inner.name))
                    kind = ArrayType(kind) if text.startswith("list[") else kind
                out.append(StructField(f, kind))
            return StructType(out)

        return build(self.declared[name], depth, (name,))

    def composed(self, primary: str | None, complementary: Iterable[str] = (), supplementary: Iterable[tuple[str, str]] = ()) -> StructType:
        """One type for an extraction: a field per class, and free fields (name, type's text); the first of a name stays."""
        out = {snake_case(n): StructField(snake_case(n), self.schema(n)) for n in ([primary] if primary else []) + list(complementary)}
        for name, text in supplementary:
            out.setdefault(name, StructField(name, parse_type(text)))
        return StructType(list(out.values()))

    # -- as tables; their size is the number of declared classes

    def models(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, m.theme, list(m.fields.items())) for m in self.declared.values()]
        return spark.createDataFrame(rows, "model_class string, theme string, fields array<struct<name:string,type:string>>")

    def labels(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x,) for x in sorted({x for m in self.declared.values() for x in m.labels.values()})], "label string")

    def relations(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, "HAS_" + f.upper(), target) for m in self.declared.values() for f, target in m.references()]
        rows += [(m.name, "REFERENCES", label) for m in self.declared.values() for label in m.labels.values()]
        return spark.createDataFrame(rows, "source string, type string, target string")

    def themes(self, spark: SparkSession) -> DataFrame:
        """path, parent of each theme and of every folder above it."""
        paths = {"/".join(p[: i + 1]) for m in self.declared.values() for p in [m.theme.split("/")] for i in range(len(p))}
        return spark.createDataFrame([(p, p.rpartition("/")[0] or None) for p in sorted(paths)], "path string, parent string")


#: The classes of the sample graph, and one that nothing instantiates.
SAMPLE = Catalogue(
    [
        Model("Region", {"name": "str", "nation": "list[Nation]"}, "trade/places"),
        Model("Nation", {"name": "str", "customer": "list[Customer]"}, "trade/places"),
        Model("Customer", {"name": "str", "key": "int", "nation": "int", "segment": "str", "order": "list[Order]"}, "trade/sales", {"segment": "Segment"}, ("key",)),
        Model("Order", {"status": "str", "priority": "str", "key": "int", "customer": "int"}, "trade/sales", {"priority": "Priority"}, ("key",)),
        Model("Invoice", {"number": "str", "order": "Order", "currency": "str"}, "trade/sales", {"currency": "Currency"}, ("number",)),
        Model("Report", {"region": "Region"}),
        Model("Toxic", {"region": "Region"}),
    ]
)
