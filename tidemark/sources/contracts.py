"""Versioned dataset contracts, compiled to schemas and rule columns.

Everything is read as text first; a contract turns text into typed columns and an array of the rules that a
row breaks, so one pass over the input yields accepted and quarantined rows alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": "string", "boolean": "boolean", "integer": "bigint", "decimal": "decimal(18,4)", "date": "date", "timestamp": "timestamp_ntz", "object": "map<string,string>"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    prefix: str = ""
    optional: bool = False

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"{self.name}: no type {self.type}")


@dataclass(frozen=True)
class Contract:
    dataset: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    format: str = "csv"
    version: str = "1.0"
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def text_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.names])


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def parsed(c: Column, f: Field) -> Column:
    """The typed value of a text, null where it does not parse. Booleans are true and false alone, dates ISO dates."""
    if f.type == "string":
        return c
    t = F.trim(c)
    if f.type == "boolean":
        return F.when(F.lower(t) == "true", True).when(F.lower(t) == "false", False)
    if f.type == "date":
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    if f.type == "timestamp":
        zoned = F.regexp_replace(t, "Z$", "+00:00")
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_utc_timestamp(F.try_to_timestamp(zoned), F.current_timezone()).try_cast("timestamp_ntz"))
    if f.type == "object":
        return F.when(t.startswith("{"), F.from_json(t, "map<string,string>"))
    return t.try_cast(TYPES[f.type])


def typed(rows: DataFrame, contract: Contract) -> DataFrame:
    """Typed contract columns beside ``rules``, the broken rules as RULE:field; further columns pass through."""
    rules, values = [], []
    for f in contract.fields:
        raw, value = F.col(f.name), parsed(F.col(f.name), f)
        tests = [("FIELD_REQUIRED", blank(raw) & F.lit(not f.nullable)), ("FIELD_TYPE_INVALID", ~blank(raw) & value.isNull())]
        if f.low is not None:
            tests.append(("VALUE_BELOW_MINIMUM", value < f.low))
        if f.high is not None:
            tests.append(("VALUE_ABOVE_MAXIMUM", value > f.high))
        if f.prefix:
            tests.append(("IDENTIFIER_PREFIX_INVALID", ~blank(raw) & ~raw.startswith(f.prefix)))
        if f.allowed:
            tests.append(("CATEGORICAL_VALUE_INVALID", ~blank(raw) & ~raw.isin(*f.allowed)))
        rules += [F.when(test, F.lit(f"{rule}:{f.name}")) for rule, test in tests]
        values.append(F.when(~blank(raw), value).alias(f.name))
    rest = [c for c in rows.columns if c not in contract.names]
    return rows.select(*values, *rest, F.array_compact(F.array(*rules)).alias("rules"))


def drift(contract: Contract, columns: list[str], policy: str = "strict") -> list[tuple[str, str, str]]:
    """(finding, column, severity) for columns missing from or unknown to the contract.

    A missing required column is an error under any policy. strict also rejects missing optional ones, strict
    and compatible reject unknown ones, report-only only warns of both.
    """
    if policy not in ("strict", "compatible", "report-only"):
        raise ValueError(f"no policy {policy}")
    out = []
    for f in contract.fields:
        if f.name not in columns:
            out.append(("MISSING_OPTIONAL", f.name, "error" if policy == "strict" else "warning") if f.optional else ("MISSING_REQUIRED", f.name, "error"))
    out += [("UNEXPECTED_COLUMN", c, "warning" if policy == "report-only" else "error") for c in columns if c not in contract.names]
    return out


def loaded(text: str) -> dict[str, Contract]:
    """Contracts by dataset from a JSON list of objects with the fields of ``Contract``; unknown keys and repeated datasets are errors."""
    import json

    out: dict[str, Contract] = {}
    for given in json.loads(text):
        fields = tuple(Field(**{k: tuple(v) if k == "allowed" else v for k, v in f.items()}) for f in given["fields"])
        parents = {c: tuple(p) for c, p in given.get("foreign_keys", {}).items()}
        made = Contract(**{**given, "fields": fields, "key": tuple(given["key"]), "foreign_keys": parents})
        if made.dataset in out:
            raise ValueError(f"{made.dataset} has two contracts")
        out[made.dataset] = made
    return out
