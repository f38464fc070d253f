"""Concept specs: what a concept is and where each source keeps it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from staygrid.operators.rules import RULES


# The one rule on stays instead of a table's rows: days between the ends of the stay.
LENGTH_OF_STAY = "los_callback"


@dataclass(frozen=True)
class Item:
    """How to read one concept from one table of one source."""

    table: str
    items: tuple = ()
    item: str | None = None
    value: str | None = None
    time: str | None = None
    unit: str | None = None
    stop: str | None = None
    dur: str | None = None
    id: str | None = None
    pattern: str | None = None
    target: str | None = None
    rule: dict[str, Any] | None = None
    untranslated: str | None = None
    params: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, entry: dict[str, Any]) -> "Item":
        """One source entry of a dictionary file; a bare rule name is understood."""
        entry = {k: v for k, v in entry.items() if not isinstance(v, bool)}
        ids = entry.pop("ids", ())
        rule, text = entry.pop("rule", None), entry.pop("callback", None)
        if rule is None and (text in RULES or text == LENGTH_OF_STAY):
            rule, text = {"rule": text}, None
        take = lambda *names: next((entry.pop(n) for n in names if n in entry), None)
        return cls(
            table=take("table") or "", items=tuple(ids) if isinstance(ids, list) else (ids,) if ids != () else (),
            item=take("sub_var"), value=take("value_var", "val_var"), time=take("index_var", "time_var"),
            unit=take("unit_var", "unit"), stop=take("stop_var", "end_var"), dur=take("dur_var"), id=take("id_var"),
            pattern=take("regex"), target=take("target"), rule=rule, untranslated=text, params=entry,
        )


# Dictionary keys and the fields they set.
_FIELDS = {
    "category": "category", "class": "kind", "class_name": "kind", "unit": "units", "min": "low", "max": "high", "target": "target",
    "aggregate": "aggregate", "interval": "interval", "callback": "derived", "concepts": "parts", "levels": "levels",
    "description": "description", "omopid": "omop_id",
}


@dataclass(frozen=True)
class Concept:
    """One clinical quantity: an item concept with sources, or one derived from ``parts``."""

    name: str
    category: str | None = None
    kind: str = "num"
    units: tuple[str, ...] = ()  # the unit of its values, then other names that mean the same
    low: float | None = None
    high: float | None = None
    target: str | None = None
    aggregate: str | None = None
    interval: str | None = None
    derived: str | None = None
    parts: tuple[str, ...] = ()
    levels: tuple = ()
    description: str | None = None
    omop_id: int | None = None
    forward: str | None = None
    sources: dict[str, tuple[Item, ...]] = field(default_factory=dict)
    said: frozenset[str] = frozenset()  # fields that overlay others even at their default

    @classmethod
    def from_mapping(cls, name: str, entry: dict[str, Any]) -> "Concept":
        unit, parts = entry.get("unit"), entry.get("concepts") or ()
        kind = str(entry.get("class") or entry.get("class_name") or "num").replace("_cncpt", "")
        aggregate = entry.get("aggregate")
        return cls(
            name, category=entry.get("category"), kind=kind, units=tuple(unit if isinstance(unit, list) else [unit] if unit else ()),
            low=entry.get("min"), high=entry.get("max"), target=entry.get("target"),
            aggregate=aggregate if isinstance(aggregate, str) else None, interval=entry.get("interval"),
            derived=entry.get("callback"), parts=tuple([parts] if isinstance(parts, str) else parts),
            levels=tuple(entry.get("levels") or ()), description=entry.get("description"), omop_id=entry.get("omopid"),
            sources={s: tuple(Item.from_mapping(dict(e)) for e in es) for s, es in entry.get("sources", {}).items()},
            said=frozenset(f for key, f in _FIELDS.items() if key in entry),
        )

    def overlay(self, other: "Concept") -> "Concept":
        """The other definition where it says something, sources merged by name."""
        default = Concept(self.name)
        given = {
            f.name: getattr(other, f.name) for f in fields(self)
            if f.name not in ("name", "sources", "said") and (f.name in other.said or getattr(other, f.name) != getattr(default, f.name))
        }
        return replace(self, **given, sources={**self.sources, **other.sources})

    @property
    def unit(self) -> str | None:
        return self.units[0] if self.units else None

    @property
    def seconds(self) -> int | None:
        """The concept's own interval, written ``HH:MM:SS``."""
        if self.interval is None:
            return None
        hours, minutes, seconds = (int(x) for x in self.interval.split(":"))
        return 3600 * hours + 60 * minutes + seconds

    @property
    def how(self) -> str:
        if self.aggregate:
            return self.aggregate
        return {"lgl": "sum", "fct": "first", "chr": "first"}.get(self.kind, "median")


@dataclass(frozen=True)
class Catalogue:
    """Concepts by name."""

    concepts: dict[str, Concept]

    def __getitem__(self, name: str) -> Concept:
        return self.concepts[name]

    def __contains__(self, name: str) -> bool:
        return name in self.concepts

    def add(self, *concepts: Concept) -> "Catalogue":
        """New or changed concepts; known names are overlaid."""
        merged = dict(self.concepts)
        for c in concepts:
            merged[c.name] = merged[c.name].overlay(c) if c.name in merged else c
        return Catalogue(merged)

    def add_item(self, name: str, source: str, *items: Item) -> "Catalogue":
        known = self.concepts.get(name, Concept(name))
        return self.add(replace(known, sources={**known.sources, source: known.sources.get(source, ()) + items}))

    def update(self, other: "Catalogue") -> "Catalogue":
        return self.add(*other.concepts.values())

    def subset(self, source: str) -> "Catalogue":
        """Concepts that the source can provide, directly or through their parts."""
        return Catalogue({n: c for n, c in self.concepts.items() if self.available(n, source)})

    def available(self, name: str, source: str, seen: frozenset[str] = frozenset()) -> bool:
        c = self.concepts.get(name)
        if c is None or name in seen:
            return False
        if c.forward:
            return self.available(c.forward, source, seen | {name})
        if source in c.sources:
            return True
        return bool(c.parts) and any(self.available(p, source, seen | {name}) for p in c.parts)

    def order(self, names: list[str]) -> list[str]:
        """The names and all they are derived from, inputs first."""
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(f"concept depends on itself: {' > '.join((*path, name))}")
            if name in done or name not in self.concepts:
                return
            c = self.concepts[name]
            for part in ((c.forward,) if c.forward else c.parts):
                visit(part, (*path, name))
            done.append(name)

        for n in names:
            if n not in self.concepts:
                raise KeyError(f"unknown concept: {n}")
            visit(n, ())
        return done

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table."""
        rows = [
            (c.name, c.category, c.kind, c.unit, None if c.low is None else float(c.low),
             None if c.high is None else float(c.high), c.target, c.how, c.derived, list(c.parts), sorted(c.sources))
            for c in self.concepts.values()
        ]
        return spark.createDataFrame(
            rows, "name string, category string, class string, unit string, low double, high double, target string,"
            " aggregate string, derived string, parts array<string>, sources array<string>",
        )

    def sources(self) -> list[str]:
        return sorted({s for c in self.concepts.values() for s in c.sources})

    def availability(self, spark: SparkSession, names: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
        """Which source has which concept."""
        rows = [(n, s, self.available(n, s)) for n in names or self.concepts for s in sources or self.sources()]
        return spark.createDataFrame(rows, "concept string, source string, available boolean")


def load_dictionary(*paths: str) -> Catalogue:
    """Dictionary files as one catalogue; later files overlay earlier ones."""
    out = Catalogue({})
    for path in paths:
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)
        out = out.add(*[Concept.from_mapping(n, e) for n, e in entries.items()])
    return out


def table_availability(spark: SparkSession, wanted: list[str], exists) -> DataFrame:
    """Which tables of a source can be read; ``exists`` tests one name."""
    return spark.createDataFrame([(t, bool(exists(t))) for t in wanted], "table string, available boolean")


def explain(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    """Name, category, unit and description of every concept."""
    rows = [(c.name, c.category, c.unit, c.description) for c in catalogue.concepts.values()]
    return spark.createDataFrame(rows, "name string, category string, unit string, description string").orderBy("category", "name")
