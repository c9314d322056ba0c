"""Domain schemas: one YAML file for each book."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.infer import Rule


@dataclass(frozen=True)
class Schema:
    name: str
    language: str
    entity_types: dict[str, str]
    relations: dict[str, dict]
    relation_aliases: dict[str, str] = field(default_factory=dict)
    disambiguation: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    chunking: dict = field(default_factory=dict)
    prescan: dict = field(default_factory=dict)
    person_type: str = "人物"

    @property
    def symmetric(self) -> list[str]:
        return [r for r, s in self.relations.items() if s.get("symmetric")]

    def spec(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n, s["domain"], s["range"], bool(s.get("directed", not s.get("symmetric", False))), bool(s.get("symmetric", False)), s.get("functional_on"), s.get("definition", ""))
            for n, s in self.relations.items()
        ]
        return spark.createDataFrame(rows, "name string, domain string, range string, directed boolean, symmetric boolean, functional_on string, definition string")


def parse(doc: dict) -> Schema:
    """A schema from its parsed document; a synonym of no relation and a relation of unknown types are errors."""
    types, relations = dict(doc.get("entity_types") or {}), dict(doc.get("relations") or {})
    for n, s in relations.items():
        for side in ("domain", "range"):
            if s.get(side) not in types:
                raise ValueError(f"relation {n}: {side} {s.get(side)!r} is no entity type")
    aliases = dict(doc.get("relation_aliases") or {})
    if bad := [a for a, r in aliases.items() if r not in relations]:
        raise ValueError(f"aliases of unknown relations: {bad}")
    rules = tuple(
        Rule(r["name"], tuple(tuple(p) for p in r["if"]), tuple(r["then"]), tuple(r["unless"]) if r.get("unless") else None, r.get("dominant_premise"), r.get("unless_head_has"))
        for r in doc.get("inference") or ()
    )
    return Schema(doc["name"], doc.get("language", ""), types, relations, aliases, tuple(doc.get("disambiguation") or ()), rules, dict(doc.get("chunking") or {}), dict(doc.get("prescan") or {}), doc.get("person_type", "人物"))


def load(path: str | Path) -> Schema:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))
