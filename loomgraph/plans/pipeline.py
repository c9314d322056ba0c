"""The whole chain from raw assertions to a layered, evaluated graph.

Each stage is one written table: a lost executor costs a stage's tasks, a stopped run starts again after the last whole stage, and variants
(with or without guard rails, merges, additions) share what lies before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import aggregate, evaluate, graph, infer, registry, review, validate
from loomgraph.plans.frames import cut

LAYERS = {"text": (graph.TEXT,), "text+model": (graph.TEXT, graph.MODEL), "all": (graph.TEXT, graph.MODEL, graph.INFERRED)}


@dataclass(frozen=True)
class PipelineConfig:
    guardrails: bool = True
    merge: bool = True
    additions: bool = True
    rules: tuple[infer.Rule, ...] = infer.RULES
    rounds: int = 3


@dataclass
class Pipeline:
    """Inputs are tables; ``verdicts`` (key, ok, kind, reason), ``proposals`` (id, book, head, relation, tail, reason), ``merge_map`` and ``curated`` (key) may be missing."""

    relations: DataFrame
    entity: DataFrame
    spec: DataFrame
    verdicts: DataFrame | None = None
    proposals: DataFrame | None = None
    merge_map: DataFrame | None = None
    curated: DataFrame | None = None
    config: PipelineConfig = PipelineConfig()
    symmetric: list[str] | None = None

    def validated(self) -> DataFrame:
        return self._once("validated", lambda: validate.validate(self.relations, self.entity, self.spec))

    def dropped(self) -> DataFrame:
        """Rows that failed, with the reason."""
        return self.validated().where("why is not null")

    def candidates(self) -> DataFrame:
        def make():
            rows = aggregate.canonical(self.validated())
            return aggregate.detailed(aggregate.aggregate(rows), rows)

        return self._once("candidates", make)

    def judged(self) -> DataFrame:
        c = self.candidates()
        v = self.verdicts if self.verdicts is not None else c.select(*aggregate.KEY, F.lit(None).cast("boolean").alias("ok"), F.lit("").alias("kind"), F.lit("").alias("reason")).limit(0)
        return review.outcomes(c, v, self.entity, self.spec, self.config.guardrails)

    def _repaired(self, edges: DataFrame) -> DataFrame:
        """Without curated edges."""
        return edges if self.curated is None else edges.join(self.curated.select(*aggregate.KEY).distinct(), list(aggregate.KEY), "left_anti")

    def _mapping(self) -> DataFrame | None:
        return registry.last_wins(self.merge_map.where("book is not null")) if self.config.merge and self.merge_map is not None else None

    def text_layer(self) -> DataFrame:
        """Candidates after review, curation, merges and functional repair."""

        def make():
            e, m = self._repaired(review.apply(self.judged())), self._mapping()
            if m is not None:
                e = aggregate.remap(e, m, self.spec)
            return aggregate.resolve_functional(e, self.spec)

        return self._once("text", make)

    def additions(self) -> DataFrame:
        """(key, reason) of the proposals that no candidate has, rejected ones included: what review took out doesn't come back.  Curated and merged as the text layer."""

        def make():
            a, m = review.additions(self.proposals, self.candidates(), self.entity, self.spec), self._mapping()
            a = self._repaired(a).select(*aggregate.KEY, "reason", "id")
            if m is not None:
                a = aggregate.mapped(a, m, self.spec)
            a = a.groupBy(*aggregate.KEY).agg(F.min_by("reason", "id").alias("reason"))
            return a.join(self.text_layer().select(*aggregate.KEY), list(aggregate.KEY), "left_anti")

        return self._once("additions", make)

    def triples(self) -> DataFrame:
        """All layers: (key, votes, source, evidence, evidence_src, evidences, chapters, pack_ids, review, rule, support, reason); rules see the text layer only."""

        def make():
            text = self.text_layer()
            layer = lambda name: F.lit(name).alias("source")
            out = text.select(*aggregate.KEY, F.col("votes").cast("long").alias("votes"), layer(graph.TEXT), "evidence", "evidence_src", "evidences", "chapters", "pack_ids", F.col("outcome").alias("review"))
            if self.config.additions and self.proposals is not None:
                out = out.unionByName(self.additions().select(*aggregate.KEY, F.lit(0).cast("long").alias("votes"), layer(graph.MODEL), "reason"), allowMissingColumns=True)
            symmetric = self.symmetric if self.symmetric is not None else [r[0] for r in self.spec.where("symmetric").select("name").collect()]  # names of the schema's relations
            i = infer.infer(text, symmetric, self.config.rules, self.config.rounds)
            return out.unionByName(i.select(*aggregate.KEY, layer(graph.INFERRED), "rule", "support"), allowMissingColumns=True)

        return self._once("triples", make)

    def metrics(self, gold: DataFrame, gold_alias: DataFrame) -> DataFrame:
        """(layers, pred, gold, hit, precision, recall, f1) of the three cumulative layers."""
        names = gold.select("book", F.explode(F.array("head", "tail")).alias("name")).unionAll(gold_alias.select("book", F.col("form").alias("name")))
        resolved = evaluate.gold_resolve(names, registry.alias_index(self.entity), registry.surnames(self.entity))
        v = cut(evaluate.variants(gold, gold_alias, resolved, self.spec))
        return evaluate.layer_scores(gold, v, self.triples(), LAYERS)

    def _once(self, stage: str, make) -> DataFrame:
        done = self.__dict__.setdefault("_done", {})
        if stage not in done:
            done[stage] = cut(make())
        return done[stage]
