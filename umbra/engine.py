"""Facade: an engine holds a policy and an analyzer, and masks and restores tables of nodes or whole documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.errors import PolicyError
from umbra.operators import cloakmap, resolve
from umbra.operators import mask as masking
from umbra.operators import policy as policies
from umbra.operators.detect import ANALYZERS, Analyzer, Recognizer, analyzer, detect
from umbra.operators.policy import Policy
from umbra.sources import documents as sources


@dataclass(frozen=True)
class Cloaked:
    """A masked table with its anchors."""

    masked: DataFrame
    anchors: DataFrame
    policy: Policy

    def unmasked(self) -> DataFrame:
        return masking.unmask(self.masked, self.anchors)

    def statistics(self, *by: str) -> DataFrame:
        return cloakmap.statistics(self.anchors, *by)

    def maps(self, texts: DataFrame) -> DataFrame:
        """texts: doc_id, text of the documents that were masked."""
        return cloakmap.build(self.anchors, texts, self.policy)


@dataclass(frozen=True)
class Engine:
    policy: Policy = policies.DEFAULT
    analyzer: Analyzer = field(default_factory=Analyzer)
    resolution: str = "greedy"

    def with_policy(self, policy: Policy | str) -> Engine:
        return replace(self, policy=policies.preset(policy) if isinstance(policy, str) else policy)

    def with_analyzer(self, own: Analyzer | str) -> Engine:
        """A named analyzer brings its threshold and languages, not its recognizers."""
        chosen = replace(analyzer(own), recognizers=self.analyzer.recognizers) if isinstance(own, str) else own
        return replace(self, analyzer=chosen)

    def with_recognizer(self, recognizer: Recognizer) -> Engine:
        return replace(self, analyzer=self.analyzer.add(recognizer))

    def with_types(self, *entity_types: str) -> Engine:
        return replace(self, analyzer=replace(self.analyzer, enabled=entity_types).enable(*entity_types))

    def with_threshold(self, threshold: float) -> Engine:
        return replace(self, analyzer=replace(self.analyzer, threshold=threshold))

    def with_resolution(self, name: str) -> Engine:
        if name not in resolve.RESOLVERS:
            raise PolicyError(f"no resolution {name}; there are {sorted(resolve.RESOLVERS)}")
        return replace(self, resolution=name)

    def without(self, *entity_types: str) -> Engine:
        return replace(self, analyzer=self.analyzer.disable(*entity_types))

    def detect(self, nodes: DataFrame) -> DataFrame:
        return self.analyzer.detect(nodes)

    def mask(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(masked nodes, anchors)."""
        found = self.analyzer.detect(nodes) if self.analyzer.threshold or self.analyzer.thresholds else detect(nodes, self.analyzer.active())
        done = masking.mask(found, self.policy, resolution=self.resolution, detected=True)
        return done, masking.anchors(done, self.policy)

    def cloak(self, nodes: DataFrame) -> Cloaked:
        return Cloaked(*self.mask(nodes), self.policy)

    def mask_documents(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents with their masked texts put back, their maps)."""
        nodes = sources.nodes(documents)
        done, anchors = self.mask(nodes)
        return sources.rebuild(documents, done), cloakmap.build(anchors, sources.full_text(nodes), self.policy)

    def unmask(self, masked: DataFrame, anchors: DataFrame, vault: DataFrame | None = None) -> DataFrame:
        return masking.unmask(masked, anchors, vault)

    def unmask_documents(self, documents: DataFrame, maps: DataFrame, vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(documents with the originals put back, the resolved anchors); the texts may have been edited since."""
        nodes = sources.nodes(documents).withColumnRenamed("text", "masked_text")
        restored, found = masking.restore(nodes, cloakmap.anchors_of(maps), vault)
        return sources.rebuild(documents, restored, "restored_text"), found


def batch_summary(masked: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row about a masked table: documents, nodes, nodes with masks, masks, types, and characters before and after."""
    size = lambda c: F.coalesce(F.sum(F.char_length(c)), F.lit(0)).cast("long")
    nodes = masked.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("nodes"), size("text").alias("chars"), size("masked_text").alias("masked_chars")).withColumn("_k", F.lit(1))
    made = anchors.agg(F.countDistinct("doc_id", "node_id").alias("masked_nodes"), F.count(F.lit(1)).alias("masks"), F.array_sort(F.collect_set("entity_type")).alias("types")).withColumn("_k", F.lit(1))
    return nodes.join(made, "_k").drop("_k")


def mask_pii(text_col: str = "text", id_col: str = "doc_id", policy: Policy | str = "default") -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform(): the same rows and columns with one text column masked."""
    engine = Engine().with_policy(policy)

    def apply(df: DataFrame) -> DataFrame:
        rows = df.withColumns({"_text": F.col(text_col), "context": F.lit("paragraph")}) if "context" not in df.columns else df.withColumn("_text", F.col(text_col))
        found = detect(rows, engine.analyzer.active(), "_text")
        found = masking.filtered(found, engine.policy).withColumn("spans", resolve.RESOLVERS[engine.resolution](F.col("spans")))
        done = masking.replaced(found, engine.policy)
        return done.withColumn(text_col, masking.splice(F.col("_text"), F.col("spans"))).select(*df.columns)

    return apply


__all__ = ["ANALYZERS", "Cloaked", "Engine", "batch_summary", "mask_pii"]
