"""Knowledge tables: lexical retrieval, consolidation, registries and the hypothesis graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.hashing import record_hash
from barwright.functions.numeric import count_where

# Token characters and graph relations: fixed values.
TOKEN_PATTERN = "[a-záéíóúñ0-9_]+"
RELATIONS = ("PARENT", "CHILD", "REFINES", "CONTRADICTS", "SUPPORTS", "REPLACES", "FALSIFIES")
DEFAULT_CONFIDENCE = 0.5


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than one character, over the whole text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def relevance(records: DataFrame, query: str | Column, content: str, tags: str, confidence: str) -> DataFrame:
    """0.8 x Jaccard of token sets plus 0.2 x confidence, per record (a projection, no join)."""
    searchable = F.concat_ws(" ", F.col(content), F.concat_ws(" ", F.col(tags)))
    asked = tokens(F.lit(query) if isinstance(query, str) else query)
    scored = records.withColumn("_have", tokens(searchable)).withColumn("_ask", asked)
    shared = F.size(F.array_intersect("_have", "_ask"))
    either = F.size("_have") + F.size("_ask") - shared
    lexical = F.when((F.size("_have") == 0) | (F.size("_ask") == 0), F.lit(0.0)).otherwise(shared / either)
    return scored.withColumn("relevance", F.round(0.8 * lexical + 0.2 * F.coalesce(F.col(confidence), F.lit(DEFAULT_CONFIDENCE)), 6)).drop("_have", "_ask")


def retrieve(scored: DataFrame, recency: str, k: int) -> DataFrame:
    return scored.orderBy(F.desc("relevance"), F.desc(recency)).limit(k)


def union_scales(scales: Mapping[str, DataFrame]) -> DataFrame:
    """Several memory scales as one table tagged with its source."""
    out = None
    for name, table in scales.items():
        tagged = table.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def consolidate(episodes: DataFrame, previous: DataFrame, minimum: int = 2) -> DataFrame:
    """Hypotheses with enough episodes and at least one evidence id the last consolidation did not hold.

    Evidence stays in long form (hypothesis, evidence), so a hypothesis with a third of all episodes is
    counted by partial aggregates instead of being collected.
    """
    facts = episodes.groupBy("hypothesis").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))).alias("confidence"))
    pairs = episodes.select("hypothesis", "evidence").distinct()
    old = previous.select("hypothesis", "evidence", F.lit(1).alias("_old")).distinct()
    counted = pairs.join(old, ["hypothesis", "evidence"], "left").groupBy("hypothesis").agg(
        F.count(F.lit(1)).alias("evidence_ids"), count_where(F.col("_old").isNull()).alias("new_evidence"))
    return facts.where(F.col("episodes") >= minimum).join(counted, "hypothesis").where(F.col("new_evidence") > 0)


def promote(consolidated: DataFrame, promoted: DataFrame, threshold: int = 4, confidence: float = 0.75) -> DataFrame:
    """Well supported, confident and not yet promoted."""
    return consolidated.where((F.col("episodes") >= threshold) & (F.col("confidence") >= confidence)).join(promoted, "hypothesis", "left_anti")


def keep_recent(records: DataFrame, owner: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last n records per owner; each task trims to n before the shuffle (rank limit)."""
    w = Window.partitionBy(*owner).orderBy(*[F.desc(c) for c in order])
    return records.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def registry_check(entries: DataFrame, identifier: str, order: str, spec: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Per id: frozen hash of the first registration, whether later ones differ, and missing required fields."""
    missing = sum((F.col(c).isNull().cast("int") for c in required), F.lit(0))
    hashed = entries.withColumn("_hash", record_hash("SPEC", spec)).withColumn("_missing", missing)
    facts = hashed.groupBy(identifier).agg(
        F.count(F.lit(1)).alias("registrations"), F.min_by("_hash", order).alias("spec_hash"),
        (F.min("_hash") != F.max("_hash")).alias("_differs"), F.sum("_missing").alias("missing_fields"))
    status = (F.when(F.col("missing_fields") > 0, F.lit("INVALID")).when(F.col("_differs"), F.lit("CONFLICT")).otherwise(F.lit("FROZEN")))
    return facts.withColumn("status", status).drop("_differs")


def latest_status(events: DataFrame, identifier: str, status: str, order: Sequence[str]) -> DataFrame:
    """Latest status per id by partial aggregates."""
    return events.groupBy(identifier).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("updates"))


def dedupe_edges(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """First edge per (source, target, relation); unknown relations are refused."""
    known = F.col("relation").isin(*RELATIONS)
    checked = edges.withColumn("relation", F.when(known, F.col("relation")).otherwise(
        F.raise_error(F.concat(F.lit("unknown relation "), F.coalesce("relation", F.lit("NULL")))).cast("string")))
    rest = [c for c in edges.columns if c not in ("source", "target", "relation")]
    return checked.groupBy("source", "target", "relation").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_e")).select(
        "source", "target", "relation", "_e.*")


def upsert_nodes(nodes: DataFrame, updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Latest version of each node; a status update without a family keeps the known one."""
    both = nodes.unionByName(updates, allowMissingColumns=True)
    key = F.struct(*order)
    return both.groupBy("id").agg(F.max_by("family", F.when(F.col("family").isNotNull(), key)).alias("family"),
                                  F.max_by("status", key).alias("status"), F.count(F.lit(1)).alias("versions"))


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


def node_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                         F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


