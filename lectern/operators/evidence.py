"""Decision lists over evidence, and selection of linked evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grading rules in order; the first that holds decides. "weak" is a retry on the first pass.
RULES = (
    ("out_of_scope", "NOT in_scope"),
    ("weak", "relationship_mode AND NOT relation_words"),
    ("weak", "event_asked AND NOT (exact AND event_found)"),
    ("sufficient", "event_asked AND section_overlap > 0 AND (definition_words OR event_in_section)"),
    ("partial", "event_asked"),
    ("weak", "control_asked AND NOT control_found"),
    ("partial", "list_field_asked AND object_reference AND NOT list_types"),
    ("sufficient", "procedure_asked AND procedure_found AND overlap > 0"),
    ("weak", "procedure_asked"),
    ("sufficient", "table_asked AND table_found AND (exact OR section_overlap > 0 OR canonical > 0)"),
    ("sufficient", "definition_asked AND (exact OR canonical > 0) AND definition_words AND section_overlap > 0"),
    ("partial", "definition_asked AND (exact OR canonical > 0 OR overlap >= greatest(1, terms - 1))"),
    ("weak", "definition_asked"),
    ("sufficient", "exact AND section_overlap > 0 AND overlap >= greatest(1, floor(terms / 2))"),
    ("partial", "security_asked AND canonical > 0"),
    ("partial", "exact OR canonical > 0"),
    ("weak", "true"),
)


def grade(retries_left: Column) -> Column:
    """The status of a row of evidence features, one column for each name in RULES."""
    out = F.when(F.lit(False), "")
    for status, rule in RULES:
        out = out.when(F.expr(rule), F.when(retries_left, "retry").otherwise("in_scope_insufficient") if status == "weak" else F.lit(status))
    return out


def linked(records: DataFrame, k: int) -> DataFrame:
    """query, rank, segment, place of records (query, rank, depth, segment): rounds over a query's first k records by depth.

    A step takes the first segment of a record's unit at that depth that wasn't taken
    before; the rounds end at k segments or after one that adds nothing, even if
    deeper units remain. One query's records are a group, bounded by k.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        units = {key: own.sort_values("order").segment.tolist() for key, own in rows.groupby(["rank", "depth"])}
        ranks = sorted(rows["rank"].unique())[:k]
        out: list[tuple] = []
        taken: set = set()
        for depth in range(int(rows.depth.max()) + 1):
            before = len(out)
            for rank in ranks:
                free = next((s for s in units.get((rank, depth), ()) if s not in taken), None)
                if free is not None and len(out) < k:
                    taken.add(free)
                    out.append((rows["query"].iloc[0], int(rank), free, len(out) + 1))
            if len(out) in (before, k):
                break
        return pd.DataFrame(out, columns=["query", "rank", "segment", "place"])

    return records.groupBy("query").applyInPandas(run, "query long, rank long, segment string, place long")


def concept_tier(alias_weight: Column, component_weight: Column, alias_similarity: Column, target_exact: Column, in_query: Column, target_similarity: Column, input_exact: Column, similarity: Column) -> Column:
    """tier and score of a concept for a question: named by an alias, by a component, by likeness, exactly, inside the question; null where nothing holds."""
    pair = lambda tier, score: F.struct(tier.cast("double").alias("tier"), score.cast("double").alias("score"))
    return (
        F.when(alias_weight > 0, pair(20 + F.least(alias_weight, F.lit(5)), F.lit(1.0)))
        .when(component_weight > 0, pair(15 + F.least(component_weight, F.lit(5)), F.lit(0.99)))
        .when(alias_similarity >= 0.5, pair(10 + F.least(F.greatest(alias_weight, F.lit(0)), F.lit(5)), alias_similarity))
        .when(target_exact, pair(F.lit(4), F.lit(0.98)))
        .when(in_query, pair(F.lit(3), F.lit(0.96)))
        .when(target_similarity >= 0.5, pair(F.lit(2), target_similarity))
        .when(input_exact, pair(F.lit(2), F.lit(0.9)))
        .when(similarity >= 0.5, pair(F.lit(1), similarity))
    )
