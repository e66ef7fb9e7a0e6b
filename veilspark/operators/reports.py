"""Counts, gates, flags and the redaction report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import UNCERTAIN_MARK
from .matching import UNIT
from .ordinal import block_of, with_ordinal


def pd_counts_per_document(doc_entries: DataFrame) -> DataFrame:
    """Private persons, professionals and other values per document; null (a
    blank cell) instead of zero."""
    def some(condition):
        n = F.count(F.when(condition, 1))
        return F.nullif(n, F.lit(0))

    person = F.col("kind") == "person"
    return doc_entries.groupBy("doc_id").agg(
        some(person & (F.col("category") == "private")).alias("n_private"),
        some(person & (F.col("category") == "professional")).alias("n_professional"),
        some(~person).alias("n_other"),
    )


def has_pd(doc_entries: DataFrame) -> DataFrame:
    """Whether a document's registry holds anything that is shown."""
    shown = (F.col("kind") != "person") | F.col("category").isin("private", "professional")
    return doc_entries.groupBy("doc_id").agg(F.bool_or(F.coalesce(shown, F.lit(False))).alias("has_pd"))


def group_other_by_type(entries: DataFrame) -> DataFrame:
    """Other values by type with their place inside the type (registry order)."""
    return with_ordinal(
        entries.filter(F.col("kind") != "person"),
        ["project_id", "pd_type"],
        [F.col("seq")],
        [block_of("seq")],
        out="pos_in_type",
        levels=2,
        total="n_in_type",
    )


def mark_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id", "pd_id").agg(F.count("*").alias("n_marks"))


def export_gate(docs: DataFrame) -> DataFrame:
    """Unresolved uncertain readings and part separators per document; either
    blocks the export."""
    uncertain = F.size(F.regexp_extract_all("text", F.lit(UNCERTAIN_MARK), F.lit(0))).cast("bigint")
    parts = F.size(F.regexp_extract_all("text", F.lit(r"\[PART:[0-9]+\]"), F.lit(0))).cast("bigint")
    return docs.select(
        "doc_id",
        uncertain.alias("n_uncertain"),
        parts.alias("n_parts"),
        ((uncertain > 0) | (parts > 0)).alias("blocked"),
    )


def merge_flags(flags: DataFrame, how: str = "any", scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Flags of many documents as one set per project (or other scope): ``any``
    keeps every flag that is true somewhere, ``last`` the value set last (by
    ``seq``)."""
    keys = [*scope, "pd_id"]
    if how == "any":
        merged = flags.groupBy(*keys).agg(F.bool_or("flag").alias("flag"))
        return merged.filter("flag")
    if how == "last":
        return flags.groupBy(*keys).agg(F.max_by("flag", "seq").alias("flag"))
    raise ValueError(f"unknown mode: {how}")


def remaining_chunks(jobs: DataFrame, chunk: int = 1) -> DataFrame:
    """Page steps still to do over all jobs, at least one."""
    start = F.coalesce(F.nullif(F.col("next_page"), F.lit(0)), F.lit(1))
    left = F.greatest(F.lit(0), F.col("total_pages") - start + 1)
    return jobs.agg(F.greatest(F.coalesce(F.sum(F.ceil(left / chunk)), F.lit(0)), F.lit(1)).cast("bigint").alias("remaining"))


def toggle_category(entries: DataFrame, flags: DataFrame, category: str | None = None) -> DataFrame:
    """New flags after toggling a group: all of it off when every entry was
    flagged, else all of it on. Groups are person categories and types of other
    values; ``category`` toggles one, None each of them."""
    group = F.when(F.col("kind") == "person", F.col("category")).otherwise(F.col("pd_type"))
    on = flags.select("project_id", "pd_id", F.lit(True).alias("_on")).distinct()
    state = (
        entries.withColumn("group_key", group)
        .join(on, ["project_id", "pd_id"], "left")
        .withColumn("flag", F.coalesce("_on", F.lit(False)))
        .drop("_on")
    )
    if category is not None:
        state = state.filter(F.col("group_key") == category)
    target = state.groupBy("project_id", "group_key").agg((~F.bool_and("flag")).alias("target"))
    return state.join(target, ["project_id", "group_key"]).select("project_id", "pd_id", "group_key", "target")


def project_rollup(projects: DataFrame, members: DataFrame) -> DataFrame:
    """Documents per project and its last update, with the number of projects."""
    sizes = members.groupBy("project_id").agg(F.count("*").alias("n_docs"))
    return (
        projects.select("project_id", "updated_at")
        .join(sizes, "project_id", "left")
        .withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        .withColumn("n_projects", projects.agg(F.count("*").alias("n")).scalar())
    )


def occurrence_index(matches: DataFrame) -> DataFrame:
    """Concordance inside each document: the k-th of n marks of an entry, with
    the previous and next one in a ring (windows stay inside a document)."""
    order = Window.partitionBy("doc_id", "pd_id").orderBy("unit_no", "start")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("unit_no", "start")
    return matches.select(
        "doc_id",
        "pd_id",
        "unit_no",
        "start",
        F.row_number().over(order).cast("bigint").alias("k"),
        F.count("*").over(whole).alias("n"),
        F.coalesce(F.lead(here).over(order), F.first(here).over(whole)).alias("next"),
        F.coalesce(F.lag(here).over(order), F.last(here).over(whole)).alias("previous"),
    )


def redaction_report(entries: DataFrame, matches: DataFrame, flags: DataFrame, docs: DataFrame) -> DataFrame:
    """Per project and type: entries, marks, documents touched, flagged marks;
    open uncertain readings and over-long documents of the project beside them.

    Marks are first counted per document and entry, then rolled up, so no
    group of marks is gathered anywhere.
    """
    group = F.when(F.col("kind") == "person", F.col("category")).otherwise(F.col("pd_type"))
    typed = entries.select("project_id", "pd_id", group.alias("group_key"))
    on = flags.select("project_id", "pd_id").distinct().withColumn("_on", F.lit(1))
    per_doc = matches.groupBy("project_id", "pd_id", "doc_id").agg(F.count("*").alias("n"))
    marks = (
        per_doc.join(typed, ["project_id", "pd_id"])
        .join(on, ["project_id", "pd_id"], "left")
        .groupBy("project_id", "group_key", "doc_id")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_on") == 1, F.col("n")).otherwise(0)).alias("hidden"))
        .groupBy("project_id", "group_key")
        .agg(
            F.sum("n").alias("n_marks"),
            F.sum("hidden").alias("n_hidden"),
            F.count("*").alias("n_docs"),
        )
    )
    counted = typed.groupBy("project_id", "group_key").agg(F.count("*").alias("n_entries"))
    state = docs.groupBy("project_id").agg(
        F.sum("n_uncertain").alias("n_uncertain"), F.count(F.when(F.col("is_long"), 1)).alias("n_long_docs")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        counted.join(marks, ["project_id", "group_key"], "left")
        .join(state, "project_id", "left")
        .select(
            "project_id", "group_key", "n_entries", *[zero(c) for c in ("n_marks", "n_hidden", "n_docs", "n_uncertain", "n_long_docs")]
        )
    )
