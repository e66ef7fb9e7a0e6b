"""End-to-end flows over whole corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.corpus import ENTRY_COLUMNS, entries_with_mentions, last_document
from ..operators.detection import detect_pd
from ..operators.lines import explode_lines
from ..operators.matching import match_dictionary, resolve_overlaps
from ..operators.redaction import redact, units_to_documents
from ..operators.registry import assign_letters, effective_registry, explode_registry, merge_others, merge_persons
from ..operators.reports import export_gate
from .session import settle


def line_units(docs: DataFrame) -> DataFrame:
    """``documents(project_id, doc_id, text)`` as line units."""
    return explode_lines(docs.select("project_id", "doc_id", "text")).select(
        "project_id", "doc_id", F.col("line_no").alias("unit_no"), F.col("line").alias("text")
    )


def whole_units(docs: DataFrame) -> DataFrame:
    """Each document as one unit (values may then span line breaks)."""
    return docs.select("project_id", "doc_id", F.lit(0).alias("unit_no"), "text")


def detect_and_redact(docs: DataFrame, rules, strategy: str = "auto") -> DataFrame:
    """Detect, build the registry per project, locate every entry in every
    line, resolve overlaps, hide everything. Redacted units, see ``redact``.

    The registry is the only thing written in between: it is small next to the
    texts and is read by several branches.
    """
    units = line_units(docs)
    entries = settle(detect_pd(units, rules))
    mentions = explode_registry(entries)
    kept = resolve_overlaps(match_dictionary(units, mentions, strategy), "registry")
    return redact(units, kept, entries, entries.select("project_id", "pd_id"))


def redact_documents(docs: DataFrame, rules, strategy: str = "auto") -> DataFrame:
    units = detect_and_redact(docs, rules, strategy)
    return units_to_documents(units, totals=("n_hidden",))


def recognize(
    pages: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Hook for a page recogniser supplied by the caller (batches of pages in,
    batches of page texts out)."""
    return pages.mapInPandas(fn, schema)


def project_registry(members: DataFrame, shared: DataFrame, doc_entries: DataFrame) -> DataFrame:
    """Registry rows with ``mentions`` that hold for each project: its shared
    entries or, without any, those of its last document; persons and other
    values merged, persons lettered."""
    chosen = effective_registry(shared, doc_entries, last_document(members)).drop("origin")
    people, person_rows = merge_persons(chosen.filter("kind = 'person'"))
    others, other_rows = merge_others(chosen.filter("kind <> 'person'"))
    columns = [c.split()[0] for c in ENTRY_COLUMNS.split(", ")]
    entries = assign_letters(people, people.filter(F.coalesce("letter", F.lit("")) != "")).select(*columns).unionByName(others.select(*columns))
    rows = ["project_id", "pd_id", "mention", "m_seq", "m_pos"]
    return entries_with_mentions(entries, person_rows.select(*rows).unionByName(other_rows.select(*rows)))


def publish_documents(docs: DataFrame, members: DataFrame, shared: DataFrame, doc_entries: DataFrame, flags: DataFrame) -> DataFrame:
    """Documents ready for export: the registry of each project is settled, its
    entries are found in every line, flagged ones are hidden by pseudonym or
    label. Documents with open readings or part marks are held back.

    ``docs(project_id, doc_id, text)``; ``members(project_id, pos, doc_id)``;
    ``shared`` and ``doc_entries`` (with ``doc_id``) are registry rows;
    ``flags(project_id, pd_id)``. Returns project_id, doc_id, text, n_hidden.
    """
    open_ = export_gate(docs.select("doc_id", "text")).filter(~F.col("blocked")).select("doc_id")
    ready = docs.select("project_id", "doc_id", "text").join(open_, "doc_id")
    entries = settle(project_registry(members, shared, doc_entries))
    units = line_units(ready)
    kept = resolve_overlaps(match_dictionary(units, explode_registry(entries)), "registry")
    return units_to_documents(redact(units, kept, entries, flags), totals=("n_hidden",)).select("project_id", "doc_id", "text", "n_hidden")
