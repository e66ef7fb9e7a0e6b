"""Projects and their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import ANALYSIS_LIMIT, is_long_text
from ..plans.session import settle
from ..sources.versions import VersionedTables
from .ordinal import block_of, first_per_key, with_ordinal

# ---- fixed values -----------------------------------------------------------
MAX_DOCUMENTS = 50
MAX_PROJECTS = 30
BATCH_SOURCE = "project-batch"
SUMMARY_SOURCE = "project-summary"
# ---- end of fixed values ----------------------------------------------------


def tenant_filter(df: DataFrame, user_id, column: str = "user_id") -> DataFrame:
    """Row-level security; a plain equality that reaches the scan."""
    return df.filter(F.col(column) == F.lit(user_id))


def exclude_summaries(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce("is_summary", F.lit(False)))


def long_document_flag(docs: DataFrame, limit: int = ANALYSIS_LIMIT) -> DataFrame:
    own = ~F.coalesce("is_summary", F.lit(False)) & ~F.coalesce("source", F.lit("")).isin(SUMMARY_SOURCE, BATCH_SOURCE)
    return docs.withColumn("is_long", own & is_long_text("text", limit))


def membership(projects: DataFrame) -> DataFrame:
    """Ordered membership rows from ``document_ids`` arrays (pos from 0)."""
    return projects.select("project_id", F.posexplode("document_ids").alias("pos", "doc_id"))


def project_documents(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents in project order; ids without a document vanish, summaries
    are left out. ``members(project_id, pos, doc_id)``."""
    rest = [c for c in docs.columns if c not in ("project_id", "doc_id")]
    listed = exclude_summaries(docs) if "is_summary" in docs.columns else docs
    return members.join(listed.select("doc_id", *rest), "doc_id").select("project_id", "pos", "doc_id", *rest)


def part_numbers(members: DataFrame) -> DataFrame:
    """1-based ordinal of a document in its project, and the project's size."""
    return with_ordinal(members, ["project_id"], [F.col("pos")], [block_of("pos")], out="part_no", total="n_parts")


def last_document(members: DataFrame) -> DataFrame:
    return members.groupBy("project_id").agg(F.max_by("doc_id", "pos").alias("doc_id"))


def manifest_diff(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Incoming files with the known session they continue, if any: same name,
    size and modification time, missing ones as '' and 0, PDF sessions only
    (the latest one where an identity occurs twice).

    ``files(file_id, file_name, file_size, modified)``;
    ``sessions(session_id, source_kind, file_name, file_size, modified, next_page)``.
    """
    key = [
        F.coalesce("file_name", F.lit("")).alias("k_name"),
        F.coalesce(F.col("file_size").cast("bigint"), F.lit(0)).alias("k_size"),
        F.coalesce(F.col("modified").cast("bigint"), F.lit(0)).alias("k_time"),
    ]
    kind = F.coalesce(F.nullif(F.col("source_kind"), F.lit("")), F.lit("pdf"))
    known = (
        sessions.filter(kind == "pdf")
        .select(*key, "session_id", "next_page")
        .groupBy("k_name", "k_size", "k_time")
        .agg(F.max("session_id").alias("session_id"), F.max_by("next_page", "session_id").alias("next_page"))
    )
    return files.select("*", *key).join(known, ["k_name", "k_size", "k_time"], "left").drop("k_name", "k_size", "k_time")


def same_image_set(session_files: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions whose images are the incoming ones, in the same order.

    Compared position by position (both sides are long tables), so the sets
    may be of any size: equal counts and no position that differs.
    ``(set_id, pos, file_name, file_size, modified)`` on both sides.
    """
    def shape(df: DataFrame) -> DataFrame:
        return df.select(
            "set_id",
            "pos",
            F.xxhash64(
                F.coalesce("file_name", F.lit("")),
                F.coalesce(F.col("file_size").cast("bigint"), F.lit(0)),
                F.coalesce(F.col("modified").cast("bigint"), F.lit(0)),
            ).alias("h"),
            F.struct(
                F.coalesce("file_name", F.lit("")),
                F.coalesce(F.col("file_size").cast("bigint"), F.lit(0)),
                F.coalesce(F.col("modified").cast("bigint"), F.lit(0)),
            ).alias("triple"),
        )

    a, b = shape(session_files).alias("a"), shape(files).alias("b")
    both = a.join(b, ["set_id", "pos"], "full_outer").select(
        "set_id", F.col("a.triple").eqNullSafe(F.col("b.triple")).alias("same")
    )
    return both.groupBy("set_id").agg(F.bool_and("same").alias("same"))


def chunk_key(docs: DataFrame) -> Column:
    """Identity of a document made from a page range; null when a part is
    missing (such documents are never duplicates)."""
    summary = F.coalesce("is_summary", F.lit(False)) if "is_summary" in docs.columns else F.lit(False)
    whole = (
        ~summary
        & (F.coalesce("batch_file", F.lit("")) != "")
        & (F.coalesce("page_from", F.lit(0)) != 0)
        & (F.coalesce("page_to", F.lit(0)) != 0)
    )
    return F.when(
        whole,
        F.concat_ws("::", F.coalesce("project_id", F.lit("")), "batch_file", F.col("page_from").cast("string"), F.col("page_to").cast("string")),
    )


def dedupe_chunks(docs: DataFrame) -> DataFrame:
    """Documents without the later copies of a page range. The first per key is
    found by a partial aggregate and the copies leave by an anti-join on the
    document id, so a key with very many copies meets in no single task."""
    keyed = docs.withColumn("_key", chunk_key(docs))
    first = (
        keyed.filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.min_by("doc_id", F.struct("pos", "doc_id")).alias("doc_id"))
        .select("doc_id")
        .withColumn("_first", F.lit(True))
    )
    return (
        keyed.join(first, "doc_id", "left").filter(F.col("_key").isNull() | F.col("_first")).drop("_key", "_first")
    )


def merge_source_files(files: DataFrame, scope: str = "doc_id") -> DataFrame:
    """One row per storage path, else name, else position - the first in order."""
    key = F.coalesce(
        F.nullif(F.col("storage_path"), F.lit("")),
        F.nullif(F.col("name"), F.lit("")),
        F.concat(F.lit("file_"), F.col("pos").cast("string")),
    )
    return first_per_key(files.withColumn("file_key", key), [scope, "file_key"], ["pos"])


def build_project_summary(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The project's documents as numbered parts of one summary.

    A part row holds its separator and text (``\\n[PART:i]\\n`` from the second
    part on) and the offset at which it starts; the summary text is the parts
    in order. Parts stay rows: a project may hold any number of documents.
    Offsets are summed over the lengths alone; the texts are joined last.
    """
    sizes = docs.withColumn("_size", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    kept = [c for c in ("is_summary",) if c in docs.columns]
    ordered = part_numbers(project_documents(members, sizes.select("doc_id", "_size", *kept)))
    lead = F.when(F.col("part_no") == 1, "").otherwise(F.concat(F.lit("\n[PART:"), F.col("part_no").cast("string"), F.lit("]\n")))
    sized = ordered.select("project_id", "part_no", "n_parts", "doc_id", lead.alias("_lead"), (F.length(lead) + F.col("_size")).alias("_len"))
    sized = sized.withColumn("_block", block_of("part_no"))
    inside = Window.partitionBy("project_id", "_block").orderBy("part_no")
    blocks = sized.groupBy("project_id", "_block").agg(F.sum("_len").alias("_sum"))
    upto = Window.partitionBy("project_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("project_id", "_block", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    placed = (
        sized.withColumn("_at", F.sum("_len").over(inside) - F.col("_len"))
        .join(starts, ["project_id", "_block"])
        .select("project_id", "part_no", "n_parts", "doc_id", "_lead", (F.col("_base") + F.col("_at")).alias("char_start"))
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return placed.join(texts, "doc_id").select("project_id", "part_no", "n_parts", "doc_id", F.concat("_lead", "_text").alias("part_text"), "char_start")


def project_summaries(
    members: DataFrame, docs: DataFrame, entries: DataFrame, flags: DataFrame, sources: DataFrame, pages: DataFrame
) -> dict[str, DataFrame]:
    """Everything a project's summary holds, as long tables:

    ``parts`` as ``build_project_summary`` gives them; ``registry``, the
    entries of the project's last document; ``flags`` that are set in any of
    its documents; ``sources`` and ``pages``, the merged page metadata. Summary
    documents do not count. ``entries(project_id, doc_id, pd_id, ...)``;
    ``flags(doc_id, pd_id, flag)``; ``sources(doc_id, source_key, seq, page_from,
    page_to, total_pages)``; ``pages(doc_id, source_key, seq, page_no)``.
    """
    from .pages import merge_page_metadata
    from .reports import merge_flags

    kept = [c for c in ("is_summary",) if c in docs.columns]
    # the last document that counts may stand before a summary in the list
    own = settle(project_documents(members, docs.select("doc_id", *kept)).select("project_id", "pos", "doc_id"))
    last = last_document(own)
    of = own.select("project_id", "doc_id")
    scoped = lambda df: df.join(of, "doc_id").withColumn("scope", F.col("project_id")).drop("project_id", "doc_id")
    merged, page_rows = merge_page_metadata(scoped(sources), scoped(pages))
    return {
        "parts": build_project_summary(members, docs),
        "registry": entries.join(last, ["project_id", "doc_id"], "left_semi"),
        "flags": merge_flags(flags.join(of, "doc_id"), "any"),
        "sources": merged.withColumnRenamed("scope", "project_id"),
        "pages": page_rows.withColumnRenamed("scope", "project_id"),
    }


def replace_summaries(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Documents with the new summary rows in place of the older summaries of
    the same projects; projects without a new one keep theirs."""
    renewed = summaries.select(F.col("project_id").alias("_p")).distinct()
    old = F.coalesce("is_summary", F.lit(False)) & (F.col("project_id") == F.col("_p"))
    return docs.join(renewed, old, "left_anti").unionByName(summaries, allowMissingColumns=True)


def add_documents(members: DataFrame, additions: DataFrame) -> DataFrame:
    """Append documents that are not listed yet behind the last position.
    ``additions(project_id, doc_id, a_seq)``; repeated additions count once."""
    once = first_per_key(additions.select("project_id", "doc_id", "a_seq"), ["project_id", "doc_id"], ["a_seq"])
    fresh = once.join(members.select("project_id", "doc_id"), ["project_id", "doc_id"], "left_anti")
    ends = members.groupBy("project_id").agg(F.max("pos").alias("_end"))
    placed = with_ordinal(fresh, ["project_id"], [F.col("a_seq")], [block_of("a_seq")], out="_k").join(
        ends, "project_id", "left"
    )
    return members.unionByName(
        placed.select("project_id", (F.coalesce("_end", F.lit(-1)) + F.col("_k")).alias("pos"), "doc_id")
    )


def remove_documents(members: DataFrame, removals: DataFrame) -> DataFrame:
    return members.join(removals.select("project_id", "doc_id").distinct(), ["project_id", "doc_id"], "left_anti")


def referential_actions(
    docs: DataFrame, members: DataFrame, deleted_projects: DataFrame, deleted_users: DataFrame, deleted_docs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Project deleted: its documents lose the project. User deleted: their
    documents go. Document deleted: it leaves its project's list."""
    gone = deleted_projects.select(F.col("project_id").alias("_p")).distinct()
    kept = docs.join(deleted_users.select("user_id").distinct(), "user_id", "left_anti").join(
        deleted_docs.select("doc_id").distinct(), "doc_id", "left_anti"
    )
    freed = kept.join(gone, kept["project_id"] == gone["_p"], "left").withColumn(
        "project_id", F.when(F.col("_p").isNull(), F.col("project_id"))
    )
    left = members.join(deleted_projects.select("project_id").distinct(), "project_id", "left_anti").join(
        deleted_docs.select("doc_id").distinct(), "doc_id", "left_anti"
    )
    return freed.select(*docs.columns), left


def latest(df: DataFrame, k: int, stamp: str, tie: str, per: str | None = None) -> DataFrame:
    """The k most recent rows, overall or per owner."""
    if per is None:
        return df.orderBy(F.desc(stamp), F.desc(tie)).limit(k)
    order = Window.partitionBy(per).orderBy(F.desc(stamp), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")


def latest_documents(docs: DataFrame, k: int = MAX_DOCUMENTS, **how) -> DataFrame:
    return latest(docs, k, how.get("stamp", "saved_at"), how.get("tie", "doc_id"), how.get("per"))


def latest_projects(projects: DataFrame, k: int = MAX_PROJECTS, **how) -> DataFrame:
    return latest(projects, k, how.get("stamp", "updated_at"), how.get("tie", "project_id"), how.get("per"))


def document_texts(facts: DataFrame, segments: DataFrame, file: tuple[str, ...] = ("project_id", "file_key"), segment: int = 1000) -> DataFrame:
    """Facts next to their texts: one row per document and run of ``segment``
    page numbers at every size, ``segment_no`` giving the order; a document
    whose pages are all blank has one row with an empty text."""
    first = F.floor((F.col("page_from") - 1) / segment).cast("bigint")
    joined = facts.join(segments, list(file), "left")
    return joined.withColumn("segment_no", F.coalesce("segment_no", first)).withColumn("text", F.coalesce("text", F.lit("")))


def append_pages(pages: DataFrame, file: tuple[str, ...] = ("project_id", "file_key"), segment: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Growing document per file from its pages, whatever their arrival order.

    ``pages(project_id, file_key, page_no, seq, doc_id, title, text,
    total_pages)``. Returns (document facts, text segments): start of the first
    page, end and total of the last, id and title of the first; texts joined by
    line breaks without the empty ones.
    """
    keys = list(file)
    once = first_per_key(pages, [*keys, "page_no"], ["seq"])
    total = F.nullif(F.col("total_pages"), F.lit(0))
    facts = once.groupBy(*keys).agg(
        F.min_by("doc_id", "page_no").alias("doc_id"),
        F.min_by("title", "page_no").alias("title"),
        F.min("page_no").alias("page_from"),
        F.max("page_no").alias("page_to"),
        F.max_by(total, F.when(total.isNotNull(), F.col("page_no"))).alias("total_pages"),
        F.count("*").alias("n_pages"),
        F.lit(BATCH_SOURCE).alias("source"),
        F.lit(1).alias("chunk_size"),
    )
    segments = (
        once.filter(F.coalesce("text", F.lit("")) != "")
        .withColumn("segment_no", F.floor((F.col("page_no") - 1) / segment).cast("bigint"))
        .groupBy(*keys, "segment_no")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_p"))
        .select(*keys, "segment_no", F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text"))
    )
    return facts, segments


def growing_documents(
    pages: DataFrame, flags: DataFrame, files: DataFrame, sources: DataFrame, file: tuple[str, ...] = ("project_id", "file_key"), segment: int = 1000
) -> dict[str, DataFrame]:
    """All that a growing document takes from its pages, as long tables by file:
    ``facts`` and ``segments`` as ``append_pages`` gives them, ``flags`` (a page
    overrides those before it), ``files`` (one per path, name or place), and the
    page metadata as ``sources`` and ``pages``. Ends that no page knows are
    those of the file's first source.

    ``flags(*file, page_no, pd_id, flag)``; ``files(*file, pos, name,
    storage_path, ...)``; ``sources(*file, source_key, seq, page_from, page_to,
    total_pages)``.
    """
    from .pages import merge_page_metadata
    from .reports import merge_flags

    keys = list(file)
    facts, segments = append_pages(pages, file, segment)
    scope = F.struct(*keys)
    merged, page_rows = merge_page_metadata(
        sources.withColumn("scope", scope).drop(*keys),
        sources.select(scope.alias("scope"), "source_key", "seq", F.explode(F.sequence("page_from", "page_to")).alias("page_no")),
    )
    unpacked = lambda df: df.select(*[F.col(f"scope.{k}").alias(k) for k in keys], *[c for c in df.columns if c != "scope"])
    merged, page_rows = unpacked(merged), unpacked(page_rows)
    ends = ("page_from", "page_to", "total_pages")
    first = merged.groupBy(*keys).agg(F.min_by(F.struct(*ends), "seq").alias("_first"))
    facts = facts.join(first, keys, "left").withColumns({c: F.coalesce(c, F.col(f"_first.{c}")) for c in ends}).drop("_first")
    packed = files.select(scope.alias("_scope"), *[c for c in files.columns if c not in keys])
    named = merge_source_files(packed, "_scope").withColumnRenamed("file_key", "source_name")
    return {
        "facts": facts,
        "segments": segments,
        "flags": merge_flags(flags.withColumn("seq", F.col("page_no")), "last", keys),
        "files": named.select(*[F.col(f"_scope.{k}").alias(k) for k in keys], *[c for c in named.columns if c != "_scope"]),
        "sources": merged,
        "pages": page_rows,
    }


def merge_document_into_project(
    project_entries: DataFrame, doc_entries: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry of a project after a document joins it: merged persons and
    other values (the project's own first), then letters for the new persons.
    Returns (persons, others, mention rows)."""
    from .registry import assign_letters, merge_others, merge_persons

    everything = project_entries.unionByName(doc_entries)
    persons, person_rows = merge_persons(everything.filter(F.col("kind") == "person"))
    others, other_rows = merge_others(everything.filter(F.col("kind") != "person"))
    known = project_entries.filter(F.col("kind") == "person")
    lettered = assign_letters(persons, known)
    cols = ["project_id", "pd_id", "mention", "m_seq", "m_pos"]
    return lettered, others, person_rows.select(*cols).unionByName(other_rows.select(*cols))


ENTRY_COLUMNS = "project_id string, pd_id string, seq bigint, kind string, category string, pd_type string, value string, role string, letter string, replacement string"


def project_tables(spark: SparkSession, path: str, id_type: str = "bigint") -> VersionedTables:
    """Documents, membership, registry and marks of projects as one set. A
    document and a project's registry are those of the last commit that has
    them; membership only grows."""
    return VersionedTables(
        spark,
        path,
        {
            "documents": f"project_id string, doc_id {id_type}, text string",
            "members": f"project_id string, doc_id {id_type}, pos bigint",
            "registry": ENTRY_COLUMNS,
            "mentions": "project_id string, pd_id string, mention string, m_seq bigint, m_pos int",
            "marks": f"project_id string, doc_id {id_type}, unit_no int, start int, end int, hit string, pd_id string",
        },
    )


_OWNERS = {"documents": "doc_id", "registry": "project_id", "mentions": "project_id", "marks": "doc_id"}


def current(tables: VersionedTables, name: str) -> DataFrame:
    """A table's rows as the last commits left them."""
    rows = tables.read(name)
    if name not in _OWNERS:
        return rows.drop("commit")
    # the document's row, or the project's registry, says which commit counts last
    owner = _OWNERS[name]
    last = tables.read("documents" if owner == "doc_id" else "registry").groupBy(owner).agg(F.max("commit").alias("commit"))
    return rows.join(last, [owner, "commit"], "left_semi").drop("commit")


def entries_with_mentions(entries: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entries with their lists again; spellings are distinct, so a list is as
    long as an entry has ways to be written, however often they occur."""
    own = ["project_id", "pd_id"]
    listed = mentions.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("m_seq", "m_pos", "mention"))).alias("_m"))
    return entries.join(listed, own, "left").withColumn("mentions", F.transform("_m", lambda m: m["mention"])).drop("_m")


def join_documents(tables: VersionedTables, number: int, docs: DataFrame, doc_entries: DataFrame, marks: DataFrame) -> bool:
    """Documents join their projects, all at once: the projects' registries take
    up the documents' entries, entries that a document has no mark of are
    matched between its marks, the documents are inserted or replaced, listed
    in their projects, and the registries stored. One commit; done before, it
    changes nothing.

    ``docs(project_id, doc_id, text)``; ``doc_entries`` are registry rows with
    ``mentions``; ``marks(project_id, doc_id, unit_no, start, end, hit, pd_id)``
    by line.
    """
    if tables.is_done(number):
        return False
    from .matching import match_unmarked, resolve_overlaps
    from .redaction import second_pass_segments, segment_spans
    from .registry import explode_registry
    from ..plans.flows import line_units

    touched = docs.select("project_id").distinct()
    known = current(tables, "registry").join(touched, "project_id", "left_semi")
    known = settle(entries_with_mentions(known, current(tables, "mentions")))
    # the project's own entries come first
    ends = known.groupBy("project_id").agg(F.max("seq").alias("_end"))
    fresh = doc_entries.join(ends, "project_id", "left").withColumn("seq", F.col("seq") + F.coalesce(F.col("_end") + 1, F.lit(0))).drop("_end")
    persons, others, rows = merge_document_into_project(known, fresh.select(*known.columns))
    merged = settle(persons.unionByName(others).select(*[c.split()[0] for c in ENTRY_COLUMNS.split(", ")]))
    rows = settle(rows)

    marks = marks.select("project_id", "doc_id", "unit_no", "start", "end", "hit", "pd_id")
    gaps = settle(second_pass_segments(line_units(docs), marks))
    mentions = explode_registry(entries_with_mentions(merged, rows), literal_persons=True)
    found = resolve_overlaps(match_unmarked(gaps, mentions, marks, literal_persons=True), "merge")
    found = segment_spans(found).select(*marks.columns)

    listed = tables.read("members").drop("commit").join(touched, "project_id", "left_semi")
    grown = add_documents(listed, docs.select("project_id", "doc_id", F.col("doc_id").alias("a_seq")))
    new = grown.join(listed.select("project_id", "doc_id"), ["project_id", "doc_id"], "left_anti")
    return tables.commit(number, documents=docs, members=new, registry=merged, mentions=rows, marks=marks.unionByName(found))
