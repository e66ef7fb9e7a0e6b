"""Readers for document and project tables, portable files and source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import js_trim, let
from ..operators.pages import normalize_metadata
from ..schemas import PAGE_METADATA, PERSONAL_DATA, PORTABLE, SOURCE_FILE

# ---- fixed values -----------------------------------------------------------
DEFAULT_SOURCE = "ocr"
IMPORTED_TITLE = "Импортированный документ"
IMAGE_ENDINGS = r"(?i)\.(jpe?g|png|webp|gif|bmp|tiff?)\z"
REJECTED = "unsupported file type"
# ---- end of fixed values ----------------------------------------------------


def _empty_pd() -> Column:
    return F.from_json(F.lit('{"persons":[],"otherPD":[],"ambiguousPersons":[]}'), PERSONAL_DATA)


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def _number(name: str) -> Column:
    return F.nullif(F.col(name).cast("bigint"), F.lit(0))


def complete_documents(rows: DataFrame) -> DataFrame:
    """Fill absent columns of a document table (older tables lack some)."""
    wanted = {
        "id": "string", "user_id": "string", "project_id": "string", "title": "string", "original_file_name": "string",
        "text": "string", "edited_html": "string", "personal_data": PERSONAL_DATA, "anonymized": "map<string,boolean>",
        "source": "string", "is_project_summary": "boolean", "page_from": "bigint", "page_to": "bigint",
        "total_pages": "bigint", "chunk_index": "bigint", "chunk_size": "bigint", "batch_file_name": "string",
        "source_files": f"array<{SOURCE_FILE}>", "page_metadata": PAGE_METADATA, "saved_at": "timestamp",
        "updated_at": "timestamp",
    }
    have = set(rows.columns)
    return rows.select(
        *[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in wanted.items()]
    )


def read_documents(rows: DataFrame, ordered: bool = True) -> DataFrame:
    """Document rows in working shape: every column defaulted, page range taken
    from the first metadata source where the row has none, newest first.

    ``ordered=False`` leaves out the global sort for use inside a larger plan.
    """
    full = complete_documents(rows)
    entry = {c: F.col(c) for c in (
        "original_file_name", "batch_file_name", "project_id", "page_from", "page_to", "total_pages", "source_files")}
    meta = full.withColumn("page_metadata", normalize_metadata(F.col("page_metadata"), entry))
    first = F.get(F.col("page_metadata.sources"), F.lit(0))
    out = meta.select(
        F.col("id").alias("doc_id"),
        "user_id",
        F.nullif(F.col("project_id"), F.lit("")).alias("project_id"),
        "title",
        _text("original_file_name").alias("original_file_name"),
        _text("text").alias("text"),
        _text("edited_html").alias("edited_html"),
        F.coalesce("personal_data", _empty_pd()).alias("personal_data"),
        F.coalesce("anonymized", F.create_map().cast("map<string,boolean>")).alias("anonymized"),
        _text("source", DEFAULT_SOURCE).alias("source"),
        F.coalesce("is_project_summary", F.lit(False)).alias("is_summary"),
        F.coalesce(_number("page_from"), first["pageFrom"]).alias("page_from"),
        F.coalesce(_number("page_to"), first["pageTo"]).alias("page_to"),
        F.coalesce(_number("total_pages"), first["totalPages"]).alias("total_pages"),
        "chunk_index",
        "chunk_size",
        _text("batch_file_name").alias("batch_file"),
        F.coalesce("source_files", F.array().cast(f"array<{SOURCE_FILE}>")).alias("source_files"),
        "page_metadata",
        F.coalesce("saved_at", "updated_at").alias("saved_at"),
    )
    return out.orderBy(F.desc("saved_at"), F.desc("doc_id")) if ordered else out


def read_projects(rows: DataFrame, ordered: bool = True) -> DataFrame:
    have = set(rows.columns)
    empty = F.from_json(F.lit('{"persons":[],"otherPD":[]}'), PERSONAL_DATA)
    shared = F.coalesce("shared_pd", empty) if "shared_pd" in have else empty
    out = rows.select(
        F.col("id").alias("project_id"),
        "user_id",
        "title",
        F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"),
        shared.alias("shared_pd"),
        (F.col("batch_session") if "batch_session" in have else F.lit(None).cast("string")).alias("batch_session"),
        "created_at",
        "updated_at",
    )
    return out.orderBy(F.desc("updated_at"), F.desc("project_id")) if ordered else out


def read_portable_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Portable JSON below ``path``: new ids, defaults, normalised page
    metadata. One document per file, or per line with ``multi_line=False``.
    Records without title, html and text, and what is not JSON, come back with
    ``error`` set."""
    raw = (
        spark.read.schema(f"{PORTABLE}, _corrupt_record string")
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("file", F.input_file_name())
    )
    return shape_portable(raw)


def shape_portable(raw: DataFrame) -> DataFrame:
    empty = (_text("title") == "") & (_text("editedHtml") == "") & (_text("text") == "")
    error = (
        F.when(F.col("_corrupt_record").isNotNull(), "not a document file")
        .when(empty, "no document data")
    )
    entry = {
        "original_file_name": F.col("originalFileName"),
        "batch_file_name": F.col("batchFileName"),
        "project_id": F.lit(None).cast("string"),
        "page_from": F.col("pageFrom"),
        "page_to": F.col("pageTo"),
        "total_pages": F.col("totalPages"),
        "source_files": F.lit(None).cast(f"array<{SOURCE_FILE}>"),
    }
    return raw.select(
        F.concat(F.lit("doc_"), F.uuid()).alias("doc_id"),
        _text("title", IMPORTED_TITLE).alias("title"),
        _text("originalFileName").alias("original_file_name"),
        _text("text").alias("text"),
        _text("editedHtml").alias("edited_html"),
        F.coalesce("personalData", _empty_pd()).alias("personal_data"),
        F.coalesce("anonymized", F.create_map().cast("map<string,boolean>")).alias("anonymized"),
        _text("source", DEFAULT_SOURCE).alias("source"),
        _number("pageFrom").alias("page_from"),
        _number("pageTo").alias("page_to"),
        _number("totalPages").alias("total_pages"),
        _number("chunkIndex").alias("chunk_index"),
        _number("chunkSize").alias("chunk_size"),
        _text("batchFileName").alias("batch_file"),
        normalize_metadata(F.col("pageMetadata"), entry).alias("page_metadata"),
        F.current_timestamp().alias("saved_at"),
        error.alias("error"),
        "file",
    )


def classify_file(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return (
        F.when(name.rlike(r"(?i)\.pdf\z") | name.rlike(IMAGE_ENDINGS), "page-batch")
        .when(name.rlike(r"(?i)\.docx\z"), "docx")
        .otherwise("rejected")
    )


def classify_sources(files: DataFrame) -> DataFrame:
    """File rows ``(path, length, modificationTime)`` with their route; files
    of any other type keep a row with an error."""
    route = classify_file(F.col("path"))
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("file_name"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
        route.alias("route"),
        F.when(route == "rejected", REJECTED).alias("error"),
    )


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing only: the content column is never read."""
    return classify_sources(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content"))


def unify_sources(**frames: DataFrame) -> DataFrame:
    """Rows of several origins in one table; the keyword names the ``source``.
    Pasted text is trimmed and dropped when nothing is left."""
    out = None
    for source, df in frames.items():
        rows = df.withColumn("source", F.lit(source))
        if source == "paste":
            rows = rows.withColumn("text", js_trim("text")).filter("text <> ''")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def explode_personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry rows and ambiguous rows from nested ``personal_data``; ids are
    put under the project so that documents cannot clash."""
    # outer: an inner explode would add a size filter that parses the answer twice
    pd = F.col("personal_data")
    base = ["project_id", "doc_id"]
    nothing = F.lit(None).cast("string")
    persons = docs.select(*base, F.posexplode_outer(pd["persons"]).alias("p", "e")).filter("p IS NOT NULL").select(
        *base,
        F.col("e.id").alias("pd_id"),
        F.col("p").cast("bigint").alias("seq"),
        F.lit("person").alias("kind"),
        F.col("e.category").alias("category"),
        nothing.alias("pd_type"),
        F.col("e.fullName").alias("value"),
        F.col("e.role").alias("role"),
        F.col("e.letter").alias("letter"),
        nothing.alias("replacement"),
        F.col("e.mentions").alias("mentions"),
    )
    others = docs.select(*base, F.posexplode_outer(pd["otherPD"]).alias("p", "e")).filter("p IS NOT NULL").select(
        *base,
        F.col("e.id").alias("pd_id"),
        F.col("p").cast("bigint").alias("seq"),
        F.lit("other").alias("kind"),
        nothing.alias("category"),
        F.col("e.type").alias("pd_type"),
        F.col("e.value").alias("value"),
        nothing.alias("role"),
        nothing.alias("letter"),
        F.col("e.replacement").alias("replacement"),
        F.col("e.mentions").alias("mentions"),
    )
    ambiguous = docs.select(*base, F.posexplode_outer(pd["ambiguousPersons"]).alias("seq", "a")).filter("seq IS NOT NULL").select(
        *base, "seq", "a.value", "a.context", "a.reason"
    )
    return persons.unionByName(others), ambiguous


def parse_pd_response(raw: Column) -> Column:
    """struct<personal data> from a model answer: code fences off, first brace
    to last brace, parsed; what cannot be parsed is an empty registry."""
    fenced = F.regexp_replace(raw, r"(?ms)\A(.*?)^```[A-Za-z0-9_]*\n?", "$1")
    fenced = F.regexp_replace(fenced, r"(?ms)\A(.*?)```\s*$", "$1")
    body = F.regexp_extract(fenced, r"(?s)(\{.*\})", 1)

    def sound(parsed: Column) -> Column:
        nothing = parsed.isNull() | (
            parsed["persons"].isNull() & parsed["otherPD"].isNull() & parsed["ambiguousPersons"].isNull()
        )
        return F.when(nothing, _empty_pd()).otherwise(parsed)

    # parsed once, though read several times
    return let(F.from_json(F.nullif(body, F.lit("")), PERSONAL_DATA, {"mode": "PERMISSIVE"}), sound)


def read_pd_responses(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry and ambiguous rows from model answers ``(project_id, doc_id,
    raw)``: ambiguous mentions leave the persons' lists, addresses without
    detail and generic birthplaces are dropped."""
    from ..operators.registry import filter_address_detail, filter_generic_birthplace

    parsed = answers.select("project_id", "doc_id", parse_pd_response(F.col("raw")).alias("personal_data"))
    unclear = F.filter(
        F.transform(
            F.coalesce(F.col("personal_data.ambiguousPersons"), F.array().cast("array<struct<value:string,context:string,reason:string>>")),
            lambda a: F.lower(js_trim(F.coalesce(a["value"], F.lit("")))),
        ),
        lambda v: v != "",
    )
    def without(mentions):
        known = F.coalesce(mentions, F.array().cast("array<string>"))
        return F.filter(known, lambda m: m.isNotNull() & ~F.coalesce(F.array_contains("unclear", F.lower(js_trim(m))), F.lit(False)))

    # the answer's own list cleans its persons in the row, before they are spread
    persons = F.transform("personal_data.persons", lambda p: F.when(F.size("unclear") > 0, p.withField("mentions", without(p["mentions"]))).otherwise(p))
    cleaned_answers = parsed.withColumn("unclear", unclear).withColumn("personal_data", F.col("personal_data").withField("persons", persons))
    cleaned, ambiguous = explode_personal_data(cleaned_answers.drop("unclear"))
    person = F.col("kind") == "person"
    return filter_generic_birthplace(filter_address_detail(cleaned.filter("kind = 'other'"))).unionByName(
        cleaned.filter(person)
    ), ambiguous
