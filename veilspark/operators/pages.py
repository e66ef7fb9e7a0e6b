"""Pages of files: validation, numbering, assembly, metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_page, dehyphenate, js_trim, let
from ..schemas import PAGE, PAGE_METADATA, SOURCE_FILE
from .ordinal import block_of, first_per_key, with_ordinal

# ---- fixed values -----------------------------------------------------------
METADATA_VERSION = 1
MIN_REVISED_ONE_PAGE = 50
MIN_REVISED_PAGE = 30
# ---- end of fixed values ----------------------------------------------------

# Pages glued into one text row; a longer file continues in the next segment.
SEGMENT_PAGES = 1000


def positive(value: Column, to: str = "bigint") -> Column:
    """Number when finite and above zero, else null; text is converted."""
    usable = lambda n: (n > 0) & (n < float("inf")) & ~F.isnan(n)
    kept = let(value.try_cast("double"), lambda n: F.when(usable(n), n.cast(to)))
    return F.nullif(kept, F.lit(0).cast(to))


def number_or_null(value: Column) -> Column:
    finite = lambda n: (F.abs(n) < float("inf")) & ~F.isnan(n)
    return let(value.try_cast("double"), lambda n: F.when(finite(n), n))


def _missing_as_null(value: Column) -> Column:
    """Empty text and zero count as missing where a default exists."""
    return F.when(value.cast("string").isin("", "0", "0.0"), None).otherwise(value)


def valid_pages(pages: DataFrame, page_no: str = "page_no") -> DataFrame:
    """Rows whose page number is finite and positive, as a number."""
    return pages.withColumn(page_no, positive(F.col(page_no))).filter(F.col(page_no).isNotNull())


def pages_from_range(page_from: Column, page_to: Column) -> Column:
    """array<page>; empty unless both ends are positive and in order."""
    empty = F.lit(None).cast("double")

    def between(r: Column) -> Column:
        numbers = F.when(r["b"] >= r["a"], F.sequence(r["a"], r["b"]))
        return F.transform(
            F.coalesce(numbers, F.array().cast("array<bigint>")),
            lambda n, i: F.struct(
                n.alias("pageNumber"),
                (i + 1).cast("bigint").alias("chunkPageIndex"),
                empty.alias("pdfWidth"),
                empty.alias("pdfHeight"),
                empty.alias("renderWidth"),
                empty.alias("renderHeight"),
                F.lit(0.0).alias("rotation"),
                F.lit("").alias("mediaType"),
            ),
        )

    return let(F.struct(positive(page_from).alias("a"), positive(page_to).alias("b")), between)


def normalize_page(page: Column, index: Column, fallback_number: Column) -> Column:
    """struct<page> with coerced numbers and defaults; null without a number."""
    return let(
        positive(F.coalesce(_missing_as_null(page["pageNumber"]), fallback_number)),
        lambda number: F.when(
            number.isNotNull(),
            F.struct(
                number.alias("pageNumber"),
                F.coalesce(positive(page["chunkPageIndex"]), (index + 1).cast("bigint")).alias("chunkPageIndex"),
                number_or_null(page["pdfWidth"]).alias("pdfWidth"),
                number_or_null(page["pdfHeight"]).alias("pdfHeight"),
                positive(page["renderWidth"], "double").alias("renderWidth"),
                positive(page["renderHeight"], "double").alias("renderHeight"),
                F.coalesce(number_or_null(page["rotation"]), F.lit(0.0)).alias("rotation"),
                F.coalesce(page["mediaType"], F.lit("")).alias("mediaType"),
            ),
        ),
    )


def _text(value: Column, *more: Column) -> Column:
    found = [F.nullif(v, F.lit("")) for v in (value, *more)]
    return F.coalesce(*found, F.lit(""))


def normalize_source(source: Column, entry: Mapping[str, Column]) -> Column:
    """struct<source> of one metadata source with the document's own fields as
    fallback; null when neither range nor pages are known."""
    ends = F.struct(
        positive(F.coalesce(_missing_as_null(source["pageFrom"]), entry["page_from"])).alias("start"),
        positive(F.coalesce(_missing_as_null(source["pageTo"]), entry["page_to"])).alias("end"),
        positive(F.coalesce(_missing_as_null(source["totalPages"]), entry["total_pages"])).alias("total"),
    )
    file = source["sourceFile"]
    named = file.isNotNull() | (_text(entry["original_file_name"], entry["batch_file_name"]) != "")
    source_file = F.when(
        named,
        F.struct(
            _text(file["name"], entry["original_file_name"], entry["batch_file_name"]).alias("name"),
            positive(file["size"], "double").alias("size"),
            _text(file["type"]).alias("type"),
            _text(file["bucket"]).alias("bucket"),
            _text(file["storagePath"]).alias("storagePath"),
            _text(file["uploadedAt"]).alias("uploadedAt"),
        ),
    )
    project = F.nullif(_text(source["projectId"], entry["project_id"]), F.lit(""))

    def pages_of(e: Column) -> Column:
        given = F.transform(
            source["pages"], lambda p, i: normalize_page(p, i, F.when(e["start"].isNotNull(), e["start"] + i))
        )
        return F.when(F.size(source["pages"]) > 0, F.filter(given, lambda p: p.isNotNull())).otherwise(
            pages_from_range(e["start"], e["end"])
        )

    def shape(e: Column, pages: Column) -> Column:
        return F.when(
            e["start"].isNotNull() | e["end"].isNotNull() | (F.size(pages) > 0),
            F.struct(
                source_file.alias("sourceFile"),
                _text(source["batchFileName"], entry["batch_file_name"]).alias("batchFileName"),
                project.alias("projectId"),
                F.coalesce(e["start"], F.get(pages, F.lit(0))["pageNumber"]).alias("pageFrom"),
                F.coalesce(e["end"], F.try_element_at(pages, F.lit(-1))["pageNumber"]).alias("pageTo"),
                e["total"].alias("totalPages"),
                pages.alias("pages"),
            ),
        )

    return let(ends, lambda e: let(pages_of(e), lambda pages: shape(e, pages)))


def normalize_metadata(meta: Column, entry: Mapping[str, Column]) -> Column:
    """Page metadata of a document in its normal form (in-row); documents
    without usable metadata get one source built from their own fields."""
    known = F.filter(
        F.transform(meta["sources"], lambda s: normalize_source(s, entry)), lambda s: s.isNotNull()
    )
    files = entry.get("source_files")
    first_file = F.get(files, F.lit(0)) if files is not None else F.lit(None).cast(SOURCE_FILE)
    bare = F.struct(
        first_file.cast(SOURCE_FILE).alias("sourceFile"),
        entry["batch_file_name"].alias("batchFileName"),
        entry["project_id"].alias("projectId"),
        entry["page_from"].alias("pageFrom"),
        entry["page_to"].alias("pageTo"),
        entry["total_pages"].alias("totalPages"),
        F.lit(None).cast(f"array<{PAGE}>").alias("pages"),
    )
    none = F.lit(None).cast("string")
    no_names = {**entry, "original_file_name": none, "batch_file_name": none}
    built = normalize_source(bare, no_names)
    version = F.lit(METADATA_VERSION).alias("version")
    return let(
        F.struct(known.alias("known"), built.alias("built")),
        lambda m: F.when(F.size(m["known"]) > 0, F.struct(version, m["known"].alias("sources")))
        .when(m["built"].isNotNull(), F.struct(version, F.array(m["built"]).alias("sources"))),
    ).cast(PAGE_METADATA)


def assemble_pages(
    pages: DataFrame, file: tuple[str, ...] = ("file_key",), clean: bool = True, segment: int = SEGMENT_PAGES
) -> DataFrame:
    """Text of a file from its pages, each behind its page marker.

    One row per file and run of ``segment`` page numbers, so a huge file never
    has to fit into one task: its text is its segments in order, joined by a
    line break. A page that arrives twice counts once (first by ``seq`` where
    the column exists).
    """
    keys = [*file, "page_no"]
    body = clean_page("text") if clean else F.col("text")
    rows = pages.select(*keys, *(["seq"] if "seq" in pages.columns else []), body.alias("text"))
    once = first_per_key(rows, keys, ["seq"] if "seq" in pages.columns else ["text"])
    piece = F.concat(F.lit("[PAGE:"), F.col("page_no").cast("string"), F.lit("]\n"), F.col("text"))
    return (
        once.withColumn("segment_no", F.floor((F.col("page_no") - 1) / segment).cast("bigint"))
        .groupBy(*file, "segment_no")
        .agg(
            F.array_sort(F.collect_list(F.struct("page_no", piece.alias("t")))).alias("_p"),
            F.min("page_no").alias("page_from"),
            F.max("page_no").alias("page_to"),
            F.count("*").alias("n_pages"),
        )
        .select(
            *file,
            "segment_no",
            "page_from",
            "page_to",
            "n_pages",
            F.array_join(F.transform("_p", lambda p: p["t"]), "\n").alias("text"),
        )
    )


def apply_revision(pages: DataFrame, revised: DataFrame, file: tuple[str, ...] = ("file_key",)) -> DataFrame:
    """Revised page texts where they are long enough, with their markers.

    Several pages: a revised page counts above 30 signs, else the trimmed
    original stays; either is dehyphenated; blank pages are left alone. A lone
    page needs more than 50 signs, else its text is returned as it was.
    ``pages(file, page_no, marker, text)``; ``revised(file, page_no, revised)``.
    """
    counts = pages.groupBy(*file).agg(F.count("*").alias("_n"))
    joined = pages.join(revised, [*file, "page_no"], "left").join(counts, list(file))
    lone = F.col("_n") <= 1
    long_enough = F.length("revised") > F.when(lone, MIN_REVISED_ONE_PAGE).otherwise(MIN_REVISED_PAGE)
    accepted = F.coalesce(long_enough, F.lit(False))
    marked = lambda body: F.when(
        F.col("marker").isNotNull(), F.concat(F.lit("\n"), F.col("marker"), F.lit("\n"), body)
    ).otherwise(body)
    text = (
        F.when(lone & accepted, marked(dehyphenate("revised")))
        .when(lone, F.concat(F.coalesce("marker", F.lit("")), F.col("text")))
        .when(js_trim("text") == "", marked(F.col("text")))
        .when(accepted, marked(dehyphenate("revised")))
        .otherwise(marked(dehyphenate(js_trim("text"))))
    )
    return joined.select(*file, "page_no", text.alias("text"), accepted.alias("accepted"))


def dedupe_pages(pages: DataFrame, source: tuple[str, ...] = ("source_key",)) -> DataFrame:
    """First row per source and page number (by ``seq``), renumbered 1..n as
    ``chunk_page_index``. Copies of a page are aggregated, not gathered."""
    once = first_per_key(valid_pages(pages), [*source, "page_no"], ["seq"])
    return with_ordinal(
        once, list(source), [F.col("page_no")], [block_of("page_no", 4096)], out="chunk_page_index"
    )


def source_key(file_path: Column, file_name: Column, batch_file: Column, project: Column) -> Column:
    return F.concat_ws("::", *[F.coalesce(c, F.lit("")) for c in (file_path, file_name, batch_file, project)])


def merge_page_metadata(sources: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources of the same file become one: lowest start, highest end, first
    known total (by ``seq``), with their pages deduplicated.

    ``sources(scope, source_key, seq, page_from, page_to, total_pages)``;
    ``pages(scope, source_key, seq, page_no)``. Returns (sources, pages).
    """
    own = ["scope", "source_key"]
    total = F.nullif(F.col("total_pages"), F.lit(0))
    merged = sources.groupBy(*own).agg(
        F.min(F.nullif(F.col("page_from"), F.lit(0))).alias("page_from"),
        F.max(F.nullif(F.col("page_to"), F.lit(0))).alias("page_to"),
        F.min_by(total, F.when(total.isNotNull(), F.col("seq"))).alias("total_pages"),
        F.min("seq").alias("seq"),
    )
    return merged, dedupe_pages(pages, tuple(own))
