"""Documents as lines: exploding, gluing broken lines, page of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import becomes_special, is_blank, is_special_line, js_rtrim, js_trim, let


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line; every other column rides along except the text."""
    rest = [c for c in docs.columns if c not in (text,)]
    # a split is never empty; outer keeps the optimizer from testing that by splitting twice
    return docs.select(*rest, F.posexplode_outer(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def _joins(line: Column, before: Column) -> Column:
    """Whether ``line`` continues the line ``before`` it (null: first line)."""
    return F.coalesce(
        ~is_blank(before)
        & ~is_special_line(js_trim(before))
        & ~line.rlike(r"\A[ \t]{2,}")
        & ~is_special_line(js_trim(line)),
        F.lit(False),
    )


#: Lines folded in one piece; longer texts go block by block.
FOLD_BLOCK = 256


def merge_broken_lines(text: Column | str) -> Column:
    """Glue a line to the paragraph line above it, inside the row.

    A line opens a new paragraph when it follows a blank line, starts with two
    or more blanks or tabs, or is a structural line; nothing is glued to a
    structural line. Each line is seen with its neighbour, so the work is
    linear in the text. A head such as ``##`` becomes structural by the first
    line glued to it; texts that have such a head are folded along their lines,
    carrying only that.
    """
    text = F.col(text) if isinstance(text, str) else text
    raw = F.split(text, "\n", -1)
    none = F.array(F.lit(None).cast("string"))
    with_before = F.zip_with(raw, F.slice(F.concat(none, raw), F.lit(1), F.size(raw)), lambda c, p: F.struct(c.alias("line"), p.alias("before")))
    seen = F.transform(
        with_before,
        lambda t: F.struct(t["line"].alias("line"), _joins(t["line"], t["before"]).alias("joins"), becomes_special(js_trim(t["line"])).alias("latent")),
    )

    def glued(lines: Column, joins: Column) -> Column:
        marked = F.zip_with(
            F.zip_with(lines, joins, lambda m, j: F.struct(m["line"].alias("line"), j.alias("joins"))),
            F.slice(F.concat(joins, F.array(F.lit(False))), F.lit(2), F.size(joins)),
            lambda m, n: F.struct(m["line"].alias("line"), m["joins"].alias("joins"), n.alias("continues")),
        )
        pieces = F.transform(
            marked,
            lambda m, i: F.concat(
                F.when(i == 0, "").when(m["joins"], " ").otherwise("\n"),
                F.when(m["joins"], js_trim(m["line"])).when(m["continues"], js_rtrim(m["line"])).otherwise(m["line"]),
            ),
        )
        return F.array_join(pieces, "")

    def joined(lines: Column) -> Column:
        latent = F.exists(lines, lambda m: m["latent"])
        joins = F.when(latent, _folded_joins(lines)).otherwise(F.transform(lines, lambda m: m["joins"]))
        return let(joins, lambda j: glued(lines, j))

    # lines and joins are worked out once, though read several times
    return let(seen, joined)


def _folded_joins(seen: Column) -> Column:
    """Which lines join, when gluing may turn a head into a structural line.
    Carried along: whether the paragraph is such a head alone, and whether it
    has become structural."""

    def step(acc: Column, m: Column) -> Column:
        joined = m["joins"] & ~acc["special"]
        return F.struct(
            (~joined & m["latent"]).alias("latent"), (joined & acc["latent"]).alias("special"), F.concat(acc["out"], F.array(joined)).alias("out")
        )

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(
            F.slice(seen, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)),
            F.struct(acc["latent"].alias("latent"), acc["special"].alias("special"), F.array().cast("array<boolean>").alias("out")),
            step,
        )
        return F.struct(inner["latent"].alias("latent"), inner["special"].alias("special"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    start = F.struct(F.lit(False).alias("latent"), F.lit(False).alias("special"), F.array().cast("array<array<boolean>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(seen) - 1) / FOLD_BLOCK).cast("int"))
    return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))


def page_of_line(lines: DataFrame, id_col: str = "doc_id", segment: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Number of the last page marker at or above each line, and the last
    marker of the document as its page total.

    With ``segment`` the lines of a document come in segments, numbered in
    their order; windows then stay inside a segment, and the last marker of the
    segments before is carried into it as one small row each. A document
    without a marker takes its total from ``totals(id_col, total_pages,
    page_to)``, the first of the two that is known.
    """
    marker = F.regexp_extract("line", r"\A\[PAGE:([0-9]+)\]\z", 1)
    number = F.when(marker != "", marker.try_cast("bigint"))
    cell = [id_col] if segment is None else [id_col, segment]
    here = Window.partitionBy(*cell).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("_page", F.when(number > 0, number)).withColumn("_own", F.last("_page", ignorenulls=True).over(here))
    ends = marked.groupBy(*cell).agg(F.max_by("_page", F.when(F.col("_page").isNotNull(), F.col("line_no"))).alias("_end"))
    order = F.lit(0) if segment is None else F.col(segment)
    at = Window.partitionBy(id_col).orderBy(order)
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    whole = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)],
        F.last("_end", ignorenulls=True).over(before).alias("_carried"),
        F.last("_end", ignorenulls=True).over(whole).alias("last_page"),
    )
    if totals is not None:
        known = lambda c: F.nullif(F.col(c), F.lit(0))
        given = totals.select(F.col(id_col).alias("_of"), F.coalesce(known("total_pages"), known("page_to")).cast("bigint").alias("_given"))
        carried = carried.join(given, F.col("_k0").eqNullSafe(F.col("_of")), "left").withColumn("last_page", F.coalesce("last_page", "_given")).drop("_of", "_given")
    same = F.lit(True)
    for i, c in enumerate(cell):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (
        marked.join(carried, same)
        .withColumn("page_no", F.coalesce("_own", "_carried"))
        .drop("_page", "_own", "_carried", *[f"_k{i}" for i in range(len(cell))])
    )
