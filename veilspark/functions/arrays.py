"""In-row array rules over mention lists (each list belongs to one entry)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .patterns import initials_of
from .text import as_col, normalize_pd_text


def dedupe_mentions(values: Column | str) -> Column:
    """Normalised, no empties, the first spelling per lower-case key, in order.

    Sort, compare neighbours, sort back: n log n, whatever the list length."""
    norm = F.filter(
        F.transform(F.coalesce(as_col(values), F.array().cast("array<string>")), normalize_pd_text),
        lambda v: v != "",
    )
    tagged = F.transform(
        norm, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))
    )
    ordered = F.array_sort(tagged)
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda t: t["k"]))
    firsts = F.filter(
        F.zip_with(ordered, before, lambda t, k: F.struct(t["i"].alias("i"), t["v"].alias("v"), t["k"].alias("k"), k.alias("p"))),
        lambda t: t["k"].isNotNull() & ~t["k"].eqNullSafe(t["p"]),
    )
    back = F.array_sort(F.transform(firsts, lambda t: F.struct(t["i"], t["v"])))
    return F.transform(back, lambda t: t["v"])


def person_mentions(full_name: Column, mentions: Column) -> Column:
    return dedupe_mentions(F.concat(F.array(full_name), F.coalesce(mentions, F.array().cast("array<string>"))))


def other_mentions(value: Column, mentions: Column) -> Column:
    return person_mentions(value, mentions)


def canonical_mentions(full_name: Column | str) -> Column:
    """Name, surname, surname with initials behind and in front."""
    norm = normalize_pd_text(full_name)
    words = F.split(norm, " ", -1)
    surname = F.element_at(words, 1)
    initials = F.array_join(F.transform(initials_of(words), lambda c: F.concat(c, F.lit("."))), "")
    with_initials = initials != ""
    return dedupe_mentions(
        F.array(
            norm,
            surname,
            F.when(with_initials, F.concat_ws(" ", surname, initials)).otherwise(""),
            F.when(with_initials, F.concat_ws(" ", initials, surname)).otherwise(""),
        )
    )
