"""Regular-expression builders, each a Column made from the mention text.

Every pattern starts with ``(?iu)`` and is put together from escaped parts, so
no value can yield an invalid expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .charset import LETTER, LETTERS, WS
from .text import as_col, js_trim, let

# ---- fixed values -----------------------------------------------------------
FLAGS = "(?iu)"
LEFT_EDGE = f"(?<!{LETTER})"
RIGHT_EDGE = f"(?!{LETTER})"
ENDING = "[А-яЁё]{0,5}"
INITIAL = "[А-ЯЁ]"
SEP = rf"{WS}*[.,]{WS}*"
INITIALS_AFTER = f"(?:{WS}+{INITIAL}{SEP}{INITIAL}(?:{SEP})?|{WS}+{INITIAL}{SEP})?"
INITIALS_BEFORE = f"(?:(?:{INITIAL}{SEP}{INITIAL}(?:{SEP})?|{INITIAL}{SEP}){WS}+)?"
STARTS_WITH_INITIALS = rf"(?iu)\A{INITIAL}{WS}*[.,]{WS}*{INITIAL}?(?:{WS}*[.,])?{WS}"
STREET = (
    rf"(?iu)(?:ул\.?|улиц[аеиы]){WS}*([А-ЯA-ZЁ][A-Za-zА-Яа-яЁё0-9-]*(?:{WS}+[А-ЯA-ZЁ][A-Za-zА-Яа-яЁё0-9-]*){{0,3}})"
)
HOUSE = rf"(?iu)(?:д\.?|дом){WS}*№?{WS}*([0-9]+(?:[A-Za-zА-Яа-яЁё/-]*[0-9A-Za-zА-Яа-яЁё]*)?)"
HOUSE_AT_END = rf"(?iu),{WS}*([0-9]+(?:[A-Za-zА-Яа-яЁё/-]*[0-9A-Za-zА-Яа-яЁё]*)?){WS}*\z"
LOCALITY = (
    rf"(?iu)(?:\A|,{WS}*|{WS}+)(с\.?|пос\.?|пгт\.?|г\.?|дер\.?|д\.){WS}*"
    rf"([А-ЯA-ZЁ][A-Za-zА-Яа-яЁё-]*(?:{WS}+[А-ЯA-ZЁ][A-Za-zА-Яа-яЁё-]*){{0,2}})"
)
STREET_LABEL = r"(?:ул\.?|улиц[аеиы])"
HOUSE_LABEL = r"(?:д\.?|дом)"
# ---- end of fixed values ----------------------------------------------------


def regex_escape(s: Column | str) -> Column:
    return F.regexp_replace(as_col(s), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def ws_flexible_pattern(v: Column | str) -> Column:
    """The value with any run of white space (line breaks too) between words.
    A blank value is taken literally. Without flags, so that it can be nested."""
    v = as_col(v)
    words = F.filter(F.split(js_trim(v), WS + "+", -1), lambda w: w != "")
    joined = F.array_join(F.transform(words, regex_escape), WS + "+")
    return F.when(F.size(words) == 0, regex_escape(v)).otherwise(joined)


def literal_pattern(v: Column | str) -> Column:
    return regex_escape(v)


def _first_letter_any_case(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    upper, lower = F.upper(first), F.lower(first)
    head = F.when(
        upper != lower, F.concat(F.lit("["), regex_escape(upper), regex_escape(lower), F.lit("]"))
    ).otherwise(regex_escape(first))
    return F.when(w == "", "").otherwise(F.concat(head, regex_escape(F.substring(w, F.lit(2), F.length(w)))))


def is_inflected(word: Column) -> Column:
    """Only longer words with a Russian final letter change their ending."""
    return (F.length(word) > 4) & word.rlike(r"[А-яЁё]\z")


def word_stem(word: Column) -> Column:
    return F.when(is_inflected(word), F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(word)


def _word_pattern(word: Column) -> Column:
    body = _first_letter_any_case(word_stem(word))
    return F.when(is_inflected(word), F.concat(body, F.lit(ENDING))).otherwise(body)


def mention_words(mention: Column | str) -> Column:
    return F.split(as_col(mention), WS + "+", -1)


def person_pattern(mention: Column | str) -> Column:
    """Inflected words, optional initials behind, for one word also in front."""
    m = as_col(mention)
    words = mention_words(m)
    body = F.array_join(F.transform(words, _word_pattern), WS + "+")
    single = (F.size(words) == 1) & ~m.rlike(STARTS_WITH_INITIALS)
    return F.concat(
        F.lit(LEFT_EDGE), F.when(single, INITIALS_BEFORE).otherwise(""), body, F.lit(INITIALS_AFTER)
    )


def ambiguous_pattern(v: Column | str) -> Column:
    return F.concat(F.lit(LEFT_EDGE), ws_flexible_pattern(v), F.lit(RIGHT_EDGE))


def address_parts(v: Column | str) -> Column:
    """struct<street, house, locality_type, locality_name>; null unless both
    street and house are present."""
    # each pattern is tried once per row, though its result is read several times
    return let(js_trim(F.coalesce(as_col(v), F.lit(""))), _parts_of)


def _parts_of(text: Column) -> Column:
    def found(pattern: str, group: int) -> Column:
        return js_trim(F.regexp_extract(text, pattern, group))

    def located(x: Column) -> Column:
        place = F.struct(
            x["street"].alias("street"),
            x["house"].alias("house"),
            found(LOCALITY, 1).alias("locality_type"),
            found(LOCALITY, 2).alias("locality_name"),
        )
        return F.when((x["street"] != "") & (x["house"] != ""), place)

    def with_house(street: Column) -> Column:
        house = let(found(HOUSE, 1), lambda h: F.when(h != "", h).when(street != "", found(HOUSE_AT_END, 1)).otherwise(""))
        return let(F.struct(street.alias("street"), house.alias("house")), located)

    return let(found(STREET, 1), with_house)


def address_pattern(v: Column | str) -> Column:
    """The value itself or street and house in one of three usual orders."""
    both = F.struct(ws_flexible_pattern(v).alias("exact"), address_parts(v).alias("parts"))
    return let(both, lambda x: F.when(x["parts"].isNull(), x["exact"]).otherwise(_address_variants(x["exact"], x["parts"])))


def _address_variants(exact: Column, parts: Column) -> Column:
    flexible = lambda part, many: F.regexp_replace(regex_escape(part), WS + "+", F.lit(WS.replace("\\", "\\\\") + many))
    gap = WS[:-1] + ",]+"
    between = rf"(?:{WS}*,{WS}*|{WS}+)"

    def of(x: Column) -> Column:
        before = F.when(x["known"], F.concat(F.lit("(?:"), x["place"], F.lit(gap + ")?"))).otherwise("")
        after = F.when(x["known"], F.concat(F.lit("(?:" + gap), x["place"], F.lit(")?"))).otherwise("")
        variants = [
            exact,
            F.concat(
                before,
                F.lit(rf"(?:по{WS}+)?{STREET_LABEL}{WS}+"),
                x["street"],
                F.lit(rf"{between}(?:{HOUSE_LABEL}{WS}*№?{WS}*)?"),
                x["house"],
                after,
            ),
            F.concat(
                before,
                F.lit(rf"(?:на{WS}+)?улиц[еы]{WS}+"),
                x["street"],
                F.lit(rf"{between}(?:дом(?:е|а)?{WS}*)?"),
                x["house"],
                after,
            ),
            F.concat(
                F.lit(rf"(?:во{WS}+дворе{WS}*)?(?:{HOUSE_LABEL}{WS}*№?{WS}*)"),
                x["house"],
                F.lit(rf"(?:{WS}*(?:,|по){WS}*|{WS}+по{WS}+){STREET_LABEL}{WS}+"),
                x["street"],
                after,
            ),
        ]
        return F.concat(F.lit("(?:"), F.concat_ws("|", *variants), F.lit(")"))

    escaped = F.struct(
        flexible(parts["street"], "+").alias("street"),
        regex_escape(parts["house"]).alias("house"),
        F.concat(flexible(parts["locality_type"], "*"), F.lit(WS + "*"), flexible(parts["locality_name"], "+")).alias("place"),
        (parts["locality_name"] != "").alias("known"),
    )
    return let(escaped, of)


def mention_pattern(kind: Column, pd_type: Column, mention: Column) -> Column:
    """Pattern by kind of registry entry: person, address or any other value."""
    return F.concat(
        F.lit(FLAGS),
        F.when(kind == "person", person_pattern(mention))
        .when(pd_type == "address", address_pattern(mention))
        .otherwise(ws_flexible_pattern(mention)),
    )


def initials_of(words: Column) -> Column:
    """Up to two upper-case initials from the words behind the surname."""

    def of_word(word: Column) -> Column:
        letters = F.regexp_extract_all(word, F.lit(f"([{LETTERS}])"), F.lit(1))
        return F.slice(letters, F.lit(1), F.when(word.rlike("[.,]"), 2).otherwise(1))

    tail = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.slice(F.transform(F.flatten(F.transform(tail, of_word)), F.upper), 1, 2)
