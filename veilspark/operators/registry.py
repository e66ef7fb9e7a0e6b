"""The personal-data registry in normal form.

``entries(project_id, pd_id, seq, kind, category, pd_type, value, role,
letter, replacement, mentions)`` - one row per person or other value;
``mentions`` is the entry's own list as it came in.
``mention rows(project_id, pd_id, ..., mention, m_seq, m_pos)`` - exploded.

Merged registries stay exploded: an entry met in a third of all inputs is then
an aggregate over its spellings, never a list built in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import canonical_mentions, dedupe_mentions, other_mentions, person_mentions
from ..functions.charset import WS
from ..functions.patterns import literal_pattern, mention_pattern, ws_flexible_pattern
from ..functions.text import js_trim, normalize_pd_text
from .ordinal import block_of, first_per_key, with_ordinal

# ---- fixed values -----------------------------------------------------------
PD_TYPES = [
    "address", "phone", "passport", "zagranpassport", "inn", "snils", "card", "email", "dob", "birthplace",
    "social_id", "vehicle_plate", "vehicle_vin", "driver_license", "military_id", "oms_policy",
    "birth_certificate", "imei", "org_link", "other",
]
# Labels put into a replacement; a type without label stands for itself.
TYPE_LABELS = {
    "address": "адрес",
    "phone": "телефон",
    "passport": "паспорт",
    "zagranpassport": "загранпаспорт",
    "inn": "ИНН",
    "snils": "СНИЛС",
    "card": "карта",
    "email": "email",
    "dob": "дата рождения",
    "birthplace": "место рождения",
    "vehicle_plate": "номер авто",
    "vehicle_vin": "VIN",
    "driver_license": "вод. удостоверение",
    "military_id": "военный билет",
    "oms_policy": "полис ОМС",
    "birth_certificate": "свид. о рождении",
    "imei": "IMEI",
    "other": "ПД",
}
# Headings of the type groups in a report.
TYPE_GROUP_LABELS = {
    "address": "Адреса",
    "phone": "Телефоны",
    "passport": "Паспорт РФ",
    "zagranpassport": "Загранпаспорт",
    "inn": "ИНН",
    "snils": "СНИЛС",
    "card": "Карты/счета",
    "email": "Email",
    "dob": "Даты рождения",
    "birthplace": "Место рождения",
    "social_id": "Аккаунты",
    "vehicle_plate": "Госномера ТС",
    "vehicle_vin": "VIN-номера",
    "driver_license": "Вод. удостоверения",
    "military_id": "Военные билеты",
    "oms_policy": "Полисы ОМС",
    "birth_certificate": "Св-ва о рождении",
    "imei": "IMEI устройств",
    "org_link": "Организации/ИП",
    "other": "Прочее",
}
PRIVATE_LETTERS = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"
ADDRESS_DETAIL = (
    r"ул\.?|пр\.?|пер\.?|пр-т|б-р|бульв|шоссе|наб\.?|пл\.?|д\.\s*\d|дом\s*\d|кв\.\s*\d|квартира\s*\d"
    r"|проспект|переулок|улица|бульвар|набережная|площадь|тупик|проезд|тер\.?|территори(?:я|и)|снт|днт|тсн"
    r"|сад\b|коллективный\s+сад|участ(?:ок|ка)\b|владен(?:ие|ия)\b|домовладен(?:ие|ия)\b|\d+[-/]\d+"
)
GENERIC_BIRTHPLACE = (
    r"(?iu)\A(г\.?\s*)?[А-ЯЁ][а-яё]+(-[А-ЯЁ][а-яё]+)?(\s+(обл|область|края|край|респ|республика)\.?)?\z"
)
# ---- end of fixed values ----------------------------------------------------

# A word edge in the browser dialect sees ASCII word characters only, so behind
# a Russian letter it needs one to follow.
_ADDRESS_DETAIL = ADDRESS_DETAIL.replace(r"\b", "(?=[A-Za-z0-9_])").replace(r"\s", WS)


def label_for(pd_type: Column, labels: dict[str, str] | None = None) -> Column:
    """Label of a type; an unknown type is its own label."""
    table = TYPE_LABELS if labels is None else labels
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), pd_type), pd_type)


def type_labels(entries: DataFrame) -> DataFrame:
    return entries.withColumn("label", label_for(F.col("pd_type"))).withColumn(
        "replacement", F.concat(F.lit("["), F.col("label"), F.lit("]"))
    )


def persons_by_category(entries: DataFrame, category: str) -> DataFrame:
    return entries.filter((F.col("kind") == "person") & (F.col("category") == category))


def filter_address_detail(entries: DataFrame, value: str = "value") -> DataFrame:
    """An address counts only with street, house, plot or similar detail."""
    return entries.filter((F.col("pd_type") != "address") | has_address_detail(F.col(value)))


def has_address_detail(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike(_ADDRESS_DETAIL)


def is_generic_birthplace(value: Column) -> Column:
    return js_trim(F.coalesce(value, F.lit(""))).rlike(GENERIC_BIRTHPLACE.replace(r"\s", WS))


def filter_generic_birthplace(entries: DataFrame, value: str = "value") -> DataFrame:
    """A birthplace that is just a city (and region) identifies nobody."""
    return entries.filter((F.col("pd_type") != "birthplace") | ~is_generic_birthplace(F.col(value)))


def mention_length_filter(rows: DataFrame, minimum: int = 2) -> DataFrame:
    """Person mentions shorter than ``minimum`` are ignored everywhere."""
    return rows.filter((F.col("kind") != "person") | (F.length("mention") >= minimum))


def explode_registry(entries: DataFrame, literal_persons: bool = False) -> DataFrame:
    """Mention rows with pattern and rank columns.

    Persons: their mentions, or the full name when the list is null; other
    values: value and mentions, deduplicated. One-letter person mentions are
    ignored. The rank columns order by length, then registry order, persons
    first; ``literal_persons`` leaves inflection out (used when an annotated
    document joins a project).
    """
    person = F.col("kind") == "person"
    values = F.when(person, F.coalesce("mentions", F.array("value"))).otherwise(
        other_mentions(F.col("value"), F.col("mentions"))
    )
    rows = entries.select(
        *[c for c in entries.columns if c != "mentions"], F.posexplode_outer(values).alias("m_pos", "mention")
    ).filter(F.col("mention").isNotNull() & (F.col("mention") != ""))
    rows = mention_length_filter(rows)
    kind = F.col("kind")
    pattern = (
        F.when(
            kind == "person", F.concat(F.lit("(?iu)"), literal_pattern("mention"))
        ).otherwise(F.concat(F.lit("(?iu)"), ws_flexible_pattern("mention")))
        if literal_persons
        else mention_pattern(kind, F.col("pd_type"), F.col("mention"))
    )
    return rows.select(
        "*",
        pattern.alias("pattern"),
        F.struct(
            (-F.length("mention")).alias("by_length"),
            F.when(kind == "person", 0).otherwise(1).alias("by_kind"),
            F.col("seq").cast("bigint").alias("by_seq"),
            F.col("m_pos").cast("bigint").alias("by_pos"),
        ).alias("rank"),
    )


def rank_mentions(mentions: DataFrame) -> DataFrame:
    """Global rank of mentions inside a project: longest first, then registry
    order, persons ahead of other values."""
    flat = mentions.select("*", *[F.col(f"rank.{f}").alias(f) for f in ("by_length", "by_kind", "by_seq", "by_pos")])
    return with_ordinal(
        flat,
        ["project_id"],
        [F.col(c) for c in ("by_length", "by_kind", "by_seq", "by_pos")],
        [F.col("by_length"), F.col("by_kind"), block_of("by_seq")],
        out="mention_rank",
        levels=2,
    ).drop("by_length", "by_kind", "by_seq", "by_pos")


def remove_ambiguous_mentions(entries: DataFrame, ambiguous: DataFrame, scope: str = "doc_id") -> DataFrame:
    """Delete from the persons' lists every mention that the same scope also
    reports as ambiguous (trimmed, lower case)."""
    key = lambda c: F.lower(js_trim(F.coalesce(c, F.lit(""))))
    unclear = ambiguous.select(F.col(scope), key(F.col("value")).alias("m_key")).filter("m_key <> ''").distinct()
    return entries.withColumn("m_key", key(F.col("mention"))).join(unclear, [scope, "m_key"], "left_anti").drop("m_key")


def _merge(entries: DataFrame, key: list[str], canonical_joins: bool) -> tuple[DataFrame, DataFrame]:
    """Shared core of both merges: base row per key, mentions met later.

    Nothing is collected per key. Every spelling is an aggregate row; the base
    row's own list is kept as it is unless spellings are added.
    """
    base = first_per_key(entries, ["project_id", *key], ["seq"])
    own = ["project_id", *key]
    listed = dedupe_mentions(F.col("mentions"))
    incoming = listed if not canonical_joins else other_mentions(F.col("value"), F.col("mentions"))
    firsts = base.select(*own, F.col("seq").alias("base_seq"), normalize_pd_text("value").alias("base_value"))
    spellings = (
        entries.select(*own, "seq", listed.alias("kept"), incoming.alias("offered"))
        .join(firsts, own)
        .select(
            *own,
            "seq",
            "base_seq",
            "base_value",
            F.posexplode(F.when(F.col("seq") == F.col("base_seq"), F.col("kept")).otherwise(F.col("offered"))).alias(
                "m_pos", "mention"
            ),
        )
        .withColumn("m_key", F.lower("mention"))
    )
    if not canonical_joins:
        spellings = spellings.filter(
            (F.col("seq") == F.col("base_seq")) | (F.col("m_key") != F.lower("base_value"))
        )
    spellings = (
        spellings.groupBy(*own, "m_key", "base_seq")
        .agg(F.min(F.struct("seq", "m_pos", "mention")).alias("first"))
        .select(
            *own,
            F.col("first.mention").alias("mention"),
            F.col("first.seq").alias("m_seq"),
            F.col("first.m_pos").alias("m_pos"),
            (F.col("first.seq") > F.col("base_seq")).alias("added"),
        )
    )
    return base, spellings


def _settle_spellings(
    base: DataFrame, spellings: DataFrame, own: list[str], rewritten: DataFrame
) -> DataFrame:
    """Spellings of entries whose list was rewritten, raw lists of the others."""
    raw = base.join(rewritten, own, "left_anti").select(
        *own, F.posexplode_outer("mentions").alias("m_pos", "mention"), F.col("seq").alias("m_seq")
    )
    return (
        spellings.join(rewritten, own, "left_semi")
        .select(*own, "mention", "m_seq", "m_pos")
        .unionByName(raw.filter(F.col("mention").isNotNull()).select(*own, "mention", "m_seq", "m_pos"))
    )


def merge_persons(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge person rows (existing ones first by ``seq``) on the lower-case
    full name, white space as it is. Returns (entries, mention rows).

    The first row keeps id, category and letter; the role is the first
    non-empty one; later spellings are added unless known.
    """
    keyed = entries.withColumn("name_key", F.lower("value"))
    own = ["project_id", "name_key"]
    base, spellings = _merge(keyed, ["name_key"], canonical_joins=False)
    rewritten = spellings.filter("added").select(*own).distinct()
    role = keyed.filter(F.coalesce("role", F.lit("")) != "").groupBy(*own).agg(
        F.min_by("role", "seq").alias("first_role")
    )
    merged = (
        base.join(role, own, "left")
        .withColumn("role", F.coalesce(F.nullif(F.col("role"), F.lit("")), "first_role", "role"))
        .drop("first_role")
    )
    rows = _settle_spellings(base, spellings, own, rewritten)
    ids = merged.select(*own, "pd_id")
    return merged.drop("name_key", "mentions"), rows.join(ids, own).drop("name_key")


def merge_others(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge other values on type and lower-case normalised value."""
    keyed = entries.withColumn("value_key", F.lower(normalize_pd_text("value")))
    own = ["project_id", "pd_type", "value_key"]
    base, spellings = _merge(keyed, ["pd_type", "value_key"], canonical_joins=True)
    # any second row rewrites the list, even when it adds nothing new
    rewritten = keyed.groupBy(*own).agg(F.count("*").alias("n")).filter("n > 1").select(*own)
    rows = _settle_spellings(base, spellings, own, rewritten)
    ids = base.select(*own, "pd_id")
    return base.drop("value_key", "mentions"), rows.join(ids, own).drop("value_key")


def registry_delta(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Mention rows of ``incoming`` that an update must carry: all rows of new
    entries and the added spellings of known ones. Both sides are person rows;
    the result says which (``change`` in new / extended)."""
    def rows(df: DataFrame) -> DataFrame:
        return df.select(
            "project_id",
            F.lower("value").alias("name_key"),
            "pd_id",
            F.explode(person_mentions(F.col("value"), F.col("mentions"))).alias("mention"),
        ).withColumn("m_key", F.lower("mention"))

    known = rows(existing).select("project_id", "name_key", "m_key").distinct()
    names = existing.select("project_id", F.lower("value").alias("name_key")).distinct().withColumn("known", F.lit(True))
    fresh = rows(incoming).join(known, ["project_id", "name_key", "m_key"], "left_anti")
    return (
        fresh.join(names, ["project_id", "name_key"], "left")
        .select(
            "project_id", "pd_id", "mention", F.when(F.col("known"), "extended").otherwise("new").alias("change")
        )
        .distinct()
    )


def assign_letters(entries: DataFrame, existing: DataFrame | None = None, policy: str = "count") -> DataFrame:
    """Pseudonyms in registry order for persons that have none.

    Private persons take the letters of the alphabet, then ``Л-30`` and so on;
    all others ``[ФИО k]``. Numbering starts behind the *number* of existing
    entries of the category (so letters may collide after deletions);
    ``policy='max'`` starts behind the highest number in use instead.
    """
    if policy not in ("count", "max"):
        raise ValueError(f"unknown policy: {policy}")
    series = F.when(F.col("category") == "private", "private").otherwise("professional")
    todo = F.coalesce("letter", F.lit("")) == ""
    fresh = with_ordinal(
        entries.filter(todo).withColumn("_series", series),
        ["project_id", "_series"],
        [F.col("seq")],
        [block_of("seq")],
        out="_k",
        levels=2,
    )
    if existing is None:
        numbered = fresh.withColumn("_base", F.lit(0).cast("bigint"))
    else:
        known = existing.filter(F.col("category").isin("private", "professional"))
        if policy == "count":
            base = known.groupBy("project_id", F.col("category").alias("_series")).agg(F.count("*").alias("_base"))
        else:
            base = known.groupBy("project_id", F.col("category").alias("_series")).agg(
                F.max(_letter_number(F.col("letter"))).alias("_base")
            )
        numbered = fresh.join(base, ["project_id", "_series"], "left").withColumn(
            "_base", F.coalesce("_base", F.lit(0))
        )
    n = F.col("_base") + F.col("_k")
    alphabet = F.array(*[F.lit(f"{c}.") for c in PRIVATE_LETTERS])
    letter = F.when(
        F.col("_series") == "private",
        F.coalesce(F.get(alphabet, n.cast("int") - 1), F.concat(F.lit("Л-"), n.cast("string"))),
    ).otherwise(F.concat(F.lit("[ФИО "), n.cast("string"), F.lit("]")))
    done = entries.filter(~todo)
    return numbered.withColumn("letter", letter).select(*entries.columns).unionByName(done)


def _letter_number(letter: Column) -> Column:
    digits = F.regexp_extract(letter, "([0-9]+)", 1).try_cast("bigint")
    return F.coalesce(digits, F.nullif(F.instr(F.lit(PRIVATE_LETTERS), F.substring(letter, 1, 1)), F.lit(0)))


def delete_entries(entries: DataFrame, flags: DataFrame, matches: DataFrame, gone: DataFrame) -> tuple[DataFrame, ...]:
    """Drop entries with their flags and marks (the text underneath stays)."""
    keys = ["project_id", "pd_id"]
    drop = gone.select(*keys).distinct()
    return tuple(df.join(drop, keys, "left_anti") for df in (entries, flags, matches))


def rename_entries(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits ``(project_id, pd_id, new_value, new_role)``: the value is
    normalised, its canonical spellings join the list, a role may be set."""
    edits = edits.select("project_id", "pd_id", "new_value", "new_role").withColumn("_edited", F.lit(True))
    joined = entries.join(edits, ["project_id", "pd_id"], "left")
    value = normalize_pd_text(F.coalesce(F.nullif(F.col("new_value"), F.lit("")), "value"))
    edited = F.coalesce("_edited", F.lit(False))
    person = F.col("kind") == "person"
    more = F.when(person, canonical_mentions(value)).otherwise(F.array(value))
    mentions = dedupe_mentions(F.concat(F.coalesce("mentions", F.array().cast("array<string>")), more))
    return joined.select(
        *[
            F.when(edited, value).otherwise(F.col("value")).alias("value")
            if c == "value"
            else F.when(edited & person, F.coalesce("new_role", "role", F.lit(""))).otherwise(F.col("role")).alias("role")
            if c == "role"
            else F.when(edited, mentions).otherwise(F.col("mentions")).alias("mentions")
            if c == "mentions"
            else F.col(c)
            for c in entries.columns
        ]
    )


def attach_mentions(entries: DataFrame, attached: DataFrame, ambiguous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add text fragments to entries and drop the ambiguous rows they settle.

    ``attached(project_id, pd_id, fragment, a_seq, amb_value, amb_context,
    amb_reason)``. Returns (mention rows, ambiguous rows left). Spellings are
    aggregated, so an entry may take any number of fragments.
    """
    keys = ["project_id", "pd_id"]
    first = attached.groupBy(*keys).agg(F.min("a_seq").alias("first_seq"))
    old = entries.select(*keys, F.lit(-1).cast("bigint").alias("a_seq"), F.posexplode(
        F.coalesce("mentions", F.array().cast("array<string>"))).alias("m_pos", "mention"))
    new = attached.select(*keys, F.col("a_seq").cast("bigint"), F.lit(0).alias("m_pos"), F.col("fragment").alias("mention"))
    own = entries.join(first, keys).select(
        *keys, F.col("first_seq").cast("bigint").alias("a_seq"), F.lit(1).alias("m_pos"), F.col("value").alias("mention")
    )
    touched = old.join(first.select(*keys), keys, "left_semi").unionByName(new).unionByName(own)
    clean = touched.withColumn("mention", normalize_pd_text("mention")).filter("mention <> ''")
    merged = (
        clean.groupBy(*keys, F.lower("mention").alias("m_key"))
        .agg(F.min(F.struct("a_seq", "m_pos", "mention")).alias("f"))
        .select(*keys, "f.mention", "f.a_seq", "f.m_pos")
    )
    rows = merged.unionByName(old.join(first.select(*keys), keys, "left_anti").select(*keys, "mention", "a_seq", "m_pos"))
    a, s = ambiguous, attached.select("project_id", "amb_value", "amb_context", "amb_reason").distinct()
    text = lambda c: F.coalesce(c, F.lit(""))
    left = a.join(
        s,
        (a["project_id"] == s["project_id"])
        & (text(a["value"]) == text(s["amb_value"]))
        & (text(a["context"]) == text(s["amb_context"]))
        & (text(a["reason"]) == text(s["amb_reason"])),
        "left_anti",
    )
    return rows, left


def add_entries(entries: DataFrame, additions: DataFrame) -> DataFrame:
    """Append manual entries ``(project_id, pd_id, seq, kind, category,
    pd_type, value, role, selected)``: persons get the next letter, other
    values their label as replacement."""
    person = F.col("kind") == "person"
    shaped = additions.select(
        "project_id",
        "pd_id",
        "seq",
        "kind",
        "category",
        "pd_type",
        F.when(person, F.col("value")).otherwise(F.col("selected")).alias("value"),
        F.when(person, F.coalesce("role", F.lit(""))).otherwise(F.col("role")).alias("role"),
        F.lit(None).cast("string").alias("letter"),
        F.when(~person, F.concat(F.lit("["), label_for(F.col("pd_type")), F.lit("]"))).alias("replacement"),
        F.when(person, dedupe_mentions(F.array("value", "selected")))
        .otherwise(dedupe_mentions(F.array("selected")))
        .alias("mentions"),
    )
    persons = assign_letters(shaped.filter(person), entries.filter(person))
    return entries.unionByName(persons).unionByName(shaped.filter(~person))


def prune_unreferenced(entries: DataFrame, removed: DataFrame, marks: DataFrame) -> DataFrame:
    """Drop entries whose last mark was just removed."""
    keys = ["project_id", "pd_id"]
    gone = removed.select(*keys).distinct().join(marks.select(*keys), keys, "left_anti")
    return entries.join(gone, keys, "left_anti")


def effective_registry(entries: DataFrame, doc_entries: DataFrame, last_docs: DataFrame) -> DataFrame:
    """The project's shared registry if it has entries, else the registry of
    the project's last document. ``last_docs(project_id, doc_id)``."""
    shared = entries.select("project_id").distinct()
    fallback = doc_entries.join(last_docs, ["project_id", "doc_id"], "left_semi").join(
        shared, "project_id", "left_anti"
    )
    return entries.withColumn("origin", F.lit("shared")).unionByName(
        fallback.select(*entries.columns).withColumn("origin", F.lit("last_document"))
    )
