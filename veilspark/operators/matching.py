"""Dictionary matching: every mention of a project against every text unit.

A text unit is a row ``(project_id, doc_id, unit_no, text)`` - a line or a whole
document. Comparing all units of a project with all its mentions would grow
with their product, so both sides are first joined on an *anchor*: a piece of
the mention that any text it matches must contain as a word, as a word start or
as a run of characters. Each mention gets exactly one anchor, the one the
fewest mentions of its project share; each unit offers its distinct pieces.
The pattern then decides. Anchors never lose a match:

* person patterns (and ambiguous ones) start at a letter edge and keep each
  word up to its ending, so the start of a word's letters is the start of a
  letter run in the text;
* other values may begin and end inside a word, but pieces between separators
  appear as whole words, the last piece as a word start, neighbouring pieces as
  neighbours (the end of one next to the start of the other), and a value made
  of a single piece as a run of characters inside a word;
* of an address with street and house only the street's letters are sure to
  appear, as a run;
* a value without letters and digits is compared with every unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.charset import LETTERS, WS, WS_CHARS
from ..functions.patterns import FLAGS, LEFT_EDGE, RIGHT_EDGE, address_parts, mention_words, word_stem, ws_flexible_pattern
from ..functions.text import UNCERTAIN_MARK, fold_case, js_rtrim, js_trim
from ..plans.session import settle
from .plain_values import DEPTH, EDGED, FREE, PlainValues, find_values

UNIT = ["doc_id", "unit_no"]
# Lengths at which word starts and inner runs are indexed.
PREFIX_SIZES = (1, 2, 3, 5, 8)
GRAM_SIZES = (1, 2, 3, 6)
# Characters of both neighbours' near ends that are indexed together.
PAIR_SIZES = (1, 2, 3)
# Further anchors of a mention that are tested before its pattern.
EXTRA_ANCHORS = 3
# 64-bit words of the set filter over all anchors of a dictionary, powers of two.
FILTER_WORDS = {"broadcast": 2**14, "shuffle": 2**17}
RANK_FIELDS = (("by_length", "int"), ("by_kind", "int"), ("by_seq", "bigint"), ("by_pos", "bigint"))
# A dictionary up to this many bytes is sent to every executor.
BROADCAST_BYTES = 16_000_000
# Plain values of up to so many letters in all, and mention rows of so many bytes, are sent to every executor.
PLAIN_LETTERS = 4_000_000
PLAIN_BYTES = 64_000_000
# Buckets over which the units behind one anchor are spread otherwise.
SALT = 16

WORD = r"\p{L}+|\p{Nd}+"
_KIND = r"\A(\*|[A-Z][0-9]*)"
_DIGITS = r"\A\p{Nd}"
_LETTER_RUN = f"[{LETTERS}]+"


def _sized(tag: str, piece: Column, sizes: tuple[int, ...]) -> Column:
    """Key for the longest indexed size the piece fills."""
    n = F.length(piece)
    size = F.lit(None).cast("int")
    for s in sizes:
        size = F.when(n >= s, s).otherwise(size)
    return F.when(n > 0, F.concat(F.lit(tag), size.cast("string"), F.lit(":"), F.left(piece, size)))


def _person_anchors(mention: Column) -> Column:
    """Starts of the letters each word keeps, and the pieces inside a word. A
    word that does not start with a letter of its own gives no start."""

    def of_word(word: Column) -> Column:
        kept = fold_case(word_stem(word))
        lead = F.regexp_extract(kept, rf"\A({_LETTER_RUN})", 1)
        return F.concat(F.array(_sized("L", lead, PREFIX_SIZES)), _word_anchors(kept))

    return F.flatten(F.transform(mention_words(mention), of_word))


def _word_anchors(folded: Column) -> Column:
    """Whole inner pieces and the start of the last piece of a folded value."""
    pieces = F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(pieces)
    open_start = folded.rlike(rf"\A(?:{WORD})")
    open_end = folded.rlike(rf"(?:{WORD})\z")
    first = F.when(open_start, 2).otherwise(1)
    last = F.when(open_end, n - 1).otherwise(n)
    whole = F.when(last >= first, F.slice(pieces, first, last - first + 1)).otherwise(F.array().cast("array<string>"))
    whole = F.transform(whole, lambda p: F.concat(F.lit("W:"), p))
    start_of_last = F.when(
        open_end & (n >= F.when(open_start, 2).otherwise(1)), _sized("P", F.element_at(pieces, -1), PREFIX_SIZES)
    )
    return F.concat(whole, F.array(start_of_last), F.transform(_neighbours(pieces), _pair_anchor))


def _neighbours(pieces: Column) -> Column:
    """array<struct<a, b>> of pieces next to each other."""
    # get gives null for a place outside the array
    behind = F.transform(pieces, lambda p, i: F.struct(p.alias("a"), F.get(pieces, i + 1).alias("b")))
    return F.filter(behind, lambda x: x["b"].isNotNull())


def _near_ends(pieces: Column) -> Column:
    """Neighbours as far as they are indexed: the end of one, the start of the next."""
    most = max(PAIR_SIZES)
    ends = F.transform(pieces, lambda p: F.right(p, F.lit(most)))
    starts = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.left(p, F.lit(most)))
    pair = F.zip_with(
        ends, starts, lambda a, b: F.struct(a.alias("a"), F.length(a).alias("a_size"), b.alias("b"), F.length(b).alias("b_size"))
    )
    # the last piece has no neighbour
    return F.slice(pair, 1, F.size(starts))


def _pair_anchor(pair: Column) -> Column:
    most = F.lit(max(PAIR_SIZES))
    end, start = F.least(F.length(pair["a"]), most), F.least(F.length(pair["b"]), most)
    return F.concat(
        F.lit("B"), end.cast("string"), start.cast("string"), F.lit(":"), F.right(pair["a"], end), F.left(pair["b"], start)
    )


def _run_anchors(folded: Column) -> Column:
    """Character runs of the longest piece: the fallback of a one-piece value.
    Digits (``D``) and letters (``G``) are indexed apart."""
    pieces = F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1))
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    n = F.length(longest)
    size = F.lit(None).cast("int")
    for s in GRAM_SIZES:
        size = F.when(n >= s, s).otherwise(size)
    tag = F.when(longest.rlike(_DIGITS), "D").otherwise("G")
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(1), n - size + 1),
            lambda i: F.concat(tag, size.cast("string"), F.lit(":"), F.substring(longest, i, size)),
        ),
    ).otherwise(F.array(F.lit("*")))


def mention_anchors(kind: Column, pd_type: Column, mention: Column) -> Column:
    """All anchors a mention could be found by (at least one).

    An address is also found by street and house alone: only the letters of
    its street are sure to appear."""
    folded = fold_case(mention)
    at_letter_edge = kind.isin("person", "ambiguous")
    street = F.when((kind == "other") & (pd_type == "address"), address_parts(mention)["street"])
    strong = F.filter(
        F.when(at_letter_edge, _person_anchors(mention))
        .when(street.isNotNull(), _run_anchors(fold_case(street)))
        .otherwise(_word_anchors(folded)),
        lambda k: k.isNotNull(),
    )
    fallback = F.when(at_letter_edge, F.array(F.lit("*"))).otherwise(_run_anchors(folded))
    return F.array_distinct(F.when(F.size(strong) > 0, strong).otherwise(fallback))


def _probes(kind: Column, pd_type: Column, mention: Column) -> Column:
    """array of the first and last word as far as every match holds them."""
    words = F.filter(mention_words(js_trim(mention)), lambda w: w != "")
    kept = F.when(kind == "person", F.transform(words, word_stem)).otherwise(words)
    ends = F.transform(F.array_distinct(F.array(F.get(kept, F.lit(0)), F.try_element_at(kept, F.lit(-1)))), fold_case)
    loose = (F.size(words) == 0) | ((kind == "other") & (pd_type == "address"))
    return F.when(loose, F.array(F.lit(""))).otherwise(ends)


def _anchor_kind(literal_persons: bool) -> tuple[Column, Column]:
    """Literal patterns carry neither endings nor address variants."""
    if literal_persons:
        return F.lit("other"), F.lit(None).cast("string")
    return F.col("kind"), F.col("pd_type")


def choose_anchors(mentions: DataFrame, literal_persons: bool = False) -> DataFrame:
    """Mention rows with ``anchors``: first the one to join on - shared by the
    fewest mentions of the project, longer ones first among equals - then up
    to ``EXTRA_ANCHORS`` more. Each is a necessary condition for a match."""
    ids = ["project_id", "pd_id", "mention"]
    listed = mentions if "offered" in mentions.columns else _with_offered(mentions, literal_persons)
    rows = listed.select(*ids, F.explode("offered").alias("anchor")).distinct()
    load = rows.groupBy("project_id", "anchor").agg(F.count("*").alias("load"))
    # a list per mention: as long as the mention has pieces
    ranked = F.array_sort(F.collect_list(F.struct("load", (-F.length("anchor")).alias("size"), "anchor")))
    best = (
        rows.join(load, ["project_id", "anchor"])
        .groupBy(*ids)
        .agg(F.transform(F.slice(ranked, 1, 1 + EXTRA_ANCHORS), lambda a: a["anchor"]).alias("anchors"))
    )
    return listed.drop("offered").join(best, ids)


def _with_offered(mentions: DataFrame, literal_persons: bool) -> DataFrame:
    kind, pd_type = _anchor_kind(literal_persons)
    return mentions.withColumn("offered", mention_anchors(kind, pd_type, F.col("mention")))


def _anchor_id(anchor: Column) -> Column:
    """Hash of kind and piece, as ``with_unit_anchors`` builds it from texts."""
    kind = F.regexp_extract(anchor, _KIND, 1)
    return F.xxhash64(kind, F.substring(anchor, F.length(kind) + 2, F.length(anchor)))


def _anchor_filter(chosen: DataFrame, words: int, most: int) -> DataFrame:
    """One row with a bit set over the first ``most`` anchor ids of each
    mention, of fixed size."""
    slot = F.pmod("anchor_id", F.lit(words * 64))
    bits = chosen.select(F.explode(F.slice("anchor_set", 1, most)).alias("anchor_id")).select(
        F.floor(slot / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int")).alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = chosen.sparkSession.range(words).withColumnRenamed("id", "word")
    cell = F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return every.join(bits, "word", "left").agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["bits"]).alias("bits")
    )


def with_unit_anchors(units: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """Units with ``anchor_ids``: hashes of the distinct anchors a text offers,
    limited to the kinds the dictionary uses and thinned by its bit set (what
    the filter lets through wrongly finds no partner in the join).
    ``first_ids`` are those of them that some mention is joined on."""
    nothing = F.array().cast("array<string>")
    folded = F.col("_folded")
    letters = F.lit(f"({_LETTER_RUN})")
    runs = F.regexp_extract_all(folded, letters, F.lit(1))
    # folding may turn a neighbour into a letter: then keep the raw run starts too
    raw_runs = F.transform(F.regexp_extract_all("text", letters, F.lit(1)), fold_case)
    prepared = (
        units.withColumn("_folded", _even(fold_case("text")))
        .withColumn("_used", _used_tags(chosen).scalar())
        .withColumn("_all", F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1)))
        .withColumn("_words", F.array_distinct("_all"))
        .withColumn(
            "_pairs",
            F.when(F.exists("_used", lambda t: t.startswith("B")), _near_ends(F.col("_all"))).otherwise(
                F.array().cast("array<struct<a:string,a_size:int,b:string,b_size:int>>")
            ),
        )
        .withColumn(
            "_runs",
            F.when(
                F.exists("_used", lambda t: t.startswith("L")),
                F.array_distinct(
                    F.when(F.col("text").rlike("[ſıİ\u212a]"), F.concat(runs, raw_runs)).otherwise(runs)
                ),
            ).otherwise(nothing),
        )
    )

    # too short a piece gives null, which the filter below drops
    def pairs(end: int, start: int) -> Column:
        tag = F.lit(f"B{end}{start}")
        near = lambda x: F.xxhash64(tag, F.concat(F.right(x["a"], F.lit(end)), F.left(x["b"], F.lit(start))))
        return F.transform("_pairs", lambda x: F.when((x["a_size"] >= end) & (x["b_size"] >= start), near(x)))

    def when_used(tag: str, keys: Column) -> Column:
        return F.when(F.array_contains("_used", tag), keys).otherwise(F.array().cast("array<bigint>"))

    def starts(tag: str, pieces: str, s: int) -> Column:
        return F.transform(pieces, lambda p: F.when(F.length(p) >= s, F.xxhash64(F.lit(f"{tag}{s}"), F.left(p, F.lit(s)))))

    def grams(tag: str, s: int) -> Column:
        digits = F.lit(tag == "D")
        return F.flatten(
            F.transform(
                F.filter("_words", lambda p: (F.length(p) >= s) & (p.rlike(_DIGITS) == digits)),
                lambda p: F.transform(
                    F.sequence(F.lit(1), F.length(p) - s + 1),
                    lambda i: F.xxhash64(F.lit(f"{tag}{s}"), F.substring(p, i, F.lit(s))),
                ),
            )
        )

    parts = [when_used("W", F.transform("_words", lambda w: F.xxhash64(F.lit("W"), w)))]
    for s in PREFIX_SIZES:
        parts.append(when_used(f"P{s}", starts("P", "_words", s)))
        parts.append(when_used(f"L{s}", starts("L", "_runs", s)))
    for s in GRAM_SIZES:
        parts.append(when_used(f"D{s}", grams("D", s)))
        parts.append(when_used(f"G{s}", grams("G", s)))
    for end in PAIR_SIZES:
        for start in PAIR_SIZES:
            parts.append(when_used(f"B{end}{start}", pairs(end, start)))
    parts.append(when_used("*", F.array(F.xxhash64(F.lit("*"), F.lit("")))))

    def passes(bits: str, h: Column) -> Column:
        slot = h.bitwiseAND(F.lit(words * 64 - 1))
        word = F.get(bits, F.call_function("shiftright", slot, F.lit(6)).cast("int"))
        return F.call_function("getbit", word, slot.bitwiseAND(63).cast("int")) == 1

    return (
        prepared.withColumn("_ids", F.concat(*parts))
        .withColumn("_bits", _anchor_filter(chosen, words, 1 + EXTRA_ANCHORS).scalar())
        .withColumn("_first", _anchor_filter(chosen, words, 1).scalar())
        .withColumn("anchor_ids", F.array_distinct(F.filter("_ids", lambda h: passes("_bits", h))))
        .withColumn("first_ids", F.filter("anchor_ids", lambda h: passes("_first", h)))
        .drop("_used", "_all", "_words", "_pairs", "_runs", "_ids", "_bits", "_first")
    )


_BLOCK = 256
# Matches of runs that are folded together.
RUN_BLOCK = 64
_SIGN = "\ue000"
# Letters whose cases lower() and regular expressions pair alike.
_PLAIN_LETTERS = r"\A[\x{20}-\x{7e}\x{a0}-\x{ff}\x{400}-\x{45f}]+\z"


def _folded_value(mention: Column) -> Column:
    """The folded value with one blank between its words."""
    return fold_case(F.array_join(F.filter(F.split(js_trim(mention), WS + "+", -1), lambda w: w != ""), " "))


def _with_value(mentions: DataFrame) -> DataFrame:
    """Mention rows with ``value`` where the pattern takes it literally, alone or
    between letter edges (``edge``), null otherwise; ``value_id`` names it."""
    value, exact = _folded_value(F.col("mention")), ws_flexible_pattern("mention")
    pattern = F.col("pattern")
    edge = F.when(pattern == F.concat(F.lit(FLAGS), exact), FREE).when(
        pattern == F.concat(F.lit(FLAGS + LEFT_EDGE), exact, F.lit(RIGHT_EDGE)), EDGED
    )
    fits = (value != "") & value.rlike(_PLAIN_LETTERS) & edge.isNotNull()
    rows = mentions.withColumn("edge", edge).withColumn("value", F.when(fits, value))
    return rows.withColumn("value_id", F.xxhash64("project_id", "edge", "value"))


def _literal(mention: Column, pattern: Column, overlapping: bool) -> Column:
    """The folded value, one blank between its words, where the pattern says no
    more than that: it is then found without a regular expression. Null
    otherwise, and for a value that can overlap itself where that counts."""
    value, n = _folded_value(mention), F.length(_folded_value(mention))
    fits = (value != "") & value.rlike(_PLAIN_LETTERS) & (pattern == F.concat(F.lit(FLAGS), ws_flexible_pattern(mention)))
    if overlapping:
        inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        fits = fits & ~F.exists(inner, lambda k: F.left(value, k) == F.right(value, k))
    return F.when(fits, value)


def _even(folded: Column) -> Column:
    """Folded text with every white space character as a blank."""
    return F.translate(folded, WS_CHARS, " " * len(WS_CHARS))


def _explode_spans(pairs: DataFrame, overlapping: bool = False) -> DataFrame:
    """Rows with ``start, end, hit`` (0-based half-open code points) for every
    non-empty hit of ``pattern`` in ``text``.

    Offsets are running sums over the hits and the gaps between them, taken
    block by block so that a text with very many hits stays cheap.
    ``overlapping`` tests every position instead of going on behind a hit.
    """
    text, pattern = F.col("text"), F.col("pattern")
    if overlapping:
        pattern = F.concat(F.lit("(?=("), pattern, F.lit("))"))
    hits = F.regexp_extract_all(text, pattern, F.lit(1 if overlapping else 0))
    # gaps: hits replaced by a sign the text does not hold, cut at that sign
    # (cutting at the pattern itself would compile it for every row)
    cut_at_hits = F.split(text, pattern, -1)
    if overlapping:
        # a zero-width hit at the very start makes no gap of its own
        at_start = F.rlike(text, F.concat(F.lit(r"\A"), pattern))
        cut_at_hits = F.when(at_start, F.concat(F.array(F.lit("")), cut_at_hits)).otherwise(cut_at_hits)
    gaps = (
        F.when(F.size(hits) == 0, F.array(text))
        .when(F.contains(text, F.lit(_SIGN)), cut_at_hits)
        .otherwise(F.split(F.regexp_replace(text, pattern, F.lit(_SIGN)), _SIGN, -1))
    )
    by_pattern = F.zip_with(
        gaps,
        hits,
        lambda g, h: F.struct(F.length(F.coalesce(g, F.lit(""))).alias("gap"), F.length(h).alias("n"), h.alias("hit")),
    )
    cuts, single = by_pattern, None
    if "literal" in pairs.columns:
        # literal values are looked up in the folded text, which is as long
        value, even, n = F.col("literal"), F.col("even"), F.length("literal")
        plain = ~F.contains(even, F.lit(_SIGN)) & (~F.contains(value, F.lit(" ")) | ~F.contains(even, F.lit("  ")))
        pairs = pairs.withColumn("_at", F.when(plain, F.call_function("instr", even, value))).filter("_at IS NULL OR _at > 0")
        more = F.call_function("locate", value, even, F.col("_at") + n) > 0
        step_back = n if overlapping else F.lit(0)  # where a hit does not advance, its gap does
        rests = F.transform(
            F.split(F.replace(even, value, F.lit(_SIGN)), _SIGN, -1),
            lambda g, i: F.struct(
                (F.length(g) + F.when(i > 0, step_back).otherwise(0)).alias("gap"), n.alias("n"), F.lit(None).cast("string").alias("hit")
            ),
        )
        # behind the last hit nothing follows
        by_value = F.slice(rests, 1, F.size(F.split(F.replace(even, value, F.lit(_SIGN)), _SIGN, -1)) - 1)
        cuts = F.when(F.col("_at").isNull(), by_pattern).when(more, by_value)
        at = F.col("_at") - 1
        single = F.when(
            F.col("_at").isNotNull() & ~more,
            F.array(F.struct(at.alias("start"), (at + n).alias("end"), F.lit(None).cast("string").alias("hit"))),
        )
    rest = [c for c in pairs.columns if c not in ("text", "pattern", "literal", "even", "_at")]
    cut = pairs.select(*rest, "text", cuts.alias("_cut"), *([single.alias("_single")] if single is not None else []))
    advance = F.lit(0) if overlapping else F.lit(1)
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, c: Column) -> Column:
        start = acc["at"] + c["gap"]
        span = F.struct(start.alias("start"), (start + c["n"]).alias("end"), c["hit"].alias("hit"))
        return F.struct(
            (start + F.coalesce(c["n"], F.lit(0)) * advance).alias("at"),
            F.when(c["n"] > 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    def block_step(acc: Column, b: Column) -> Column:
        inner = F.aggregate(
            F.slice("_cut", b * _BLOCK + 1, F.lit(_BLOCK)),
            F.struct(acc["at"].alias("at"), empty.alias("spans")),
            step,
        )
        return F.struct(inner["at"].alias("at"), F.concat(acc["blocks"], F.array(inner["spans"])).alias("blocks"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,hit:string>>>").alias("blocks"))
    spans = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size("_cut") - 1) / _BLOCK).cast("int")),
        zero,
        block_step,
        lambda acc: F.flatten(acc["blocks"]),
    )
    if single is not None:
        spans = F.coalesce("_single", spans)
    # outer: an inner explode would add a size filter that works everything out twice
    found = cut.select(*rest, "text", F.explode_outer(spans).alias("_s")).filter(F.col("_s").isNotNull())
    at = F.substring("text", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
    return found.select(*rest, "_s.start", "_s.end", F.coalesce("_s.hit", at).alias("hit"))


def _used_tags(chosen: DataFrame) -> DataFrame:
    """One row: the kinds of anchor in use (a few dozen values at most)."""
    tag = F.regexp_extract("anchor", _KIND, 1)
    return chosen.select(F.explode("anchors").alias("anchor")).select(tag.alias("tag")).agg(F.collect_set("tag").alias("tags"))


def candidate_pairs(
    units: DataFrame, mentions: DataFrame, strategy: str = "auto", literal_persons: bool = False, overlapping: bool = False
) -> DataFrame:
    """Unit rows next to the mention rows of their project whose anchor they
    offer: a small superset of the pairs that match. ``literal`` and ``even``
    spare ``_explode_spans`` the regular expression.

    ``strategy='auto'`` measures the dictionary: up to ``BROADCAST_BYTES`` it
    is sent to all executors and the texts do not move at all; a larger one is
    shuffled by anchor with the (text-free) anchors of the units, hot anchors
    spread over ``SALT`` buckets, and the texts are joined back for the final
    test. Both ways test the same.
    """
    carried = [c for c in ("pd_id", "kind", "mention", "pattern", "rank") if c in mentions.columns]
    if strategy not in ("auto", *FILTER_WORDS):
        raise ValueError(f"unknown strategy: {strategy}")
    # the dictionary in its working shape, written once: it is read several times below
    probes = _probes(*_anchor_kind(literal_persons), F.col("mention")).alias("probes")
    literal = _literal(F.col("mention"), F.col("pattern"), overlapping).alias("literal")
    offered = mention_anchors(*_anchor_kind(literal_persons), F.col("mention")).alias("offered")
    listed = settle(mentions.select("project_id", *carried, offered, probes, literal))
    # with mostly regular expressions, rows go by pattern: one is compiled once per run of equal ones
    by_pattern = listed.agg(2 * F.count("literal") < F.count("*")).first()[0]
    in_order = lambda pairs: pairs.sortWithinPartitions("pattern") if by_pattern else pairs
    if strategy == "auto":
        width = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in carried if c in ("pd_id", "mention", "pattern")), F.lit(128))
        size = listed.agg(F.sum(2 * width)).first()[0] or 0
        strategy = "broadcast" if size <= BROADCAST_BYTES else "shuffle"
    anchor_set = F.transform("anchors", _anchor_id)
    chosen = settle(
        choose_anchors(listed).select("project_id", "anchors", anchor_set.alias("anchor_set"), "probes", "literal", *carried)
    )
    if strategy == "shuffle":
        # texts are joined back by these keys: candidates of a dictionary that is small
        # enough after all stay beside them
        units = units.repartition("project_id", *UNIT)
    anchored = with_unit_anchors(units, chosen, FILTER_WORDS[strategy])
    wanted = chosen.withColumn("anchor_id", F.get("anchor_set", F.lit(0))).drop("anchors")
    # every further anchor of the mention must be among those of the unit
    meets_all = F.lit(True)
    for i in range(1, 1 + EXTRA_ANCHORS):
        other = F.get("anchor_set", F.lit(i))
        meets_all = meets_all & (other.isNull() | F.array_contains("anchor_ids", other))
    # the text must also hold the mention's outer words, before its pattern is tried
    holds = lambda text: F.contains(text, F.get("probes", F.lit(0))) & F.contains(
        text, F.coalesce(F.get("probes", F.lit(1)), F.lit(""))
    )
    if strategy == "broadcast":
        # outer: an inner explode would add a size filter that works the anchors out twice
        offered = anchored.select("*", F.explode_outer("first_ids").alias("anchor_id"))
        return in_order(
            offered.join(F.broadcast(wanted), ["project_id", "anchor_id"])
            .filter(meets_all & holds(F.col("_folded")))
            .drop("anchor_id", "anchor_ids", "first_ids", "anchor_set", "probes")
            .withColumnRenamed("_folded", "even")
        )
    bucket = F.pmod(F.xxhash64(*UNIT), F.lit(SALT)).cast("int")
    offered = anchored.select(
        "project_id", *UNIT, "anchor_ids", F.explode_outer("first_ids").alias("anchor_id"), bucket.alias("salt")
    ).filter(F.col("anchor_id").isNotNull())
    spread = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    candidates = (
        offered.join(spread, ["project_id", "anchor_id", "salt"])
        .filter(meets_all)
        .drop("anchor_id", "anchor_ids", "anchor_set", "salt")
    )
    even = units.withColumn("even", _even(fold_case("text")))
    return in_order(candidates.join(even, ["project_id", *UNIT]).filter(holds(F.col("even"))).drop("probes"))


def match_dictionary(
    units: DataFrame,
    mentions: DataFrame,
    strategy: str = "auto",
    literal_persons: bool = False,
    overlapping: bool = False,
    except_marked: DataFrame | None = None,
) -> DataFrame:
    """All hits of all mentions in all units of the same project, without the
    pairs (doc_id, pd_id) of ``except_marked``, which are not matched at all.

    ``units(project_id, doc_id, unit_no, text)``;
    ``mentions(project_id, pd_id, kind, mention, pattern, rank, ...)``.
    Returns ``(project_id, doc_id, unit_no, start, end, hit, pd_id, kind,
    mention, rank)``.
    """
    slim = units.select("project_id", *UNIT, "text")
    if strategy not in ("auto", *FILTER_WORDS):
        raise ValueError(f"unknown strategy: {strategy}")
    columns = ["project_id", *UNIT, "start", "end", "hit", "pd_id", "kind", "mention", "rank"]
    plain, rest = _match_plain(slim, mentions, overlapping) if strategy == "auto" else (None, mentions)
    found = [] if plain is None else [_without(plain, except_marked)]
    if rest is not None:
        pairs = candidate_pairs(slim, rest, strategy, literal_persons, overlapping)
        found.append(_explode_spans(_without(pairs, except_marked), overlapping))
    by_either = [f.select(*columns) for f in found]
    return by_either[0] if len(by_either) == 1 else by_either[0].unionByName(by_either[1])


def _without(rows: DataFrame, marked: DataFrame | None) -> DataFrame:
    if marked is None:
        return rows
    return rows.join(marked.select("doc_id", "pd_id").distinct(), ["doc_id", "pd_id"], "left_anti")


def _match_plain(units: DataFrame, mentions: DataFrame, overlapping: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """Hits of the mentions whose patterns are plain values, and the other
    mentions; null where there are none. A dictionary with too many letters is
    left to the other ways."""
    spark = units.sparkSession
    carried = [c for c in ("project_id", "pd_id", "kind", "pd_type", "mention", "pattern", "rank") if c in mentions.columns]
    listed = settle(_with_value(mentions.select(*carried).filter(F.col("project_id").isNotNull())))
    width = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in carried if c in ("pd_id", "mention")), F.lit(128))
    n_rows, n_plain, letters, size = listed.agg(
        F.count("*"), F.count("value"), F.sum(F.least(F.length("value"), F.lit(DEPTH))), F.sum(F.when(F.col("value").isNotNull(), width))
    ).first()
    if not n_plain or letters > PLAIN_LETTERS:
        return None, listed.drop("value", "edge", "value_id")
    is_plain = F.col("value").isNotNull()
    values = listed.filter(is_plain).select("project_id", "edge", "value", "value_id").distinct().toArrow()
    if len(values["value_id"].unique()) < values.num_rows:  # two values of one hash
        return None, listed.drop("value", "edge", "value_id")
    trie = PlainValues(*(values[c].to_pylist() for c in ("project_id", "edge", "value", "value_id")))
    hits = find_values(spark, trie, overlapping)(F.col("project_id"), F.col("text"), _even(fold_case("text")))
    # outer: an inner explode would add a size filter that works everything out twice
    found = (
        units.withColumn("_hits", hits)
        .select("project_id", *UNIT, F.explode_outer("_hits").alias("_s"))
        .filter(F.col("_s").isNotNull())
        .select("project_id", *UNIT, "_s.start", "_s.end", "_s.hit", "_s.value_id")
    )
    owners = listed.filter(is_plain).select("value_id", *[c for c in ("pd_id", "kind", "mention", "rank") if c in carried])
    if size <= PLAIN_BYTES:
        owners = F.broadcast(owners)
    rest = listed.filter(~is_plain).drop("value", "edge", "value_id") if n_plain < n_rows else None
    return found.join(owners, "value_id").drop("value_id"), rest


def match_alternation(units: DataFrame, mentions: DataFrame, strategy: str = "auto") -> DataFrame:
    """Hits as one pass over each unit finds them: at every position the
    uncertain-reading mark first, then the longest mention that matches there;
    the scan goes on behind a hit.

    Equal to one alternation of all patterns, without building it: all
    positions where a candidate matches, then the greedy choice by position and
    rank. A hit loses trailing white space but consumes it (``raw_end``). It
    belongs to the first mention, by rank, that matches the trimmed hit as a
    whole; none may (``pd_id`` null: plain text).
    """
    slim = units.select("project_id", *UNIT, "text")
    hits = match_dictionary(slim, mentions, strategy, overlapping=True)
    marks = _explode_spans(
        slim.filter(F.contains("text", F.lit("⚠️["))).withColumn("pattern", F.lit(UNCERTAIN_MARK))
    ).select(
        "project_id",
        *UNIT,
        "start",
        "end",
        "hit",
        F.lit(None).cast("string").alias("pd_id"),
        F.lit("uncertain").alias("kind"),
        F.lit(None).cast("string").alias("mention"),
        # ahead of every mention at the same position
        F.struct(*[F.lit(-(2**31)).cast(t).alias(n) for n, t in RANK_FIELDS]).alias("rank"),
    )
    # written once: the hits are read for their texts and for the answer
    chosen = settle(resolve_overlaps(hits.unionByName(marks), "registry"))
    trimmed = chosen.select(
        "project_id",
        *UNIT,
        "start",
        (F.col("start") + F.length(js_rtrim("hit"))).cast("int").alias("end"),
        F.col("end").alias("raw_end"),
        js_rtrim("hit").alias("hit"),
        F.col("kind").alias("_kind"),
    )
    texts = (
        trimmed.filter("_kind <> 'uncertain'")
        .select("project_id", F.col("hit").alias("text"))
        .distinct()
        .select("project_id", F.lit(0).alias("doc_id"), F.xxhash64("project_id", "text").alias("unit_no"), "text")
    )
    whole = F.concat(F.lit("(?:"), F.col("pattern"), F.lit(r")\z"))
    listed = settle(_with_value(mentions))
    # a hit is a plain value as a whole when they are equal
    equal = texts.withColumn("value", F.regexp_replace(_even(fold_case("text")), " +", " ")).join(
        listed.filter(F.col("value").isNotNull()), ["project_id", "value"]
    )
    named = ["project_id", "text", F.struct("pd_id", "kind", "mention").alias("m"), "rank"]
    whole_hits = equal.select(*named)
    others = listed.filter(F.col("value").isNull()).drop("value", "edge", "value_id")
    if not others.isEmpty():
        pairs = candidate_pairs(texts, others, strategy).filter(F.rlike("text", F.concat(F.lit(r"\A"), whole)))
        whole_hits = whole_hits.unionByName(pairs.select(*named))
    owners = (
        whole_hits.groupBy("project_id", "text")
        .agg(F.min_by("m", "rank").alias("o"))
        .select("project_id", F.col("text").alias("hit"), "o.pd_id", "o.kind", "o.mention")
    )
    return trimmed.join(owners, ["project_id", "hit"], "left").select(
        "project_id",
        *UNIT,
        "start",
        "end",
        "raw_end",
        "hit",
        "pd_id",
        F.when(F.col("_kind") == "uncertain", "uncertain").otherwise(F.coalesce("kind", F.lit("plain"))).alias("kind"),
        "mention",
    )


def resolve_overlaps(matches: DataFrame, policy: str = "registry") -> DataFrame:
    """Greedy left-to-right choice inside each unit: a match is kept when it
    starts at or behind the end of the last kept one.

    Ties at one start: ``registry`` by mention rank, ``longest`` by match end,
    ``merge`` persons ahead of others in registry order. Runs of overlapping
    matches are told apart first by a window, so the fold only ever sees the
    matches of one run, or of a few short ones.
    """
    rank = F.col("rank")
    tie = {
        "registry": F.struct(rank["by_length"].alias("a"), rank["by_kind"].alias("b"), rank["by_seq"].alias("c"), rank["by_pos"].alias("d")),
        "longest": F.struct((-F.col("end")).alias("a"), rank["by_length"].alias("b"), rank["by_kind"].alias("c"), rank["by_seq"].alias("d"), rank["by_pos"].alias("e")),
        "merge": F.struct(rank["by_kind"].alias("a"), rank["by_seq"].alias("b"), rank["by_pos"].alias("c")),
    }.get(policy)
    if tie is None:
        raise ValueError(f"unknown policy: {policy}")
    rest = [c for c in matches.columns if c not in (*UNIT, "start", "end")]
    # of the hits that start at one place only the first can be kept
    order = Window.partitionBy(*UNIT).orderBy("start", "_tie", "end", *rest)
    firsts = matches.withColumn("_tie", tie).withColumn("_last", F.lag("start").over(order)).filter("_last IS NULL OR _last < start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))
    # a run begins a new block when so many rows went before that it is due
    due = F.when(opens, F.floor(F.col("_row") / RUN_BLOCK))
    runs = (
        firsts.withColumn("_reach", F.max("end").over(before))
        .withColumn("_row", F.row_number().over(order))
        .withColumn("_run", F.max(due).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    item = F.struct("start", "_tie", "end", *rest)
    grouped = runs.groupBy(*UNIT, "_run").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kind = grouped.schema["_items"].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        keep = m["start"] >= acc["at"]
        return F.struct(
            F.when(keep, m["end"]).otherwise(acc["at"]).alias("at"),
            F.when(keep, F.concat(acc["kept"], F.array(m))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.when(F.size("_items") == 1, F.col("_items")).otherwise(
        F.aggregate("_items", zero, step, lambda acc: acc["kept"])
    )
    return grouped.select(*UNIT, F.explode(kept).alias("m")).select(
        *UNIT, "m.start", "m.end", *[F.col(f"m.{c}").alias(c) for c in rest]
    ).select(*matches.columns)


def match_unmarked(units: DataFrame, mentions: DataFrame, marked: DataFrame, strategy: str = "auto", **how) -> DataFrame:
    """Second pass: hits of the entries a document has no mark of yet. The
    entry list per document is never built; marked entries leave the candidate
    pairs before any pattern is tried."""
    return match_dictionary(units, mentions, strategy, except_marked=marked, **how)


def pd_presence(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Registry entries with the number of documents and marks they have;
    entries that occur nowhere are listed with zeros."""
    seen = (
        matches.groupBy("project_id", "pd_id", "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy("project_id", "pd_id")
        .agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_marks"))
    )
    return (
        entries.join(seen, ["project_id", "pd_id"], "left")
        .withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        .withColumn("n_marks", F.coalesce("n_marks", F.lit(0)))
        .withColumn("present", F.col("n_docs") > 0)
    )
