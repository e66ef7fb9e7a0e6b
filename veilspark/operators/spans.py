"""Marks of a corpus that are stored and kept up to date.

The store holds text units, the marks found in them, and an inverted index:
per project its distinct words with the number of units that have them, and
per word the units. When registry entries change, only they are matched again
and only where they can occur: their anchors are looked up among the words,
the rarest anchor's words name the units, and inside those units the gaps
between the stored marks are searched. Marks found are added; all others stay
as they are. Index, units and marks are cut into folders by hashes, so that a
small change reads a few folders, and in them the row groups it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import fold_case
from ..plans.session import settle
from ..sources.versions import VersionedTables
from .matching import UNIT, WORD, match_dictionary, mention_anchors, resolve_overlaps
from .redaction import second_pass_segments, segment_spans
from .registry import explode_registry

#: Keys up to this number are put into the scan's filters; more are joined.
LOOKUP = 1_000

KEY = ["project_id", *UNIT]


def unit_words(text: Column) -> Column:
    """Distinct folded words of a text."""
    return F.array_distinct(F.regexp_extract_all(fold_case(text), F.lit(f"({WORD})"), F.lit(1)))


def _pieces(word: Column, sizes: list[tuple[str, int]]) -> Column:
    """array<struct<way, piece>>: the word as a whole, and its distinct starts
    and parts of the given sizes."""
    n = F.length(word)
    named = lambda way, piece: F.struct(F.lit(way).alias("way"), piece.alias("piece"))
    none = F.array().cast("array<struct<way:string,piece:string>>")
    lists = [none, F.array(named("whole", word))]
    for way, size in sizes:
        if way == "start":
            lists.append(F.when(n >= size, F.array(named("start", F.left(word, F.lit(size))))).otherwise(none))
        elif way == "part":
            begins = F.sequence(F.lit(1), n - size + 1)
            parts = F.transform(begins, lambda i: F.substring(word, i, F.lit(size)))
            lists.append(F.when(n >= size, F.transform(F.array_distinct(parts), lambda p: named("part", p))).otherwise(none))
    return F.concat(*lists)


class SpanStore:
    """Units, marks and index below ``path``; documents have ids of type
    ``id_type``. ``parts`` folders hold the units, ``slots`` the index."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", parts: int = 64, slots: int = 64):
        self.spark, self.parts, self.slots = spark, parts, slots
        key = f"project_id string, doc_id {id_type}, unit_no int"
        self.tables = VersionedTables(
            spark,
            path,
            {
                "units": f"{key}, text string, part int",
                "marks": f"{key}, start int, end int, hit string, pd_id string, part int",
                "words": "project_id string, word string, word_id bigint, n_units bigint",
                "postings": f"project_id string, word_id bigint, doc_id {id_type}, unit_no int, slot int",
            },
            {"units": ["part"], "marks": ["part"], "postings": ["slot"]},
        )

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("project_id", "doc_id"), F.lit(self.parts)).cast("int")

    def _slot(self) -> Column:
        return F.pmod("word_id", F.lit(self.slots)).cast("int")

    def add(self, number: int, units: DataFrame, marks: DataFrame) -> bool:
        """Take up units (project_id, doc_id, unit_no, text) that are new, with
        the marks (start, end, hit, pd_id) found in them."""
        if self.tables.is_done(number):
            return False
        placed = units.select(*KEY, "text").withColumn("part", self._part())
        self.tables.put("units", placed.repartition("part").sortWithinPartitions("part", *KEY), number)
        marked = marks.select(*KEY, "start", "end", "hit", "pd_id").withColumn("part", self._part())
        self.tables.put("marks", marked.repartition("part").sortWithinPartitions("part", *KEY), number)
        rows = units.select(*KEY, F.explode_outer(unit_words(F.col("text"))).alias("word")).filter(F.col("word").isNotNull())
        rows = rows.withColumn("word_id", F.xxhash64("word"))
        words = rows.groupBy("project_id", "word", "word_id").agg(F.count("*").alias("n_units"))
        self.tables.put("words", words.sortWithinPartitions("project_id", "word"), number)
        posted = rows.withColumn("slot", self._slot())
        # a frequent word's units may be many: its slot is dealt to several tasks
        self.tables.put("postings", posted.repartition("slot", F.pmod(F.xxhash64(*UNIT), F.lit(4))).sortWithinPartitions("slot", "word_id"), number)
        self.tables.finish(number)
        return True

    def marks(self) -> DataFrame:
        return self.tables.read("marks").drop("part", "commit")

    def _narrow(self, rows: DataFrame, keys: DataFrame, column: str, folder: Column, folder_name: str) -> DataFrame:
        """Rows of the table for the keys: a few keys are filters of the scan."""
        listed = keys.select(column, folder.alias(folder_name)).distinct().limit(LOOKUP + 1).collect()
        if len(listed) <= LOOKUP:
            rows = rows.filter(F.col(folder_name).isin(sorted({r[1] for r in listed})) & F.col(column).isin(sorted({r[0] for r in listed})))
        return rows.join(keys.select(*[c for c in keys.columns if c in rows.columns]).distinct(), [c for c in keys.columns if c in rows.columns], "left_semi")

    def _places(self, offered: DataFrame) -> DataFrame:
        """project_id, word_id: the words of each mention's rarest anchor. A
        mention one of whose anchors no word has is found nowhere."""
        ids = ["project_id", "pd_id", "mention"]
        # pairs of neighbours are no words
        single = F.filter("offered", lambda a: ~a.startswith("B"))
        anchors = offered.select(*ids, F.size(single).alias("n_anchors"), F.explode(single).alias("anchor"))
        tag = F.regexp_extract("anchor", r"\A([A-Z]?)", 1)
        piece = F.regexp_replace("anchor", r"\A[A-Z][0-9]*:", "")
        # a word is the piece, starts with it or holds it
        way = F.when(tag == "W", "whole").when(tag == "P", "start").otherwise("part")
        anchors = anchors.filter(tag != "").select(*ids, "n_anchors", "anchor", way.alias("way"), piece.alias("piece"))
        words = self.tables.read("words").groupBy("project_id", "word", "word_id").agg(F.sum("n_units").alias("n_units"))
        # words offer their pieces of the lengths in use (a few), so that they meet anchors by equality
        sizes = sorted({tuple(r) for r in anchors.select("way", F.length("piece")).distinct().collect()})
        held = words.select("project_id", "word_id", "n_units", F.explode_outer(_pieces(F.col("word"), sizes)).alias("p")).select("project_id", "word_id", "n_units", "p.way", "p.piece")
        found = settle(held.join(anchors, ["project_id", "way", "piece"]).select(*ids, "n_anchors", "anchor", "word_id", "n_units"))
        mass = found.groupBy(*ids, "n_anchors", "anchor").agg(F.sum("n_units").alias("mass"))
        best = mass.groupBy(*ids, "n_anchors").agg(F.min_by("anchor", F.struct("mass", "anchor")).alias("anchor"), F.count("*").alias("n")).filter("n = n_anchors")
        return found.join(best.select(*ids, "anchor"), [*ids, "anchor"], "left_semi").select("project_id", "word_id").distinct()

    def touched(self, mentions: DataFrame) -> DataFrame:
        """project_id, doc_id, unit_no of the units in which one of the mention
        rows may occur."""
        # anchors are worked out once
        every = mention_anchors(F.col("kind"), F.col("pd_type"), F.col("mention")).alias("offered")
        offered = settle(mentions.select("project_id", "pd_id", "mention", every))
        wanted = settle(self._places(offered))
        units = self._narrow(self.tables.read("postings"), wanted, "word_id", self._slot(), "slot").select(*KEY).distinct()
        wordless = offered.filter(F.array_contains("offered", "*")).select("project_id").distinct()
        if not wordless.isEmpty():
            # a mention without letters and digits can be in any unit of its project
            units = units.unionByName(self.tables.read("units").join(wordless, "project_id", "left_semi").select(*KEY)).distinct()
        return units

    def rematch(self, number: int, entries: DataFrame) -> bool:
        """Match changed registry entries again and add the marks they gain.
        At one place the longest hit counts, then the registry's order."""
        if self.tables.is_done(number):
            return False
        mentions = settle(explode_registry(entries).filter(F.length("mention") > 1))
        where = settle(self.touched(mentions))
        keyed = where.withColumn("part", self._part())
        units = self._narrow(self.tables.read("units"), keyed, "doc_id", F.col("part"), "part")
        marks = self._narrow(self.tables.read("marks"), keyed, "doc_id", F.col("part"), "part")
        gaps = settle(second_pass_segments(units.select(*KEY, "text"), marks))
        found = resolve_overlaps(match_dictionary(gaps, mentions), "longest")
        return self.tables.commit(number, marks=segment_spans(found).withColumn("part", self._part()))
