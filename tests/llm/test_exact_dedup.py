import hashlib
import re

from pyspark.sql import functions as F

from veilspark.llm import exact_dedup as X


def keyed(n):
    return [hashlib.sha256(str(i).encode()).digest() for i in range(n)]


def test_filter_inserts_finds_and_deletes():
    cuckoo = X.CuckooFilter.sized(1000)
    keys = keyed(1000)
    assert all(cuckoo.insert(k) for k in keys)
    assert all(k in cuckoo for k in keys)
    for k in keys[:500]:
        assert cuckoo.delete(k)
    assert all(k in cuckoo for k in keys[500:])
    assert sum(k in cuckoo for k in keys[:500]) < 10


def test_overflow_resizes_from_stored_keys():
    shard = X.Shard({}, X.CuckooFilter(2))
    for i, k in enumerate(keyed(300)):
        shard.insert(k, i, 1)
    assert shard.filter.buckets * X.SLOTS >= 300
    assert all(k in shard.filter for k in keyed(300))
    assert [shard.keys[k] for k in keyed(3)] == [[0, 1], [1, 1], [2, 1]]


def test_a_false_hit_is_verified_against_the_bucket():
    shard = X.Shard({}, X.CuckooFilter(1))
    a = bytes(32)
    b = bytes(31) + b"\1"  # the same fingerprint and buckets
    shard.insert(a, 1, 1)
    assert b in shard.filter
    shard.insert(b, 2, 1)
    assert shard.keys == {a: [1, 1], b: [2, 1]}


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for i, t, _ in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep))
    return sorted(out, key=repr)


def test_equals_brute_force(docs, rows_of):
    rows = [(i, f"text\t {i % 7}" if i % 3 else f"text {i % 7}", "s") for i in range(1, 60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "  ", "s"), (103, " ", "s"), (None, "text 1", None), (None, "alone", "s"), (5, "text 5", "s"), (5, "text 5", "s"), (104, "x" * 300_000, "s"), (105, "x" * 300_000, "s")]
    got = X.exact_dedup(docs(*rows)).select("doc_id", "keep_id", "group_size", "kept")
    assert rows_of(got) == brute(rows)


def test_empty_table(docs):
    assert X.exact_dedup(docs()).count() == 0
    assert X.drop_copies(docs()).count() == 0


def test_drop_copies_keeps_columns_and_null_ids(docs, rows_of):
    kept = X.drop_copies(docs((2, "a  b", "s"), (1, "a b", "s"), (None, "a b", "s"), (None, "c", "t")))
    assert kept.columns == docs().columns
    assert rows_of(kept.select("doc_id", "text")) == [(1, "a b"), (None, "c")]


def test_deletion_and_new_keepers(docs, rows_of):
    rows = X.digests(docs((1, "a", "s"), (2, "a", "s"), (3, "b", "s")))
    index = X.empty_index(rows.sparkSession, 3).update(inserts=rows)
    index = index.update(deletes=rows.where("doc_id IN (1, 3)"), inserts=X.digests(docs((4, "a", "s"))))
    assert [(r.keep_id, r.live) for r in index.keys.collect()] == [(1, 2)]
    live = rows.where("doc_id = 2").unionByName(X.digests(docs((4, "a", "s"))))
    assert [(r.keep_id, r.live) for r in index.rename_keepers(live).keys.collect()] == [(2, 2)]


BIG = 2**60


def test_large_ids_beside_null_ids_and_three_updates(docs, rows_of):
    rows = [(BIG + k, f"t{k % 40}", "s") for k in range(110)] + [(None, "t1", "s"), (None, "new", "s")]
    assert rows_of(X.exact_dedup(docs(*rows)).select("doc_id", "keep_id", "group_size", "kept")) == brute(rows)
    assert X.drop_copies(docs(*rows)).count() == 40 + 1
    source = X.digests(docs(*rows))
    index = X.empty_index(source.sparkSession, len(rows))
    for third in range(3):
        index = index.update(inserts=source.where(f"pmod(hash(doc_id, digest), 3) = {third}"))
    assert rows_of(index.decide(source).select("doc_id", "keep_id", "group_size", "kept")) == brute(rows)
    index = index.update(deletes=source.where(f"doc_id >= {BIG + 40}"))
    kept = {(r.keep_id, r.live) for r in index.keys.collect()}
    assert {(BIG + k, 1) for k in range(2, 40)} < kept and len(kept) == 41


def test_of_rows_that_repeat_one_stays(docs, rows_of):
    kept = X.drop_copies(docs((1, "a b", "s"), (1, "a  b", "t"), (2, "a b", "s"), (None, "b", "s"), (None, "b", "s"), (3, "c", "s"), (3, "d", "s")))
    assert rows_of(kept.select("doc_id", F.left("text", F.lit(1)))) == [(1, "a"), (3, "c"), (3, "d"), (None, "b")]


def test_text_ids(spark, rows_of):
    rows = [("b", "x"), ("a", "x"), ("c", "y"), (None, "y"), ("d ü", "z")]
    got = X.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "keep_id", "kept")
    assert rows_of(got) == sorted([("b", "a", False), ("a", "a", True), ("c", "c", True), (None, "c", False), ("d ü", "d ü", True)], key=repr)


def test_clashing_names(spark):
    rows = [(1, "x", "g", "h", 0), (2, "x", "g", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, gone_digest string, shard int")
    assert [r.doc_id for r in X.drop_copies(docs).collect()] == [1]
