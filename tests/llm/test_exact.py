"""Exact duplicates against a plain grouping."""

import hashlib
import random
import re

from cohortmill.llm import base, exact

KINDS = "doc_id bigint, text string, keep_id string, _row int, `_id` string, length string, a.b int".replace("a.b", "`a.b`")


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def corpus():
    rnd = random.Random(31)
    texts = [None, "", " ", "\t\n", "a", "a b", "same start " * 20 + "x", "same start " * 20 + "y", "ü" * 100, "long " * 40_000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    texts += ["one very  common text"] * 400 + ["one very\r\ncommon text"] * 100
    rows = [(i, t, "k", i % 3, "x", "l", 1) for i, t in enumerate(texts)]
    rows += [(None, "a", "k", 0, "x", "l", 1), (None, "only without a key", "k", 0, "x", "l", 1)]
    rows += [rows[6], rows[6], rows[9], rows[-1], rows[-1]]
    rnd.shuffle(rows)
    return rows


def check(rows, got):
    groups = {}
    for r in rows:
        groups.setdefault(plain(r[1]), []).append(r[0])
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        ids = groups[plain(r["text"])]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[plain(r["text"])] = kept.get(plain(r["text"]), 0) + 1
    assert kept == dict.fromkeys(groups, 1)


def test_groups_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, KINDS)
    for df in (docs, docs.repartition(9)):
        got = exact.mark(df).collect()
        check(rows, got)
    names = set(got[0].asDict())
    assert {"_row", "_id", "length", "a.b"} <= names and type(got[0]["keep_id"]) in (int, type(None))
    assert sorted(r["_row"] for r in got) == sorted(r[3] for r in rows)


def test_bitmaps_that_mark_nearly_everything_change_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(base, "BITS_PER_KEY", 0)
    monkeypatch.setattr(base, "PIECE_BITS", 8)
    check(rows, exact.mark(spark.createDataFrame(rows, KINDS)).collect())


def test_bitmap_marks_its_hashes_and_few_others(spark):
    keys = base.stored(spark.range(5000).selectExpr("xxhash64(id) h"), "bitmap-test")
    rows = spark.range(10_000).selectExpr("id", "xxhash64(id) x")
    got = base.marked(rows, rows["x"], base.bitmap_of(keys), "hit").collect()
    assert all(r["hit"] for r in got if r["id"] < 5000)
    assert sum(r["hit"] for r in got if r["id"] >= 5000) < 600


def test_keep_first_returns_whole_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, KINDS)
    got = exact.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(plain(r["text"]) for r in got.collect()) == sorted({plain(r[1]) for r in rows})
    assert {r["keep_id"] for r in got.collect()} == {"k"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], KINDS)
    assert exact.mark(empty).collect() == [] and exact.keep_first(empty).collect() == []


def test_query(spark, tmp_path):
    from cohortmill.llm import queries
    rows = [r[:2] for r in corpus()]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_exact_duplicates(spark, str(tmp_path)).collect()
    assert sorted(r["text_sha256"] for r in got) == sorted(hashlib.sha256(plain(t).encode()).hexdigest() for _, t in rows)
    assert sum(r["kept"] for r in got) == len({plain(t) for _, t in rows})
