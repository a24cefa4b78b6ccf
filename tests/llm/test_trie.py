"""Prefix tries and Euler tours against plain trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortmill.llm import base, queries, tour, trie

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, part int"


def conversations(n=220, seed=5):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-3, n, 1)]:
        if c % 100 == 0 and c > 200 or c % 41 == 7:
            continue
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t else "user", rnd.choice(["hi", "ho", "héé", "", None, "x" * 50])))
    rows += [(-250, None, None, None), (7, None, "user", "b"), (7, None, "user", "a"), (7, 1, "system", "c"), (7, 1, "system", "c")]
    rows += [(900, 3, "u", f"t{i % 5}") for i in range(90)] + [(901, None, "u", f"t{i}") for i in range(70)]
    rows += [(None, 0, "user", "takes no part"), (2 ** 40, 0, "user", "hi")]
    rnd.shuffle(rows)
    return [(*r, "own", 1) for r in rows]


def plain_trie(rows, rebuild):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            m = hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()
            convs.setdefault(c, []).append((t is not None, t or 0, m, r or "", x or ""))
    convs = {c: [v[3:] for v in sorted(ts)] for c, ts in convs.items()}
    built = convs
    if rebuild:
        built = {}
        for c, ts in convs.items():
            h = zlib.crc32(str(c).encode()) % 6
            lender = c - (abs(c) % 100) * (1 if c >= 0 else -1)
            built[c] = convs.get(lender, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        kids = children.get(p, [])
        sums[p] = (sum(sums[k][0] for k in kids) or 1, own + sum(sums[k][1] for k in kids))
    out = set()
    for p, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        out.add((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), *sums[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("rebuild,rest", [(False, tour.REST), (True, 200)])
def test_trie_against_plain_tree(spark, rebuild, rest):
    rows = conversations()
    steps = trie.numbered(spark.createDataFrame(rows, TURNS))
    passed = trie.members(trie.with_borrowed_heads(steps) if rebuild else steps)
    got = trie.digest(trie.nodes(passed, rest), passed).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_trie(rows, rebuild)


def test_query_equals_plain_tree(spark, tmp_path):
    rows = [r[:4] for r in conversations(seed=6)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = queries.op12_conversation_trie(spark, str(tmp_path))
    assert {f.dataType.simpleString() for f in got.schema if f.name != "ends_sha256"} == {"bigint"}
    assert set(map(tuple, got.collect())) == plain_trie(rows, True)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).collect() == []
    # crc32("3") % 6 > 1 and conversation 0 is missing: nothing is left of 3.
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1)
    passed = trie.members(trie.with_borrowed_heads(trie.numbered(spark.createDataFrame([(lone, 0, "u", "t", "", 1)], TURNS))))
    got = trie.digest(trie.nodes(passed), passed).collect()
    assert len(got) == 1 and got[0]["conv_id"] == lone and got[0]["n_convs"] == 1 and got[0]["n_leaves"] == 1


def test_tour_of_a_forest(spark):
    """Paths, stars and single roots; sums and nested places."""
    rnd = random.Random(3)
    parent = {i: None if i % 97 == 0 else (i - 1 if i % 97 < 40 else rnd.randrange(i // 97 * 97, i)) for i in range(600)}
    weight = {i: rnd.randrange(100) for i in parent}
    rows = base.stored(spark.createDataFrame([(i, p, -i, weight[i]) for i, p in parent.items()],
                                             "no bigint, parent bigint, place bigint, w bigint").repartition(6), "tour-test")
    want = dict(weight)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    got = {r["no"]: r for r in tour.subtree_sums(rows, ["w"], rest=60).collect()}
    assert {i: r["w"] for i, r in got.items()} == want
    for i, p in parent.items():
        if p is not None:
            assert got[p]["enter"] < got[i]["enter"] < got[i]["exit"] < got[p]["exit"]
    places = {(r["enter"], r["exit"]) for i, r in got.items() if i < 97}
    assert sorted(x for pair in places for x in pair) == list(range(2 * 97))
    assert rows.filter(F.col("parent").isNull()).count() == sum(p is None for p in parent.values())
