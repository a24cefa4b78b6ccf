"""The pipeline against plain versions of its stages, on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from test_native import base_brute, level_targets, words
from test_search import edit_share, plain_components, plain_fingerprint


def corpus():
    rnd = random.Random(12)
    vocabulary = [f"word{i}" for i in range(400)]
    pick = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [[f"item{i}x{j}" for j in range(20)] for i in range(5)]
    rows, labels = [], []
    for i in range(500):
        body, kind = pick(rnd.choice([40, 150])), i % 10
        if kind == 0:
            body = [b.upper() + "!!" for b in body]
        elif kind == 1 and i > 10:
            body = rows[i - rnd.choice([8, 10])][1].split(" ")
        elif kind == 2:
            item = list(rnd.choice(items))
            item[rnd.randrange(20)] = "changed"
            body[10:10] = item
        elif kind == 3:
            body.insert(5, "password=b7db7aa4a5fcc78305")
        rows.append((i, " ".join(body), "en", rnd.choice(["a", "b", None]), 0))
        if i % 3 == 0:
            labels.append((i, int(kind != 0), 0))
    rows += [(500, None, "en", "a", 0), (None, "a row without a key stands here", None, "b", 0), rows[7], rows[7]]
    return rows, labels, [" ".join(i) for i in items]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, labels, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [r for r in rows if not (r[1] or "").endswith("!!")]
    classes, kept = plain_components([plain_fingerprint(r[1]) for r in good], 4), {}
    for c, r in zip(classes, good):
        kept[c] = min(kept.get(c, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    clean = [r for r in kept.values() if all(
        edit_share(i.split(), (r[1] or "").split()) > len(i.split()) * .2 for i in items)]
    masked = {}
    for key, text, _, source, _ in clean:
        for start, _, end in sorted(base_brute(text or ""), reverse=True):
            text = text[:start] + "[SECRET]" + text[end:] if "[SECRET]" not in text[start:end] else text
        masked[key] = (text, source)
    assert {r["doc_id"] for r in got} <= set(masked)
    assert all((r["text"], r["source"]) == masked[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)

    sizes = {}
    for text, source in masked.values():
        sizes[source] = sizes.get(source, 0) + words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level_targets(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)})
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"]
    assert {s: int(t + 1e-9) for s, t in want.items() if t} == taken
    places = [r["position"] for r in got]
    assert places == sorted(places) and len({(r["doc_id"], r["copy"]) for r in got}) == len(got)


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    empty = spark.createDataFrame([], kinds)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty.withColumn("spans", F.lit("extra")), str(tmp_path))
        assert out.count() == 0 and "spans" in out.columns
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == [*empty.columns, "spans"]
