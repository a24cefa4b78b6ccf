"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has one bit per position that is set in over half of the 64-bit
shingle hashes. Two fingerprints link when at most ``distance`` bits differ.

Candidates follow the pigeonring principle. The 64 bits form a ring of m =
distance + 1 segments. If two fingerprints differ in at most n = distance bits,
then some start i exists from which every chain of l consecutive segments
differs in at most floor(l * n / m) bits in total: none in the first segment, at
most one in the first two, and so on round the ring. The first two links of that
chain are an index key: segment i as it is, and segment i + 1 with one bit left
out. Fingerprints that share a key are candidates; the rest of the chain prunes
them, and the full Hamming distance decides.

A key with many fingerprints is dealt out in blocks of bounded size, and each
pair of blocks is compared in a task of its own, which returns only the links of
a spanning forest. So no task holds a whole key and no key makes all its pairs,
while components stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortmill.llm import base
from cohortmill.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints in a block of a hot key.
BLOCK = 256


# --- fingerprints ---------------------------------------------------------------------

def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of all word shingles, repeats included; of the whole text if shorter."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1:] - 1).tolist())]


def fingerprint(text: str | None, size: int) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """All other columns, with the text replaced by its fingerprint (bigint).

    A null text is empty and gets 0, like a text without words.
    """
    carried = [c for c in base.beside(docs, [out]) if c != text]
    narrow = docs.select(F.struct(*[base.named(c) for c in carried]).alias("_row"), base.named(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), values], ["_row", "_bits"])

    schema = narrow.drop("_text").schema.add("_bits", T.LongType())
    return narrow.mapInArrow(run, schema).select("_row.*", F.col("_bits").alias(out))


# --- candidates and links -------------------------------------------------------------

def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the distance + 1 segments."""
    m = distance + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(low: int, width: int) -> int:
    value = ((1 << width) - 1) << low
    return value - (1 << BITS) if value >> (BITS - 1) else value


def index_keys(fp: Column, distance: int) -> Column:
    """Keys of a fingerprint: hashes of start, bit left out, and remaining bits of the first two links.

    Where two keys share a hash, the check of the chain still tells them apart.
    """
    parts = segments(distance)
    keys = []
    for i, (low, width) in enumerate(parts):
        if distance == 0:
            keys.append(fp)
            continue
        low2, width2 = parts[(i + 1) % len(parts)]
        pair = _mask(low, width) | _mask(low2, width2)
        # The budget of two links is floor(2 n / m): one bit as soon as n >= 1.
        keys += [F.xxhash64(F.lit(i * BITS + bit), fp.bitwiseAND(F.lit(pair & ~_signed(1 << bit))))
                 for bit in range(low2, low2 + width2)]
    return F.array(*keys)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def linked(a: Column, b: Column, distance: int) -> Column:
    """Whether a chain from some start stays within its budgets, and then the full distance."""
    parts, n = segments(distance), distance
    m = len(parts)
    diff = a.bitwiseXOR(b)
    chains = F.lit(False)
    for i in range(m):
        held, chain = F.lit(True), 0
        for length in range(1, m):
            chain |= _mask(*parts[(i + length - 1) % m])
            held = held & (F.bit_count(diff.bitwiseAND(F.lit(_signed(chain % (1 << BITS))))) <= length * n // m)
        chains = chains | held
    return chains & (F.bit_count(diff) <= distance)


def forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the close pairs within a block, or between two."""
    values = left if right is None else np.concatenate((left, right))
    diff = left[:, None] ^ (left if right is None else right)[None, :]
    close = np.zeros(diff.shape, bool)
    parts, n = segments(distance), distance
    m = len(parts)
    for i in range(m):
        chain = np.uint64(0)
        live = ~close
        for length in range(1, m):
            low, width = parts[(i + length - 1) % m]
            chain |= np.uint64(((1 << width) - 1) << low)
            live &= np.bitwise_count(diff & chain) <= length * n // m
            if not live.any():
                break
        close |= live
    close &= np.bitwise_count(diff) <= distance
    if right is None:
        near = close
    else:
        near = np.zeros((len(values), len(values)), bool)
        near[:len(left), len(left):] = close
        near[len(left):, :len(left)] = close.T
    # Breadth-first from the lowest unvisited member; each new one links to a member of the wave before.
    waiting, child, parent = near.sum(axis=0) > (right is None), [], []
    while waiting.any():
        wave = np.array([np.argmax(waiting)])
        waiting[wave] = False
        while len(wave):
            reached = near[wave] & waiting
            new = np.flatnonzero(reached.any(axis=0))
            child.append(new)
            parent.append(wave[reached[:, new].argmax(axis=0)])
            waiting[new] = False
            wave = new
    if not child:
        return values[:0], values[:0]
    return values[np.concatenate(parent)], values[np.concatenate(child)]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all close pairs.

    ``fps`` has one distinct bigint column ``fp``. Pairs that are alone under a
    key come straight from its smallest and largest member; fuller keys are
    dealt out in blocks. Connected through the result are exactly the
    fingerprints connected through pairs at most ``distance`` bits apart.
    """
    # A few bytes per document become many keys: spread them over the cluster first.
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = fps.repartition(spread, "fp").select("fp", F.explode(index_keys(F.col("fp"), distance)).alias("k"))
    keys = base.stored(
        posts.groupBy("k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1"), "simhash-keys")
    pairs = keys.filter("n = 2").select("a", "b").distinct().filter(linked(F.col("a"), F.col("b"), distance))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    full = (posts.join(keys.filter("n > 2").select("k", blocks.alias("blocks")).hint("merge"), "k")
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (full.select("k", "fp", "own", other.alias("other"))
             .select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.struct((F.col("own") > F.col("other")).alias("second"), "fp").alias("member")))
    cells = (dealt.groupBy("k", "i", "j").agg(F.sort_array(F.collect_list("member")).alias("m"))
             .select((F.col("i") == F.col("j")).alias("same"), "m").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            members = batch.column("m")
            flat = members.flatten()
            values = np.asarray(flat.field("fp").to_numpy(zero_copy_only=False)).view(np.uint64)
            second = np.asarray(flat.field("second").to_numpy(zero_copy_only=False))
            bounds = np.concatenate(([0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))))
            for same, lo, hi in zip(batch.column("same").to_pylist(), bounds, bounds[1:]):
                part, split = values[lo:hi], lo + int(np.count_nonzero(~second[lo:hi]))
                x, y = forest(part, None, distance) if same else forest(values[lo:split], values[split:hi], distance)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            x, y = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    found = cells.mapInArrow(run, "a bigint, b bigint")
    return pairs.unionByName(found).distinct()


# --- classes --------------------------------------------------------------------------

def classes(fps: DataFrame, distance: int = 4, fp: str = "fingerprint") -> DataFrame:
    """(fp, root): every distinct fingerprint with the smallest fingerprint connected to it."""
    distinct = base.stored(fps.select(F.col(fp).alias("fp")).distinct(), "simhash-distinct")
    near = components(links(distinct, distance), "simhash-links").withColumnRenamed("node", "fp")
    return distinct.join(near, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4,
                    distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: its key, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest key reachable through links; null if all
    keys of the component are null. Texts without words share fingerprint zero
    and so one component. Repeated rows stay repeated. Input columns with the
    result's names are not carried.
    """
    narrow = docs.select(base.named(key).alias("key"), base.named(text).alias("text"))
    fps = base.stored(fingerprints(narrow, shingle=shingle), "simhash")
    root = base.stored(classes(fps, distance), "simhash-classes")
    least = fps.groupBy("fingerprint").agg(F.min("key").alias("key")).join(
        root, F.col("fingerprint") == F.col("fp")).groupBy("root").agg(F.min("key").alias("component_id"))
    component = root.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return fps.join(component, "fingerprint").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4,
             distance: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that with the smallest key.

    Among rows with that key a hash of all columns decides, and of fully equal
    rows one stays. Null keys come after all others. All columns are returned.
    """
    row = F.xxhash64(*[base.named(c) for c in docs.columns])
    narrow = docs.select(base.named(key).alias("key"), row.alias("row"), base.named(text).alias("text"))
    fps = base.stored(fingerprints(narrow, shingle=shingle), "simhash")
    root = classes(fps, distance)
    rank = F.struct(F.col("key").isNull().alias("last"), "key", "row")
    first = fps.groupBy("fingerprint").agg(F.min(rank).alias("first")).join(
        root, F.col("fingerprint") == F.col("fp")).groupBy("root").agg(F.min("first").alias("first"))
    winners = base.stored(first.select(F.xxhash64("first.key").alias("_k"), F.col("first.row").alias("_r")),
                          "simhash-winners")
    kept = docs.select(F.struct(*[base.named(c) for c in docs.columns]).alias("_row"), F.xxhash64(base.named(key)).alias("_k"),
                       row.alias("_r")).join(winners, ["_k", "_r"], "leftsemi")
    return kept.dropDuplicates(["_k", "_r"]).select("_row.*")
