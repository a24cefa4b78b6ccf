"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

A document leaks an item if some stretch of its words is at most ``edits`` (a
share of the item's words) insertions, deletions and replacements away from the
item's words. Words are letters, digits and anything beyond ASCII, A-Z in lower
case.

Every window of an item's size is a candidate. A CGK random walk copies its
words to a longer string, staying on a word or moving on by a random bit of the
word, so that a small edit distance becomes a small Hamming distance. A key is a
few sampled places of that string; windows and items that share a key in one of
the repetitions are compared exactly. Places lie where the walk hasn't passed
the shortest stretch within the budget, so one window serves stretches of all
lengths. How many repetitions and places a length needs follows from a target
recall at the full budget, for whichever kind of edit is hardest (``plan_of``).

Before the walk, windows that hold too few words of an item to be within the
edits are left out, which loses nothing.

Texts are not shuffled: the items go to the texts, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortmill.llm import base
from cohortmill.llm.words import PUNCTUATION, Group, groups, mixed, spelling, word_hashes

#: Share of an item's words that may differ.
EDITS = 0.2
#: Share of the stretches at the full budget that the keys must find, by simulation with so many edit patterns and walks.
TARGET_RECALL, PATTERNS, WALKS, SEED = 0.999, 64, 64, 20240501
#: Places per key if that takes at most so many repetitions; fewer places need fewer repetitions and tell less.
MOST_PLACES, FEW_REPETITIONS, MOST_REPETITIONS = 3, 64, 512
#: Items and bytes of item text that go to the tasks at once.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Words that occur in at most this many items of a block count as telling.
TELLING_ITEMS = 2
#: Bits of a word hash that address the vocabulary bitmaps.
MAP_BITS = 20
TEXT_BYTES = 1 << 22


class Plan(NamedTuple):
    """Repetitions for items of one length: a salt per repetition and step, and whether the step is sampled."""
    salts: np.ndarray
    sampled: np.ndarray


class Items(NamedTuple):
    """Items of a block with what the search needs of them.

    telling and telling_items: the items' telling words, sorted, each with its
    item. needed: telling words that a stretch must hold; where that is none,
    the item's length class is plain. plans and keys: per length class, the
    latter as (sorted keys, each key's item).
    """
    ids: list[Any]
    words: list[np.ndarray]
    budgets: np.ndarray
    lengths: np.ndarray
    classes: np.ndarray
    known: np.ndarray
    telling: np.ndarray
    telling_items: np.ndarray
    needed: np.ndarray
    plain: np.ndarray
    length_budgets: np.ndarray
    plans: list[Plan]
    keys: list[tuple[np.ndarray, np.ndarray]]


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: np.ndarray) -> Iterator[np.ndarray]:
    """The words (repetition, window) that a CGK walk copies in each step; 0 behind a window's text."""
    at = np.broadcast_to(starts, (len(salts), len(starts))).copy()
    padded = np.append(words, np.uint64(0))
    for step in range(salts.shape[1]):
        here = padded[np.minimum(at, ends)]
        here[at >= ends] = 0
        yield here
        at += (mixed(here ^ salts[:, step][:, None]) >> np.uint64(63)).astype(np.int64)


def keys_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, plan: Plan) -> np.ndarray:
    """LSH keys (repetition, window) of the windows of one length class that begin at ``starts``."""
    keys = np.repeat(np.arange(1, len(plan.salts) + 1, dtype=np.uint64)[:, None], len(starts), axis=1)
    for step, here in enumerate(walk(words, starts, ends, plan.salts)):
        chosen = plan.sampled[:, step]
        if chosen.any():
            keys[chosen] = mixed(keys[chosen] * np.uint64(0x9E3779B97F4A7C15) + here[chosen])
    return keys


def edited(rng: np.random.Generator, n: int, budget: int, kind: str) -> list[int]:
    """The numbers 1 to n with ``budget`` edits of a kind; new words are large numbers."""
    parts = [[i] for i in range(1, n + 1)]
    for at in rng.choice(n, budget, replace=False).tolist():
        new = int(rng.integers(1 << 40, 1 << 60))
        parts[at] = {"replace": [new], "delete": [], "insert": [new, at + 1]}[kind]
    return [w for part in parts for w in part]


@lru_cache(maxsize=4096)
def agreement(n: int, budget: int, kind: str) -> np.ndarray:
    """(edit pattern, walk): share of the sampled steps in which an item of n words and a stretch at its budget agree."""
    rng = np.random.default_rng((SEED, n, budget))
    size = 2 * n + budget
    rows = [[*range(1, n + 1), *[0] * size]] + [
        edited(rng, n, budget, kind) + rng.integers(1 << 40, 1 << 60, size).tolist() for _ in range(PATTERNS)]
    flat = mixed(np.array([r[:size] for r in rows], np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15))
    starts = np.arange(len(rows)) * size
    ends = starts + n
    salts = rng.integers(0, 1 << 63, (WALKS, steps_of(n, budget)), dtype=np.uint64)
    same = np.zeros((WALKS, PATTERNS))
    for here in walk(flat, starts, ends, salts):
        same += here[:, 1:] == here[:, :1]
    return (same / salts.shape[1]).T


def steps_of(n: int, budget: int) -> int:
    """Steps that stay inside the shortest stretch within the budget, as half of all steps move on."""
    return max(1, 2 * (n - budget))


@lru_cache(maxsize=4096)
def settings(n: int, budget: int, target: float = TARGET_RECALL) -> tuple[int, int]:
    """(places, repetitions) that reach the target recall for every kind of edit."""
    for places in range(min(MOST_PLACES, steps_of(n, budget)), 0, -1):
        least = 1
        for kind in ("replace", "delete", "insert") if budget else ():
            missed = 1.0 - (agreement(n, budget, kind) ** places).mean(axis=1)
            least = max(least, next((r for r in range(1, MOST_REPETITIONS) if (missed ** r).mean() <= 1.0 - target), MOST_REPETITIONS))
        if least <= FEW_REPETITIONS or places == 1:
            return places, least
    raise AssertionError


def plan_of(n: int, budget: int) -> Plan:
    """The walks and sampled places of a length; the same in every run."""
    places, repetitions = settings(n, budget)
    rng = np.random.default_rng((SEED, 1, n, budget))
    steps = steps_of(n, budget)
    sampled = np.zeros((repetitions, steps), bool)
    for r in range(repetitions):
        sampled[r, rng.choice(steps, places, replace=False)] = True
    salts = rng.integers(0, 1 << 63, (repetitions, steps), dtype=np.uint64)
    # Steps behind the last sampled one need not be walked.
    last = int(np.flatnonzero(sampled.any(axis=0))[-1]) + 1
    return Plan(salts[:, :last], sampled[:, :last])


def prepare(items: list[tuple[Any, str | None]], edits: float = EDITS) -> Items | None:
    """The search structure of some items; None if none has words."""
    how = spelling(PUNCTUATION, lower=True)
    read = [(i, word_hashes(t or "", how)) for i, t in items]
    read = [(i, w) for i, w in read if len(w)]
    if not read:
        return None
    ids, words = [i for i, _ in read], [w for _, w in read]
    sizes = np.array([len(w) for w in words])
    budgets = np.floor(sizes * edits + 1e-9).astype(np.int64)
    lengths, classes = np.unique(sizes, return_inverse=True)
    distinct, counts = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    known = np.zeros(1 << MAP_BITS, bool)
    known[_place(distinct)] = True
    rare = distinct[counts <= TELLING_ITEMS]
    own = [np.intersect1d(w, rare) for w in words]
    # Each edit takes away one of the item's telling words at most.
    needed = np.array([len(w) for w in own]) - budgets
    pairs = np.array([(w, i) for i, ws in enumerate(own) for w in ws.tolist()], np.uint64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    plain = np.isin(np.arange(len(lengths)), classes[needed < 1])
    length_budgets = np.floor(lengths * edits + 1e-9).astype(np.int64)
    plans = [plan_of(int(n), int(b)) for n, b in zip(lengths, length_budgets)]
    flat, first = np.concatenate(words), np.concatenate(([0], np.cumsum(sizes)))
    keys = []
    for c, plan in enumerate(plans):
        own_class = np.flatnonzero(classes == c)
        found = keys_of(flat, first[own_class], first[own_class + 1], plan)
        order = np.argsort(found.ravel(), kind="stable")
        keys.append((found.ravel()[order], np.broadcast_to(own_class, found.shape).ravel()[order]))
    return Items(ids, words, budgets, lengths, classes, known, pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), needed,
                 plain, length_budgets, plans, keys)


def gathered(group: Group, items: Items, known: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, item) of windows in places that hold enough telling words of an item."""
    words = group.hashes
    hits = np.flatnonzero(known)
    low = np.searchsorted(items.telling, words[hits])
    high = np.searchsorted(items.telling, words[hits], side="right")
    times = high - low
    at = np.repeat(hits, times)
    item = items.telling_items[np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(at))]
    ready = items.needed[item] > 0
    at, item = at[ready], item[ready]
    order = np.lexsort((at, item))
    at, item = at[order], item[order]
    last = np.arange(len(at)) + items.needed[item] - 1
    there = np.flatnonzero(last < len(at))
    last = last[there]
    reach = np.array([len(w) for w in items.words]) + items.budgets
    enough = (item[last] == item[there]) & (at[last] - at[there] < reach[item[there]]) & (ends[at[last]] == ends[at[there]])
    first, last, item = at[there[enough]], at[last[enough]], item[there[enough]]
    # The nearest stretch can be taken to begin with a word of the item, up to the first telling one.
    begin = np.maximum(last - reach[item] + 1, np.concatenate((group.bounds, [0]))[
        np.searchsorted(group.bounds, first, side="right") - 1])
    times = first - begin + 1
    start = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())
    item = np.repeat(item, times)
    keep = known[start]
    both = np.unique(item[keep] * (len(words) + 1) + start[keep])
    return both % (len(words) + 1), both // (len(words) + 1)


def crowded(group: Group, items: Items, known: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length class) of windows in places with enough words of any item, for the plain classes."""
    starts, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    before, every = np.concatenate(([0], np.cumsum(known))), np.flatnonzero(known)
    for c in np.flatnonzero(items.plain):
        stop = np.minimum(every + items.lengths[c], ends[every])
        chosen = every[before[stop] - before[every] >= items.lengths[c] - items.length_budgets[c]]
        starts.append(chosen)
        classes.append(np.full(len(chosen), c))
    return np.concatenate(starts), np.concatenate(classes)


def lanes(group: Group, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length class) of the windows that hold enough of the items' words, by class."""
    known = items.known[_place(group.hashes)]
    ends = np.repeat(group.bounds[1:], np.diff(group.bounds))
    start, item = gathered(group, items, known, ends)
    more, plain = crowded(group, items, known, ends)
    span = len(group.hashes) + 1
    both = np.unique(np.concatenate((items.classes[item] * span + start, plain * span + more)))
    return both % span, both // span


def candidates(group: Group, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, end) of what must be searched, in order and without overlap.

    A window that shares a key with an item may begin up to the budget before or
    behind the stretch that it comes from.
    """
    start, classes = lanes(group, items)
    ends = np.repeat(group.bounds[1:], np.diff(group.bounds))
    found = [np.zeros((0, 3), np.int64)]
    for c in np.unique(classes).tolist():
        own, (keys, owner), plan = start[classes == c], items.keys[c], items.plans[c]
        step = max(1, (1 << 18) // len(plan.salts))
        for lo in range(0, len(own), step):
            part = own[lo:lo + step]
            here = keys_of(group.hashes, part, np.minimum(part + items.lengths[c], ends[part]), plan)
            low, high = np.searchsorted(keys, here), np.searchsorted(keys, here, side="right")
            r, i = np.nonzero(low < high)
            times = (high - low)[r, i]
            place = np.repeat(low[r, i] - np.cumsum(times) + times, times) + np.arange(times.sum())
            at = np.repeat(part[i], times)
            row = np.searchsorted(group.bounds, at, side="right") - 1
            found.append(np.unique(np.stack((row, owner[place], at), axis=1), axis=0))
    out: list[tuple[int, int, int, int]] = []
    for row, i, begin in np.unique(np.concatenate(found), axis=0).tolist():
        size, budget = len(items.words[i]), int(items.budgets[i])
        low = max(begin - budget, int(group.bounds[row]))
        high = min(begin + size + 2 * budget, int(group.bounds[row + 1]))
        if out and out[-1][:2] == (row, i) and low <= out[-1][3]:
            out[-1] = (row, i, out[-1][2], high)
        else:
            out.append((row, i, low, high))
    return out


def best_match(item: list[int], text: list[int], budget: int) -> tuple[int, int, int] | None:
    """(distance, first, end) of the stretch of ``text`` nearest to ``item``, if within the budget.

    A bit-parallel pass (one big integer per column) finds the distance; only
    if that is within the budget, the table is filled for the place. Of equally
    near stretches the one that ends first counts.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now = full, 0, n
    least, end = n, 0
    for j, word in enumerate(text):
        match = masks.get(word, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up, right_down = (down | ~(diagonal | up)) & full, up & diagonal
        now += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
        up, down = (right_down | ~(diagonal | right_up)) & full, right_up & diagonal
        if now < least:
            least, end = now, j + 1
            if not least:
                break
    if least > budget:
        return None
    # A stretch within the budget is at most that much longer than the item.
    since = max(0, end - n - budget)
    column = [(i, since) for i in range(n + 1)]
    for j, word in enumerate(text[since:end], since):
        before, column = column, [(0, j + 1)]
        for i in range(n):
            column.append(min((before[i][0] + (item[i] != word), before[i][1]),
                              (before[i + 1][0] + 1, before[i + 1][1]), (column[i][0] + 1, column[i][1]),
                              key=lambda c: (c[0], -c[1])))
    return least, column[n][1], end


def found_in(group: Group, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Best (distance, first word, end word) by (row, item)."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, item, since, upto in candidates(group, items):
        best, budget = out.get((row, item)), int(items.budgets[item])
        if best and best[0] == 0:
            continue
        match = best_match(items.words[item].tolist(), group.hashes[since:upto].tolist(), budget)
        if match and (best is None or match[0] < best[0]):
            since -= int(group.bounds[row])
            out[row, item] = (match[0], match[1] + since, match[2] + since)
    return out


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", edits: float = EDITS) -> Iterator[Items]:
    """Search structures of all items, block by block; the number of blocks follows their number and bytes."""
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length(base.named(text))).alias("bytes")).first()
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(base.named(key), base.named(text)), F.lit(n))
    for b in range(n):
        rows = items.filter(block == b).select(base.named(key), base.named(text)).collect()
        prepared = prepare(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0], r[1] or "")), edits)
        if prepared is not None:
            yield prepared


RESULTS = ["distance", "item_words", "first_word", "end_word"]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """One row per document row and item that it leaks.

    Columns: the document's key, the item's key, its edit distance, the item's
    number of words and where the nearest stretch lies (words, end exclusive).
    Null texts are empty; items without words are not looked for. Repeated
    documents and items give repeated rows.
    """
    rows = docs.select(base.named(key).alias("_key"), base.named(text).cast("string").alias("_text"))
    kind = items.schema[item_key].dataType
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, kind),
                           *[T.StructField(c, T.LongType()) for c in RESULTS]])
    out = None
    for block in blocks(items, item_key, item_text, edits):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                at, which, values = [], [], []
                for group in groups(batch.column("_text"), spelling(PUNCTUATION, lower=True), TEXT_BYTES):
                    for (row, item), (distance, first, end) in found_in(group, model).items():
                        at.append(group.first + row)
                        which.append(model.ids[item])
                        values.append((distance, len(model.words[item]), first, end))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(at, pa.int64())), pa.array(which, target),
                     *[pa.array([v[i] for v in values], pa.int64()) for i in range(4)]], [key, item_key, *RESULTS])

        target = to_arrow_type(kind)
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
               edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all columns."""
    out = docs.select(F.struct(*[base.named(c) for c in docs.columns]).alias("_row"), base.named(text).cast("string").alias("_text"))
    for block in blocks(items, item_key, item_text, edits):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for group in groups(batch.column("_text"), spelling(PUNCTUATION, lower=True), TEXT_BYTES):
                    for row, _ in found_in(group, shared.value):
                        clean[group.first + row] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, out.schema)
    return out.select("_row.*")
