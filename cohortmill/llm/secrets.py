"""Secret scans: fixed patterns and character Markov models, with DataFrame functions only.

Patterns find assignments, access keys and hex runs. Beyond them, long runs of
key characters are judged by two character Markov models, one of random strings
and one of ordinary identifiers: the mean log-likelihood ratio per transition
must reach a threshold. Both are counted from labelled samples in Spark; only
their transition counts, 67 x 67 at most, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.llm import base


class Kind(NamedTuple):
    name: str
    pattern: str
    group: int
    least: int


# Patterns that must match exactly. A run of hex digits or of key
# characters that is too short holds no longer one, so those two ask for their
# length in the pattern; an assignment that is too short still uses up its text.
ASSIGN = Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6)
ACCESS = Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20)
HEX = Kind("hex", r"[0-9a-f]{24,}", 0, 24)
BASE_KINDS = (ASSIGN, ACCESS, HEX)
MARKOV = "markov"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A run that the models judge, the least mean log-likelihood ratio, and the smoothing mass per state.
RUN = Kind(MARKOV, r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: Two characters that the models count, and an ordinary word.
PAIR, WORD = "[A-Za-z0-9+/_=-]{2}", "[A-Za-z_]{4,}"
THRESHOLD = 1.0
SMOOTHING = 8.0
#: Documents whose strings train each model; those with the smallest hash of their key among those that hold such strings.
TRAINING_DOCUMENTS = 2000

SPAN = "array<struct<start:int,kind:int,end:int>>"
MASK = "[SECRET]"


def found(text: Column, kind: Kind, number: int) -> Column:
    """Spans (start, kind, end) of a pattern, leftmost and without overlap; code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("value"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= kind.least, F.concat(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(kind.pattern), F.aggregate(parts, nothing, add)["spans"]).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind."""
    return F.array_sort(F.concat(*[found(text, k, i) for i, k in enumerate(BASE_KINDS)]))


# --- models ---------------------------------------------------------------------------

def labelled_strings(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """Strings (string, random) of a bounded sample of documents for each class.

    Random: what the fixed patterns find (the value, for assignments).
    Ordinary: words of letters and underscores in the text without those.
    Each class is drawn from the documents of the whole table that hold such
    strings, so a class is empty only if the table has none. Documents without
    a key are drawn by their text.
    """
    body, own = base.named(text), base.named(key)
    hits = F.filter(F.concat(*[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group)) for k in BASE_KINDS]),
                    lambda h: (F.length(h) >= ASSIGN.least) & h.rlike(PAIR))
    rest = F.col("text")
    for k in BASE_KINDS:
        rest = F.regexp_replace(rest, k.pattern, " ")
    some = F.lit(False)
    for k in BASE_KINDS:
        some = some | F.col("text").rlike(k.pattern)
    keyed = docs.select(F.when(own.isNull(), F.xxhash64(body)).otherwise(F.xxhash64(own)).alias("_id"), body.alias("text"))
    holds = base.stored(keyed.filter("text is not null").withColumn("_some", some).select(
        "_id", F.when(F.col("_some"), F.size(hits) > 0).otherwise(False).alias("random"),
        F.when(F.col("_some"), rest).otherwise(F.col("text")).rlike(WORD).alias("ordinary")).filter(
        "random or ordinary"), "secret-classes")

    def drawn(label: str) -> DataFrame:
        ids = holds.filter(label).select("_id").distinct().orderBy("_id").limit(documents)
        return keyed.join(F.broadcast(ids), "_id", "leftsemi")

    random = drawn("random").select(F.explode(hits).alias("string"), F.lit(True).alias("random"))
    words = drawn("ordinary").select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("string"),
                                     F.lit(False).alias("random"))
    return random.unionByName(words)


def fit(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of all transitions, row by row; None if a class has no transition.

    ``samples`` has string and random. Each class's next-character probabilities
    are smoothed towards its character frequencies.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("string") - 1)).alias("i")
    pairs = samples.filter(F.length("string") > 1).select("random", "string", at).select(
        "random", F.substr("string", F.col("i"), F.lit(2)).alias("pair"))
    counts = pairs.filter(F.col("pair").rlike(f"^{PAIR}$")).groupBy("random", "pair").count().collect()
    n = len(ALPHABET)
    tables = {}
    for label in (True, False):
        table = [[0.0] * n for _ in range(n)]
        for row in counts:
            if row["random"] is label:
                table[ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["count"]
        total = sum(map(sum, table))
        if not total:
            return None
        share = [(sum(r[c] for r in table) + 1) / (total + n) for c in range(n)]
        tables[label] = [[math.log((r[c] + SMOOTHING * share[c]) / (sum(r) + SMOOTHING)) for c in range(n)] for r in table]
    return [a - b for x, y in zip(tables[True], tables[False]) for a, b in zip(x, y)]


def ratio(string: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a string over ``ALPHABET``."""
    values = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substr(string, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(2), F.length(string)), F.lit(0.0), lambda acc, i: acc + F.element_at(
        values, (place(i - 1) - 1) * len(ALPHABET) + place(i)))
    return total / (F.length(string) - 1)


def markov_spans(text: Column, model: list[float] | None, known: Column, threshold: float = THRESHOLD) -> Column:
    """Spans that look random: of every run, what the spans of ``known`` (by start) leave, in pieces."""
    if model is None:
        return F.array().cast(SPAN)

    def piece(start: Column, end: Column) -> Column:
        return F.when(end - start >= RUN.least, F.array(F.struct(
            start.alias("start"), F.lit(len(BASE_KINDS)).alias("kind"), end.alias("end")))).otherwise(F.array().cast(SPAN))

    def left(run: Column) -> Column:
        def cut(acc: Column, k: Column) -> Column:
            return F.struct(F.greatest(acc["at"], k["end"]).alias("at"),
                            F.concat(acc["spans"], piece(acc["at"], k["start"])).alias("spans"))

        inside = F.filter(known, lambda k: (k["start"] < run["end"]) & (run["start"] < k["end"]))
        nothing = F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(inside, nothing, cut, lambda acc: F.concat(acc["spans"], piece(acc["at"], run["end"])))

    pieces = F.flatten(F.transform(found(text, RUN, len(BASE_KINDS)), left))
    return F.filter(pieces, lambda s: ratio(F.substr(text, s["start"] + 1, s["end"] - s["start"]), model) >= threshold)


# --- operator -------------------------------------------------------------------------

def scan(docs: DataFrame, model: list[float] | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns and ``spans`` (start, kind, end) by start, then kind; an input column ``spans`` is replaced.

    Kind numbers index ``kind_names``. A null text is empty and has no spans.
    """
    carried = base.beside(docs, ["spans"])
    body = F.coalesce(base.named(text), F.lit(""))
    first = docs.select(F.struct(*[base.named(c) for c in carried]).alias("_row"), body.alias("_body"),
                        base_spans(body).alias("_base"))
    spans = F.array_sort(F.concat("_base", markov_spans(F.col("_body"), model, F.col("_base"), threshold)))
    return first.select("_row.*", spans.alias("spans"))


def of_kind(number: int) -> Callable[[Column], Column]:
    """Condition on a span. It takes one argument only: Spark gives a second one the span's place in the array."""
    return lambda span: span["kind"] == number


def kind_names() -> list[str]:
    return [k.name for k in BASE_KINDS] + [MARKOV]


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kind_names()])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float] | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``MASK``; other texts stay as they are."""
    nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col("body")

    def cut(acc: Column, s: Column) -> Column:
        between = F.concat(acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], between).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", nothing, cut)
    clean = F.concat(done["out"], F.substr(body, done["at"] + 1, F.length(body)))
    whole = docs.select(F.struct(*[base.named(c) for c in docs.columns]).alias("row"), base.named(text).alias("body"))
    marked = scan(whole, model, "body", threshold)
    return marked.select(*[
        F.when(F.size("spans") > 0, clean).otherwise(body).alias(c) if c == text
        else F.col("row").getField(c).alias(c) for c in docs.columns])
