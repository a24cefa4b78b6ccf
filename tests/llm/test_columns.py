"""Input columns with any name, the operators' own helper names among them, come out as they went in."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from cohortmill.llm import decontaminate, exact, html_text, licenses, mixing, quality, secrets, simhash, urls

HERE = os.path.join(os.path.dirname(__file__), "..", "..", "cohortmill", "llm", "*.py")
#: Every name that some operator gives a column, and some awkward ones.
NAMES = sorted({n for f in glob.glob(HERE) for n in re.findall(r'(?:alias|withColumn)\([^()]*?"(\w+)"', open(f).read())}
               - {"doc_id", "text", "source", "url", "html", "position", "copy", "words", "spans", "draw", "log_weight"}) + ["a.b", "x`y"]
ROWS = [(1, "some words stand here password=abcdef1 and more of them", "s", "http://a.net/x", "<p>x"), (2, None, None, None, None),
        (3, "other words under the MIT license", "s", "http://b.com/de/", "<p>y")]
RESULTS = {"mark": exact.RESULTS, "plan": mixing.RESULTS, "order": mixing.RESULTS, "fingerprints": ["fingerprint"], "license": list(licenses.Found._fields), "judge": urls.RESULTS}


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "never found anywhere")], "item_id bigint, text string")
    return {
        "mark": exact.mark, "keep_first": exact.keep_first, "keep_one": simhash.keep_one, "fingerprints": simhash.fingerprints,
        "scan": lambda d: secrets.scan(d, None), "redact": lambda d: secrets.redact(d, None),
        "keep_good": lambda d: quality.keep_good(d, labels), "score": lambda d: quality.score(
            d, quality.fit(d, labels), labels, keep_text=True),
        "license": licenses.scan, "html": lambda d: html_text.extract(d, out="rendered"), "judge": urls.judge,
        "plan": mixing.plan_mix, "order": lambda d: mixing.training_order(mixing.plan_mix(d)),
        "clean": lambda d: decontaminate.keep_clean(d, bench)}


@pytest.mark.parametrize("name", ["mark", "keep_first", "keep_one", "fingerprints", "scan", "redact", "keep_good", "score", "license",
                                  "html", "judge", "plan", "order", "clean"])
def test_columns_survive(spark, name):
    assert len(NAMES) > 40
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string, url string, html string")
    given = {n: f"mine {n}" for n in NAMES if n not in RESULTS.get(name, [])}
    out = operators(spark)[name](docs.select("*", *[F.lit(v).alias(n) for n, v in given.items()]))
    assert len(out.columns) == len({c.lower() for c in out.columns})
    rows = out.collect()
    assert rows and all(r[n] == v for r in rows for n, v in given.items())
