"""Repeated units without a pattern's backtracking, against the pattern itself."""

import random
import re

from auditloom.functions import text as T
from auditloom.operators import content, filler


def made_texts(n):
    rng = random.Random(8)
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            unit = "".join(rng.choice(rng.choice(("ab", "abcdefgh文😀", "a"))) for _ in range(rng.randint(1, 34)))
            text += unit * rng.randint(1, 9) + rng.choice(("", "", "\n", "x", " ", "\r", " ", "\x85")) + unit[: rng.randint(0, 5)]
        at = rng.randrange(len(text) + 1)
        yield text[:at] + rng.choice(("", "\n", "a")) + text[at:]


def test_units_as_the_pattern_counts_them():
    found = [(len(re.findall(T.FILLER_REPEAT, t)), filler.count_repeats(t)) for t in made_texts(3000)]
    assert all(a == b for a, b in found) and sum(a > 1 for a, _ in found) > 100
    assert filler.likely_units(filler.np.frombuffer("".join(map(chr, range(256, 20000))).encode("utf-32-le"), "<u4")) == []


def test_repeats_of_a_table(spark):
    """As Spark's own pattern counts them, null as nothing; the plan has no pattern that is tried at every character."""
    rows = [(0, None), (1, "")] + list(enumerate(made_texts(300), 2))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = content.repeats(df, "doc_id")
    assert {r["doc_id"]: r["n_repeats"] for r in out.collect()} == {r["doc_id"]: r["n"] for r in df.selectExpr("doc_id", f"regexp_count(coalesce(text, ''), r'{T.FILLER_REPEAT}') AS n").collect()}
    assert "regexp" not in out._jdf.queryExecution().toString().lower() and out.schema["n_repeats"].dataType.typeName() == "long"
