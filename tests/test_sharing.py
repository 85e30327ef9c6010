"""All pages of a site that share a gram, by blocks, against plain comparisons of all with all."""

import itertools
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from auditloom.operators import content, sharing


def plain_pairs(sets):
    """{(a, b): similarity} of one site; similarities of six digits, halves up."""
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x & y:
            out[a, b] = float((Decimal(len(x & y)) / len(x | y)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def written(spark):
    """Rows that all stages so far wrote for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


@pytest.mark.parametrize(("least", "most", "room"), [(256, 2_000_000, 1 << 20), (3, 2_000_000, 64), (1, 40, 5), (10**6, 10**6, 1)])
def test_sharing_pairs(spark, monkeypatch, least, most, room):
    """Sites of unlike, alike and equal sets, in one block and many, in large pieces and small."""
    for name, value in (("LEAST", least), ("MOST", most), ("ROOM", room)):
        monkeypatch.setattr(sharing, name, value)
    rng = random.Random(3)
    sites = {}
    for k in range(12):
        pool, hot = range(rng.choice((5, 60, 900))), rng.choice((0, 1, 6))
        sites[f"s{k}"] = {1000 * k + i: set(rng.sample(pool, rng.randint(0, min(len(pool), 30)))) | set(range(10**6, 10**6 + hot)) for i in range(rng.choice((1, 2, 9, 30)))}
    sites["halves"] = {10**6: {1}, 10**6 + 1: set(range(1, 129)), 10**6 + 2: {1, *range(200, 327)}, 10**6 + 3: set(range(1, 65))}
    rows = [(s, i, sorted(g)) for s, own in sites.items() for i, g in own.items()] + [(None, 1, [1]), (None, 2, [1]), ("s0", None, [10**6])]
    found = sharing.sharing_pairs(spark.createDataFrame(rows, "site string, page_id long, grams array<long>").repartition(3)).collect()
    want = {(s, *p): m for s, own in sites.items() for p, m in plain_pairs(own).items()}
    assert len(found) == len(want) and {(r["site"], r["a"], r["b"]): r["similarity"] for r in found} == want
    assert want["halves", 10**6, 10**6 + 1] == 0.007813


def test_pairs_are_not_shuffled(spark):
    """A gram that all pages share: every pair comes out, and rows are shuffled for grams and pages alone."""
    texts = {k: f"all pages say this and page{k} says words{k} of{k} its{k} own{k}" for k in range(300)}
    words = {k: t.split() for k, t in texts.items()}
    sets = {k: {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} for k, w in words.items()}
    before = written(spark)
    found = content.jaccard_pairs(spark.createDataFrame([("s", k, t) for k, t in texts.items()], "site string, page_id long, main_text string")).collect()
    rows = sum(n for k, n in written(spark).items() if k not in before)
    assert {(r["a"], r["b"]): r["similarity"] for r in found} == plain_pairs(sets) and len(found) == 300 * 299 // 2
    assert 0 < rows < sum(map(len, sets.values())) + 300 * (1 + sharing.BLOCKS) + 1000 < len(found)
