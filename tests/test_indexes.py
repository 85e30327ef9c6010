"""Boilerplate and the closest pair by their indexes, against plain comparisons of all with all."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from auditloom.operators import batches, boilerplate, closest, content

WS = r"\s\x0b\xa0  -     　﻿"


def collapsed(t):
    return re.sub(f"[{WS}]+", " ", t)


def plain_main(texts):
    out = []
    for text in texts:
        paras = [p for p in (re.sub(f"^[{WS}]+|[{WS}]+$", "", p) for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", text)) if p]
        others = [collapsed(t) for t in texts if t != text]
        bar = math.ceil(len(others) * 0.6)
        out.append("\n\n".join(p for p in paras if len(texts) == 1 or len(p) < 20 or sum(collapsed(p)[:100] in t for t in others) < bar))
    return out


def made_site(rng, n):
    """Pages with shared paragraphs, some inside others, some only in part, short ones after collapsing, and repeated texts."""
    word = lambda: "".join(rng.choice("abcdé文字") for _ in range(rng.randint(1, 6)))
    say = lambda k: " ".join(word() for _ in range(k))
    menu, foot, long, gap, cjk = say(9), say(12), say(60), "ab" + " " * 30 + "c", "文字" * 15
    texts = []
    for _ in range(n):
        parts = [say(rng.randint(1, 40)) for _ in range(3)]
        for p, share in ((menu, 0.9), (foot, 0.62), (long, 0.7), (gap, 0.8), (cjk, 0.8), (say(3) + " " + menu, 0.4), (long[:70] + say(9), 0.5)):
            if rng.random() < share:
                parts.insert(rng.randrange(len(parts) + 1), p.replace(" ", rng.choice((" ", "  ", "\n")), 1))
        texts.append(rng.choice(("\n\n", "\n \t\n")).join(parts))
        if rng.random() < 0.2:
            texts[-1] = rng.choice(texts)
    return texts


def test_main_content(spark):
    rng = random.Random(2)
    sites = {f"s{k}": made_site(rng, n) for k, n in enumerate((1, 2, 3, 5, 9, 20, 40))} | {"same": ["x\n\n" + "same text on all pages here"] * 4, "empty": ["", "", "a"]}
    rows = [(s, 1000 * k + i, "u", t) for k, (s, ts) in enumerate(sites.items()) for i, t in enumerate(ts)]
    df = boilerplate.main_content(spark.createDataFrame(rows, "site string, page_id long, url string, text string").repartition(3))
    found = {r["page_id"]: r["main_text"] for r in df.collect()}
    want = {1000 * k + i: m for k, ts in enumerate(sites.values()) for i, m in enumerate(plain_main(ts))}
    assert found == want
    assert boilerplate.main_content(spark.createDataFrame([], "site string, page_id long, url string, text string")).collect() == []


def test_anchors_are_shared():
    """Whatever stands before and after, a text has the least gram of each long opening in it as an anchor."""
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("ab ") for _ in range(rng.randint(boilerplate.INDEXED, 100)))
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 50))) + p + "".join(rng.choice("ab ") for _ in range(rng.randint(0, 50)))
        assert int(boilerplate.gram_hashes(p).min()) in boilerplate.anchors(boilerplate.gram_hashes(t))
    assert not len(boilerplate.anchors(boilerplate.gram_hashes("short")))


def test_index_of_a_site_stays_small(spark):
    """Paragraphs of their own leave no entry; the index holds what most pages share."""
    rng = random.Random(4)
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    foot = say(20)
    rows = [("s", k, "u", "\n\n".join([*(say(15) for _ in range(20)), foot])) for k in range(60)]
    pages = spark.createDataFrame(rows, "site string, page_id long, url string, text string")
    own = boilerplate.shared_openings(pages, pages.groupBy("site").agg({"*": "count"}).withColumnRenamed("count(1)", "n_site")).collect()
    assert [r["openings"] for r in own] == [{foot[:100]: 60}]


def plain_closest(sets):
    best = None
    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        if a and b and a & b:
            s = len(a & b) / len(a | b)
            if best is None or s > best[0]:
                best = (s, i, j)
    return best


@pytest.mark.parametrize("small", [False, True])
def test_closest_pairs(spark, monkeypatch, small):
    """Sites of unlike, alike, equal and nested sets; with short lists and with all lists cut into blocks."""
    if small:
        monkeypatch.setattr(closest, "LIST", 2)
        monkeypatch.setattr(closest, "FIRST", 1)
    rng = random.Random(5)
    sites = {}
    for k in range(40):
        pool, hot = range(rng.choice((5, 30, 300))), rng.choice((0, 2, 6))
        sites[f"s{k}"] = {1000 * k + i: set(rng.sample(pool, rng.randint(0, min(len(pool), 25)))) | set(range(10**6, 10**6 + hot)) for i in range(rng.choice((1, 2, 4, 12, 25)))}
    sites["apart"] = {10**6 + i: {i} for i in range(5)}
    sites["nested"] = {10**7 + i: set(range(i + 1)) for i in range(12)}
    rows = [(s, i, sorted(g), str(sorted(g))) for s, own in sites.items() for i, g in own.items()]
    df = closest.closest_pairs(spark.createDataFrame(rows, "site string, page_id long, grams array<long>, digest string").repartition(3))
    found = {r["site"]: (r["similarity"], r["a"], r["b"]) for r in df.collect()}
    assert found == {s: best for s, own in sites.items() if (best := plain_closest(own))}


def test_a_hot_gram_pairs_few_pages(spark):
    """A gram that all pages share, beside rare ones: candidates stay far below all pairs."""
    rng = random.Random(6)
    sets = {i: {-1, -2, *rng.sample(range(3000), 20)} for i in range(400)}
    sets[400] = sets[7] ^ {-1, 5000}
    rows = [("s", i, sorted(g), str(sorted(g)), len(g)) for i, g in sets.items()]
    shared = closest.shared_grams(spark.createDataFrame(rows, "site string, page_id long, grams array<long>, digest string, n int")).cache()
    bounds = closest.first_bounds(shared)
    assert bounds.collect()[0]["bound"] == pytest.approx(len(sets[7] & sets[400]) / len(sets[7] | sets[400]))
    entries = closest.prefixes(shared, bounds)
    assert closest._paired(entries).count() < 100 < math.comb(401, 2)
    shared.unpersist()


def test_best_of_blocks_keeps_one_pair():
    import pandas as pd

    rows = pd.DataFrame({"page_id": [1, 2, 3, 4], "n": [4, 4, 4, 40], "left": [4, 4, 4, 4], "bound": [0.2] * 4, "block": [0, 0, 0, 0], "grams": [np.array(x) for x in ([1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 6], [1, 2, 3, 4])]})
    out = closest.best_of_blocks(("s", 1, 0, 0), rows)
    assert out.values.tolist() == [["s", 1, 2, 0.6]]


def test_duplication_names_the_pair(spark):
    text = lambda k, own: " ".join(f"w{i}" for i in range(k)) + " " + own
    rows = [("a", 1, text(20, "one two three four")), ("a", 2, text(20, "five six")), ("a", 3, "nothing of the kind is said here"), ("b", 4, "only page"), ("c", 5, "x y"), ("c", 6, "x y")]
    found = {r["site"]: r for r in content.duplication(spark.createDataFrame([(s, i, "u", t, t) for s, i, t in rows], "site string, page_id long, url string, text string, main_text string")).collect()}
    assert (found["a"]["page_a"], found["a"]["page_b"], found["a"]["status"]) == (1, 2, "warn")
    assert found["b"]["page_a"] is None and found["c"]["max_similarity"] == 0 and found["c"]["originality_score"] == 100


def test_one_site_spreads_over_tasks(spark, monkeypatch):
    """Texts of one site come out of several tasks, are right, and pieces of a batch stay small."""
    monkeypatch.setattr(boilerplate, "TOGETHER", 5)
    texts = made_site(random.Random(9), 60)
    df = boilerplate.main_content(spark.createDataFrame([("s", k, "u", t) for k, t in enumerate(texts)], "site string, page_id long, url string, text string"))
    rows = df.selectExpr("page_id", "main_text", "spark_partition_id() AS at").collect()
    assert {r["page_id"]: r["main_text"] for r in rows} == dict(enumerate(plain_main(texts))) and len({r["at"] for r in rows}) > 1
    batch = pa.RecordBatch.from_pydict({"site": ["s"] * 6, "text": ["x" * n for n in (3, 3, 9, 1, 1, 1)]})
    assert [b.column(1).to_pylist() for b in batches.pieces([batch], 1, 4)] == [["xxx"], ["xxx"], ["x" * 9], ["x"] * 3] and list(batches.pieces([batch.slice(0, 0)], 1)) == []


def test_only_openings_carry_spots():
    """Anchors of texts are sent as bare numbers; places in openings, of openings alone."""
    body = "".join(random.Random(4).choices("abcdefgh ", k=4000))
    texts = pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([body])], names=["site", "body"])
    found = pa.Table.from_batches(boilerplate._anchors(iter([texts])))
    assert found.column_names == ["site", "gram"] and found.column("gram").to_pylist() == boilerplate.anchors(boilerplate.gram_hashes(body)).tolist()
    probes = pa.RecordBatch.from_arrays([pa.array(["s", "t"]), pa.array([[body[:60], body[:60], "short one of twenty"], []], pa.list_(pa.string()))], names=["site", "probes"])
    spots = pa.Table.from_batches(boilerplate._entries(iter([probes]))).to_pylist()
    hashes = boilerplate.gram_hashes(body[:60])
    want = {("s", int(hashes.min()), int(hashes.argmin()) * boilerplate.LENGTHS + 60), ("s", None, 19)}
    assert {tuple(r.values()) for r in spots} == want and len(spots) == 2
