"""Skeletons by pivots against plain comparisons of all with all."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from auditloom.operators import templates


def differing(a, b):
    return sum(x != y for x, y in itertools.zip_longest(a, b))


def plain(skeletons):
    """(a, b): differing places, of the similar pairs."""
    out = {}
    for (i, a), (j, b) in itertools.combinations(sorted(skeletons.items()), 2):
        d = differing(a, b)
        if d * 10 <= max(len(a), len(b)) * 4:
            out[i, j] = d
    return out


def made(rng, kinds, n, noise):
    """Skeletons of a few layouts, with noise, and of different lengths."""
    layouts = ["".join(rng.choice("WN .,") for _ in range(rng.randint(20, 120))) for _ in range(kinds)]
    found = {}
    while len(found) < n:
        s = "".join(c if rng.random() > noise else rng.choice("WN .,é") for c in rng.choice(layouts))[: rng.randint(15, 120)]
        found[s] = len(found)
    return {k: s for s, k in found.items()}


def linked(pairs, nodes):
    least = {n: n for n in nodes}
    for a, b in pairs:
        x, y = sorted((least[a], least[b]))
        least = {n: x if v == y else v for n, v in least.items()}
    return least


def test_distances():
    rng = random.Random(1)
    for _ in range(100):
        own = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(5)]
        chars, sizes = templates.table(own)
        one, _ = templates.table(["".join(rng.choice("ab") for _ in range(rng.randint(1, 15)))])
        assert templates.distances(one[0], chars).tolist() == [differing("".join(map(chr, one[0])), s) for s in own] and sizes.tolist() == [len(s) for s in own]


@pytest.mark.parametrize("forest", [False, True])
def test_compare_leaves_out_what_pivots_rule_out(forest):
    rng = random.Random(2)
    own = list(made(rng, 12, 300, 0.05).values())
    chars, sizes = templates.table(own)
    dists = np.stack([templates.distances(chars[k], chars) for k in range(templates.PIVOTS)], axis=1)
    every = np.arange(len(own))
    x, y, d, compared = templates.compare(chars, sizes, dists, every, every, True, forest)
    want = plain(dict(enumerate(own)))
    got = dict(zip(zip(x.tolist(), y.tolist(), strict=True), d.tolist(), strict=True))
    square = len(own) * (len(own) - 1) // 2
    if forest:
        assert got.items() <= want.items() and linked(got, every.tolist()) == linked(want, every.tolist())
        assert min(d / max(len(own[a]), len(own[b])) for (a, b), d in got.items()) == min(d / max(len(own[a]), len(own[b])) for (a, b), d in want.items())
        assert compared < square / 10
    else:
        assert got == want and compared < square / 3


@pytest.mark.parametrize("forest", [False, True])
def test_compared(spark, monkeypatch, forest):
    """Sites of one and many layouts over several blocks, and a site of a single skeleton."""
    monkeypatch.setattr(templates, "BLOCK", 6)
    monkeypatch.setattr(templates, "PIVOTS", 3)
    rng = random.Random(3)
    sites = {"one": made(rng, 1, 40, 0.2), "many": made(rng, 8, 60, 0.1), "noise": made(rng, 30, 30, 0.9), "single": {0: "W"}}
    rows = [(s, 1000 * k + i, x) for k, (s, own) in enumerate(sites.items()) for i, x in own.items()]
    df = templates.compared(spark.createDataFrame(rows, "site string, shape long, s string").repartition(3), forest).collect()
    for k, (site, own) in enumerate(sites.items()):
        want = plain(own)
        got = {(r["a"] - 1000 * k, r["b"] - 1000 * k): r["longer"] - r["same"] for r in df if r["site"] == site}
        if forest:
            assert got.items() <= want.items() and linked(got, own) == linked(want, own)
            share = lambda p: p[1] / max(len(own[p[0][0]]), len(own[p[0][1]]))  # noqa: B023, E731
            assert not want or min(map(share, got.items())) == min(map(share, want.items()))
        else:
            assert got == want


def test_far_blocks_never_meet(spark):
    rows = [("s", k, c * 50 + "." * (k % 9)) for k, c in enumerate("WN ," * 9)]
    near = templates.placed(spark.createDataFrame(rows, "site string, shape long, s string"))
    own = near.withColumnRenamed("ball", "block")
    blocks = own.select("block").distinct().count()
    assert templates.block_pairs(own).count() < blocks * (blocks + 1) / 2 and blocks > 2


def test_pivots_go_to_each_part_once(spark, monkeypatch):
    """Rows don't carry their site's pivots, batches stay small, and parts of a site give the distances to the same pivots."""
    monkeypatch.setattr(templates, "PART", 7)
    monkeypatch.setattr(templates, "STEP", 4)
    rng = random.Random(4)
    sites = {"x": list(made(rng, 4, 50, 0.1).values()), "y": list(made(rng, 2, 3, 0.3).values())}
    pivots = {site: own[: templates.PIVOTS] for site, own in sites.items()}
    rows = [(site, part, k, k, s) for site in sites for part in (0, 1) for k, s in enumerate(pivots[site])]
    rows += [(site, k % 2, None, k, s) for site, own in sites.items() for k, s in enumerate(own)]
    rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["site", "part", "rn", "shape", "s"])
    out = list(templates.near_pivots(iter([batch.slice(0, 9), batch.slice(9)])))
    assert max(b.num_rows for b in out) <= 4
    got = {(r["site"], r["shape"]): r for b in out for r in b.to_pylist()}
    assert len(got) == 53
    for (site, k), r in got.items():
        want = [differing(p, sites[site][k]) for p in pivots[site]]
        assert r["dists"] == want and r["ball"] == want.index(min(want))
    shapes = spark.createDataFrame([(site, 100 * len(site) + k, s) for site, own in sites.items() for k, s in enumerate(own)], "site string, shape long, s string")
    near = templates.placed(shapes).collect()
    assert len(near) == 53 and all(0 in {d for r in near if r["site"] == site for d in [r["dists"][k]]} for site in sites for k in range(len(pivots[site])))
