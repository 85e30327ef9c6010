"""Conversation repair, hard negatives and media columns against plain versions, and odd rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from auditloom.llm import conversations, media, negatives

SPACES = "\x20\t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, fault string, audit string, position int"


def got(df):
    return [r.asDict() for r in df.collect()]


def plain_repair(rows):
    """(faults, illegal, cost, audit, repaired) of rows (turn, role, text): every line of edits up to the best cost, by hand."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    layer = {"": (0, "", ())}  # by the last initial that stays: the least (cost, audit, repaired)
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for state, (cost, audit, kept) in list(layer.items()):
                initial = "a" if state == "u" else "u"
                new = (cost + 2, audit + "I", (*kept, ({"u": "user", "a": "assistant"}[initial], "")))
                if initial not in layer or new[:2] < layer[initial][:2]:
                    layer[initial] = new
        if i == len(rows):
            break
        _, role, text = rows[i]
        after = {}

        def offer(state, new, after=after):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, kept) in layer.items():
            offer(state, (cost + 3, audit + "D", kept))
            if faults[i] in ("blank", "duplicate"):
                continue
            more = cost + (faults[i] == "truncated")
            wanted = "a" if state == "u" else "u"
            offer(wanted, (more + 2, audit + "R", (*kept, ({"u": "user", "a": "assistant"}[wanted], text))))
            if role[:1] and (role[0] == wanted or (role[0] == "s" and state == "")):
                offer(role[0], (more, audit + "K", (*kept, (role, text))))
        layer = after
    cost, audit, kept = min((layer[s] for s in ("", "a") if s in layer), key=lambda x: x[:2])
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return faults, illegal, cost, audit, kept


def plain_report(conv, rows):
    space = lambda x: " " if x is None else str(x)
    after = []
    for turn, role, text in rows:
        way = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if way:
            row = (turn, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
            after += [row] * (2 if way == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, illegal, cost, audit, kept = plain_repair(after)
    turns = {t for t, _, _ in after if t is not None}
    body = "\n".join(f"{r}:{t}" for r, t in kept)
    return {"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0} | {n: faults.count(n) for n in ("blank", "duplicate", "truncated")} | {"illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(body.encode()).hexdigest()}


def test_conversations(spark):
    """Random conversations, short and longer than a block, with nulls, odd roles, repeated rows, gaps and very long texts."""
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "ua"], ["Yes.", "No", " \n", None, "", "Why? \t", "So.\n\n", "é!", "x" * 3_000_000 + "."]
    told = {}
    for conv in range(120):
        n = rng.choice((0, 1, 2, 3, 5, 9, 20)) or 1
        told[conv] = [(rng.choice((k, k, k, 2 * k, None, rng.randrange(5))), rng.choice(roles[:3] * 3 + roles), rng.choice(texts[:-1]) if rng.random() < 0.5 else f"{k}{rng.choice('.?x')}") for k in range(n)]
    told[None] = [(k, "user", "Null.") for k in range(4)]
    told[500] = [(k, rng.choice(("user", "assistant", "user", "assistant", "system")), f"{k % 90}.") for k in range(conversations.BLOCK * 3 + 7)]
    told[501] = [(k, ("user", "assistant")[k % 2], f"{k}.") for k in range(conversations.BLOCK * 2)]
    told[502] = [(0, "user", texts[-1]), (1, "assistant", texts[-1]), (2, "assistant", texts[-1] + " ")]
    told[503] = [(3, "user", "same.")] * 40
    rows = [(c, t, r, x, "f", "a", 1) for c, own in told.items() for t, r, x in own]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r["conv_id"]: r for r in got(conversations.conversation_repair(df))}
    assert len(found) == len(told)
    for conv, own in told.items():
        assert found[conv] == plain_report(conv, own)


def test_conversation_rules(spark):
    """Worked by hand, without damage."""
    say = lambda *roles: [(k, r, f"{k}.") for k, r in enumerate(roles)]
    cases = {
        1: (say("user", "assistant"), 0, "KK"),
        2: (say("system", "user", "assistant"), 0, "KKK"),
        3: (say("user"), 2, "KI"),
        4: (say("assistant"), 2, "IK"),
        5: (say("user", "user"), 2, "KR"),
        6: (say("system"), 3, "D"),
        7: ([(0, "user", "a"), (1, "assistant", "b.")], 1, "KK"),
        8: ([(0, "user", "a."), (1, "user", "a."), (2, "assistant", "b.")], 3, "KDK"),
        9: ([(0, "user", " ")], 3, "D"),
        10: (say("user", "assistant", "system", "user", "assistant"), 3, "KKDKK"),
        11: (say("assistant", "user"), 4, "IKKI"),
    }
    rows = [(c, t, r, x, "f", "a", 1) for c, (own, _, _) in cases.items() for t, r, x in own]
    reports, repaired = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in got(reports)} == {c: x[1:] for c, x in cases.items()}
    turns = {}
    for r in sorted(got(repaired), key=lambda r: (r["conv_id"], r["position"])):
        turns.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert turns[3] == [("K", "user", "0."), ("I", "assistant", "")] and turns[5] == [("K", "user", "0."), ("R", "assistant", "1.")]
    assert 6 not in turns and turns[8] == [("K", "user", "a."), ("K", "assistant", "b.")]
    nothing = spark.createDataFrame([], SCHEMA)
    assert got(conversations.conversation_repair(nothing)) == []


def test_search_stops_early_and_agrees_over_blocks(monkeypatch):
    """Blocks of any size give the same line of edits as one search over the whole conversation."""
    rng = random.Random(8)
    for _ in range(200):
        rows = [(rng.choice("uuaas?"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 24))]
        lines = set()
        for size in (1, 3, 7, 100):
            monkeypatch.setattr(conversations, "BLOCK", size)
            search = conversations.Search()
            for r in rows:
                search.add(*r)
            lines.add(search.end())
        assert len(lines) == 1


def plain_negatives(rows):
    """rows (vec_id, embedding, label) to the contract's rows; None ids last."""
    own = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((k, i, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, v, label in own:
        if i is None or i % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), j, other) for m, j, w, other in own if m != k), key=lambda x: (-x[0], last(x[1])))
        for score, j, other in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score][:5]
            out += [(i, j, rank + 1, x[1], score, x[0]) for rank, x in enumerate(fits)]
            del other
    return sorted(out, key=repr)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, id long, norm double, rank int"


@pytest.mark.parametrize("round_bytes", [1, 1 << 24])
def test_negatives(spark, monkeypatch, round_bytes):
    """Random vectors of many norms, ties, copies, a hot vector, nulls, odd components and lengths; one round, and one block a round."""
    monkeypatch.setattr(negatives, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "STEP", 3)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(420):
        v = (rng.standard_normal(8) * rng.choice((0.1, 1.0, 3.0))).tolist()
        rows.append((k * (25 if k % 3 == 0 else 1), v, int(rng.integers(4))))
    rows += [(k, [0.5] * 8, k % 3) for k in range(1000, 1300, 5)]
    rows += [rows[0], rows[0], (7000, None, 1), (7001, [0.1, None], 1), (7002, [float("nan")] * 8, 1), (7003, [float("inf")] * 8, 1), (7004, [1.0] * 8, None), (None, [1.0] * 8, 1), (7100, [], 1), (7200, [0.5, 0.5], 2), (7300, [0.5] * 12, 2), (7400, [-0.5] * 8, 0)]
    df = spark.createDataFrame([(*r, 1, 1.0, 1) for r in rows], EMBEDDINGS).repartition(4)
    found = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got(negatives.hard_negatives(df))), key=repr)
    assert found == plain_negatives(rows)
    assert got(negatives.hard_negatives(df.limit(0))) == [] and got(negatives.hard_negatives(df.where("vec_id % 100 <> 0"))) == []


def test_negatives_of_large_components(spark):
    """Scores beyond what doubles add exactly, and vectors whose scores fit no long."""
    rng = random.Random(9)
    rows = [(k, [float(rng.randrange(-(1 << 20), 1 << 20)) for _ in range(6)], k % 2) for k in range(0, 300, 3)]
    rows += [(1, [1e30], 0), (2, [3e7, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got(negatives.hard_negatives(df))), key=repr)
    assert found == plain_negatives([r for r in rows if r[0] not in (1, 2)]) and found


def test_norms_leave_buckets_out():
    """Buckets below the bound are never scored."""
    rng = np.random.default_rng(1)
    make = lambda scale, first, n: negatives.Block([{"n": n, "width": 4, "rows": np.arange(first, first + n).tobytes(), "ids": np.arange(first, first + n).tobytes(), "labels": np.zeros(n, np.int64).tobytes(), "vectors": (np.abs(rng.standard_normal((n, 4))) * scale + scale).astype(np.int64).tobytes()}])
    anchors, buckets = make(100, 10**6, 3), [make(s, k * 100, 20) for k, s in enumerate((1000, 300, 10, 1))]
    scored = []
    own = negatives.Block.scores
    negatives.Block.scores = lambda self, some, other: scored.append(int(other.rows[0])) or own(self, some, other)
    try:
        negatives.positives_of(anchors, iter(buckets))
    finally:
        negatives.Block.scores = own
    assert 0 in scored and 200 not in scored and 300 not in scored


DOCS = "doc_id long, text string, digest string, media string, item string, n_bytes int"


def test_media_columns(spark):
    """Every text comes back from its picture; odd rows each keep a row."""
    texts = [None, "", "a", "é" * 31 + "a", "x" * 63, "x" * 64, "x" * 65, "<p>a</p>\0", "long text " * 300_000, "a", None]
    rows = [(k if k < 9 else None if k == 9 else 3, t, "d", "m", "i", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    found = got(media.media_columns(df))
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts[:9]):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        stored = f"P5\n# {len(raw)} bytes\n64 {len(padded) // 64}\n255\n".encode() + padded
        r = next(x for x in by[k] if x["n_bytes"] == len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.feature_of(memoryview(padded))
    same = [{k: v for k, v in r.items() if k != "doc_id"} for r in (by[2][0], by[None][0])]
    assert same[0] == same[1] and got(media.media_columns(df.limit(0))) == []


def test_sequences(spark):
    """Order, captions of figures, references by digest and by data, and what isn't text."""
    held = base64.b64encode(b"bytes").decode()
    page = f"""<head><title>T</title><style>p {{}}</style></head><p>One &amp; <b>two</b></p><img src="a.png" alt="An a"><p>Three
      <figure><figcaption>Cap <i>it</i></figcaption><img src="media:{'AB' * 32}" alt="no"><img src='data:image/png;base64,{held}'></figure>four<script>x</script>
      <video src="v.mp4" title="V"></video><img><figure>in a figure<figcaption>alone</figcaption></figure><audio src="data:,x%20y"></audio>"""
    items = media.parsed(page)
    assert [x["position"] for x in items] == list(range(len(items)))
    assert [(x["kind"], x["text"] or x["src"][:6], x["caption"]) for x in items] == [("text", "T", None), ("text", "One & two", None), ("media", "a.png", "An a"), ("text", "Three", None), ("media", "media:", "Cap it"), ("media", "data:i", "Cap it"), ("text", "four", None), ("media", "v.mp4", "V"), ("text", "in a figure", None), ("text", "alone", None), ("media", "data:,", None)]
    assert [x["digest"] for x in items if x["kind"] == "media"] == [None, "ab" * 32, hashlib.sha256(b"bytes").hexdigest(), None, hashlib.sha256(b"x y").hexdigest()]
    assert media.parsed(None) == media.parsed("") == [] and media.digest_of("data:;base64,a") is None
    rows = [(1, page, "c"), (1, None, "c"), (None, "<img src='media:" + "ab" * 32 + "'>", "c")]
    df = media.sequences(spark.createDataFrame(rows, "page_id long, html string, medium string").drop("medium"))
    known = spark.createDataFrame([("ab" * 32, 7)], "digest string, size int")
    out = got(media.aligned(media.resolved(df, known), ["page_id"]))
    by = {r["page_id"]: r["items"] for r in out}
    assert [x["medium"]["size"] if x["medium"] else None for x in by[1]] == [None] * 4 + [7] + [None] * 6
    assert [x["item"]["position"] for x in by[1]] == list(range(11)) and by[None][0]["medium"]["size"] == 7
    with pytest.raises(ValueError):
        media.sequences(spark.createDataFrame([(1, "", "s")], "page_id long, html string, sequence string"))


def test_broken_pictures():
    for bad in (b"", b"P5\n64 1\n255\n" + b"\0" * 64, b"P5\n# 3 bytes\n64 1\n255\n" + b"\0" * 63, b"P5\n# 65 bytes\n64 1\n255\n" + b"\0" * 64):
        with pytest.raises(ValueError):
            media.samples(memoryview(bad))
