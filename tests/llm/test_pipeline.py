"""The pipeline against plain versions of its stages, and rows that try to hide."""

import re

import pytest

import corpus_pipeline
from auditloom.llm import leaks, quality

DATA = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[\x20\x09-\x0d]+")


def words(t):
    return [w for w in SPLIT.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if w]


def plain(rows, scores, items):
    """Rows (doc_id, text) after the first four stages."""
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.7]
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        best.setdefault(SPLIT.sub("", r[1] or ""), r)
    rows = sorted(best.values())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in (words(t or "") for _, t in rows)]
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    rows = [r for k, r in enumerate(rows) if least[k] == k]
    out = []
    for r in rows:
        own = leaks.words_of(r[1] or "").tolist()
        near = lambda w: any(leaks.edit_distance(w, own[p : p + len(w)], len(w) // 5) <= len(w) // 5 for p in range(len(own)))  # noqa: B023, E731
        # words of an item that leaks are mostly there in the document
        if not any(len(set(w) & set(own)) >= 0.6 * len(set(w)) and near(w) for w in items):
            out.append(r)
    return out


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    weights = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scored = quality.with_scores(docs, weights).collect()
    items = [w for w in (leaks.words_of(r["text"] or "").tolist() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()) if len(w) >= 5]
    want = {r[0] for r in plain([(r["doc_id"], r["text"]) for r in scored], [r["score"] for r in scored], items)}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert len(rows) == len(want) and {r["doc_id"] for r in rows} == want
    assert "doc_id" in rows[0] and "taken" in rows[0]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat doc_ids, have none, or have columns named like inner ones."""
    rows = [(1, "A a a a a a", 0), (2, "A a a a a  a", 1), (2, "B b c d e f g", 2), (2, "B b c d e f g", 3), (None, "C c", 4), (None, "C c", 5), (None, "D", 6), (3, None, 7), (4, "", 8)]
    return spark.createDataFrame([(*r, "x", 0.1, True) for r in rows], "doc_id long, text string, in_file long, source string, score double, leaked boolean")


@pytest.mark.parametrize("stage", [1, 2, 3])
def test_odd_rows(spark, odd, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, odd, DATA)
    assert out.columns == odd.columns and out.limit(0).collect() == []
    kept = sorted(r["in_file"] for r in out.collect())
    if stage == 1:
        assert len(kept) == 5 and {1, 6} <= set(kept) and len({2, 3} & set(kept)) == len({4, 5} & set(kept)) == 1
    elif stage == 2:  # empty texts link with nothing
        assert len(kept) == 6 and {0, 6, 7, 8} <= set(kept) and len({2, 3} & set(kept)) == 1 == len({4, 5} & set(kept))
    else:
        assert kept == list(range(9))
    assert corpus_pipeline.STAGES[stage][1](spark, odd.limit(0), DATA).count() == 0


def test_quality_stage_keeps_columns(spark, odd):
    out = corpus_pipeline.keep_good(spark, odd, DATA)
    assert out.columns == odd.columns and out.count() <= 9
