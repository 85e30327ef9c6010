"""Saved reports, the batch scorer and phases: what is written, what is lost, what is asked."""

import hashlib
import json
import os
import sys

import pytest
from pyspark import cloudpickle

from auditloom.operators import details, replies, report, scorer, timing
from auditloom.sources import reports

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file

HEADS = "site string, vot double, cap long, n_pages long, type string"
ITEMS = "site string, item string, bucket string, status string"
PAGES = "site string, page_id long, title string, page_type string"


def made(spark):
    heads = spark.createDataFrame([("a.example", 61.5, 100, 2, "content"), ("B c/d", None, None, 0, None), ("e.example", 10.0, 50, 1, "game")], HEADS)
    items = spark.createDataFrame([("a.example", f"i{k}", "HCUL"[k % 4], ("pass", "warn", "fail")[k % 3]) for k in range(9)] + [("e.example", "x", "H", "fail")], ITEMS)
    pages = spark.createDataFrame([("a.example", 2, 'quote " and \\ and é\n', "content"), ("a.example", 1, None, "homepage")], PAGES)
    return heads, items, pages


def test_round_trip(spark, tmp_path):
    heads, items, pages = made(spark)
    reports.write_site_reports(reports.rows_of(heads, items, pages), str(tmp_path), "s1")
    names = sorted(os.listdir(tmp_path))
    assert names == sorted(["a.example-s1.json", "e.example-s1.json", f"site__c_d-{hashlib.sha256(b'B c/d').hexdigest()[:12]}-s1.json"])
    whole = json.loads((tmp_path / "a.example-s1.json").read_text())
    assert [p["page_id"] for p in whole["pages"]] == [1, 2] and len(whole["items"]) == 9 and whole["report"]["vot"] == 61.5
    found, broken = reports.read_site_reports(spark, str(tmp_path))
    assert broken.count() == 0 and {tuple(r) for r in reports.saved_heads(found).select("site", "vot", "cap", "n_pages", "type").collect()} == {tuple(r) for r in heads.collect()}
    assert {tuple(r) for r in reports.saved_items(found).collect()} == {tuple(r) for r in items.collect()}
    again = report.site_report(reports.saved_items(found), reports.saved_heads(found).select("site", "vot", "cap")).collect()
    assert sorted(map(str, again)) == sorted(map(str, report.site_report(items, heads.select("site", "vot", "cap")).collect()))
    assert next(r for r in found.collect() if r["site"] == "a.example")["pages"][1]["title"] == 'quote " and \\ and é\n'


def test_broken_files_are_told(spark, tmp_path):
    heads, items, pages = made(spark)
    reports.write_site_reports(reports.rows_of(heads, items, pages), str(tmp_path), "s1")
    bad = {"cut.json": '{"site": "x", "items": [', "other.json": '{"x": 1}', "list.json": '[{"site": 1', "types.json": '{"site": "y", "items": 3}'}
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "notes.txt").write_text("no report")
    found, broken = reports.read_site_reports(spark, str(tmp_path))
    assert found.count() == 3 and {r["file_name"] for r in broken.collect()} == set(bad)


def test_a_lost_task_leaves_nothing(tmp_path):
    writer = reports.SiteReportWriter(str(tmp_path), "s")
    row = lambda site, part, body: {"site": site, "part": part, "ordinal": 0, "body": body}

    def lost():
        yield row("a", 0, "{}")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(lost())
    again = writer.write(iter([row("a", 0, "{}"), row("b", 2, '{"page_id": 1}')]))
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".json")]
    writer.commit([again, None])
    assert sorted(os.listdir(tmp_path)) == ["a-s.json", "b-s.json"]
    assert json.loads((tmp_path / "a-s.json").read_text()) == {"site": "a", "report": {}, "items": [], "pages": []}
    assert json.loads((tmp_path / "b-s.json").read_text()) == {"site": "b", "items": [], "pages": [{"page_id": 1}]}
    other = reports.SiteReportWriter(str(tmp_path), "t")
    other.write(iter([row("a", 0, "{}")]))
    other.abort([])
    assert sorted(os.listdir(tmp_path)) == ["a-s.json", "b-s.json"]


class Counting:
    """Notes each question in a file of its own folder; fails as told."""

    def __init__(self, folder, fail=()):
        self.folder, self.fail = str(folder), fail

    def __call__(self, prompt):
        at = f"{self.folder}/{hashlib.md5(prompt.encode()).hexdigest()}"
        with open(at, "a") as f:
            f.write("x")
        if prompt in self.fail and os.path.getsize(at) < 3:
            raise TimeoutError("slow")
        if prompt == "never":
            raise ValueError("no")
        return "" if prompt == "silent" else f"re {prompt}"


def test_scorer_asks_once(spark, tmp_path):
    asked, kept = tmp_path / "asked", tmp_path / "kept"
    asked.mkdir()
    prompts = [f"p{k}" for k in range(23)] + ["never", "silent", "p3"]
    df = spark.createDataFrame([("s", k, p) for k, p in enumerate(prompts)], "site string, page_id long, prompt string")
    model = Counting(asked, fail=("p7",))
    run = lambda: {r["page_id"]: (r["response"], r["error"], r["attempts"]) for r in scorer.replies(df, model, str(kept), wait=0.0).collect()}
    first = run()
    assert len(first) == len(prompts) and first[0] == ("re p0", None, 1) and first[7] == ("re p7", None, 3)
    assert first[23] == (None, "ValueError: no", 3) and first[24] == ("", None, 1)
    count = lambda p: os.path.getsize(asked / hashlib.md5(p.encode()).hexdigest())
    before = {p: count(p) for p in prompts}
    assert run() == first  # as after a lost task: answered ones come from the folder, the failure is asked again
    assert {p: count(p) for p in prompts if p != "never"} == {p: n for p, n in before.items() if p != "never"} and count("never") == 6


def test_waits_double(monkeypatch):
    waited = []
    monkeypatch.setattr(scorer.time, "sleep", waited.append)
    assert scorer.ask("p", lambda p: 1 / 0, attempts=4, wait=1.0) == {"response": None, "error": "ZeroDivisionError: division by zero", "attempts": 4}
    assert waited == [1.0, 2.0, 4.0]


def test_phases(spark):
    phases = timing.Phases()
    phases.stored(spark.range(7).where("id > 2"), "some")
    phases.stored(spark.range(0), "none")
    rows = phases.report(spark).collect()
    assert [(r["phase"], r["position"], r["n_rows"]) for r in rows] == [("some", 1, 4), ("none", 2, 0)] and all(r["seconds"] > 0 for r in rows) and abs(sum(r["percent"] for r in rows) - 100) < 0.2


def test_records_with_replies(spark):
    own = spark.createDataFrame([("s", 1, "pass"), ("s", 2, "warn")], "site string, page_id long, display_status string")
    reply = '{"evaluation_details": {"value": 8, "value_reason": "deep"}, "assessment": "fine", "suggestions": ["a", "b"]}'
    parsed = replies.parse_replies(spark.createDataFrame([(1, "fr", reply)], "reply_id long, lang string, response string")).withColumnRenamed("reply_id", "page_id")
    got = {r["page_id"]: r for r in details.with_replies(own, parsed).collect()}
    assert (got[1]["value"], got[1]["value_reason"], got[1]["assessment"], got[1]["suggestions"]) == (8, "deep", "fine", ["a", "b"])
    assert got[2]["value"] is None and got[2]["suggestions"] == []
