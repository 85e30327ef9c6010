"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans are those of four strict patterns and of looser ones (written-out
addresses, national phone numbers, identity numbers). Five labelers vote on each
candidate: its pattern, a gazetteer, the words before it, its borders and its digits.
Expectation-maximisation over the counts of vote patterns (at most 3**5 per kind)
estimates how reliable each labeler is; a logistic span classifier is then fitted to
the posteriors over the same bounded table, and every loose candidate it accepts is
added. Spans of the strict patterns always stay.

Results in special cases: a null text counts as empty and has no spans; repeated rows
each give a row; an empty table gives an empty one; columns other than doc_id and text
are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Kinds in the order in which spans that start together are listed; the first four are strict.
KINDS = ("email", "ip", "card", "phone", "written_email", "local_phone", "identity")

# The rewritten patterns match what the plain ones do, without retrying inside a run that failed.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "written_email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?{_LABEL}{{1,64}}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?{_LABEL}{{1,64}}){{1,4}}",
    "local_phone": r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "identity": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
}
#: A plain test that every text with a match passes.
GUARDS = {"email": "@", "ip": ".", "phone": "+", "identity": "-"}
LONG_NUMBER = r"[0-9](?:[\x20-]?[0-9]){13}"
BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
CONTEXT = r"(?i)(?:mail|contact|phone|call|tel|mobile|fax|card|visa|credit|ip|host|server|ssn|social|identity|write)[^A-Za-z]*$"
GAZETTEER = r"(?i)(?:\.|dot\)?\]?\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
LABELERS = 5
#: Code points looked at before a span, and the least probability at which a loose candidate is added.
BEFORE, ACCEPT, ROUNDS = 24, 0.5, 25


def luhn(number: Column) -> Column:
    """Whether a text of 14 to 19 digits has a right check digit."""
    digits = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.element_at(digits, i).cast("int")).otherwise(
            F.element_at(digits, i).cast("int") * 2 - F.when(F.element_at(digits, i).cast("int") > 4, F.lit(9)).otherwise(F.lit(0))
        ),
    )
    return total % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def votes(kind: str, found: Column, before: Column, after: Column) -> Column:
    """The labelers' votes as digits 0 (against), 1 (abstains), 2 (for), one per labeler."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    strict = kind in KINDS[:4]
    pattern = F.lit("2" if strict else "1")
    if "email" in kind:
        gazetteer = F.when(found.rlike(GAZETTEER), "2").otherwise("0")
    elif kind == "ip":
        gazetteer = F.when(found.rlike(r"^(?:0|127|255)\."), "0").otherwise("2")
    elif kind == "card":
        gazetteer = F.when(found.rlike("^[3-6]"), "2").otherwise("0")
    elif kind == "identity":
        gazetteer = F.when(found.rlike("^(?:000|666|9)"), "0").otherwise("2")
    else:
        gazetteer = F.when(digits.rlike("(?:^|[2-9])[2-9][0-9]{9}$|^[0-9]{11,}$"), "2").otherwise("0")
    context = F.when(before.rlike(CONTEXT), "2").otherwise("1")
    border = F.when(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"), "0").otherwise("2")
    if "email" in kind:
        shape = F.when(found.rlike("[A-Za-z]"), "2").otherwise("0")
    else:
        shape = F.when(F.size(F.array_distinct(F.split(digits, ""))) >= 3, "2").otherwise("0")
    return F.concat(pattern, gazetteer, context, border, shape)


def _placed(k: int, kind: str) -> Column:
    """The kind's matches that count, as (start, kind, label, end, votes, holds), from its columns of matches and of the pieces between."""
    found, pieces = F.col(f"m_{kind}"), F.col(f"p_{kind}")

    # a match starts where all pieces and matches before it end
    def after_it(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(pieces, i)).cast("long")
        end = start + F.length(F.element_at(found, i))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    def described(start: Column, i: Column) -> Column:
        own = F.element_at(found, i + 1)
        before, after = F.right(F.element_at(pieces, i + 1), F.lit(BEFORE)), F.left(F.element_at(pieces, i + 2), F.lit(1))
        end = start + F.length(own)
        return F.struct(
            start.alias("start"),
            F.lit(k).alias("kind"),
            F.concat_ws(":", F.lit(kind), start.cast("string"), end.cast("string")).alias("label"),
            end.cast("long").alias("end"),
            votes(kind, own, before, after).alias("votes"),
            holds(kind, own).alias("holds"),
        )

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    starts = F.aggregate(F.sequence(F.lit(1), F.size(found)), none, after_it)["out"]
    return F.filter(F.transform(starts, described), lambda x: x["holds"])


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and an array of (start, kind, label, strict, votes), strict ones checked."""
    text = F.col("text")
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    for kind in KINDS:
        if kind in GUARDS:
            may = text.contains(GUARDS[kind])
        elif kind == "written_email":
            may = text.rlike(r"(?:\(at\)|\[at\]|\x20at\x20)") & text.rlike(r"(?:\(dot\)|\[dot\]|\x20dot\x20)")
        elif kind == "card":
            may = text.rlike(LONG_NUMBER)
        else:
            may = text.rlike("[0-9]{3}")
        none = F.array().cast("array<string>")
        df = df.withColumn(f"m_{kind}", F.when(may, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none))
    for kind in KINDS:
        df = df.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", PATTERNS[kind], -1)))
    parts = [F.when(F.size(f"m_{kind}") > 0, _placed(k, kind)) for k, kind in enumerate(KINDS)]
    empty = F.array().cast("array<struct<start:bigint,kind:int,label:string,end:bigint,votes:string,holds:boolean>>")
    return df.select("doc_id", F.concat(*(F.coalesce(p, empty) for p in parts)).alias("spans"))


def reliabilities(counts: dict[str, int]) -> tuple[float, list[list[float]], dict[str, float]]:
    """EM for labelers that vote independently given the truth: prior, P(vote | truth), posterior per vote pattern."""
    posterior = {v: min(0.99, max(0.01, (v.count("2") + 0.5 * v.count("1")) / len(v))) for v in counts}
    prior, table = 0.5, []
    for _ in range(ROUNDS):
        total = sum(counts.values())
        mass = [sum(n * posterior[v] for v, n in counts.items()), sum(n * (1 - posterior[v]) for v, n in counts.items())]
        prior = (mass[0] + 1) / (total + 2)
        table = [[0.0] * 6 for _ in range(LABELERS)]
        for j in range(LABELERS):
            for c in range(3):
                # the pseudo-counts lean to votes that are right more often than wrong
                table[j][c] = (sum(n * posterior[v] for v, n in counts.items() if v[j] == str(c)) + (0.5, 1.0, 1.5)[c]) / (mass[0] + 3)
                table[j][3 + c] = (sum(n * (1 - posterior[v]) for v, n in counts.items() if v[j] == str(c)) + (1.5, 1.0, 0.5)[c]) / (mass[1] + 3)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][int(v[j])] / table[j][3 + int(v[j])]) for j in range(LABELERS))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, table, posterior


def classifier(counts: dict[str, int], posterior: dict[str, float]) -> list[float]:
    """Weights of a logistic model (bias first) of the votes, fitted to the posteriors by gradient steps."""
    weights, total = [0.0] * (LABELERS + 1), max(1, sum(counts.values()))
    for _ in range(400):
        slope = [0.0] * len(weights)
        for v, n in counts.items():
            x = [1.0, *(int(c) - 1.0 for c in v)]
            miss = posterior[v] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True))))
            for i, xi in enumerate(x):
                slope[i] += n * miss * xi
        weights = [w + 0.5 * (g / total - 1e-3 * w) for w, g in zip(weights, slope, strict=True)]
    return weights


def personal_data(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the strict spans, and all spans."""
    found = materialise(candidates(documents), "personal")
    # bounded: at most 3**5 vote patterns for each kind
    table = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    accepted = []
    for k in range(len(KINDS)):
        counts = {r["votes"]: r["count"] for r in table if r["kind"] == k}
        if k < 4 or not counts:
            continue
        # kinds of one sort share reliabilities: the strict spans of that sort are votes too
        sort = {"written_email": ("email",), "local_phone": ("phone",), "identity": ("card",)}[KINDS[k]]
        for r in table:
            if KINDS[r["kind"]] in sort:
                counts[r["votes"]] = counts.get(r["votes"], 0) + r["count"]
        _, _, posterior = reliabilities(counts)
        weights = classifier(counts, posterior)
        for v in {r["votes"] for r in table if r["kind"] == k}:
            if 1 / (1 + math.exp(-sum(w * x for w, x in zip(weights, [1.0, *(int(c) - 1.0 for c in v)], strict=True)))) >= ACCEPT:
                accepted.append(f"{k}:{v}")
    strict = F.filter("spans", lambda s: s["kind"] < 4)
    loose = F.filter("spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), s["votes"]).isin(accepted) if accepted else F.lit(False))
    found = found.select("doc_id", F.array_sort(strict).alias("strict"), loose.alias("loose"))
    # a loose span that a strict one already covers adds nothing
    free = F.filter("loose", lambda a: ~F.exists("strict", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["label"]), ",")
    number = lambda k: F.size(F.filter("strict", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])),
        F.sha2(joined("strict"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("strict", free))).alias("spans"),
    )
