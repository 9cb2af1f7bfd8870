"""Column forms of validators, rule resolution and redaction: everything that Catalyst can plan without Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions import catalog as C
from textward.functions.scan import FINDING
from textward.operators.policy import Policy

FINDINGS = f"array<{FINDING.simpleString()}>"
_DIGIT = "[0-9]"


def label_of(names: tuple[str, ...], ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), ordinal + 1)


# ---------------------------------------------------------------- validators


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.coalesce(digits.rlike("^[0-9]{12,}$") & (F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0), F.lit(False))


def card_brand(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & reduce(lambda a, b: a | b, [digits.startswith(p) for p in C.CARD_PREFIXES])


def iban(value: Column) -> Column:
    moved = F.upper(F.concat(F.substr(value, F.lit(5)), F.left(value, F.lit(4))))
    step = lambda a, c: F.when(c.rlike(_DIGIT), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return moved.rlike("^[A-Z0-9]+$") & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def ssn(area: Column, group: Column, serial: Column) -> Column:
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def ipv4(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (p.cast("int") < 256) & ((p == "0") | ~p.startswith("0")))


def jwt(token: Column) -> Column:
    head = F.translate(F.split(token, r"\.")[0], "-_", "+/")
    size = (F.ceil(F.length(head) / 4) * 4).cast("int")
    shown = F.try_to_binary(F.rpad(head, size, "="), F.lit("base64")).cast("string")
    return F.coalesce(F.array_contains(F.json_object_keys(shown), "alg"), F.lit(False))


def fold_ascii(text: Column) -> Column:
    """The folded form of a text that is all ASCII; null for others, which need the Arrow lane."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text))


def strip_invisible(text: Column) -> Column:
    return F.translate(text, C.INVISIBLE, "")


def total_weight(names: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for n, v in C.SIGNALS.items() for x in (n, v[0])], F.lit(C.OBFUSCATED), F.lit(C.OBFUSCATED_WEIGHT))
    return F.round(F.aggregate(F.array_distinct(names), F.lit(0.0), lambda a, n: a + F.coalesce(F.element_at(weights, n), F.lit(0.0))), 3)


def severity_of(total: Column) -> Column:
    return reduce(lambda rest, s: F.when(total >= s[0], s[1]).otherwise(rest), reversed(C.SEVERITY_STEPS), F.lit(0))


def confidence_of(total: Column) -> Column:
    return F.least(F.lit(0.99), F.round(total / 5.0, 3))


# ---------------------------------------------------------------- rules

DECISION = "struct<rule:string,action:int,finding:int,reason:string,redaction:string>"


def governing_rule(policy: Policy, stage: str, f: Column) -> Column:
    """The decision for a finding, without its index; null if no rule matches. Rules are literals: no join, no shuffle."""
    out = F.lit(None).cast("struct<rule:string,action:int,reason:string,redaction:string>")
    for r in reversed(policy.ranked(stage)):
        test = (f["severity"] >= r.min_severity) & (f["confidence"] >= r.min_confidence)
        if r.detect != "*":
            head, dot, kind = r.detect.partition(".")
            test = test & (f["detector"] == head) & ((f["kind"] == kind) if dot else F.lit(True))
        redaction = policy.redaction_for(r) if C.ACTIONS[r.action] == "redact" else None
        out = F.when(test, F.struct(F.lit(r.id).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.reason).alias("reason"), F.lit(redaction).cast("string").alias("redaction"))).otherwise(out)
    return out


def decisions(policy: Policy, stage: str, findings: Column) -> Column:
    """Decisions in the findings' order; findings that no rule matches have none."""
    each = F.transform(findings, lambda f, i: F.struct(i.alias("finding"), governing_rule(policy, stage, f).alias("r")))
    matched = F.filter(each, lambda x: x["r"].isNotNull())
    return F.transform(matched, lambda x: F.struct(x["r"]["rule"].alias("rule"), x["r"]["action"].alias("action"), x["finding"].alias("finding"), x["r"]["reason"].alias("reason"), x["r"]["redaction"].alias("redaction")))


def verdict(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda d: d["action"])), F.lit(0))


# ---------------------------------------------------------------- redaction


def placeholder(strategy: Column, kind: Column, matched: Column, salt: str) -> Column:
    token = F.upper(kind)
    masked = lambda x: F.regexp_replace(x, r"[\p{L}\p{N}]", "*")
    n = F.length(matched)
    partial = F.when(n > 4, F.concat(masked(F.substr(matched, F.lit(1), n - 4)), F.right(matched, F.lit(4)))).otherwise(masked(F.left(matched, F.greatest(n - 4, F.lit(0)))))
    # three and fewer characters count from the end, as slices do
    partial = F.when(n < 4, masked(F.left(matched, F.greatest(2 * n - 4, F.lit(0))))).otherwise(partial)
    digest = F.substr(F.sha2(F.concat(F.lit(salt), matched).cast("binary"), 256), F.lit(1), F.lit(12))
    return (
        F.when(strategy == "label", F.concat(F.lit("["), token, F.lit("]")))
        .when(strategy == "remove", F.lit(""))
        .when(strategy == "mask", masked(matched))
        .when(strategy == "partial", partial)
        .when(strategy == "hash", F.concat(F.lit("["), token, F.lit(":"), digest, F.lit("]")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown redaction strategy: "), F.coalesce(strategy, F.lit("none")))))
    )


def surviving(findings: Column, element: str) -> Column:
    """Of overlapping spans the most severe, then surest, longest and first; what stays is sorted by start."""
    rank = lambda f: F.struct(-f["severity"], -f["confidence"], f["start"] - f["end"], f["start"], f["kind"], f.alias("f"))
    ordered = F.array_sort(F.transform(findings, rank))
    clear = lambda kept, f: ~F.exists(kept, lambda k: (k["start"] < f["end"]) & (f["start"] < k["end"]))
    kept = F.aggregate(ordered, F.array().cast(f"array<{element}>"), lambda acc, x: F.when(clear(acc, x["f"]), F.array_append(acc, x["f"])).otherwise(acc))
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


SPAN = "struct<start:int,end:int,severity:int,confidence:double,kind:string,redaction:string>"


def redacted(text: Column, findings: Column, found: Column, salt: str = "") -> Column:
    """The text with the findings of redacting decisions replaced."""
    redact = F.filter(found, lambda d: d["action"] == C.ACTIONS.index("redact"))

    def span(d: Column) -> Column:
        f = F.get(findings, d["finding"])
        return F.struct(*[f[c].alias(c) for c in ("start", "end", "severity", "confidence", "kind")], d["redaction"].alias("redaction"))

    spans = F.array_distinct(F.transform(redact, span))
    parts = surviving(spans, SPAN)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, f: Column) -> Column:
        before = F.substr(text, acc["at"] + 1, f["start"] - acc["at"])
        matched = F.substr(text, f["start"] + 1, f["end"] - f["start"])
        return F.struct(F.concat(acc["out"], before, placeholder(f["redaction"], f["kind"], matched, salt)).alias("out"), f["end"].alias("at"))

    done = F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(parts) > 0, done).otherwise(text)
