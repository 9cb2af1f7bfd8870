"""The batch check: findings -> decisions -> verdict -> text, all of it projections.

Texts are scanned in one Arrow function per row batch; what follows is Catalyst expressions over the findings. A null text
has no findings and verdict allow. A budget, which is off unless asked for, is kept inside the Arrow function, because
wall time isn't a deterministic column.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.functions import catalog as C
from textward.functions.scan import FINDING
from textward.operators import columns, registry
from textward.operators.policy import Policy, default

FIELDS = FINDING.fieldNames()
SCANNED = T.StructType([T.StructField("findings", T.ArrayType(FINDING)), T.StructField("skipped", T.ArrayType(T.StringType())), T.StructField("ms", T.MapType(T.StringType(), T.DoubleType()))])


def scan_all(text: str, detectors: Iterable[registry.Detector], left: Callable[[], bool] = lambda: True, clock: Callable[[], float] = time.perf_counter):
    """Findings in order, detectors for which no time was left, milliseconds by detector."""
    found, skipped, ms = [], [], {}
    for d in detectors:
        if not left():
            skipped.append(d.name)
            continue
        began = clock()
        found.extend(d.scan(text))
        ms[d.name] = (clock() - began) * 1000.0
    return sorted(found, key=lambda f: (f[2], f[0], f[1])), skipped, ms


def findings(text: Column, detectors: Iterable[registry.Detector]) -> Column:
    """Findings of a text column, as an array of structs."""
    active = tuple(detectors)

    @F.pandas_udf(T.ArrayType(FINDING))
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [dict(zip(FIELDS, f, strict=True)) for f in scan_all(t, active)[0]])

    return scan(text)


def timed_findings(text: Column, detectors: Iterable[registry.Detector], total_ms: float | None, clock: Callable[[], float] = time.perf_counter) -> Column:
    """Findings, skipped detectors and timings under a budget for each row."""
    active = tuple(detectors)

    @F.pandas_udf(SCANNED)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            began = clock()
            left = lambda began=began: total_ms is None or (clock() - began) * 1000.0 < total_ms
            found, skipped, ms = scan_all(t or "", active, left, clock)
            rows.append({"findings": [dict(zip(FIELDS, f, strict=True)) for f in found], "skipped": skipped, "ms": ms})
        return pd.DataFrame(rows, columns=SCANNED.fieldNames())

    return scan(text)


def detectors(policy: Policy, stage: str) -> list[registry.Detector]:
    return [registry.build(n) for n in policy.detectors_for(stage)]


def holdback(policy: Policy, stage: str) -> int:
    """Characters that a stream of this stage withholds: the longest match of its detectors."""
    return max((d.widest for d in detectors(policy, stage)), default=1)


def guard(df: DataFrame, text: str = "text", policy: Policy | None = None, stage: str = "input", budget: bool = False, only: Iterable[registry.Detector] | None = None, timed: bool = False) -> DataFrame:
    """Adds findings, decisions, verdict, text_out, original_length, budget_exceeded and skipped_detectors.

    ``timed`` adds ms, milliseconds by detector, and elapsed_ms, their sum.
    """
    policy = policy or default()
    active = list(only) if only is not None else detectors(policy, stage)
    t = F.col(text)
    limit = policy.budget.total_ms if budget else None
    if limit is not None or timed:
        out = df.withColumn("_scan", timed_findings(t, active, limit))
        out = out.withColumn("findings", F.col("_scan.findings")).withColumn("skipped_detectors", F.col("_scan.skipped"))
        if timed:
            out = out.withColumn("ms", F.col("_scan.ms")).withColumn("elapsed_ms", F.aggregate(F.map_values("ms"), F.lit(0.0), lambda a, v: a + v))
        out = out.drop("_scan")
    else:
        out = df.withColumn("findings", findings(t, active)).withColumn("skipped_detectors", F.array().cast("array<string>"))
    return resolve(out, text, policy, stage)


def resolve(df: DataFrame, text: str, policy: Policy, stage: str) -> DataFrame:
    """From findings and skipped_detectors on."""
    t, over = F.col(text), F.size("skipped_detectors") > 0
    out = df.withColumn("decisions", columns.decisions(policy, stage, F.col("findings"))).withColumn("budget_exceeded", over)
    out = out.withColumn("_redacted", columns.redacted(t, F.col("findings"), F.col("decisions"), policy.hash_salt))
    closed = policy.budget.on_exceeded == "fail_closed"
    marker = F.struct(
        F.lit("budget").alias("detector"), F.lit("exceeded").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(3).alias("severity"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("budget exhausted; skipped "), F.array_join("skipped_detectors", ", ")).alias("detail"), F.array().cast("array<string>").alias("signals"),
    )
    mark = F.struct(F.lit("__budget__").alias("rule"), F.lit(3 if closed else 1).alias("action"), F.size("findings").alias("finding"), F.lit(f"latency budget exceeded before every detector ran ({policy.budget.on_exceeded})").alias("reason"), F.lit(None).cast("string").alias("redaction"))
    out = out.withColumn("decisions", F.when(over, F.array_append("decisions", mark)).otherwise(F.col("decisions")))
    out = out.withColumn("findings", F.when(over, F.array_append("findings", marker)).otherwise(F.col("findings")))
    said = columns.verdict(F.col("decisions"))
    redacts = F.exists("decisions", lambda d: d["action"] == 2)
    # a replacement that equals what it replaced changes nothing, and is no redaction
    out = out.withColumn("verdict", F.when((said == 2) & redacts & (F.col("_redacted") == t), F.lit(1)).otherwise(said))
    out = out.withColumn("text_out", F.when(F.col("verdict") == 3, F.lit("")).otherwise(F.col("_redacted")))
    return out.withColumn("original_length", F.length(t)).withColumn("stage", F.lit(stage)).withColumn("policy", F.lit(policy.name)).drop("_redacted")


def reasons() -> Column:
    """Why a row was blocked: the rules' reasons, or the labels and rules."""
    blocking = F.filter("decisions", lambda d: d["action"] == 3)
    label = lambda d: F.concat_ws(".", F.get("findings", d["finding"])["detector"], F.get("findings", d["finding"])["kind"])
    return F.transform(blocking, lambda d: F.when(d["reason"] != "", d["reason"]).otherwise(F.concat(label(d), F.lit(" ("), d["rule"], F.lit(")"))))


def result_json(include_text: bool = True, elapsed: bool = False) -> Column:
    """An audit record of a checked row: findings never carry the matched text. ``elapsed`` needs rows checked with ``timed``."""
    found = F.transform(
        "findings",
        lambda f: F.struct(
            f["detector"].alias("detector"), f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"),
            columns.label_of(C.SEVERITIES, f["severity"]).alias("severity"), F.round(f["confidence"], 4).alias("confidence"),
            F.when(f["detail"] != "", f["detail"]).alias("detail"), F.when(F.size(f["signals"]) > 0, f["signals"]).alias("signals"),
        ),
    )
    made = F.transform("decisions", lambda d: F.struct(d["rule"].alias("rule"), columns.label_of(C.ACTIONS, d["action"]).alias("action"), d["finding"].alias("finding"), F.when(d["reason"] != "", d["reason"]).alias("reason")))
    fields = [F.col("stage"), F.col("policy"), columns.label_of(C.ACTIONS, F.col("verdict")).alias("verdict"), F.col("original_length"), found.alias("findings"), made.alias("decisions"), F.col("budget_exceeded"), F.when(F.size("skipped_detectors") > 0, F.col("skipped_detectors")).alias("skipped_detectors")]
    return F.to_json(F.struct(*fields, *([F.round("elapsed_ms", 3).alias("elapsed_ms")] if elapsed else []), *([F.col("text_out").alias("text")] if include_text else [])))
