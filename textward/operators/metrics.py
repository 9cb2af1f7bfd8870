"""Metrics as tables: counters and histograms by aggregation, and their text exposition."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions import catalog as C
from textward.operators import guard
from textward.operators.columns import label_of
from textward.operators.policy import STAGES, Policy

#: Names, kinds and help texts (with the engine's own prefix).
METRICS = {
    "textward_checks_total": ("counter", "Guard checks performed."),
    "textward_findings_total": ("counter", "Findings raised."),
    "textward_check_duration_seconds": ("histogram", "Wall time per guard check."),
    "textward_detector_duration_seconds": ("histogram", "Wall time per detector."),
    "textward_budget_exceeded_total": ("counter", "Checks that ran out of latency budget before every detector had run."),
    "textward_stream_chunks_total": ("counter", "Chunks fed to the streaming guard."),
    "textward_stream_blocks_total": ("counter", "Streams terminated by a block-level finding."),
    "textward_stream_leaks_total": ("counter", "Findings detected only after their text had already been emitted."),
    "textward_schema_repair_attempts_total": ("counter", "Schema repair attempts."),
    "textward_stream_holdback_chars": ("gauge", "Characters the streaming guard withholds, derived from the active detectors."),
}


def checks_total(checked: DataFrame) -> DataFrame:
    return checked.groupBy("stage", label_of(C.ACTIONS, F.col("verdict")).alias("verdict")).agg(F.count(F.lit(1)).alias("value"))


def findings_total(checked: DataFrame) -> DataFrame:
    each = checked.select(F.explode("findings").alias("f"))
    return each.groupBy("f.detector", "f.kind", label_of(C.SEVERITIES, F.col("f.severity")).alias("severity")).agg(F.count(F.lit(1)).alias("value"))


def budget_exceeded_total(checked: DataFrame) -> DataFrame:
    return checked.groupBy("stage").agg(F.count_if("budget_exceeded").alias("value")).where("value > 0")


def repair_outcomes_total(repairs: DataFrame, column: str = "repair") -> DataFrame:
    """Repairs by outcome: clean, repaired or failed."""
    return repairs.groupBy(F.col(column)["outcome"].alias("outcome")).agg(F.count(F.lit(1)).alias("value"))


def stream_totals(streams: DataFrame) -> DataFrame:
    """(metric, value): chunks, blocked streams and leaks of a table of replayed streams."""
    sums = streams.agg(F.sum("chunks").alias("chunks"), F.count_if("blocked").alias("blocks"), F.sum("leaks").alias("leaks"))
    each = [F.struct(F.lit(f"textward_stream_{n}_total").alias("metric"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("value")) for n in ("chunks", "blocks", "leaks")]
    return sums.select(F.inline(F.array(*each)))


def holdback_gauge(spark: SparkSession, policy: Policy) -> DataFrame:
    """(stage, value): characters that a stream of each stage withholds."""
    return spark.createDataFrame([(s, guard.holdback(policy, s)) for s in STAGES], "stage string, value long")


def detector_durations(timed: DataFrame) -> DataFrame:
    """The histogram of seconds by detector of rows that were checked with ``timed``."""
    return histogram(timed.select(F.explode("ms").alias("detector", "value")), F.col("value") / 1000, ["detector"])


def check_durations(timed: DataFrame) -> DataFrame:
    """The histogram of seconds by stage of rows that were checked with ``timed``."""
    return histogram(timed, F.col("elapsed_ms") / 1000, ["stage"])


def histogram(df: DataFrame, value: Column, labels: Iterable[str] = (), buckets: tuple[float, ...] = C.BUCKETS) -> DataFrame:
    """Cumulative bucket counts b0, b1, ..., with sum and count, by labels: one pass, partial sums before the shuffle."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    return df.groupBy(*labels).agg(*counts, F.sum(value).alias("sum"), F.count(value).alias("count"))


def quantile(hist: DataFrame, q: float, buckets: tuple[float, ...] = C.BUCKETS) -> Column:
    """The first bound whose cumulative count reaches q of all: a bound, not an interpolation. NaN if empty."""
    steps = F.array(*[F.struct(F.col(f"b{i}").alias("n"), F.lit(float(b)).alias("bound")) for i, b in enumerate(buckets)])
    reached = F.filter(steps, lambda s: s["n"] >= F.col("count") * q)
    return F.when(F.col("count") == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.get(reached, F.lit(0))["bound"], F.lit(float("inf"))))


def _label(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _labels(names: list[str], *extra: Column) -> Column:
    parts = [F.concat(F.lit(f'{n}="'), _label(F.col(n).cast("string")), F.lit('"')) for n in names]
    parts += list(extra)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("")


def _number(value: Column) -> Column:
    plain = value.cast("double")
    return F.when(plain == F.floor(plain), F.floor(plain).cast("string")).otherwise(plain.cast("string"))


def sample_lines(name: str, df: DataFrame, labels: list[str]) -> DataFrame:
    """(metric, rank, line) of a counter's or gauge's series."""
    line = F.concat(F.lit(name), _labels(labels), F.lit(" "), _number(F.col("value")))
    return df.select(F.lit(name).alias("metric"), F.concat_ws("\x01", *labels, F.lit("")).alias("rank"), line.alias("line"))


def histogram_lines(name: str, hist: DataFrame, labels: list[str], buckets: tuple[float, ...] = C.BUCKETS) -> DataFrame:
    out = []
    for i, b in enumerate(buckets):
        out.append((f"{i:03d}", "_bucket", [F.lit(f'le="{b:g}"')], F.col(f"b{i}")))
    out += [("900", "_bucket", [F.lit('le="+Inf"')], F.col("count")), ("901", "_sum", [], F.col("sum")), ("902", "_count", [], F.col("count"))]
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit(name + end), _labels(labels, *more), F.lit(" "), _number(v)).alias("line")) for k, end, more, v in out])
    each = hist.select(*labels, F.explode(rows).alias("r"))
    return each.select(F.lit(name).alias("metric"), F.concat_ws("\x01", *labels, F.col("r.k")).alias("rank"), F.col("r.line").alias("line"))


def exposition(lines: DataFrame) -> DataFrame:
    """One row, ``text``: all series sorted by metric and labels, with their HELP and TYPE. Series are few by design."""
    heads = lines.sparkSession.createDataFrame([(m, "", f"# HELP {m} {h}\n# TYPE {m} {k}") for m, (k, h) in METRICS.items()], "metric string, rank string, line string")
    used = heads.join(lines.select("metric").distinct(), "metric", "left_semi")
    every = F.array_sort(F.collect_list(F.struct("metric", "rank", "line")))
    return used.union(lines).agg(F.concat(F.array_join(F.transform(every, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


class Tally:
    """Counters of one driver, for what isn't a table: each name is declared once, with its labels."""

    def __init__(self) -> None:
        self._labels: dict[str, tuple[str, ...]] = {}
        self._values: dict[tuple[str, tuple[str, ...]], float] = {}

    def declare(self, name: str, *labels: str) -> str:
        """The name; declaring it again with the same labels is fine, with others it is not."""
        if self._labels.setdefault(name, labels) != labels:
            raise ValueError(f"{name} is declared with labels {self._labels[name]}, not {labels}")
        return name

    def _at(self, name: str, values: tuple) -> tuple[str, tuple[str, ...]]:
        if len(values) != len(self._labels[name]):
            raise ValueError(f"{name} takes {len(self._labels[name])} label(s), got {len(values)}")
        return name, tuple(map(str, values))

    def add(self, name: str, *values: str, amount: float = 1.0) -> None:
        at = self._at(name, values)
        self._values[at] = self.value(name, *values) + amount

    def value(self, name: str, *values: str) -> float:
        return self._values.get(self._at(name, values), 0.0)

    def lines(self, spark: SparkSession) -> DataFrame:
        """The series as ``exposition`` takes them."""
        out = None
        for name, labels in sorted(self._labels.items()):
            rows = [(*values, v) for (n, values), v in self._values.items() if n == name] or ([(0.0,)] if not labels else [])
            schema = "".join(f"`{x}` string, " for x in labels) + "value double"
            each = sample_lines(name, spark.createDataFrame(rows, schema), list(labels))
            out = each if out is None else out.union(each)
        return out if out is not None else spark.createDataFrame([], "metric string, rank string, line string")
