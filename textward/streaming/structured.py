"""Structured Streaming: chunks (stream_id, seq, chunk, is_last) through the stream filter, with state by stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textward.operators.policy import Policy, default
from textward.streaming.window import State, StreamFilter

OUT = "stream_id string, seq int, text string, event string, verdict int"


def chunked(df: DataFrame, size: int, key: str = "stream_id", text: str = "text") -> DataFrame:
    """Fixed-size chunks of texts: stream_id, seq, chunk, is_last. An empty text is one empty, last chunk."""
    if size < 1:
        raise ValueError("the chunk size must be positive")
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    each = df.select(F.col(key).cast("string").alias("stream_id"), F.col(text).alias("_t"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return each.select("stream_id", "seq", F.substr("_t", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("is_last"))


def _advance(flt: StreamFilter, waiting: dict[int, tuple[str, bool]], want: int) -> tuple[list[tuple], int]:
    """Feeds the chunks that are next in order; (rows, the seq that is wanted now)."""
    rows = []
    while want in waiting and not flt.state.closed:
        chunk, last = waiting.pop(want)
        out = flt.feed(chunk)
        if last:
            out += flt.close()
        if out:
            rows.append((want, out, "text"))
        if flt.state.blocked:
            rows.append((want, "", "blocked"))
            flt.state.closed = True
        elif last:
            rows.append((want, "", "closed"))
        want += 1
    return rows, want


def filtered(chunks: DataFrame, policy: Policy | None = None, stage: str = "output", idle_ms: int = 600_000) -> DataFrame:
    """A streaming table of chunks -> rows of (stream_id, seq, text, event, verdict).

    Chunks may come out of order within a stream: they wait for their turn. A stream that stays idle for ``idle_ms`` of
    processing time is closed and its tail goes out. Chunks that come after the end give ``late`` rows.
    """
    policy = policy or default()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"state": None, "waiting": {}, "want": 0}
        flt = StreamFilter(policy, stage, State.load(kept["state"]))
        waiting = {int(k): (v[0], v[1]) for k, v in kept["waiting"].items()}
        want, rows = kept["want"], []
        if state.hasTimedOut:
            if not flt.state.closed:
                for seq in sorted(waiting):
                    out = flt.feed(waiting[seq][0])
                    rows += [(seq, out, "text")] if out else []
                tail = flt.close()
                rows += ([(want, tail, "text")] if tail else []) + [(want, "", "expired")]
            state.remove()
        else:
            for pdf in batches:
                for seq, chunk, last in zip(pdf["seq"], pdf["chunk"], pdf["is_last"], strict=True):
                    if flt.state.closed or seq < want:
                        rows.append((int(seq), "", "late"))
                    else:
                        waiting[int(seq)] = (chunk or "", bool(last))
            more, want = _advance(flt, waiting, want)
            rows += more
            state.update((json.dumps({"state": flt.state.dump(), "waiting": waiting, "want": want}),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *r, flt.verdict()) for r in rows], columns=["stream_id", "seq", "text", "event", "verdict"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, "kept string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replayed(chunks: DataFrame, policy: Policy | None = None, stage: str = "output", stride: int = 1024) -> DataFrame:
    """The same filter over a finished table of chunks, a stream at a time in order of seq.

    stream_id, text, verdict, blocked, emitted, leaks, n_findings, chunks. Rows are sorted by stream within partitions, and state
    lives for one stream only; memory is bounded by the longest stream's text, which is a row of the result. Scans are
    ``stride`` characters apart, since only whole texts are returned.
    """
    policy = policy or default()
    schema = "stream_id string, text string, verdict int, blocked boolean, emitted long, leaks int, n_findings int, chunks int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, flt, parts = None, None, []

        def done() -> tuple:
            parts.append(flt.close())
            s = flt.state
            return key, "".join(parts), flt.verdict(), s.blocked, s.emitted, s.leaks, len(s.findings), s.chunks

        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows = []
            for stream, chunk in zip(pdf["stream_id"], pdf["chunk"], strict=True):
                if flt is None or stream != key:
                    if flt is not None:
                        rows.append(done())
                    key, flt, parts = stream, StreamFilter(policy, stage, stride=stride), []
                parts.append(flt.feed(chunk or ""))
            yield pd.DataFrame(rows, columns=names)
        if flt is not None:
            yield pd.DataFrame([done()], columns=names)

    ordered = chunks.select("stream_id", "seq", "chunk").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.select("stream_id", "chunk").mapInPandas(run, schema)
