"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each end position the automaton's output links give all pieces that end there, longest first; each relaxes the best
score of the position from that of its start. A character that no single-character piece covers costs the lowest
score less 10 and becomes byte pieces (or the unknown piece, in a model without them). Only a strictly better score
replaces an earlier one, so of equal segmentations the one with the longer last piece stays.

No piece of the public models holds a space mark after another character, so the best segmentation of a text is that
of its space-led segments put together; segments are remembered, up to ``CACHE`` of them. A model with pieces across
spaces is run over the whole text instead.

Each row is encoded by itself, whole. Cases: a null text has null ids, an empty one no ids; very long texts are read in
slices that end between segments; repeated rows get equal ids; an empty table gives no rows; other columns are kept or
left out as the caller says, whatever their names. Decoding gives the normalised text back; unknown ids are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import common

SPACE = "▁"
CACHE = 300_000
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SLICE = 1 << 20


class Pieces(dict):
    """Encoder and decoder of one model file; as a dict: segment -> its ids as int32 bytes."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.machine = ahocorasick.Automaton()
        for i in plain:
            self.machine.add_word(names[i], (len(names[i]), scores[i], i))
        self.machine.make_automaton()
        self.single = {names[i] for i in plain if len(names[i]) == 1}
        self.unknown = min(scores[i] for i in plain) - 10.0
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk_id = sp.unk_id()
        self.apart = not any(SPACE in names[i].lstrip(SPACE) for i in plain)
        self.shown = [b""] * n
        for i in plain:
            self.shown[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.shown[i] = bytes([b])
        self.sp = sp
        self.prefix = sp.normalize("a").startswith(SPACE)
        self.identity = all(sp.normalize(x) == self._mark(x) for x in ("a", " a  b ", "\tﬁ é\n　Ａ", "a\r\x00b​"))

    def _mark(self, text: str) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return self._mark(text) if self.identity else self.sp.normalize(text)

    def __missing__(self, segment: str) -> bytes:
        ids = np.array(self.viterbi(segment), dtype=np.int32).tobytes()
        if len(segment) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = ids
        return ids

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best segmentation of a normalised text."""
        n, single, unknown = len(text), self.single, self.unknown
        best, back = [0.0] + [float("-inf")] * n, [(1, -1)] * (n + 1)
        at = 0  # all positions up to here are final
        for last, (length, score, piece) in self.machine.iter(text):
            end = last + 1
            while at < end - 1:
                at += 1
                if text[at - 1] not in single and best[at - 1] + unknown > best[at]:
                    best[at], back[at] = best[at - 1] + unknown, (1, -1)
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (length, piece)
        while at < n:
            at += 1
            if text[at - 1] not in single and best[at - 1] + unknown > best[at]:
                best[at], back[at] = best[at - 1] + unknown, (1, -1)
        out: list[int] = []
        at = n
        while at > 0:
            length, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[at - 1 : at].encode("utf-8", "replace")))
            else:
                out.append(self.unk_id)
            at -= length
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        text = self.normalise(text)
        if not self.apart:
            return np.array(self.viterbi(text), dtype=np.int32)
        get, at, out = self.__getitem__, 0, []
        while at < len(text):
            end = at + _SLICE
            if end < len(text):
                cut = text.find(SPACE, end)
                end = len(text) if cut < 0 else cut
            out.append(b"".join(map(get, _SEGMENT.findall(text[at:end]))) if not (end < len(text) and text[end - 1] == SPACE) else None)
            if out[-1] is None:  # the slice would end inside a run of space marks: end it before the run
                run = end
                while run > at and text[run - 1] == SPACE:
                    run -= 1
                end = run if run > at else len(text)
                out[-1] = b"".join(map(get, _SEGMENT.findall(text[at:end])))
            at = end
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        shown, n = self.shown, self.size
        text = b"".join([shown[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[int, Pieces] = {}


def model(proto: bytes) -> Pieces:
    """The model of a file's bytes; built once in a Python worker."""
    key = hash(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def read(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; executors get the bytes
        return f.read()


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    size = np.array([0 if p is None else len(p) for p in parts], dtype=np.int64)
    bounds = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(size, out=bounds[1:])
    flat = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    where = pa.array(bounds, mask=np.array([p is None for p in parts] + [False])) if any(p is None for p in parts) else pa.array(bounds)
    return pa.ListArray.from_arrays(where, pa.array(flat))


def encode(docs: DataFrame, proto: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ids, n_tokens, n_byte_tokens and round_trip (decoding gives the normalised text)."""
    held = docs.sparkSession.sparkContext.broadcast(proto)  # the model file
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(held.value)
        is_byte = np.zeros(m.size, dtype=bool)
        is_byte[list(m.bytes.values())] = True
        for b in batches:
            for part in common.pieces(b, "_text"):
                texts = part.column(len(keep)).to_pylist()
                ids = [None if t is None else m.encode(t) for t in texts]
                same = [None if t is None else m.decode(i.tolist()) == _expected(m, t) for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        _lists(ids),
                        pa.array([0 if i is None else len(i) for i in ids], pa.int64()),
                        pa.array([0 if i is None else int(is_byte[i].sum()) for i in ids], pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    [*keep, "ids", "n_tokens", "n_byte_tokens", "round_trip"],
                )

    return kept.mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")


def _expected(m: Pieces, text: str) -> str:
    if m.identity:
        return text.replace(SPACE, " ")
    text = m.normalise(text).replace(SPACE, " ")
    return text[1:] if m.prefix and text.startswith(" ") else text


def decode(rows: DataFrame, proto: bytes, keep: list[str], ids: str = "ids") -> DataFrame:
    """The kept columns with the text of each row's ids; null ids give a null text."""
    held = rows.sparkSession.sparkContext.broadcast(proto)
    kept = rows.select(*keep, F.col(ids).alias("_ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(held.value)
        for b in batches:
            texts = [None if x is None else m.decode([i for i in x if i is not None]) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return kept.mapInArrow(run, f"{fields}, text string")
