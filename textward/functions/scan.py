"""Scanning one text: what the Arrow functions run for each row.

A finding is a tuple in the order of ``FINDING``'s fields. Offsets count code points of the original text; the matched text
itself is never part of a finding.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import unicodedata
from functools import cache

from pyspark.sql import types as T

from textward.functions import catalog as C

FINDING = T.StructType(
    [
        T.StructField("detector", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detail", T.StringType()),
        T.StructField("signals", T.ArrayType(T.StringType())),
    ]
)
_HIDDEN = dict.fromkeys(map(ord, C.INVISIBLE))
_DIGITS = {n: re.compile(rf"\d{{{n}}}") for n in (1, 2, 3, 4)}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _any(needles: tuple[str, ...] | None, text: str) -> bool:
    return not needles or any(x in text for x in needles)


# ---------------------------------------------------------------- validators


def luhn(digits: str) -> bool:
    if len(digits) < 12 or not digits.isdigit():
        return False
    ds = [int(d) for d in reversed(digits)]
    return (sum(ds[::2]) + sum(_DOUBLED[d] for d in ds[1::2])) % 10 == 0


def card_brand(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and digits.startswith(C.CARD_PREFIXES)


def iban(value: str) -> bool:
    rest = 0
    for ch in value[4:] + value[:4]:
        if not ch.isalnum():
            return False
        v = int(ch) if ch.isdigit() else ord(ch.upper()) - 55
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def ssn(area: str, group: str, serial: str) -> bool:
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def jwt(token: str) -> bool:
    head = token.partition(".")[0]
    try:
        claims = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(claims, dict) and "alg" in claims


def ipv4(value: str) -> bool:
    return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split("."))


def _confidence(kind: str, m) -> float | None:
    """The confidence of a match; None where its validator rejects it."""
    text, sure = m.group(), C.CONFIDENCE.get(kind)
    if kind == "ssn":
        return C.SSN_CONFIDENCE[not m.group(2)] if ssn(m.group(1), m.group(3), m.group(4)) else None
    if kind == "credit_card":
        digits = text.translate({32: None, 45: None})
        return sure if luhn(digits) and card_brand(digits) else None
    if kind == "email":
        local = text.partition("@")[0]
        return None if local[0] == "." or local[-1] == "." or ".." in local else sure
    check = {"iban": iban, "jwt": jwt, "ipv4": ipv4}.get(kind)
    return sure if check is None or check(text) else None


# ---------------------------------------------------------------- detectors


def pii(text: str, kinds: tuple[str, ...] = tuple(C.PII)) -> list[tuple]:
    """Findings of validated patterns, by start, longer ones first. An email may be wider than its usual bound."""
    out = []
    digits = next((n for n in (4, 3, 2, 1) if _DIGITS[n].search(text)), 0)
    for kind in kinds:
        if C.NEEDS_DIGITS.get(kind, 0) > digits or not _any(C.NEEDS.get(kind), text):
            continue
        _, severity, widest, detail = C.PII[kind]
        for m in C.COMPILED.pii[kind].finditer(text):
            sure = _confidence(kind, m)
            if sure is not None:
                start, end = m.span(1 if kind == "api_key" else 0)
                if kind == "email" or end - start <= widest:
                    out.append(("pii", kind, start, end, severity, sure, detail, []))
    return sorted(out, key=lambda f: (f[2], f[2] - f[3]))


_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*\Z"), re.compile(r"(?:[A-Za-z0-9-]{1,63}\.)*[A-Za-z0-9-]{0,63}\Z")


def unfinished_email(text: str) -> int:
    """Where an email begins that the text's end may cut, whatever its width; the text's length if none does."""
    at = text.rfind("@")
    if at < 1 or not _DOMAIN.match(text, at + 1):
        return len(text)
    return _LOCAL.search(text, max(0, at - 64), at).start()


@cache
def _fold_char(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKC", ch).casefold() if not unicodedata.combining(x))


def fold(text: str) -> tuple[str, list[int] | range]:
    """Text for matching, and the original offset of each of its characters."""
    if text.isascii():
        return text.lower(), range(len(text))
    out, index = [], []
    for at, ch in enumerate(text):
        if ord(ch) in _HIDDEN:
            continue
        folded = ch.lower() if ch < "\x80" else _fold_char(ch)
        out.append(folded)
        index.extend([at] * len(folded))
    return "".join(out), index


def original_span(index, start: int, end: int, whole: int) -> tuple[int, int]:
    """A span of folded text in original offsets."""
    if not index:
        return 0, whole
    start = min(max(start, 0), len(index) - 1)
    return (index[start], index[min(end, len(index)) - 1] + 1) if end > start else (index[start], index[start] + 1)


def hidden_text(text: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of base64 runs that hide readable text."""
    out = []
    for m in C.COMPILED.base64.finditer(text):
        run = m.group()
        try:
            raw = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
            shown = raw.decode("utf-8")
        except (binascii.Error, ValueError):
            continue
        readable = sum(32 <= b < 127 or b in b"\t\n\r" for b in raw)
        if len(raw) >= C.BASE64_BYTES and readable >= C.BASE64_READABLE * len(raw):
            out.append((m.start(), m.end(), shown))
    return out


def total_weight(names) -> float:
    return round(sum(C.SIGNALS[n][0] if n in C.SIGNALS else C.OBFUSCATED_WEIGHT if n == C.OBFUSCATED else 0.0 for n in set(names)), 3)


def severity_of(total: float) -> int:
    return next((s for least, s in C.SEVERITY_STEPS if total >= least), 0)


def describe(names) -> list[str]:
    known = {n: v[2] for n, v in C.SIGNALS.items()} | {C.OBFUSCATED: C.OBFUSCATED_TEXT}
    return [f"{n}: {known[n]}" for n in names if n in known]


def clusters(spans) -> list[tuple[int, int]]:
    """Sorted spans, joined while a cluster stays within the widest finding."""
    out: list[list[int]] = []
    for start, end in sorted(set(spans)):
        if out and end - out[-1][0] <= C.WIDEST:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def signal_hits(text: str) -> tuple[dict[str, tuple[int, int]], bool]:
    """The first hit of each signal, in original offsets, and whether a payload was hidden."""
    folded, index = fold(text)
    hits = {}
    for name, pattern in C.COMPILED.signals.items():
        if _any(C.SIGNAL_NEEDS[name], folded) and (m := pattern.search(folded)):
            span = original_span(index, *m.span(), len(text))
            if span[1] - span[0] <= C.WIDEST:
                hits[name] = span
    hidden = False
    for start, end, shown in hidden_text(text):
        inner = fold(shown)[0]
        for name, pattern in C.COMPILED.signals.items():
            if pattern.search(inner):
                hits.setdefault(name, (start, end))
                hidden = True
    if not hidden and hits and not text.isascii():
        hidden = any(fold(text[a:b])[0] != text[a:b].casefold() for a, b in hits.values())
    return hits, hidden


def scored(names: tuple[str, ...], spans, detail: str = "") -> list[tuple]:
    total = total_weight(names)
    text = f"score {total} from {len(names)} signal(s){detail}"
    return [("injection", "prompt_injection", a, b, severity_of(total), min(0.99, round(total / 5.0, 3)), text, list(names)) for a, b in spans]


def injection(text: str) -> list[tuple]:
    """One finding per cluster of signal hits; all carry the score of the whole text."""
    hits, hidden = signal_hits(text)
    if not hits:
        return []
    return scored((*sorted(hits), *([C.OBFUSCATED] if hidden else [])), clusters(hits.values()))
