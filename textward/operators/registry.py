"""Detectors by name: the built-in ones and those that callers register."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from textward.functions import catalog as C
from textward.functions import scan


class DetectorContractError(ValueError):
    """A detector doesn't have the shape or the behaviour that the engine relies on."""


@dataclass(frozen=True)
class Detector:
    """``scan`` maps a text to finding tuples; it must be stateless and picklable. ``widest`` bounds a finding's length.

    A detector with wider findings gives ``unfinished``: where in a text one may begin that the text's end cuts.
    """

    name: str
    kinds: tuple[str, ...]
    widest: int
    scan: Callable[[str], list[tuple]] = field(compare=False)
    unfinished: Callable[[str], int] | None = field(default=None, compare=False)

    def check(self) -> Detector:
        if not isinstance(self.name, str) or not re.fullmatch(r"[a-z][a-z0-9_]*", self.name):
            raise DetectorContractError(f"detector name {self.name!r} is not a lower-case identifier")
        if not isinstance(self.kinds, tuple) or not self.kinds or not all(isinstance(k, str) and re.fullmatch(r"[a-z][a-z0-9_]*", k) for k in self.kinds):
            raise DetectorContractError(f"detector {self.name!r}: kinds must be a non-empty tuple of lower-case identifiers")
        if isinstance(self.widest, bool) or not isinstance(self.widest, int) or self.widest < 1:
            raise DetectorContractError(f"detector {self.name!r}: the longest match must be a positive integer")
        if not callable(self.scan):
            raise DetectorContractError(f"detector {self.name!r} has no scan function")
        return self


def pii_detector(kinds: tuple[str, ...] | None = None) -> Detector:
    chosen = tuple(C.PII) if kinds is None else tuple(k for k in C.PII if k in kinds)
    if kinds is not None and (odd := sorted(set(kinds) - set(C.PII))):
        raise ValueError(f"unknown pii kinds: {', '.join(odd)}")
    return Detector("pii", chosen, max((C.PII[k][2] for k in chosen), default=1), lambda text: scan.pii(text, chosen), scan.unfinished_email if "email" in chosen else None)


def injection_detector() -> Detector:
    return Detector("injection", ("prompt_injection",), C.WIDEST, scan.injection)


_BUILT_IN: dict[str, Callable[[], Detector]] = {"injection": injection_detector, "pii": pii_detector}
_held: dict[str, Callable[[], Detector]] = dict(_BUILT_IN)


def register(factory: Callable[[], Detector], name: str | None = None, replace: bool = False) -> Detector:
    """Adds a detector; its factory runs once here, to check what it makes."""
    made = factory()
    if not isinstance(made, Detector):
        raise DetectorContractError(f"the factory returned a {type(made).__name__}, not a Detector")
    made.check()
    if name is not None and name != made.name:
        raise DetectorContractError(f"registered as {name!r}, but the detector is named {made.name!r}")
    if made.name in _held and not replace:
        raise DetectorContractError(f"detector {made.name!r} is already registered; pass replace=True")
    _held[made.name] = factory
    return made


def unregister(name: str) -> None:
    if name not in _held:
        raise KeyError(f"no detector named {name!r}")
    del _held[name]


def reset() -> None:
    _held.clear()
    _held.update(_BUILT_IN)


def registered() -> tuple[str, ...]:
    return tuple(_held)


def build(name: str) -> Detector:
    if name not in _held:
        raise KeyError(f"no detector named {name!r}")
    return _held[name]()


def known_labels() -> list[str]:
    return sorted({"*", *(x for n in _held for x in (n, *(f"{n}.{k}" for k in build(n).kinds)))})


def suggest(label: str) -> str | None:
    near = difflib.get_close_matches(label, known_labels(), n=1, cutoff=0.6)
    return near[0] if near else None


def valid_label(label: str) -> bool:
    return re.match(C.LABEL, label) is not None
