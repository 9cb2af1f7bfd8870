"""The policy language: strict loading on the driver, and its rules as literals of a plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from textward.functions import catalog as C
from textward.operators import registry

STAGES = ("input", "output")
MODES = ("fail_open", "fail_closed")
#: Keys that each part of a document may have.
KEYS = {
    "policy": ("version", "name", "description", "defaults", "budget", "input", "output"),
    "defaults": ("redaction", "hash_salt"),
    "budget": ("total_ms", "on_exceeded"),
    "stage": ("rules",),
    "rule": ("id", "detect", "action", "min_severity", "min_confidence", "redaction", "reason"),
}


class PolicyError(ValueError):
    """A policy document says something that has no meaning."""


@dataclass(frozen=True)
class Rule:
    id: str
    detect: str
    action: int
    min_severity: int = 0
    min_confidence: float = 0.0
    redaction: str | None = None
    reason: str = ""

    @property
    def specificity(self) -> int:
        return 0 if self.detect == "*" else 1 + ("." in self.detect)

    def matches(self, detector: str, kind: str, severity: int, confidence: float) -> bool:
        return self.detect in ("*", detector, f"{detector}.{kind}") and severity >= self.min_severity and confidence >= self.min_confidence


@dataclass(frozen=True)
class Budget:
    total_ms: float | None = None
    on_exceeded: str = "fail_open"


@dataclass(frozen=True)
class Policy:
    name: str
    description: str = ""
    rules: dict[str, tuple[Rule, ...]] = field(default_factory=lambda: dict.fromkeys(STAGES, ()))
    budget: Budget = Budget()
    default_redaction: str = "label"
    hash_salt: str = ""
    version: int = 1

    def rules_for(self, stage: str) -> tuple[Rule, ...]:
        if stage not in STAGES:
            raise PolicyError(f"unknown stage {stage!r}; expected one of {', '.join(STAGES)}")
        return self.rules.get(stage, ())

    def ranked(self, stage: str) -> list[Rule]:
        """Rules so that the first that matches a finding governs it: most specific first, then in the file's order."""
        return sorted(self.rules_for(stage), key=lambda r: -r.specificity)

    def resolve(self, stage: str, finding: tuple) -> Rule | None:
        return next((r for r in self.ranked(stage) if r.matches(finding[0], finding[1], finding[4], finding[5])), None)

    def detectors_for(self, stage: str) -> list[str]:
        """Names of the detectors that the stage's rules can use; injection and pii first, then as rules name them."""
        heads = [r.detect.partition(".")[0] for r in self.rules_for(stage)]
        names = list(registry.registered()) if "*" in heads else list(dict.fromkeys(heads))
        return sorted(names, key=lambda n: ("injection", "pii").index(n) if n in ("injection", "pii") else 2)

    def redaction_for(self, rule: Rule) -> str:
        return rule.redaction or self.default_redaction

    def to_dict(self) -> dict:
        out: dict = {"version": self.version, "name": self.name}
        if self.description:
            out["description"] = self.description
        out["defaults"] = {"redaction": self.default_redaction} | ({"hash_salt": self.hash_salt} if self.hash_salt else {})
        if self.budget.total_ms is not None:
            out["budget"] = {"total_ms": self.budget.total_ms, "on_exceeded": self.budget.on_exceeded}
        for stage in STAGES:
            out[stage] = {"rules": [_rule_dict(r) for r in self.rules_for(stage)]}
        return out

    def dump(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, default_flow_style=False)


def _rule_dict(r: Rule) -> dict:
    out: dict = {"id": r.id, "detect": r.detect, "action": C.ACTIONS[r.action]}
    extra = {"min_severity": C.SEVERITIES[r.min_severity] if r.min_severity else None, "min_confidence": r.min_confidence, "redaction": r.redaction, "reason": r.reason}
    return out | {k: v for k, v in extra.items() if v}


class _Reader:
    """Walks a document; every complaint names the path it is about."""

    @staticmethod
    def fail(path: str, message: str) -> PolicyError:
        return PolicyError(f"{path}: {message}")

    def table(self, value, path: str, part: str) -> dict:
        if not isinstance(value, dict):
            raise self.fail(path, f"expected a mapping, got {type(value).__name__}")
        if odd := sorted(str(k) for k in value if k not in KEYS[part]):
            raise self.fail(path, f"unknown key(s) {', '.join(odd)}; allowed: {', '.join(sorted(KEYS[part]))}")
        return value

    def one_of(self, value, path: str, names: tuple[str, ...], what: str) -> str:
        text = str(value)
        if text not in names:
            raise self.fail(path, f"unknown {what} {text!r}; expected one of {', '.join(names)}")
        return text

    def ordinal(self, value, path: str, names: tuple[str, ...], what: str) -> int:
        return names.index(self.one_of(str(value).strip().lower(), path, names, what))

    def number(self, value, path: str, message: str, good) -> float:
        if isinstance(value, bool) or not isinstance(value, int | float) or not good(value):
            raise self.fail(path, message)
        return float(value)

    def rule(self, raw, path: str) -> Rule:
        m = self.table(raw, path, "rule")
        for key in KEYS["rule"][:3]:
            if key not in m:
                raise self.fail(path, f"missing required key {key!r}")
        detect = str(m["detect"])
        if not registry.valid_label(detect):
            raise self.fail(f"{path}.detect", f"{detect!r} is not a valid label; expected 'detector', 'detector.kind' or '*'")
        if detect not in registry.known_labels():
            hint = registry.suggest(detect)
            raise self.fail(f"{path}.detect", f"no detector produces {detect!r}" + (f"; did you mean {hint!r}?" if hint else ""))
        action = self.ordinal(m["action"], f"{path}.action", C.ACTIONS, "action")
        severity = self.ordinal(m.get("min_severity", "info"), f"{path}.min_severity", C.SEVERITIES, "severity")
        sure = self.number(m.get("min_confidence", 0.0), f"{path}.min_confidence", "expected a number in [0, 1]", lambda x: 0 <= x <= 1)
        redaction = m.get("redaction")
        if redaction is not None:
            redaction = self.one_of(redaction, f"{path}.redaction", C.STRATEGIES, "strategy")
            if C.ACTIONS[action] != "redact":
                raise self.fail(f"{path}.redaction", f"only meaningful with action 'redact', but this rule's action is {C.ACTIONS[action]!r}")
        return Rule(str(m["id"]), detect, action, severity, sure, redaction, str(m.get("reason", "")))

    def stage(self, raw, stage: str) -> tuple[Rule, ...]:
        rules = (self.table(raw, stage, "stage").get("rules") if raw is not None else None) or []
        if not isinstance(rules, list):
            raise self.fail(f"{stage}.rules", f"expected a list, got {type(rules).__name__}")
        out: list[Rule] = []
        for i, entry in enumerate(rules):
            rule = self.rule(entry, f"{stage}.rules[{i}]")
            if any(r.id == rule.id for r in out):
                raise self.fail(f"{stage}.rules[{i}].id", f"duplicate rule id {rule.id!r}")
            out.append(rule)
        return tuple(out)

    def budget(self, raw) -> Budget:
        m = self.table(raw, "budget", "budget") if raw is not None else {}
        if m.get("total_ms") is None:
            return Budget()
        total = self.number(m["total_ms"], "budget.total_ms", "expected a positive number of milliseconds", lambda x: x > 0)
        if "on_exceeded" not in m:
            raise self.fail("budget.on_exceeded", f"required whenever a budget is set; expected one of {', '.join(MODES)}")
        return Budget(total, self.one_of(m["on_exceeded"], "budget.on_exceeded", MODES, "value"))


def loads(text: str, name: str | None = None) -> Policy:
    """A policy from YAML text; raises PolicyError, with the path of what is wrong."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise PolicyError(f"policy is not valid YAML: {e}") from None
    if raw is None:
        raise PolicyError("policy is empty")
    read = _Reader()
    m = read.table(raw, "policy", "policy")
    if m.get("version") != 1 or isinstance(m.get("version"), bool):
        raise read.fail("policy.version", f"expected 1, got {m.get('version')!r}")
    defaults = read.table(m.get("defaults") or {}, "defaults", "defaults")
    return Policy(
        name=str(m.get("name") or name or "unnamed"),
        description=str(m.get("description", "")),
        rules={s: read.stage(m.get(s), s) for s in STAGES},
        budget=read.budget(m.get("budget")),
        default_redaction=read.one_of(defaults.get("redaction", "label"), "defaults.redaction", C.STRATEGIES, "strategy"),
        hash_salt=str(defaults.get("hash_salt", "")),
    )


def load(path: str | Path) -> Policy:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise PolicyError(f"cannot read policy {path}: {e}") from None
    return loads(text, Path(path).stem)


def default() -> Policy:
    """The bundled policy."""
    return load(Path(__file__).parent / "default_policy.yaml")
