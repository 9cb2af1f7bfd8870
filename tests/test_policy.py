import pytest

from textward.operators import policy as P

RULE = "version: 1\ninput: {rules: [%s]}"


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("", "empty"),
        ("[1]", "policy: expected a mapping"),
        ("a: [", "not valid YAML"),
        ("version: 2", "policy.version"),
        ("name: x", "policy.version"),
        ("version: 1\nodd: 2", r"unknown key\(s\) odd; allowed: budget"),
        ("version: 1\ndefaults: {redaction: blur}", "defaults.redaction: unknown strategy 'blur'"),
        ("version: 1\ninput: {rules: 3}", "input.rules: expected a list"),
        ("version: 1\ninput: 3", "input: expected a mapping"),
        (RULE % "{detect: pii, action: flag}", r"input.rules\[0\]: missing required key 'id'"),
        (RULE % "{id: a, detect: pii, action: flag}, {id: a, detect: pii, action: flag}", r"input.rules\[1\].id: duplicate"),
        (RULE % "{id: a, detect: PII, action: flag}", "not a valid label"),
        (RULE % "{id: a, detect: pii.emial, action: flag}", "did you mean 'pii.email'"),
        (RULE % "{id: a, detect: pii, action: stop}", r"input.rules\[0\].action: unknown action 'stop'"),
        (RULE % "{id: a, detect: pii, action: flag, min_severity: grave}", "min_severity"),
        (RULE % "{id: a, detect: pii, action: flag, min_confidence: 2}", r"number in \[0, 1\]"),
        (RULE % "{id: a, detect: pii, action: flag, min_confidence: true}", r"number in \[0, 1\]"),
        (RULE % "{id: a, detect: pii, action: flag, redaction: mask}", "only meaningful with action 'redact'"),
        (RULE % "{id: a, detect: pii, action: redact, redaction: blur}", "unknown strategy"),
        ("version: 1\nbudget: {total_ms: -1, on_exceeded: fail_open}", "positive number"),
        ("version: 1\nbudget: {total_ms: 5}", "on_exceeded: required"),
        ("version: 1\nbudget: {total_ms: 5, on_exceeded: maybe}", "unknown value 'maybe'"),
    ],
)
def test_bad_documents(text, message):
    with pytest.raises(P.PolicyError, match=message):
        P.loads(text)


def test_resolution_and_round_trip(tmp_path):
    p = P.default()
    assert p.detectors_for("output") == ["injection", "pii"]
    resolve = lambda stage, *f: getattr(p.resolve(stage, ("pii", *f)), "id", None)
    assert resolve("input", "ssn", 0, 3, 3, 0.95) == "redact-ssn"
    assert resolve("input", "ssn", 0, 3, 3, 0.55) == "redact-pii"
    assert P.loads(p.dump()) == p
    salted = P.loads("version: 1\ndefaults: {hash_salt: s}")
    assert P.loads(salted.dump()).hash_salt == "s"
    (tmp_path / "mine.yaml").write_text("version: 1")
    assert P.load(tmp_path / "mine.yaml").name == "mine"
    with pytest.raises(P.PolicyError, match="cannot read policy"):
        P.load(tmp_path / "none.yaml")
    with pytest.raises(P.PolicyError, match="unknown stage"):
        p.rules_for("middle")
    assert P.loads("version: 1\ninput:\noutput: {rules: }").rules_for("input") == ()
    star = P.loads(RULE % "{id: a, detect: '*', action: flag}, {id: b, detect: '*', action: block}")
    assert star.resolve("input", ("x", "y", 0, 1, 0, 0.0)).id == "a" and set(star.detectors_for("input")) == {"pii", "injection"}
