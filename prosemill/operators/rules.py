"""Rules as data: validation of one rule, rulesets with an identity, and their explanation.

A ruleset is a small table that is read and checked on the driver; ``edits`` takes its automatic rules.  Files are JSON
lists or, where a reader is installed, YAML documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import morphology
from ..sources.reports import canonical
from .edits import Rule

# Modes with the actions they allow, match types, scopes, and the bounds of a rule.
ACTIONS = {"diagnostic": {"none"}, "safe-fix": {"replace", "delete"}, "protected": {"protect"}, "style-fix": {"replace"}}
MATCHES = {"phrase": {"text"}, "word": {"text", "forms"}, "regex": {"pattern"}, "lemma": {"lemma", "pos", "classes"}}
SCOPES = {"prose", "heading", "list", "quote", "code", "table", "link"}
TRIGGERS = {"REPEATED_TRANSITION", "TRANSITION_DENSITY"}
REQUIRED = {"id", "version", "name", "mode", "description", "match", "reason", "provenance", "examples"}
OPTIONAL = {"action", "scope", "case", "priority", "requires_diagnostic", "review"}
MAX_PATTERN, MAX_PHRASE, MAX_REPLACEMENT, MAX_PRIORITY, MAX_LABEL = 200, 120, 120, 1000, 60
MAX_FILE_BYTES, MAX_RULES = 64 << 10, 5000
# Constructs that a pattern may not use.
FORBIDDEN = {r"\\[1-9]": "backreferences", r"\(\?R\)": "recursion", r"\(\?P>": "subpattern calls", r"\(\?\(": "conditionals", r"\(\?[aiLmsux]*\)": "inline flags", r"\([^)]*[+*}][^)]*\)\s*[+*]": "nested quantifiers"}


class RuleError(ValueError):
    """A rule or ruleset that isn't fully understood."""


class _Checked:
    """One rule under examination; every complaint names it."""

    def __init__(self, data: Any, source: str):
        self.name = source
        self.mapping(data, "rule", REQUIRED | OPTIONAL, REQUIRED)
        self.data, self.name = data, f"{data['id']} in {source}"

    def fail(self, text: str) -> None:
        raise RuleError(f"{self.name}: {text}")

    def want(self, condition: object, text: str) -> None:
        if not condition:
            self.fail(text)

    def mapping(self, value: Any, what: str, known: set[str], needed: set[str] = frozenset()) -> dict:
        self.want(isinstance(value, dict), f"{what} must be a mapping")
        self.want(not set(value) - known, f"{what} has unknown fields {sorted(set(value) - known)}")
        self.want(not needed - set(value), f"{what} lacks {sorted(needed - set(value))}")
        return value

    def text(self, value: Any, what: str, most: int) -> str:
        self.want(isinstance(value, str) and value.strip(), f"{what} must be a text")
        self.want(len(value) <= most, f"{what} is longer than {most}")
        return value

    def one_of(self, value: Any, what: str, known: Any) -> str:
        self.want(isinstance(value, str) and value in known, f"{what} must be one of {sorted(known)}")
        return value

    def matching(self, raw: Any) -> dict:
        kind = self.one_of(self.mapping(raw, "match", {"type", "case"}.union(*MATCHES.values()), {"type"})["type"], "match.type", MATCHES)
        self.mapping(raw, f"a {kind} match", {"type", "case"} | MATCHES[kind])
        case = self.one_of(raw.get("case", "insensitive"), "match.case", ("sensitive", "insensitive"))
        if kind == "regex":
            pattern = self.text(raw.get("pattern"), "match.pattern", MAX_PATTERN)
            for construct, what in FORBIDDEN.items():
                self.want(not re.search(construct, pattern), f"match.pattern uses {what}")
            try:
                re.compile(pattern)
            except re.error as e:
                self.fail(f"match.pattern doesn't compile: {e}")
            return {"type": kind, "case": case, "pattern": pattern}
        if kind == "lemma":
            pos = self.one_of(raw.get("pos"), "match.pos", morphology.CLASSES)
            classes = raw.get("classes", [])
            self.want(isinstance(classes, list) and len(set(classes)) == len(classes) and set(classes) <= set(morphology.CLASSES[pos]), f"match.classes must be forms of a {pos}")
            return {"type": kind, "case": case, "lemma": self.text(raw.get("lemma"), "match.lemma", MAX_PHRASE).strip(), "pos": pos, "classes": tuple(classes)}
        text = self.text(raw.get("text"), "match.text", MAX_PHRASE)
        surfaces = raw.get("forms", [])
        self.want(isinstance(surfaces, list) and all(isinstance(f, str) and f for f in surfaces) and len({text, *surfaces}) == len(surfaces) + 1, "match.forms must be distinct texts")
        if kind == "word":
            self.want(all(re.fullmatch(r"[A-Za-z][A-Za-z'-]*", w) for w in (text, *surfaces)), "a word match holds letters, apostrophes and hyphens only")
        return {"type": kind, "case": case, "surfaces": [text, *surfaces]}

    def action(self, raw: Any, mode: str) -> dict:
        raw = self.mapping(raw if raw is not None else {"type": "none"}, "action", {"type", "replacement", "lemma", "recapitalize"}, {"type"})
        kind = self.one_of(raw["type"], f"the action of a {mode} rule", ACTIONS[mode])
        if kind == "replace":
            self.want(("replacement" in raw) != ("lemma" in raw), "a replacement is either a text or a lemma")
            self.text(raw.get("replacement", raw.get("lemma")), "action.replacement", MAX_REPLACEMENT)
        else:
            self.want("replacement" not in raw and "lemma" not in raw, f"{kind} takes no replacement")
        return dict(raw)


def build_rule(data: Any, source: str = "rule") -> dict:
    """A rule that passed every check, with its defaults; RuleError names what isn't understood."""
    c = _Checked(data, source)
    c.want(isinstance(data["id"], str) and re.fullmatch(r"[A-Z]+\.[A-Z][A-Z0-9]{1,15}\.\d{3}", data["id"]), "id must look like XX.FAMILY.001")
    c.want(type(data["version"]) is int and data["version"] >= 1, "version must be a positive integer")
    mode = c.one_of(data["mode"], "mode", ACTIONS)
    c.text(data["name"], "name", 80)
    c.text(data["description"], "description", 600)
    c.text(c.mapping(data["reason"], "reason", {"short"}, {"short"})["short"], "reason.short", 120)
    match, action = c.matching(data["match"]), c.action(data.get("action"), mode)
    scope = c.mapping(data.get("scope", {"include": ["prose"]}), "scope", {"include", "exclude"})
    include, exclude = (scope.get(k, []) for k in ("include", "exclude"))
    c.want(isinstance(include, list) and isinstance(exclude, list) and include and set(include) | set(exclude) <= SCOPES and not set(include) & set(exclude), f"scope must name some of {sorted(SCOPES)}")
    policy = c.one_of(c.mapping(data.get("case", {"policy": "preserve"}), "case", {"policy"}, {"policy"})["policy"], "case.policy", ("preserve", "exact"))
    priority = data.get("priority", 100)
    c.want(type(priority) is int and 0 <= priority <= MAX_PRIORITY, f"priority must be 0 to {MAX_PRIORITY}")
    c.mapping(data["provenance"], "provenance", {"source", "reference", "licence"}, {"source", "licence"})
    examples = c.mapping(data["examples"], "examples", {"positive", "negative", "transform"}, {"positive", "negative"})
    c.want(all(isinstance(examples.get(k, []), list) for k in ("positive", "negative", "transform")), "examples must be lists")
    trigger = None
    if mode == "style-fix":
        raw = c.mapping(data.get("requires_diagnostic"), "requires_diagnostic", {"id", "evidence_label"}, {"id", "evidence_label"})
        label = c.text(raw["evidence_label"], "evidence_label", MAX_LABEL)
        c.want(label == label.strip().lower(), "evidence_label must be lower case and trimmed")
        trigger = (c.one_of(str(raw["id"]).rsplit(".", 1)[-1], "requires_diagnostic.id", TRIGGERS), label)
        c.want(c.mapping(data.get("review"), "review", {"required"}, {"required"})["required"] is True, "review.required must be true")
    else:
        c.want("requires_diagnostic" not in data and "review" not in data, "only a style-fix has a trigger and a review")
    for bad, why in (
        (match["type"] == "lemma" and mode == "safe-fix" and "lemma" not in action, "a lemma is replaced by a lemma"),
        ("lemma" in action and match["type"] != "lemma", "a lemma replaces a lemma only"),
        (action["type"] == "delete" and match["type"] in ("lemma", "word"), "a single word may not be deleted"),
        (action["type"] == "replace" and match["type"] == "regex", "a pattern may not replace"),
        (mode == "style-fix" and match["type"] != "phrase", "a style-fix matches a phrase"),
        (policy == "exact" and match["case"] == "insensitive" and mode == "safe-fix", "exact casing needs a case-sensitive match"),
    ):
        c.want(not bad, why)
    return {"id": data["id"], "version": data["version"], "name": data["name"], "mode": mode, "description": data["description"].strip(), "match": match, "action": action, "include": sorted(include), "exclude": sorted(exclude), "case": policy, "priority": priority, "reason": data["reason"]["short"], "trigger": trigger, "examples": examples}


def literals(rule: dict) -> dict[str, str]:
    """The surfaces of a checked rule and what replaces them; empty for patterns."""
    match, action = rule["match"], rule["action"]
    if match["type"] == "lemma":
        if "lemma" in action:
            return morphology.pairs(match["lemma"], action["lemma"], match["pos"], match["classes"])
        found = morphology.forms(match["lemma"], match["pos"])
        return {found[c]: "" for c in match["classes"] or found}
    return {s: action.get("replacement", "") for s in match.get("surfaces", [])}


def executable(rule: dict) -> Rule:
    """A checked rule in the form that the matcher takes."""
    exact = rule["match"]["case"] == "sensitive"
    return Rule(rule["id"], literals(rule), rule["priority"], exact=exact, mode=rule["mode"], include=frozenset(rule["include"]), exclude=frozenset(rule["exclude"]), pattern=rule["match"].get("pattern", ""), version=rule["version"])


def _documents(path: Path) -> list:
    raw = path.read_bytes()
    if len(raw) > MAX_FILE_BYTES:
        raise RuleError(f"{path.name} has {len(raw)} bytes, more than {MAX_FILE_BYTES}")
    if path.suffix == ".json":
        import json

        found = json.loads(raw)
        return found if isinstance(found, list) else [found]
    try:
        import yaml
    except ImportError as e:
        raise RuleError(f"{path.name}: no reader for YAML is installed") from e
    try:
        return [d for d in yaml.safe_load_all(raw.decode("utf-8")) if d is not None]
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise RuleError(f"{path.name}: {e}") from e


def load_ruleset(folder: str, read: Callable[[Path], list] = _documents) -> dict:
    """{version, sha256, rules} of the rule files in a folder, which holds a manifest RULESET with ruleset_version.

    Rules are ordered by id and version, whatever the order of the files; the hash covers all that a rule says.
    """
    files = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".json", ".yaml", ".yml"))
    manifest = [p for p in files if p.stem == "RULESET"]
    if len(manifest) != 1:
        raise RuleError("a ruleset has one manifest RULESET")
    head = read(manifest[0])[0]
    version = head.get("ruleset_version") if isinstance(head, dict) and not set(head) - {"ruleset_version", "description"} else None
    if not isinstance(version, str) or not version.strip():
        raise RuleError("the manifest must state ruleset_version")
    found = [build_rule(d, f"{p.name}#{k}") for p in files if p.stem != "RULESET" for k, d in enumerate(read(p))]
    if not 0 < len(found) <= MAX_RULES:
        raise RuleError(f"a ruleset has 1 to {MAX_RULES} rules, not {len(found)}")
    ids = [r["id"] for r in found]
    if len(set(ids)) < len(ids):
        raise RuleError(f"rules share an id: {sorted({i for i in ids if ids.count(i) > 1})}")
    rules = sorted(found, key=lambda r: (r["id"], r["version"]))
    for r in rules:
        try:
            literals(r)
        except ValueError as e:
            raise RuleError(f"{r['id']}: {e}") from e
    return {"version": version, "sha256": hashlib.sha256(canonical([version, morphology.VERSION, [dict(r, match={k: list(v) if isinstance(v, tuple) else v for k, v in r["match"].items()}) for r in rules]]).encode()).hexdigest(), "rules": rules}


def explain(rule: dict) -> str:
    """What a rule does, in one paragraph."""
    match = rule["match"]
    surfaces = ", ".join(f'"{s}"' for s in sorted(literals(rule))) or f"the pattern {match.get('pattern')}"
    does = {"replace": lambda: "replaced by " + ", ".join(f'"{r}"' for r in sorted(set(literals(rule).values()))), "delete": lambda: "deleted at a sentence's start", "protect": lambda: "protected", "none": lambda: "reported"}[rule["action"]["type"]]()
    return f"{rule['id']} (version {rule['version']}, {rule['mode']}): {surfaces} is {does}. {rule['reason']}. In {', '.join(rule['include'])}" + (f", not in {', '.join(rule['exclude'])}" if rule["exclude"] else "") + "."


def listing(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, mode, priority, surface, replacement) of every literal of executable rules."""
    rows = [(r.rule_id, r.mode, r.priority, s, t) for r in rules for s, t in sorted(r.literals.items())]
    return spark.createDataFrame(rows, "rule_id string, mode string, priority int, surface string, replacement string")
