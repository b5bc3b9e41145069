"""Presenting a document: governed edits with their new places, findings, review proposals, and the contracts.

A document is planned, guarded, measured and reviewed in one Arrow pass; decisions about review proposals are tables.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import markdown, segment
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.reports import canonical
from . import edits, facts, observe, readability

PER_DIAGNOSTIC = 25
STYLE_RULES = [edits.Rule("style." + old.strip(",").lower().replace(" ", "-"), {old: new}, 40, exact=True, mode="style-fix") for old, new in edits.STYLE_FIXES.items()]

_FINDING = pa.struct([("diagnostic", pa.string()), ("severity", pa.string()), ("value", pa.float64()), ("sample", pa.int64()), ("label", pa.string()), ("evidence", pa.list_(pa.struct([("place", pa.int32()), ("excerpt", pa.string())])))])
_FINDING_SQL = "struct<diagnostic:string,severity:string,value:double,sample:bigint,label:string,evidence:array<struct<place:int,excerpt:string>>>"
_REVIEW = pa.struct([("proposal_id", pa.string()), ("diagnostic", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule_id", pa.string()), ("surface", pa.string()), ("replacement", pa.string()), ("budget", pa.int32())])
_REVIEW_SQL = "struct<proposal_id:string,diagnostic:string,start:int,end:int,rule_id:string,surface:string,replacement:string,budget:int>"
_PLAN = pa.schema([("doc_id", pa.int64()), ("before", pa.string()), ("after", pa.string()), ("proposals", edits._PROPOSALS), ("broken", pa.string()), ("admitted", pa.list_(pa.string())), ("withdrawn", pa.list_(pa.string())), ("findings", pa.list_(_FINDING)), ("reviews", pa.list_(_REVIEW)), ("plan_sha256", pa.string())])
_PLAN_SQL = f"doc_id long, before string, after string, proposals {edits.PROPOSALS_SQL}, broken string, admitted array<string>, withdrawn array<string>, findings array<{_FINDING_SQL}>, reviews array<{_REVIEW_SQL}>, plan_sha256 string"


def identities() -> dict[str, str]:
    """What a result depends on besides its text: versions and hashes of rules and policies."""
    rules = canonical([[r.rule_id, r.literals, r.priority, r.exact, r.mode] for r in [*edits.AUTOMATIC, *edits.PROTECTED, *STYLE_RULES]])
    profiles = canonical([V.DIAGNOSTICS, V.PROFILES, V.TARGETS])
    return {"engine": __version__, "facts": facts.policy_hash(), "rules": hashlib.sha256(rules.encode()).hexdigest(), "profiles": hashlib.sha256(profiles.encode()).hexdigest()}


def changes(docs: DataFrame, rules: list[edits.Rule] = edits.AUTOMATIC) -> DataFrame:
    """(doc_id, start, end, rule_id, surface, replacement, revised_start) of accepted edits.

    revised_start is the start moved by the lengths of all earlier edits of the document: a running sum.
    """
    accepted = edits.plans(docs, rules).where("broken = ''").select("doc_id", F.inline(edits.decided("proposals", "accepted")))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("replacement") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    return accepted.select("doc_id", "start", "end", "rule_id", "surface", "replacement", (F.col("start") + shift).cast("long").alias("revised_start"))


def document_findings(text: str, split: Callable[[str], list[str]], as_markdown: bool = False) -> list[dict]:
    """All thirteen diagnostics of one text; its blocks are those of Markdown, or paragraphs between blank lines."""
    if as_markdown:
        blocks = [(b["position"], b["kind"], b["text"]) for b in markdown.blocks(text)]
        prose = markdown.prose(text)[0]
    else:
        blocks = [(k, "paragraph", " ".join(text[a:b].split())) for k, (a, b) in enumerate(segment.paragraph_ranges(text))]
        prose = text
    return observe.of_sentences(prose, split) + observe.of_blocks(blocks)


def admitted(text: str, accepted: list[edits.Proposal], measure: Callable[[str], list[dict]], profile: dict[str, tuple]) -> tuple[list[str], list[str]]:
    """(admitted, withdrawn) rules: those whose edits raise no diagnostic's band over the source's.

    Where all edits together raise none, all are admitted.  Else rules are tried one after the other in the order of their
    ids, each together with those admitted so far; one that raises a band is withdrawn and takes part in no later try.
    """
    groups = sorted({p.rule_id for p in accepted})
    if not groups:
        return [], []
    base = observe.bands(measure(text), profile)

    def rises(names: list[str]) -> bool:
        tried = observe.bands(measure(edits.spliced_text(text, [p for p in accepted if p.rule_id in names])), profile)
        return any(band > base.get(d, 0) for d, band in tried.items())

    if not rises(groups):
        return groups, []
    kept: list[str] = []
    for name in groups:
        if not rises([*kept, name]):
            kept.append(name)
    return kept, [g for g in groups if g not in kept]


def budget(labels: list[str], target: str, new: str, notice: float) -> int:
    """Smallest number of occurrences of ``target`` to turn into ``new`` until no label's share reaches ``notice``; 0 if none does."""
    counts = Counter(labels)
    for k in range(1, counts[target] + 1):
        now = counts - Counter({target: k})
        now[new] += k
        if max(now.values()) / len(labels) < notice:
            return k
    return 0


def density_budget(n_hits: int, n_sentences: int, removable: int, notice: float) -> int:
    """Smallest number of connectives to replace by ones that aren't counted until their density falls below ``notice``."""
    return next((k for k in range(1, removable + 1) if (n_hits - k) / n_sentences < notice), 0)


def reviews(text: str, accepted: list[edits.Proposal], findings: list[dict], find: edits.Matcher, split: Callable[[str], list[str]], profile_name: str) -> list[dict]:
    """Style fixes that a person may approve: for findings that reach the profile's notice, the last occurrences of the label.

    A proposal has to pass the firewall, must not overlap an accepted edit, and there are 25 at most for a diagnostic, as
    the measure defines.
    """
    profile = observe.limits(profile_name)
    sentences = split(text)
    hits = observe.transitions(text, sentences)
    found = [m for m in find(text) if not m[6]]
    out: list[dict] = []
    for f in findings:
        if f["diagnostic"] not in ("REPEATED_TRANSITION", "TRANSITION_DENSITY") or observe.severity(f, profile) not in ("notice", "strong"):
            continue
        notice = profile[f["diagnostic"]][1]
        label = f["label"] if f["diagnostic"] == "REPEATED_TRANSITION" else None
        own = [m for m in found if label in (None, m[4].strip(",").lower())]
        counted = lambda m: bool(observe.transitions(m[5] + " x", [m[5] + " x"]))
        if label is not None:
            n = budget(hits, label, own[0][5].strip(",").lower(), notice) if own else 0
        else:
            own = [m for m in own if not counted(m)]
            n = density_budget(len(hits), len(sentences), len(own), notice)
        passing = [m for m in own if facts.changed(m[4], m[5]) == (Counter(), Counter()) and not any(p.start < m[1] and m[0] < p.end for p in accepted) and not any(r["start"] < m[1] and m[0] < r["end"] for r in out)]
        for start, end, rule_id, _, surface, new, _ in passing[max(0, len(passing) - min(n, PER_DIAGNOSTIC)) :] if n else []:
            identity = hashlib.sha256("\n".join([hashlib.sha256(text.encode()).hexdigest(), profile_name, f["diagnostic"], rule_id, str(start), str(end), new]).encode()).hexdigest()
            out.append({"proposal_id": "SP-" + identity[:16], "diagnostic": f["diagnostic"], "start": start, "end": end, "rule_id": rule_id, "surface": surface, "replacement": new, "budget": n})
    return sorted(out, key=lambda r: (r["start"], r["end"], r["rule_id"]))


def document_plans(docs: DataFrame, profile: str, rules: list[edits.Rule] = edits.AUTOMATIC, split: Callable[[str], list[str]] = segment.split, as_markdown: bool = False) -> DataFrame:
    """One row per document: proposals with their decisions, the guard's choice, findings, review proposals and the plan's hash.

    Edits of a withdrawn rule are decided withdrawn.  Sentences are those of ``split``.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, style, limits = edits.Matcher([*rules, *edits.PROTECTED]), edits.Matcher(STYLE_RULES), observe.limits(profile)
        layout = edits.Layout.of_markdown if as_markdown else edits.Layout.of_text
        measure = lambda t: document_findings(t, split, as_markdown)
        for batch in it:
            rows: dict[str, list] = {name: [] for name in _PLAN.names}
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                own = edits.planned(text, find, layout)
                accepted = [p for p in own if p.decision == "accepted"]
                kept, gone = admitted(text, accepted, measure, limits)
                own = [replace(p, decision="withdrawn") if p.decision == "accepted" and p.rule_id in gone else p for p in own]
                accepted = [p for p in own if p.decision == "accepted"]
                after = edits.spliced_text(text, accepted)
                broken = ",".join(sorted({kind for side in facts.changed(text, after) for kind, _ in side})) if after != text else ""
                findings = measure(text)
                asked = reviews(text, accepted, findings, style, split, profile)
                told = [f | {"severity": observe.severity(f, limits)} for f in findings]
                plan = {"source": hashlib.sha256(text.encode()).hexdigest(), "profile": profile, "proposals": [vars(p) for p in own], "reviews": asked}
                values = (doc_id, text, text if broken else after, plan["proposals"], broken, kept, gone, told, asked, hashlib.sha256(canonical(plan).encode()).hexdigest())
                for name, value in zip(_PLAN.names, values, strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _PLAN], schema=_PLAN)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PLAN_SQL)


def style_guard(docs: DataFrame, profile: str, rules: list[edits.Rule] = edits.AUTOMATIC, split: Callable[[str], list[str]] = segment.split) -> DataFrame:
    """(doc_id, admitted, withdrawn) of documents with accepted edits."""
    return document_plans(docs, profile, rules, split).where("size(admitted) + size(withdrawn) > 0").select("doc_id", "admitted", "withdrawn")


def style_proposals(docs: DataFrame, profile: str, split: Callable[[str], list[str]] = observe.simple_split) -> DataFrame:
    """(doc_id, proposal_id, diagnostic, start, end, rule_id, surface, replacement, budget) for review, never applied by themselves."""
    return document_plans(docs, profile, split=split).select("doc_id", F.inline("reviews"))


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, proposal_id, approved, error) of decisions (doc_id, proposal_id, approve).

    An unknown or twice decided proposal is an error, and one error fails the whole batch of decisions: errors are counted
    first, and their number meets every row.
    """
    known = proposals.select("doc_id", "proposal_id").distinct().withColumn("known", F.lit(True))
    w = Window.partitionBy("doc_id", "proposal_id")
    rows = decisions.withColumn("__n", F.count(F.lit(1)).over(w)).join(known, ["doc_id", "proposal_id"], "left")
    rows = rows.withColumn("error", F.when(F.col("known").isNull(), "unknown proposal").when(F.col("__n") > 1, "decided twice"))
    errors = rows.agg(F.count("error").alias("errors"))
    return rows.join(F.broadcast(errors)).select("doc_id", "proposal_id", (F.col("approve") & (F.col("errors") == 0)).alias("approved"), "error").distinct()


def apply_approved(docs: DataFrame, proposals: DataFrame, decided: DataFrame) -> DataFrame:
    """(doc_id, before, after, status) with approved proposals applied, refused whole if a fact would change."""
    chosen = proposals.join(decided.where("approved").select("doc_id", "proposal_id"), ["doc_id", "proposal_id"])
    applied = edits.apply_edits(docs, chosen.select("doc_id", "start", "end", "rule_id", "replacement"))
    checked = facts.with_differences(applied.select(F.col("doc_id").alias("pair_id"), "before", "after"))
    bad = F.size("differences") > 0
    rows = checked.join(applied.select(F.col("doc_id").alias("pair_id"), "status"), "pair_id")
    return rows.select(F.col("pair_id").alias("doc_id"), "before", F.when(bad, F.col("before")).otherwise(F.col("after")).alias("after"), F.when(bad, "refused").otherwise(F.col("status")).alias("status"))


def present(docs: DataFrame, profile: str, as_markdown: bool = False) -> DataFrame:
    """One row per document: hashes of source, result and plan, status, edits, findings, review proposals, identities."""
    rows = document_plans(docs, profile, as_markdown=as_markdown)
    n = F.when(F.col("broken") != "", F.lit(0)).otherwise(F.size(edits.decided("proposals", "accepted")))
    vetoed = F.size(edits.decided("proposals", "vetoed"))
    status = F.when(n > 0, "applied").when((F.col("broken") != "") | (vetoed > 0), "refused").otherwise("unchanged")
    told = F.filter("findings", lambda f: f["severity"].isin("notice", "strong"))
    known = F.create_map(*[x for k, v in identities().items() for x in (F.lit(k), F.lit(v))])
    return rows.select(
        F.lit("prosemill.present.1").alias("schema"), "doc_id", F.lit(profile).alias("profile"), T.sha256(F.col("before")).alias("source_sha256"), T.sha256(F.col("after")).alias("result_sha256"), "plan_sha256",
        F.col("after").alias("text"), status.alias("status"), n.cast("long").alias("n_edits"), F.filter("proposals", lambda p: p["decision"] != "accepted").alias("refused"), "withdrawn", told.alias("findings"), "reviews", known.alias("identities"),
    )


def diagnose(docs: DataFrame, profile: str, as_markdown: bool = False) -> DataFrame:
    """``present`` without its text, with readability to two decimals."""
    scored = readability.readability(docs.select("doc_id", "text")).select("doc_id", F.round("consensus", 2).alias("consensus"), F.round("flesch_ease", 2).alias("flesch_ease"), "band", "sample_status")
    return present(docs, profile, as_markdown).drop("text").withColumn("schema", F.lit("prosemill.diagnose.1")).join(scored, "doc_id")


def review_bundle(docs: DataFrame, profile: str) -> DataFrame:
    """(doc_id, bundle, sha256): plan, findings, review proposals and identities of a document as canonical JSON."""
    rows = present(docs, profile).drop("text").withColumn("schema", F.lit("prosemill.review.1"))
    packed = rows.select("doc_id", F.to_json(F.struct(*rows.columns)).alias("bundle"))
    return packed.select("doc_id", "bundle", F.sha2("bundle", 256).alias("sha256"))
