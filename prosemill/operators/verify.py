"""Verdicts on (before, after) pairs: ACCEPTED, REFUSED or INCONCLUSIVE, with reasons and a receipt.

A pair is one row and is judged in one Arrow pass.  Facts, protected regions and terms of art decide first.  If nothing
is refused, both sides are brought to the automatic rules' wording and aligned as tokens, a fact or term being one; what
the alignment leaves is accounted for (a rule, an equal fact, a sentence's first capital, a paragraph break, a permitted
move) or is unresolved.  The alignment of two texts that differ throughout takes a time that grows with the product of
their lengths.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from bisect import bisect_right
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import markdown
from ..functions import vocabulary as V
from ..sources.reports import canonical
from . import edits, facts
from .observe import excerpt

VERSION = "3"
# Kinds of facts that a comparator can govern, marks that end a sentence, words and marks that join clauses.
VALUE_KINDS = {"currency", "date", "measurement", "number", "percentage", "time"}
ENDS = {".", "!", "?"}
CLAUSE_WORDS = "although and because but if nor once or since so that then though when whenever where whereas which while who whom whose yet".split()
CLAUSE_MARKS = {";", ":", "(", ")", "—", "–"}
MAX_GAP = 2
_TOKEN = re.compile(r"\n\n|\w+(?:['’]\w+)*|[^\w\s]")
_WORD = re.compile(r"\w+")

_ENTRY = pa.struct([("code", pa.string()), ("kind", pa.string()), ("before", pa.string()), ("after", pa.string()), ("detail", pa.string()), ("before_lines", pa.list_(pa.int32())), ("after_lines", pa.list_(pa.int32()))])
_ENTRY_SQL = "array<struct<code:string,kind:string,before:string,after:string,detail:string,before_lines:array<int>,after_lines:array<int>>>"
_LISTS = ("refusals", "unresolved", "equivalences")
_OUT = pa.schema([("pair_id", pa.int64()), ("verdict", pa.string()), *((name, pa.list_(_ENTRY)) for name in _LISTS), ("error", pa.string()), ("receipt", pa.string())])
_OUT_SQL = f"pair_id long, verdict string, {', '.join(f'{n} {_ENTRY_SQL}' for n in _LISTS)}, error string, receipt string"


def policy() -> dict:
    """All that decides what is accounted for, as plain data."""
    return {"version": VERSION, "value_kinds": sorted(VALUE_KINDS), "ends": sorted(ENDS), "clause_words": sorted(CLAUSE_WORDS), "clause_marks": sorted(CLAUSE_MARKS), "max_gap": MAX_GAP, "token": _TOKEN.pattern, "facts": facts.policy_hash()}


def policy_hash() -> str:
    return hashlib.sha256(canonical(policy()).encode()).hexdigest()


class Token(NamedTuple):
    """kind: fact, term, word, mark or break; key: what makes two tokens equal; at: offset in the prose that was read."""

    kind: str
    key: tuple
    surface: str
    at: int
    fact: str = ""
    put: bool = False

    @property
    def protected(self) -> bool:
        return self.kind in ("fact", "term")

    @property
    def ends(self) -> bool:
        return self.kind == "break" or (self.kind == "mark" and self.surface in ENDS)


@dataclass
class Side:
    """One text of a pair: its prose in the automatic rules' wording as tokens, and what is never rewritten."""

    source: str
    tokens: list[Token] = field(default_factory=list)
    sentence: list[int] = field(default_factory=list)
    regions: list[tuple] = field(default_factory=list)
    rules: list[tuple[str, str, str]] = field(default_factory=list)
    unlocatable: int = 0
    broken: str = ""
    starts: list[tuple[int, int]] = field(default_factory=list)

    def line(self, offset: int) -> int:
        """The line of the source at an offset of the prose; in Markdown that of its block."""
        place = max((s for p, s in self.starts if p <= offset), default=0) if self.starts else offset
        return self.source.count("\n", 0, min(place, len(self.source))) + 1

    def members(self, index: int) -> list[int]:
        return [i for i, s in enumerate(self.sentence) if s == self.sentence[index]]

    def opens(self, index: int) -> bool:
        """Whether a token is the first of its sentence."""
        return index <= 0 or self.tokens[index - 1].ends


def _tokens(text: str, phrases: re.Pattern, put: list[tuple[int, int]], origin) -> Iterator[Token]:
    claimed = [(s, e, "fact", (kind, norm), kind) for s, e, kind, _, norm in facts.extract(text)]
    ends = [c[1] for c in claimed]

    def free(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k == len(ends) or claimed[k][0] >= b

    terms = [(m.start(), m.end(), "term", (" ".join(m[0].lower().split()),), "") for m in phrases.finditer(text) if free(m.start(), m.end())]
    put_ends = [e for _, e in put]

    def rewritten(a: int, b: int) -> bool:
        k = bisect_right(put_ends, a)
        return k < len(put) and put[k][0] < b

    at = 0
    for s, e, kind, key, fact in [*sorted(claimed + terms), (len(text), len(text), "", (), "")]:
        for m in _TOKEN.finditer(text, at, max(at, s)):
            low = m[0].lower()
            of = "break" if m[0] == "\n\n" else "mark" if not (m[0][0].isalnum() or m[0][0] == "_") else "term" if low in V.PROTECTED_TERMS else "word"
            yield Token(of, (of, low if of != "mark" else m[0]), m[0], origin(m.start()), put=rewritten(m.start(), m.end()))
        if kind:
            yield Token(kind, (kind, *key), text[s:e], origin(s), fact, rewritten(s, e))
        at = max(at, e)


def _written(piece: str, part: edits.Part, phrases: re.Pattern) -> list[Token]:
    """The tokens of a piece in the automatic rules' wording, at their offsets in the piece."""
    put, moved, shifts = [], 0, []
    for p in part.proposals:
        if p.decision == "accepted":
            put.append((p.start + moved, p.start + moved + len(p.replacement)))
            moved += len(p.replacement) - (p.end - p.start)
            shifts.append((put[-1][1], moved))
    reached = [end for end, _ in shifts]
    origin = lambda at: at - (shifts[k - 1][1] if (k := bisect_right(reached, at)) else 0)
    return list(_tokens(part.after, phrases, put, origin))


def prepared(source: str, find: edits.Matcher, phrases: re.Pattern, as_markdown: bool) -> Side:
    """Normalise and tokenise one text.  Rules that the firewall stops together explain nothing, and that is said."""
    side = Side(source)
    text = source
    if as_markdown:
        text, side.starts = markdown.prose(source)
        side.regions = markdown.regions(source)
        side.unlocatable = sum(b["kind"] == "code" and source[b["start"] :].lstrip()[:3] in ("```", "~~~") and source[b["start"] : b["end"]].rstrip()[-3:] not in ("```", "~~~") for b in markdown.blocks(source))
    own = edits.parts(text, find)
    accepted = [p for _, part in own for p in part.proposals if p.decision == "accepted"]
    lost = edits.lost_kinds(own)
    if lost:
        side.broken, accepted = ",".join(lost), []
    side.rules = [(p.rule_id, p.surface, p.replacement) for p in accepted]
    if lost:
        side.tokens = list(_tokens(text, phrases, [], int))
    else:
        # No fact, term or token lies across a cut, so a piece that texts share is read once.
        ends = [*(at for at, _ in own[1:]), len(text)]
        for (at, part), end in zip(own, ends, strict=True):
            piece = text[at:end]
            tokens = find.tokens.get(piece) if len(own) > 1 else None
            if tokens is None:
                tokens = _written(piece, part, phrases)
                if len(own) > 1 and len(piece) <= facts.KEPT_LENGTH:
                    find.tokens[piece] = tokens
                    if len(find.tokens) > facts.KEPT:
                        find.tokens.popitem(last=False)
            else:
                find.tokens.move_to_end(piece)
            side.tokens += [Token(kind, key, surface, place + at, fact, put) for kind, key, surface, place, fact, put in tokens] if at else tokens
    number = 0
    for t in side.tokens:
        side.sentence.append(number)
        number += t.ends
    return side


def _units(side: Side) -> list[tuple[int, int]]:
    """(first, last) of phrases that may move: a comparator and the value it governs, no negation before it."""
    out = []
    for i, t in enumerate(side.tokens):
        if t.fact != "comparator" or (i and side.tokens[i - 1].fact == "negation"):
            continue
        ahead = side.tokens[i + 1 : i + 2 + MAX_GAP]
        j = next((k for k, u in enumerate(ahead) if u.protected or u.ends), None)
        if j is not None and ahead[j].fact in VALUE_KINDS and all(u.kind == "word" for u in ahead[:j]):
            out.append((i, i + 1 + j))
    return out


def _rest(side: Side, unit: tuple[int, int]) -> list[tuple] | None:
    """What a unit's sentence says besides it; None unless it is one clause with the unit at one of its ends."""
    comma = ("mark", ",")
    own = [i for i in side.members(unit[0]) if not side.tokens[i].ends]
    outside = [i for i in own if not unit[0] <= i <= unit[1]]
    loose = [i for i in outside if side.tokens[i].key == comma and i not in (unit[0] - 1, unit[1] + 1)]
    rest = [side.tokens[i] for i in outside if side.tokens[i].key != comma]
    core = [i for i in own if side.tokens[i].key != comma]
    at_end = unit[0] == core[0] or unit[1] == core[-1]
    joined = any(t.key[1] in CLAUSE_WORDS if t.kind == "word" else t.surface in CLAUSE_MARKS if t.kind == "mark" else t.fact == "comparator" for t in rest)
    return None if loose or joined or not at_end else [t.key for t in rest]


class Comparison:
    """One pair under examination; ``run`` fills refusals, unresolved and equivalences."""

    def __init__(self, before: Side, after: Side):
        self.sides = before, after
        self.refusals: list[dict] = []
        self.unresolved: list[dict] = []
        self.equivalences: list[dict] = []

    def _entry(self, code: str, kind: str, detail: str, before: list | str = "", after: list | str = "", at: tuple[list[int], list[int]] = ((), ())) -> dict:
        texts = [x if isinstance(x, str) else excerpt(" ".join(t.surface for t in x if t.kind != "break"), 200) for x in (before, after)]
        lines = [sorted({side.line(o) for o in offsets}) for side, offsets in zip(self.sides, at, strict=True)]
        return {"code": code, "kind": kind, "detail": detail, "before": texts[0], "after": texts[1], "before_lines": lines[0], "after_lines": lines[1]}

    def _between(self, code: str, kind: str, detail: str, x: list[Token], y: list[Token]) -> dict:
        return self._entry(code, kind, detail, x, y, tuple([t.at for t in side if t.kind != "break"] for side in (x, y)))

    def run(self) -> str:
        b, a = self.sides
        if b.source != a.source:
            self._facts()
            self._regions()
            self._terms()
            for side, name in ((b, "before"), (a, "after")):
                if side.unlocatable:
                    self.unresolved.append(self._entry("unlocatable_structure", name, f"{side.unlocatable} part(s) of the {name} text have no certain end"))
                if side.broken:
                    self.unresolved.append(self._entry("normalisation_unavailable", name, f"rules would change facts of the {name} text: {side.broken}"))
            if not self.refusals:
                self._align()
            if not (self.refusals or self.unresolved or self.equivalences):
                self.equivalences.append(self._entry("formatting", "layout", "only white space, line breaks or inline marks differ"))
        return "REFUSED" if self.refusals else "INCONCLUSIVE" if self.unresolved else "ACCEPTED"

    def _facts(self) -> None:
        """The firewall over both sources; facts without a counterpart in order are pointed at by their neighbours' words."""
        sources = [s.source for s in self.sides]
        broken = facts._difference(*sources)
        if not broken:
            return
        found = [facts.extract(s) for s in sources]
        around = [[(f[2], f[4], *([*map(str.lower, _WORD.findall(s[max(0, f[0] - 40) : f[0]]))] or [""])[-1:], *([*map(str.lower, _WORD.findall(s[f[1] : f[1] + 40]))] or [""])[:1]) for f in fs] for s, fs in zip(sources, found, strict=True)]
        odd: tuple[list, list] = ([], [])
        for tag, i, j, k, m in difflib.SequenceMatcher(None, *around, autojunk=False).get_opcodes():
            if tag != "equal":
                odd[0].extend(found[0][i:j])
                odd[1].extend(found[1][k:m])
        for d in broken:
            lines = [sorted({s.source.count("\n", 0, f[0]) + 1 for f in fs if f[2] == d["kind"] and f[4] in d[f"{side}_facts"]}) for s, fs, side in zip(self.sides, odd, ("lost", "introduced"), strict=True)]
            detail = "changed" if d["lost_facts"] and d["introduced_facts"] else "removed" if d["lost_facts"] else "introduced"
            self.refusals.append(self._entry("protected_fact_changed", d["kind"], detail, ", ".join(d["lost_surfaces"]), ", ".join(d["introduced_surfaces"])) | {"before_lines": lines[0], "after_lines": lines[1]})

    def _regions(self) -> None:
        x, y = (s.regions for s in self.sides)
        for tag, i, j, k, m in difflib.SequenceMatcher(None, [r[1] for r in x], [r[1] for r in y], autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            kinds = ", ".join(sorted({r[0] for r in x[i:j] + y[k:m]}))
            verb = {"replace": "changed", "delete": "removed", "insert": "added"}[tag]
            lines = [[s.source.count("\n", 0, r[3]) + 1 for r in rs] for s, rs in zip(self.sides, (x[i:j], y[k:m]), strict=True)]
            self.refusals.append(self._entry("protected_region_changed", kinds, verb, " | ".join(excerpt(r[2], 160) for r in x[i:j]), " | ".join(excerpt(r[2], 160) for r in y[k:m])) | {"before_lines": lines[0], "after_lines": lines[1]})

    def _terms(self) -> None:
        counts = [Counter(t.key[1] for t in s.tokens if t.kind == "term") for s in self.sides]
        gone, new = counts[0] - counts[1], counts[1] - counts[0]
        if gone or new:
            detail = "changed" if gone and new else "removed" if gone else "introduced"
            at = tuple([t.at for t in s.tokens if t.kind == "term" and t.key[1] in more] for s, more in zip(self.sides, (gone, new), strict=True))
            self.refusals.append(self._entry("protected_term_changed", "term", detail, ", ".join(sorted(gone.elements())), ", ".join(sorted(new.elements())), at))

    def _align(self) -> None:
        b, a = self.sides
        counts = [Counter(t.key for t in s.tokens if t.kind == "fact") for s in self.sides]
        if counts[0] != counts[1]:
            show = lambda c: ", ".join(sorted(k[2] for k in c.elements()))
            self.unresolved.append(self._entry("protected_item_unmatched", "fact", "the prose of both texts holds different facts", show(counts[0] - counts[1]), show(counts[1] - counts[0])))
            return
        codes = self._opcodes([t.key for t in b.tokens], [t.key for t in a.tokens])
        partner = {i + n: k + n for tag, i, j, k, _ in codes if tag == "equal" for n in range(j - i)}
        # Sentences correspond when an aligned token that ends neither lies in both.
        akin = {(b.sentence[i], a.sentence[k]) for i, k in partner.items() if not b.tokens[i].ends}
        moved = self._moves(partner, akin)
        far = self._relocated(codes, akin, moved)
        for tag, i, j, k, m in codes:
            if tag == "equal":
                self._equal(i, j, k)
            else:
                self._changed(i, j, k, m, moved, far)
        used = [Counter(s.rules) for s in self.sides]
        for more, how in ((used[0] - used[1], ""), (used[1] - used[0], " in reverse")):
            for rule, surface, new in sorted(more.elements()):
                self.equivalences.append(self._entry("safe_rule", rule, "an automatic rule" + how, *((new, surface) if how else (surface, new))))

    @staticmethod
    def _opcodes(x: list[tuple], y: list[tuple]) -> list[tuple]:
        """Alignment with the common ends cut off first."""
        lo = 0
        while lo < min(len(x), len(y)) and x[lo] == y[lo]:
            lo += 1
        hi = 0
        while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
            hi += 1
        m, n = len(x) - hi, len(y) - hi
        middle = difflib.SequenceMatcher(None, x[lo:m], y[lo:n], autojunk=False).get_opcodes()
        return [c for c in [("equal", 0, lo, 0, lo), *((t, i + lo, j + lo, k + lo, l + lo) for t, i, j, k, l in middle), ("equal", m, len(x), n, len(y))] if c[1] < c[2] or c[3] < c[4]]

    def _equal(self, i: int, j: int, k: int) -> None:
        b, a = self.sides
        for p, q in zip(range(i, j), range(k, k + j - i), strict=True):
            x, y = b.tokens[p], a.tokens[q]
            if x.surface == y.surface:
                continue
            if x.kind == "fact":
                if x.surface.lower() != y.surface.lower():
                    self.equivalences.append(self._between("fact_equivalence", x.fact, "the same fact", [x], [y]))
            elif not (x.put or y.put) and b.opens(p) == a.opens(q):
                self.unresolved.append(self._between("unexplained_change", "capitals", "capitals changed within a sentence", [x], [y]))

    def _changed(self, i: int, j: int, k: int, m: int, moved: tuple[set[int], set[int]], far: tuple[dict, dict]) -> None:
        b, a = self.sides
        spans = range(i, j), range(k, m)
        touched = any(p in own for span, own in zip(spans, moved, strict=True) for p in span)
        left = [[s.tokens[p] for p in span if p not in own and not (touched and s.tokens[p].key == ("mark", ","))] for s, span, own in zip(self.sides, spans, moved, strict=True)]
        x, y = b.tokens[i:j], a.tokens[k:m]
        if not any(left):
            return
        if all(t.kind == "break" for t in [*left[0], *left[1]]) and b.opens(i) and a.opens(k):
            self.equivalences.append(self._entry("formatting", "paragraph", "a paragraph break between sentences came or went"))
            return
        where = {own.get(p) for span, own in zip(spans, far, strict=True) for p in span} - {None}
        if where:
            detail = "a protected item moved " + ("to another sentence" if "sentence" in where else "within its sentence")
            self.unresolved.append(self._between("protected_item_moved", "wording", detail, x, y))
        else:
            around = any(t.protected for side in left for t in side)
            self.unresolved.append(self._between("unexplained_change", "wording", "wording changed" + (" around protected items" if around else ""), x, y))

    def _moves(self, partner: dict[int, int], akin: set[tuple[int, int]]) -> tuple[set[int], set[int]]:
        """Places, on both sides, of comparator phrases whose move is permitted; if any other order changed, none is."""
        order = [[i for i, t in enumerate(s.tokens) if t.protected] for s in self.sides]
        keys = [[s.tokens[i].key for i in at] for s, at in zip(self.sides, order, strict=True)]
        if keys[0] == keys[1]:
            return set(), set()
        units = [_units(s) for s in self.sides]
        inside = [{i for u in us for i in range(u[0], u[1] + 1)} for us in units]
        fixed = [[s.tokens[i].key for i in at if i not in own] for s, at, own in zip(self.sides, order, inside, strict=True)]
        named = [[tuple(t.key for t in s.tokens[u[0] : u[1] + 1]) for u in us] for s, us in zip(self.sides, units, strict=True)]
        pairs = []
        allowed = fixed[0] == fixed[1] and Counter(named[0]) == Counter(named[1])
        if allowed:
            waiting: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
            for u, name in zip(units[1], named[1], strict=True):
                waiting[name].append(u)
            for u, name in zip(units[0], named[0], strict=True):
                v = waiting[name].pop(0)
                if all(partner.get(p) == q for p, q in zip(range(u[0], u[1] + 1), range(v[0], v[1] + 1), strict=True)):
                    continue
                rest = _rest(self.sides[0], u)
                if (self.sides[0].sentence[u[0]], self.sides[1].sentence[v[0]]) not in akin or rest is None or rest != _rest(self.sides[1], v):
                    allowed = False
                    break
                pairs.append((u, v))
        if not allowed:
            kept = difflib.SequenceMatcher(None, *keys, autojunk=False).get_matching_blocks()
            stay = [{at[block[side] + n] for block in kept for n in range(block.size)} for side, at in enumerate(order)]
            out = [[s.tokens[i] for i in at if i not in own] for s, at, own in zip(self.sides, order, stay, strict=True)]
            self.unresolved.append(self._between("protected_item_moved", "order", "protected items stand in another order", *out))
            return set(), set()
        for u, v in pairs:
            spans = [s.tokens[w[0] : w[1] + 1] for s, w in zip(self.sides, (u, v), strict=True)]
            self.equivalences.append(self._between("permitted_move", "comparator", "a comparator and its value moved between the ends of a one-clause sentence", *spans))
        return tuple({i for pair in pairs for i in range(pair[side][0], pair[side][1] + 1)} for side in (0, 1))

    def _relocated(self, codes: list[tuple], akin: set[tuple[int, int]], moved: tuple[set[int], set[int]]) -> tuple[dict, dict]:
        """How far the counterparts of protected items in changed stretches are: sentence, place, or not named where near."""
        stretch: tuple[dict, dict] = ({}, {})
        for n, (tag, *ends) in enumerate(codes):
            if tag != "equal":
                for side in (0, 1):
                    stretch[side].update({i: n for i in range(ends[2 * side], ends[2 * side + 1]) if self.sides[side].tokens[i].protected and i not in moved[side]})
        far: tuple[dict, dict] = ({}, {})
        waiting: dict[tuple, list[int]] = defaultdict(list)
        for q in sorted(stretch[1]):
            waiting[self.sides[1].tokens[q].key].append(q)
        for p in sorted(stretch[0]):
            same = waiting[self.sides[0].tokens[p].key]
            if not same:
                far[0][p] = "sentence"
                continue
            q = same.pop(0)
            if (self.sides[0].sentence[p], self.sides[1].sentence[q]) not in akin:
                far[0][p] = far[1][q] = "sentence"
            elif stretch[0][p] != stretch[1][q]:
                far[0][p] = far[1][q] = "place"
        far[1].update({q: "sentence" for same in waiting.values() for q in same})
        return far


def _examiner(rules: list[edits.Rule]) -> tuple[edits.Matcher, re.Pattern]:
    return edits.Matcher([*rules, *edits.PROTECTED]), re.compile(r"\b(?:" + "|".join(p.replace(" ", r"\s+") for p in edits.PROTECTED_PHRASES) + r")\b", re.I)


def examined(before: str, after: str, find: edits.Matcher, phrases: re.Pattern, as_markdown: bool = False) -> tuple[str, str | None, Comparison | None]:
    """(verdict, error, comparison) of a pair; None where nothing had to be compared."""
    if not (before.strip() and after.strip()):
        return "INCONCLUSIVE", "empty_input", None
    if before == after:
        return "ACCEPTED", None, None
    c = Comparison(prepared(before, find, phrases, as_markdown), prepared(after, find, phrases, as_markdown))
    return c.run(), None, c


_RUN = re.compile("[0-9]+")
_SPLIT = re.compile("[0-9],[0-9]")
_AS_ZERO = str.maketrans("123456789", "000000000")
#: Characters of a pair up to which it is judged by its likeness.
ALIKE_LENGTH = 8192


def likeness(before: str, after: str) -> tuple | None:
    """What a verdict on plain texts depends on: all but the digits, and which runs of digits are equal.

    No pattern and no rule asks which digit stands somewhere, and facts and words are only asked whether they are equal, so two
    pairs of one likeness have one verdict.  None where that isn't known: commas within a number don't count when amounts are
    compared, and a long pair is not kept.
    """
    pair = f"{before}\0{after}"
    if len(pair) > ALIKE_LENGTH or "\0" in before or _SPLIT.search(pair):
        return None
    seen: dict[str, int] = {}
    return pair.translate(_AS_ZERO), tuple([seen.setdefault(run, len(seen)) for run in _RUN.findall(pair)])


def _whole_runs(text: str) -> bool:
    """Whether no fact of a text begins or ends within a run of digits."""
    inside = lambda k: 0 < k < len(text) and text[k - 1] in "0123456789" and text[k] in "0123456789"
    return not any(inside(f[0]) or inside(f[1]) for f in facts.extract(text))


class _Judge:
    """Verdicts alone; those of plain pairs are kept by their likeness."""

    def __init__(self, rules: list[edits.Rule], as_markdown: bool):
        self.find, self.phrases = _examiner(rules)
        self.as_markdown = as_markdown
        self.alike = not as_markdown and self.find.digitless and facts.SHAPED and not any(map(_RUN.search, [*V.PROTECTED_TERMS, *edits.PROTECTED_PHRASES]))
        self.kept: OrderedDict[tuple, str] = OrderedDict()

    def __call__(self, before: str, after: str) -> str:
        key = likeness(before, after) if self.alike else None
        verdict = None if key is None else self.kept.get(key)
        if verdict is not None:
            self.kept.move_to_end(key)
            return verdict
        verdict, _, c = examined(before, after, self.find, self.phrases, self.as_markdown)
        texts = [before, after] if c is None else [before, after, *("".join([part.after for _, part in edits.parts(t, self.find)]) for t in (before, after))]
        if key is not None and all(map(_whole_runs, texts)):
            self.kept[key] = verdict
            if len(self.kept) > facts.KEPT:
                self.kept.popitem(last=False)
        return verdict


def judged(pairs: DataFrame, rules: list[edits.Rule] = edits.AUTOMATIC, as_markdown: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(pair_id, verdict and the columns to carry) of pairs (pair_id, before, after): the verdicts of ``verify`` alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(rules, as_markdown)
        for batch in it:
            verdicts = [judge(b or "", a or "") for b, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdicts, pa.string()), *batch.columns[3:]], names=["pair_id", "verdict", *carry])

    rows = pairs.select(F.col("pair_id").cast("long"), "before", "after", *carry)
    return rows.mapInArrow(run, StructType([*StructType.fromDDL("pair_id long, verdict string").fields, *rows.schema.fields[3:]]))


def verify(pairs: DataFrame, rules: list[edits.Rule] = edits.AUTOMATIC, as_markdown: bool = False) -> DataFrame:
    """(pair_id, verdict, refusals, unresolved, equivalences, error, receipt) of pairs (pair_id, before, after).

    A blank side is an error, empty_input: nothing was verified, so the verdict is INCONCLUSIVE.  Entries say what changed
    and on which lines (of a Markdown text: of which blocks).  The receipt is the SHA-256 of both texts' hashes, the
    verdict, all entries and the policies.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, phrases = _examiner(rules)
        identity = policy_hash()
        for batch in it:
            rows: dict[str, list] = {name: [] for name in _OUT.names}
            for pair_id, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, after = before or "", after or ""
                verdict, error, c = examined(before, after, find, phrases, as_markdown)
                found = {name: [] if c is None else getattr(c, name) for name in _LISTS}
                hashes = [hashlib.sha256(t.encode()).hexdigest() for t in (before, after)]
                receipt = hashlib.sha256(canonical({"policy": identity, "texts": hashes, "verdict": verdict, "error": error, "findings": found}).encode()).hexdigest()
                for name, value in {"pair_id": pair_id, "verdict": verdict, **found, "error": error, "receipt": receipt}.items():
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _OUT], schema=_OUT)

    return pairs.select(F.col("pair_id").cast("long"), "before", "after").mapInArrow(run, _OUT_SQL)
