"""Protected facts of a text, and the firewall that compares them.

Extraction needs offsets and ordered claiming, which no SQL function offers, so it is one Arrow pass over the texts.
A pair of texts is one row, so the multiset difference of its facts is made in that pass too, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocabulary as V

POLICY_VERSION = "1"


def _longest(items: list[str]) -> str:
    return "|".join(sorted(map(re.escape, items), key=len, reverse=True))


# The pattern of each kind, in the order in which they claim text.
NUMBER = r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[+-]?\d+(?:\.\d+)?"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
_SYMBOL, _CODE, _UNIT = _longest(list(V.CURRENCY_SYMBOLS)), _longest(V.CURRENCY_CODES), _longest(V.UNITS)
_COMPARATOR = "|".join(sorted((c.replace(" ", r"\s+") for c in V.COMPARATORS), key=len, reverse=True))
KINDS = [
    ("url", r"\b(?:https?|ftp)://[^\s<>\"')\]]+"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("cve", r"\bCVE-\d{4}-\d{4,7}\b"),
    ("hash", r"\b[0-9a-fA-F]{32,128}\b"),
    ("path", r"[A-Za-z]:[\\/](?:[^\s<>:\"|?*]+[\\/])*[^\s<>:\"|?*]+"),
    ("path", r"(?:\.{1,2}[\\/])(?:[^\s<>:\"|?*]+[\\/])*[^\s<>:\"|?*]+"),
    ("path", r"(?<![\w.])/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"),
    ("version", r"\bv\d+(?:\.\d+){1,3}(?:-[0-9A-Za-z.]+)?\b"),
    ("version", r"\b\d+\.\d+\.\d+(?:\.\d+)?(?:-[0-9A-Za-z.]+)?\b"),
    ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("date", r"\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b"),
    ("date", rf"\b\d{{1,2}}\s+(?:{MONTHS})\.?\s+\d{{4}}\b"),
    ("date", rf"\b(?:{MONTHS})\.?\s+\d{{1,2}},\s*\d{{4}}\b"),
    ("time", r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s*[ap]\.?m\.?)?\b"),
    ("time", r"\b\d{1,2}\s*[ap]\.?m\.?(?![a-z])"),
    ("currency", rf"(?:{_SYMBOL})\s?(?:{NUMBER})"),
    ("currency", rf"\b(?:{_CODE})\s?(?:{NUMBER})"),
    ("currency", rf"(?:{NUMBER})\s?(?:{_CODE})\b"),
    ("percentage", rf"(?:{NUMBER})\s?%"),
    ("percentage", rf"(?:{NUMBER})\s+per\s?cent(?:age)?\b"),
    ("percentage", rf"(?:{NUMBER})\s+percent\b"),
    ("measurement", rf"(?:{NUMBER})\s?(?:{_UNIT})(?![A-Za-z0-9])"),
    ("number", NUMBER),
    ("comparator", rf"\b(?:{_COMPARATOR})\b"),
    ("negation", r"\b[A-Za-z]+n't\b"),
    ("negation", rf"\b(?:{_longest(V.NEGATIONS)})\b"),
    ("modal", rf"\b(?:{_longest(V.MODALS)})\b"),
]
FOLDED = {"negation", "modal", "comparator", "cve", "date", "time", "version", "percentage", "url"}
TRIMMED, TRIM = {"url", "path", "email", "time"}, ".,;:!?"

_PATTERNS = [(kind, re.compile(p, re.I if kind in FOLDED else 0)) for kind, p in KINDS]
_AMOUNT = re.compile(NUMBER)
# Signs without which a pattern of ``KINDS`` isn't found, one of each group: 0 for digits, a and A for letters.
_WORD, _SIGN, _SLASH = "aA", "".join(c for c in V.CURRENCY_SYMBOLS if len(c) == 1), "/\\"
_NEEDED = [
    (":",), ("@",), ("-",), ("-", "0"), ("0" + _WORD,), (":", _SLASH), (".", _SLASH), ("/",), (".", "0", _WORD), (".", "0"), ("-", "0"), ("/.", "0"), ("0", _WORD), ("0", _WORD, ","),
    (":", "0"), ("0", _WORD), (_SIGN + "A", "0"), ("A", "0"), ("A", "0"), ("%", "0"), ("0", _WORD), ("0", _WORD), ("0", _WORD), ("0",), (_WORD,), (_WORD, "'"), (_WORD,), (_WORD,),
]


class _Signs(dict):
    """What stands for a character in ``_NEEDED``; beyond ASCII, signs of currencies aside, it may stand for any."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdecimal() else c if c in _SIGN else "?" if not c.isascii() else "a" if c.islower() else "A" if c.isupper() else c
        return self[code]


_OF_SIGN = _Signs()


@lru_cache(1 << 14)
def _tried(signs: frozenset) -> list[int]:
    """The patterns that may be found in a text of these signs."""
    return [k for k, groups in enumerate(_NEEDED) if all("?" in signs or not signs.isdisjoint(g) for g in groups)]


# No pattern matches across a sentence's end before a letter, nor looks beyond it.
_CUT = re.compile(r"[.!?]\s+(?=[A-Za-z])")
#: Pieces of a text whose facts are kept, and their longest.
KEPT, KEPT_LENGTH = 1 << 14, 1000
# Words that facts of several words hold, in lower case, and currencies that a number may follow within a word.
_LINKED = {w.lower() for w in [*MONTHS.split("|"), *V.UNITS, *V.CURRENCY_CODES, *V.CURRENCY_SYMBOLS, *V.NEGATIONS, *V.MODALS, *" ".join(V.COMPARATORS).split(), *"a p am pm m per cent centage percent percentage".split()]}
_ENDINGS = tuple(c for c in V.CURRENCY_SYMBOLS if c[-1].isalpha())
_SOLID = re.compile(r"\S+")
_DIGIT = re.compile("[0-9]")
#: Whether the vocabulary leaves it to the patterns which places digits take.
SHAPED = not any(map(_DIGIT.search, [*MONTHS.split("|"), *V.UNITS, *V.CURRENCY_CODES, *V.CURRENCY_SYMBOLS, *V.NEGATIONS, *V.MODALS, *V.COMPARATORS, *V.EQUAL_COMPARATORS]))
_FACTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surface", pa.string()), ("normalized", pa.string())]))
FACT_TYPE = "array<struct<start:int,end:int,kind:string,surface:string,normalized:string>>"


def policy_hash() -> str:
    """SHA-256 of everything that changes what is extracted or compared, as canonical JSON."""
    policy = {"version": POLICY_VERSION, "kinds": KINDS, "folded": sorted(FOLDED), "trimmed": sorted(TRIMMED), "trim": TRIM, "equal": V.EQUAL_COMPARATORS, "symbols": V.CURRENCY_SYMBOLS}
    return hashlib.sha256((json.dumps(policy, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n").encode()).hexdigest()


def amount(s: str) -> str:
    """A number without thousands separators and leading plus; minus and trailing zeros stay."""
    return s.replace(",", "").strip().removeprefix("+")


def _flat(s: str) -> str:
    return " ".join(s.split())


def _low(s: str) -> str:
    return _flat(s).lower()


def _quantity(s: str) -> tuple[str, str]:
    """The amount in a surface, and what stands beside it."""
    m = _AMOUNT.search(s)
    return amount(m[0]), f"{s[: m.start()]}{s[m.end() :]}".strip()


def _money(s: str) -> str | None:
    value, beside = _quantity(s)
    code = V.CURRENCY_SYMBOLS.get(beside, beside.upper())
    return f"{code} {value}" if code in V.CURRENCY_SYMBOLS.values() or code in V.CURRENCY_CODES else None


def _measured(s: str) -> str | None:
    value, unit = _quantity(s)
    return f"{value} {unit}" if unit else None


#: What makes two surfaces of a kind the same fact; a kind that isn't here keeps its surface.
IDENTITY: dict[str, Callable[[str], str | None]] = {
    "negation": lambda s: "NEG",
    "comparator": lambda s: V.EQUAL_COMPARATORS.get(_low(s), _low(s)),
    "date": _flat,
    "number": amount,
    "percentage": lambda s: _quantity(s)[0] + "%",
    "currency": _money,
    "measurement": _measured,
    **dict.fromkeys(("modal", "time", "cve", "uuid", "hash"), _low),
}


def cuts(text: str) -> list[int]:
    """Where the pieces of a text begin whose facts don't depend on each other."""
    return [0, *(m.end() for m in _CUT.finditer(text))]


def _pieces(text: str) -> list[str]:
    at = cuts(text)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)] if len(at) > 1 else [text]


def _claimed(text: str) -> list[tuple[int, int, str, str, str]]:
    starts: list[int] = []
    facts_at: dict[int, tuple[int, int, str, str, str]] = {}
    tried = [_PATTERNS[k] for k in _tried(frozenset(text.translate(_OF_SIGN)))]
    for kind, m in ((kind, m) for kind, pattern in tried for m in pattern.finditer(text)):
        surface = m[0].rstrip(TRIM) if kind in TRIMMED else m[0]
        start, end = m.start(), m.start() + len(surface)
        place = bisect(starts, start)
        free = surface and (place == 0 or facts_at[starts[place - 1]][1] <= start) and (place == len(starts) or end <= starts[place])
        identity = IDENTITY.get(kind, str)(surface) if free else None
        if identity is not None:
            starts.insert(place, start)
            facts_at[start] = (start, end, kind, surface, identity)
    return [facts_at[s] for s in starts]


@lru_cache(KEPT)
def _plain(word: str) -> bool:
    """Whether no fact holds or touches a word that stands between white space; 32 letters may be a hash."""
    return word.isascii() and word.isalpha() and len(word) < 32 and word.lower() not in _LINKED and not word.endswith(_ENDINGS)


@lru_cache(KEPT)
def _kept(piece: str) -> list[tuple[int, int, str, str, str]]:
    """``_claimed`` by runs of what stands between plain words, which repeat more often than whole pieces do."""
    runs: list[tuple[int, int]] = []
    open_ = False
    for m in _SOLID.finditer(piece):
        if _plain(m[0]):
            open_ = False
        elif open_:
            runs[-1] = runs[-1][0], m.end()
        else:
            runs.append(m.span())
            open_ = True
    if runs == [(0, len(piece))]:
        return _claimed(piece)
    return [(start + a, end + a, kind, surface, identity) for a, b in runs for start, end, kind, surface, identity in _facts_of(piece[a:b])]


def _facts_of(piece: str) -> list[tuple[int, int, str, str, str]]:
    return _kept(piece) if len(piece) <= KEPT_LENGTH else _claimed(piece)


def extract(text: str) -> list[tuple[int, int, str, str, str]]:
    """Facts in document order: start, end, kind, surface, identity.

    Kinds claim text in the order of ``KINDS``.  What touches an earlier claim, or has no identity, is no fact and is
    never shortened to one.
    """
    out, at = [], 0
    for piece in _pieces(text):
        out += [(start + at, end + at, kind, surface, identity) for start, end, kind, surface, identity in _facts_of(piece)]
        at += len(piece)
    return out


def _window(text: str, start: int, end: int) -> tuple[int, int]:
    """From the plain word before a span to the one behind it: no fact outside depends on what stands in the span."""
    first, last, base = 0, len(text), start
    while base and not first:
        base = max(0, start - max(80, 8 * (start - base)))
        before = [m for m in _SOLID.finditer(text, base, start) if m.end() < start and (m.start() > base or base == 0)]
        first = next((m.end() for m in reversed(before) if _plain(m[0])), 0)
    for m in _SOLID.finditer(text, end):
        if m.start() > end and _plain(m[0]):
            last = m.start()
            break
    return first, last


def _sides(text: str, edits: list[tuple[int, int, str]]) -> Iterator[tuple[str, str]]:
    """What stands around edits (start, end, replacement), in order and apart, before and after them; outside no fact changes."""
    windows: list[list] = []
    for edit in edits:
        first, last = _window(text, *edit[:2])
        if windows and first < windows[-1][1]:
            windows[-1][1] = max(last, windows[-1][1])
            windows[-1][2].append(edit)
        else:
            windows.append([first, last, [edit]])
    for first, last, own in windows:
        after, at = [], first
        for start, end, new in own:
            after += [text[at:start], new]
            at = end
        yield text[first:last], "".join([*after, text[at:last]])


def net(text: str, edits: list[tuple[int, int, str]]) -> dict[tuple[str, str], int]:
    """How many more or fewer of each (kind, identity) a text holds after edits (start, end, replacement), in order and apart."""
    out: Counter = Counter()
    for before, after in _sides(text, edits):
        lost, introduced = changed(before, after)
        for sign, side in ((-1, lost), (1, introduced)):
            for fact, n in side.items():
                out[fact] += sign * n
    return {fact: n for fact, n in out.items() if n}


def _numbered(text: str) -> list[tuple[str, str, int]]:
    """(kind, surface, how many digits stand before it) of the facts that hold ASCII digits."""
    out, at, seen = [], 0, 0
    for start, _, kind, surface, _ in extract(text):
        seen += len(_DIGIT.findall(text, at, start))
        at = start
        if _DIGIT.search(surface):
            out.append((kind, surface, seen))
    return out


def digits_stay(text: str, edits: list[tuple[int, int, str]]) -> bool:
    """Whether ``net`` is the same for every text that differs from this one in its ASCII digits alone.

    No pattern asks which digit stands somewhere, so such texts hold facts of the same kinds at the same places.  Where edits
    without digits leave each fact that holds digits with the same digits and signs, these facts cancel whatever they are.
    """
    return SHAPED and all(_numbered(before) == _numbered(after) for before, after in _sides(text, edits))


def changed(before: str, after: str) -> tuple[Counter, Counter]:
    """(lost, introduced) multisets of (kind, identity) between two texts; pieces that both begin or end with are equal."""
    x, y = _pieces(before), _pieces(after)
    same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    x, y = x[same:], y[same:]
    while x and y and x[-1] == y[-1]:
        x.pop()
        y.pop()
    a, b = ([(f[2], f[4]) for piece in side for f in _facts_of(piece)] for side in (x, y))
    if a == b:
        return Counter(), Counter()
    a, b = Counter(a), Counter(b)
    return a - b, b - a


def with_facts(rows: DataFrame, *columns: str) -> DataFrame:
    """Add for each text column c an array column c_facts."""
    names = rows.columns
    at = [names.index(c) for c in columns]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("start", "end", "kind", "surface", "normalized")
        for batch in it:
            new = [pa.array([[dict(zip(keys, f, strict=True)) for f in extract(t or "")] for t in batch.column(k).to_pylist()], _FACTS) for k in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *(f"{c}_facts" for c in columns)])

    added = StructType.fromDDL(", ".join(f"{c}_facts {FACT_TYPE}" for c in columns))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, surface, normalized) of every document (doc_id, text); offsets in code points."""
    return with_facts(docs.select("doc_id", "text"), "text").select("doc_id", F.inline("text_facts"))


def signature(found: DataFrame) -> DataFrame:
    """The multiset (doc_id, kind, normalized, n) of facts."""
    return found.groupBy("doc_id", "kind", "normalized").agg(F.count(F.lit(1)).alias("n"))


_DIFFERENCES = pa.list_(pa.struct([("kind", pa.string()), *((f"{side}_{what}", pa.list_(pa.string())) for side in ("lost", "introduced") for what in ("facts", "surfaces"))]))
_DIFFERENCES_SQL = "array<struct<kind:string,lost_facts:array<string>,lost_surfaces:array<string>,introduced_facts:array<string>,introduced_surfaces:array<string>>>"


def _difference(before: str, after: str) -> list[dict]:
    """By kind, the facts and surfaces that one side has more often."""
    if not any(changed(before, after)):
        return []
    sides = extract(before), extract(after)
    counts = [Counter((f[2], f[4]) for f in side) for side in sides]
    out: dict[str, dict] = {}
    for name, side, more in (("lost", sides[0], counts[0] - counts[1]), ("introduced", sides[1], counts[1] - counts[0])):
        for kind in {kind for kind, _ in more}:
            row = out.setdefault(kind, {"kind": kind} | {f"{s}_{w}": [] for s in ("lost", "introduced") for w in ("facts", "surfaces")})
            row[f"{name}_facts"] = sorted(identity for (k, identity), n in more.items() if k == kind for _ in range(n))
            row[f"{name}_surfaces"] = sorted({f[3] for f in side if f[2] == kind and (kind, f[4]) in more})
    return [out[kind] for kind in sorted(out)]


def with_differences(pairs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs (pair_id, before, after and the columns to carry) with the array differences."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [[] if a == b else _difference(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _DIFFERENCES)], names=["pair_id", "before", "after", *carry, "differences"])

    rows = pairs.select("pair_id", "before", "after", *carry)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(f"differences {_DIFFERENCES_SQL}").fields]))


def differences(pairs: DataFrame) -> DataFrame:
    """(pair_id, kind, lost, introduced, lost_surfaces, introduced_surfaces) of pairs whose facts differ, by kind.

    lost and introduced list facts in order, repeated as often as they differ; surfaces how the texts write them.
    """
    each = with_differences(pairs).select("pair_id", F.inline("differences"))
    return each.select("pair_id", "kind", F.col("lost_facts").alias("lost"), F.col("introduced_facts").alias("introduced"), "lost_surfaces", "introduced_surfaces")


def violations(pairs: DataFrame) -> DataFrame:
    """``differences`` as text, with the detail changed, removed or introduced."""
    detail = F.when((F.size("lost") > 0) & (F.size("introduced") > 0), "changed").when(F.size("lost") > 0, "removed").otherwise("introduced")
    return differences(pairs).select("pair_id", "kind", *[F.concat_ws("|", c).alias(c) for c in ("lost", "introduced", "lost_surfaces", "introduced_surfaces")], detail.alias("detail"))


def check(pairs: DataFrame) -> DataFrame:
    """(pair_id, passed, kinds): whether every fact survived, and the kinds that didn't."""
    kinds = F.concat_ws(",", F.transform("differences", lambda d: d["kind"]))
    return with_differences(pairs).select("pair_id", (F.size("differences") == 0).alias("passed"), kinds.alias("kinds"))
