"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

The tokens of a piece are found from left to right.  ``last[i]`` is the last token of the encoding of the first i
bytes: the only token that ends there and is *compatible* with the last token of the prefix it leaves, which means that
no merge of the list would have crossed the boundary between the two.  Later bytes can only build on the prefixes at
most one token length back, so tokens on which all of those agree are stable and are emitted at once; at the latest they
are when the sufficient lookahead of the merge list lies behind them, so a stream never holds more than that bound and a
block.  Memory doesn't grow with the text: windows of positions, and memos that are emptied at a fixed size.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches, own_columns, slices, text_bytes

#: How the vocabulary's files split a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of a memo before it is emptied, pieces and ids handled at once; none changes a result.
_MEMO, _BLOCK, _SHORT = 400_000, 1 << 16, 64
_NEVER = 1 << 60
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_BOTH = pa.schema([*_ENCODED, ("decoded", pa.string())])


def alphabet() -> dict[str, int]:
    """The byte that each printable stand-in character of a vocabulary file means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Memo(dict):
    """A dict that makes what it lacks.  It holds at most ``most`` entries: those of the older half that aren't asked for
    again while the younger half fills are dropped."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.half = make, most // 2
        self.older: dict = {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Transducer:
    """Encoder and decoder for a vocabulary file of the tokenizers library (byte-level BPE).

    Tokens are numbered inside by age: single bytes first, then one per merge in the list's order.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, chars = data["model"], alphabet()
        raw = {token: bytes(chars[c] for c in token) for token in model["vocab"] if all(c in chars for c in token)}
        number = {bytes([b]): b for b in range(256)}
        names = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = (raw[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            token = number.setdefault(a + b, len(self.left))
            self.merged.setdefault((number[a], number[b]), token)
            if token == len(self.left):
                self.left.append(number[a])
                self.right.append(number[b])
        self.token = {text: n for text, n in number.items() if n < 256 or self._whole(n)}
        self.longest = max(map(len, self.token))
        self.length = [0] * len(self.left)
        self.reach: dict[bytes, int] = {}
        for text, n in number.items():
            self.length[n] = len(text)
            if n >= 256 and text in self.token:
                self.reach[text[-2:]] = max(self.reach.get(text[-2:], 0), len(text))
        self.code = [b""] * len(self.left)
        for text, n in number.items():
            if text in names:
                self.code[n] = names[text].to_bytes(4, "little")
        self.added = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        size = 1 + max([*model["vocab"].values(), *self.added.values()])
        self.text_of = [b""] * size
        for text, n in names.items():
            self.text_of[n] = text
        for text, n in self.added.items():
            self.text_of[n] = text.encode()
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bound = 0
        self.held = 0
        self.fits = _Memo(lambda pair: self.compatible(*pair))
        self.memo = _Memo(lambda piece: self.encode_piece(piece.encode()), _MEMO)

    def _crosses(self, a: int, b: int, skip_top: bool) -> bool:
        """Whether a merge joins what is left of the boundary a|b with what is right of it.

        Walks back through the time in which a and b were built: x and y are the pieces beside the boundary, each
        consumed when its parent was made.  Of equal merges the left one comes first.
        """
        x, y, x_until, y_until = a, b, _NEVER, _NEVER
        while True:
            made = self.merged.get((x, y))
            if made is not None and not skip_top and made < x_until and made <= y_until:
                return True
            skip_top = False
            if x < 256 and y < 256:
                return False
            if x >= y:
                x_until, x = x, self.right[x]
            else:
                y_until, y = y, self.left[y]

    def _whole(self, token: int) -> bool:
        """Whether the bytes of a merged token are encoded as that token."""
        return not self._crosses(self.left[token], self.right[token], True)

    def compatible(self, a: int, b: int) -> bool:
        return not self._crosses(a, b, False)

    def lookahead(self) -> int:
        """Bytes after which the tokens before a point can't change any more.

        A merge at a point may be undone by an older one that overlaps its right part, that one by a still older one,
        and so on: the longest such chain over the merge list, times the longest token.
        """
        text: list[bytes] = [bytes([b]) for b in range(256)]
        starts: dict[bytes, int] = {}
        equal: dict[bytes, int] = {}
        best = 0
        for n in range(256, len(self.left)):
            a, b = text[self.left[n]], text[self.right[n]]
            text.append(a + b)
            chain = 1 + max([starts.get(b, 0), *(equal.get(b[:k], 0) for k in range(1, len(b) + 1))])
            best = max(best, chain)
            equal[a] = max(equal.get(a, 0), chain)
            for k in range(1, len(a) + 1):
                starts[a[:k]] = max(starts.get(a[:k], 0), chain)
        return best * self.longest

    def stream(self, blocks: Iterator[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in blocks, each as soon as it is stable.

        What is held back never passes the merge list's lookahead; ``held`` is the most that a stream has held so far.
        """
        self.bound = self.bound or self.lookahead()
        held, last = b"", [-1]
        for block in blocks:
            held += block
            self._extend(held, last)
            n = len(held)
            alive = set(range(max(0, n - self.longest + 1), n + 1))
            while len(alive) > 1:
                far = max(alive)
                alive.remove(far)
                alive.add(far - self.length[last[far]])
            stable = alive.pop()
            self.held = max(self.held, n - stable)
            if n - stable > self.bound:
                raise AssertionError(f"{n - stable} bytes held back, more than the merge list's lookahead of {self.bound}")
            if stable:
                yield from self._back(last, stable)
                held, last = held[stable:], last[stable:]
        yield from self._back(last, len(held))

    def _extend(self, held: bytes, last: list[int]) -> None:
        """Find the last token of every further prefix of ``held``; longer tokens are tried first."""
        token, fits, reach = self.token.get, self.fits, self.reach
        for i in range(len(last), len(held) + 1):
            s = i - reach.get(held[i - 2 : i], 1) if i > 1 else 0
            if s < 0:
                s = 0
            while True:
                t = token(held[s:i])
                if t is not None and (last[s] < 0 or fits[last[s], t]):
                    last.append(t)
                    break
                s += 1

    def _back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= self.length[last[at]]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of one piece, little-endian; all of a short piece is looked ahead at once."""
        whole = self.token.get(piece)
        if whole is not None:
            return self.code[whole]
        code = self.code
        if len(piece) <= _SHORT:
            last = [-1]
            self._extend(piece, last)
            return b"".join([code[t] for t in self._back(last, len(piece))])
        return b"".join([code[t] for t in self.stream(piece[k : k + 256] for k in range(0, len(piece), 256))])

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text in runs, little-endian; strings of added tokens stand for these tokens."""
        at = 0
        for special in [*(self.cut.finditer(text) if self.cut else ()), None]:
            to = special.start() if special else len(text)
            if to - at < _BLOCK:
                yield b"".join(map(self.memo.__getitem__, self.pieces.findall(text, at, to)))
            else:
                found = (m[0] for m in self.pieces.finditer(text, at, to))
                while run := list(islice(found, _BLOCK)):
                    yield b"".join([self.memo[p] if len(p) < _SHORT else self.encode_piece(p.encode()) for p in run])
            if special:
                yield self.added[special[0]].to_bytes(4, "little")
                at = special.end()

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text of little-endian ids in runs; the decoder holds bytes back until their character is whole."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text_of = self.text_of.__getitem__
        codes = np.frombuffer(ids, "<u4")
        for k in range(0, len(codes), _BLOCK):
            yield machine.decode(b"".join(map(text_of, codes[k : k + _BLOCK].tolist())))
        yield machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer per worker and vocabulary."""
    return Transducer(path)


def _texts(column: pa.Array) -> Iterator[str]:
    return ((t or b"").decode("utf-8", "replace") for t in text_bytes(column))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text; ids are little-endian unsigned 32-bit integers in one binary.

    ``path`` names a vocabulary file that every worker can read.  A null text is empty and has no tokens; there is no
    truncation and no padding; every row is encoded by itself, so repeated rows, ids and further columns don't matter.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            ids = [b"".join(transducer(path).encode(t)) for t in _texts(batch.column(1))]
            yield batches({"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}, _ENCODED)

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of little-endian ids; null ids give an empty text, broken UTF-8 the replacement character."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            texts = ["".join(transducer(path).decode(x or b"")) for x in batch.column(1).to_pylist()]
            yield batches({"doc_id": batch.column(0), "text": texts}, _DECODED)

    return own_columns(tokens, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, n_tokens, ids, decoded."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            t = transducer(path)
            ids = [b"".join(t.encode(x)) for x in _texts(batch.column(1))]
            decoded = ["".join(t.decode(x)) for x in ids]
            yield batches({"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": decoded}, _BOTH)

    return own_columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
