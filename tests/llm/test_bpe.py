import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

from prosemill.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_documents(docs, texts, library):
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == len(texts)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id] and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_encode_then_decode(docs, texts):
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((i, t or "") for i, t in texts)


def test_random_strings(library):
    r = random.Random(1)
    t = bpe.transducer(PATH)
    for _ in range(1500):
        kind = r.random()
        if kind < 0.4:
            s = "".join(r.choice("abcde the in er.,!'s t're 0123 \n\t") for _ in range(r.randint(0, 60)))
        elif kind < 0.7:
            s = "".join(chr(r.choice([r.randint(32, 126), r.randint(0, 0x2FF), r.randint(0x2000, 0x20FF), 0x85, 0x1C, 0xA0, 0x1F600])) for _ in range(r.randint(0, 40)))
        else:
            s = r.choice("a =-x") * r.randint(1, 1500) + r.choice(["", " b", "<|endoftext|>"])
        ids = np.frombuffer(b"".join(t.encode(s)), "<u4").tolist()
        assert ids == library.encode(s, add_special_tokens=False).ids
        assert "".join(t.decode(np.array(ids, "<u4").tobytes())) == s


def test_decoder_replaces_broken_characters(library):
    t = bpe.transducer(PATH)
    ids = np.array([i for i, b in enumerate(t.text_of) if b == b"\xc3"] + [library.token_to_id("a")], "<u4")
    assert "".join(t.decode(ids.tobytes())) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_stream_keeps_a_bounded_window():
    t = bpe.transducer(PATH)
    piece = b"ab" * 4000
    whole = list(t.stream(iter([piece])))
    t.held = 0
    parts = list(t.stream(piece[k : k + 100] for k in range(0, len(piece), 100)))
    assert whole == parts and t.bound == t.lookahead() > t.longest
    assert 0 < t.held <= 200 < len(piece)
    r = random.Random(4)
    for _ in range(30):
        odd = bytes(r.choice(b"abc =-\xc3\xa9") for _ in range(r.randint(1, 4))) * r.randint(50, 900)
        t.held = 0
        assert list(t.stream(odd[k : k + 64] for k in range(0, len(odd), 64))) == list(t.stream(iter([odd])))
        assert t.held <= t.bound


def test_tokens_come_before_the_end():
    t = bpe.transducer(PATH)
    read = []

    def blocks():
        for k in range(100):
            read.append(k)
            yield b"word" * 16

    stream = t.stream(blocks())
    next(stream)
    assert len(read) < 10


def test_empty(nothing):
    assert bpe.round_trip(nothing, PATH).count() == 0
