"""The batch transducer and the decoder: against brute force, and that the rows come through them."""

import hashlib
import random

import public_tokenizers
import pytest

from graphloom.llm import bpe


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.WordTokenizer(f.read())


def brute(merges, vocab, piece: bytes) -> list[int]:
    """The pair of least rank, the leftmost first, one at a time."""
    symbols = [bpe.byte_symbols()[b] for b in piece]
    symbols[-1] += merges.suffix
    while True:
        ranks = [merges.rank.get(pair, merges.NONE) for pair in zip(symbols, symbols[1:])]
        if not ranks or min(ranks) == merges.NONE:
            return [vocab[s] for s in symbols]
        i = ranks.index(min(ranks))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def some_pieces(seed: int, n: int, longest: int) -> list[bytes]:
    rnd = random.Random(seed)
    kinds = ["theringaonds", "ab", "a", "\u00e9\u00e7t", "123.,-"]
    return ["".join(rnd.choice(kinds[i % 5]) for _ in range(rnd.randint(1, longest))).encode() for i in range(n)]


@pytest.mark.parametrize("ordered", [True, False])
def test_many_pieces_advance_together(own, ordered):
    merges = own.transducer.merges
    assert merges.ordered
    pieces = some_pieces(1, 300, 24)
    merges.ordered = ordered
    try:
        got = list(own.transducer.pieces(pieces))
    finally:
        merges.ordered = True
    assert got == [brute(merges, own.vocab, p) for p in pieces]


def test_a_long_piece_is_read_in_steps_and_little_is_held(own):
    merges, held = own.transducer.merges, []
    apply = merges.apply

    class Watched:
        def __getattr__(self, name):
            return getattr(merges, name)

        def apply(self, ids, sizes):
            held.append(len(ids))
            return apply(ids, sizes)

    for piece in some_pieces(2, 3, 3000):
        streamed = [i for ids in bpe.Transducer(Watched(), step=256).stream(piece) for i in ids]
        assert streamed == brute(merges, own.vocab, piece)
    assert max(held) <= merges.lookahead + 2 * 256


def test_memo_generations_change_nothing(own, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 7)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["some", "words,", "come", "again;", "and", "x%d" % rnd.randrange(99)]) for _ in range(30)) for _ in range(50)]
    fresh = [own.ids(t) for t in texts]
    assert max(map(len, own.parts_memo)) < 60
    own.parts_memo[:], own.words_memo[:] = ({}, {}), ({}, {})
    monkeypatch.setattr(bpe, "MEMO", 10**6)
    assert fresh == [own.ids(t) for t in texts]


def test_rows_come_through_both_machines(own, monkeypatch):
    """All ids are made by the transducer and all decoded text by the decoder: without either there is no row."""
    text = "Some words " + "x" * 3000
    own.parts_memo[:], own.words_memo[:] = ({}, {}), ({}, {})
    pushed, made = [], []
    push, pieces, stream = bpe.Decoder.push, bpe.Transducer.pieces, bpe.Transducer.stream

    def kept(f):
        def run(self, x):
            for ids in f(self, x):
                made.extend(ids)
                yield ids

        return run

    monkeypatch.setattr(bpe.Transducer, "pieces", kept(pieces))
    monkeypatch.setattr(bpe.Transducer, "stream", kept(stream))
    monkeypatch.setattr(bpe.Decoder, "push", lambda self, tokens: pushed.extend(tokens) or push(self, tokens))
    ((n, ids, decoded),) = own.digests([text])
    assert n == len(made) == len(pushed)
    assert ids == hashlib.sha256(" ".join(map(str, made)).encode()).hexdigest()
    assert decoded == hashlib.sha256(" ".join(pushed).encode()).hexdigest()


def test_bytes_decode_incrementally():
    symbols = bpe.byte_symbols()
    d = bpe.Decoder(plain=True)
    out = [d.push([symbols[b]]) for b in "\u00e9\u65e5".encode()]
    assert out == ["", "\u00e9", "", "", "\u65e5"] and d.finish() == ""
    d = bpe.Decoder()
    assert d.push(["a"]) + d.push([]) + d.push(["b", "c"]) + d.finish() == "a b c"
