"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge of rank r changes tokens to the left of a point only by taking the token next to it, so what
unread input may still change grows, rank by rank, by the left part of a merge whose right part starts
with the token taken before. The longest such chain, in symbols, is the merge list's sufficient
lookahead: tokens that end that far before the end of what has been read are final. The transducer
emits them and keeps the rest, so its memory depends on the merge list and not on the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import let_go, without

#: Entries of a generation of a worker's memo. A full generation becomes the old one and the old one goes, so
#: words in use stay; what is remembered changes no result.
MEMO = 100_000
#: Symbols that a transducer reads at a time; a shorter piece is read to its end in one step.
STEP = 1024
#: Symbols of short pieces that advance together.
TOGETHER = 1 << 15
#: Characters that are normalised and split at a time.
BLOCK = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """One merge list as arrays: a hash table of pairs, their ranks, and the width of each token in symbols."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.suffix = suffix
        self.rank = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): r for r, m in enumerate(merges)}
        self.lookahead = self._lookahead()
        self.inner, self.final = (np.array([vocab[c + end] for c in byte_symbols()], dtype=np.int32) for end in ("", suffix))
        self.width = np.ones(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = self._length(token)
        self.made = np.array([vocab[a + b] for a, b in self.rank], dtype=np.int32)
        self._hash(np.array([vocab[a] << 32 | vocab[b] for a, b in self.rank], dtype=np.int64))
        first = {a + b: r for (a, b), r in reversed(self.rank.items())}
        last = {a + b: r for (a, b), r in self.rank.items()}
        #: No merge makes a token that an earlier merge takes: then all places of a pair may be merged at once.
        self.ordered = all(first.get(t) == last.get(t) and last.get(t, -1) < r for pair, r in self.rank.items() for t in pair)

    def _length(self, token: str) -> int:
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else len(token)

    def _lookahead(self) -> int:
        """The weight of the heaviest chain of merges through which input still unread can reach back."""
        best: dict[str, int] = {}
        widest = 1
        for left, right in self.rank:
            reach = self._length(left) + max((best[right[:n]] for n in range(1, len(right) + 1) if right[:n] in best), default=0)
            best[left] = max(best.get(left, 0), reach)
            widest = max(widest, reach)
        return widest

    def _hash(self, keys: np.ndarray) -> None:
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.slots = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, self.NONE, dtype=np.int32)
        rest = np.arange(len(keys))
        at = self._slot(keys)
        while len(rest):
            free = rest[self.keys[at] < 0]
            spot, which = np.unique(at[self.keys[at] < 0], return_index=True)
            self.keys[spot], self.slots[spot] = keys[free[which]], free[which]
            left = self.keys[at] != keys[rest]
            rest, at = rest[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, ``NONE`` for pairs that do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.slots[at], self.NONE)
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[rest]]
            hit = there == key[rest]
            out[rest[hit]] = self.slots[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out

    def apply(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges applied to each of several windows of tokens that follow each other in ``ids``.

        In every window the pair of least rank goes first, the leftmost before others. A round merges one such pair,
        in each window, or all its places there if no merge can come between them.
        """
        done_ids, done_sizes, order, here = [], [], [], np.arange(len(sizes))
        rank = np.full(len(ids), self.NONE, dtype=np.int32)
        if len(ids) > 1:
            rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[sizes.cumsum() - 1] = self.NONE
        while len(here):
            starts = sizes.cumsum() - sizes
            least = np.minimum.reduceat(rank, starts)
            going = least < self.NONE
            if going.sum() * 4 <= len(here) * 3:
                stay = np.repeat(going, sizes)
                done_ids.append(ids[~stay])
                done_sizes.append(sizes[~going])
                order.append(here[~going])
                ids, rank, sizes, least, here = ids[stay], rank[stay], sizes[going], least[going], here[going]
                if not len(here):
                    break
                starts, going = sizes.cumsum() - sizes, np.ones(len(here), dtype=bool)
            hits = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < self.NONE))
            of = np.searchsorted(starts, hits, "right") - 1
            if self.ordered:
                # Of places that overlap (a a a), every other one.
                runs = np.flatnonzero(np.r_[True, np.diff(hits) > 1])
                kept = (np.arange(len(hits)) - np.repeat(runs, np.diff(np.r_[runs, len(hits)]))) % 2 == 0
            else:
                kept = np.r_[True, of[1:] != of[:-1]]
            hits, of = hits[kept], of[kept]
            ids[hits] = self.made[rank[hits]]
            stay = np.ones(len(ids), dtype=bool)
            stay[hits + 1] = False
            ends = (starts + sizes - 1)[of] == hits + 1
            sizes = sizes - np.bincount(of, minlength=len(sizes))
            moved = hits - np.arange(len(hits))
            ids, rank = ids[stay], rank[stay]
            right = np.minimum(moved + 1, len(ids) - 1)
            rank[moved] = np.where(ends, self.NONE, self.ranks(ids[moved], ids[right]))
            left = moved[moved > (sizes.cumsum() - sizes)[of]]
            rank[left - 1] = self.ranks(ids[left - 1], ids[left])
        if not done_ids:
            return ids, sizes
        ids, sizes, order = np.concatenate(done_ids), np.concatenate(done_sizes), np.concatenate(order)
        place = np.argsort(order)
        starts = (sizes.cumsum() - sizes)[place]
        sizes = sizes[place]
        return ids[np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(len(ids))], sizes


class Transducer:
    """Reads the bytes of pieces step by step and gives token ids as soon as they are final.

    A step's tokens that end the lookahead or more before what has been read are final; the rest is held as
    symbols and read again with the next step, so what is held is bounded by the merge list and the step.
    """

    def __init__(self, merges: Merges, step: int = STEP):
        self.merges, self.step = merges, step

    def pieces(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """The ids of each of many pieces of no more than one step; their ends are read, so all tokens are final."""
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        symbols = self.merges.inner[flat]
        ends = sizes.cumsum() - 1
        symbols[ends] = self.merges.final[flat[ends]]
        ids, sizes = self.merges.apply(symbols, sizes)
        ids, at = ids.tolist(), 0
        for size in sizes.tolist():
            yield ids[at : at + size]
            at += size

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """The ids of one piece of any length, a list for each step."""
        held = np.zeros(0, dtype=np.int32)
        for at in range(0, len(piece), self.step):
            codes = np.frombuffer(piece[at : at + self.step], dtype=np.uint8)
            read = self.merges.inner[codes]
            ended = at + self.step >= len(piece)
            if ended:
                read[-1] = self.merges.final[codes[-1]]
            held = np.concatenate([held, read])
            if not ended and len(held) <= self.merges.lookahead:
                continue
            ids, _ = self.merges.apply(held.copy(), np.array([len(held)]))
            if not ended:
                reached = self.merges.width[ids].cumsum()
                ids = ids[reached <= len(held) - self.merges.lookahead]
                held = held[reached[len(ids) - 1] if len(ids) else 0 :]
            yield ids.tolist()


class Decoder:
    """Token strings to text, a block at a time.

    Where the tokenizer file names no decoder the text is the token strings with spaces between, as the
    library has it; ``plain`` turns byte symbols into UTF-8 text, word ends into spaces, and holds back
    the bytes of a character that is not complete.
    """

    def __init__(self, plain: bool = False):
        self.plain, self.first = plain, True
        if plain:
            self.bytes = {c: b for b, c in enumerate(byte_symbols())}
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, tokens: list[str]) -> str:
        if not self.plain:
            text = " ".join(tokens) if self.first or not tokens else " " + " ".join(tokens)
            self.first = self.first and not tokens
            return text
        return "".join(map(self._bytes, tokens))

    def _bytes(self, token: str) -> str:
        end = token.endswith("</w>")
        return self.utf8.decode(bytes(self.bytes.get(c, 0x3F) for c in (token[:-4] if end else token))) + " " * end

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.plain else ""


class WordTokenizer:
    """A word-level BPE tokenizer file: normalised text, pieces by pattern, merges with word ends."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab = dict(model["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.transducer = Transducer(Merges(self.vocab, model["merges"], self.suffix))
        steps = [spec["pre_tokenizer"], *(spec["pre_tokenizer"].get("pretokenizers") or [])]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        space = r"[\t-\r\x85\p{Z}]"
        # A line feed is no part of a piece, so it marks where one part without white space ends.
        self.pieces = regex.compile((pattern.replace(r"[^\s", "[^" + space[1:-1]) if r"[^\s" in pattern else pattern.replace(r"\s", space)) + r"|\n")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.strings = {i: t for t, i in self.vocab.items()}
        self.numbers = {i: str(i) for i in self.strings}
        self.named = {n: self.strings[i] for i, n in self.numbers.items()}
        #: Ids, as text, of parts without white space and of pieces: the young and the old generation.
        self.parts_memo: list[dict[str, tuple]] = [{}, {}]
        self.words_memo: list[dict[str, tuple]] = [{}, {}]
        self.spaces = regex.compile(r"[\t-\r\x85\p{Z}]+")
        #: Splits on white space are splits between pieces; these four are white space to Python alone.
        self.odd = regex.compile("[\x1c-\x1f]")

    @staticmethod
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of a text, cut where neither its composed form nor its pieces change: at white space."""
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and not (text[end].isspace() and not "\x1c" <= text[end] <= "\x1f"):
                end += 1
            yield text[at:end]
            at = end

    def parts(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """A text as special tokens, (token, []), and lists of parts without white space, (None, parts)."""
        at = 0
        for mark in self.special_at.finditer(text) if self.special_at else ():
            yield from self._plain(text[at : mark.start()])
            yield mark[0], []
            at = mark.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[tuple[None, list[str]]]:
        for block in self.blocks(text):
            block = self.normal(block)
            chunks = self.spaces.split(block) if self.odd.search(block) else block.split()
            yield None, [c for c in chunks if c]

    @staticmethod
    def unknown(wanted: set[str], memo: list[dict[str, tuple]]) -> list[str]:
        """Those of ``wanted`` that neither generation knows; the others are in the young one afterwards."""
        if len(memo[0]) > MEMO:
            memo[:] = {}, memo[0]
        young, old = memo
        missing = wanted.difference(young)
        if old:
            known = [w for w in missing if w in old]
            young.update(zip(known, map(old.__getitem__, known)))
            missing.difference_update(known)
        return list(missing)

    def learn(self, chunks: list[str]) -> None:
        """Puts all parts among ``chunks`` that are read in one step into the young memo."""
        missing = [c for c in self.unknown(set(chunks), self.parts_memo) if len(c) * 4 <= STEP]
        if not missing:
            return
        found = self.pieces.findall("\n".join(missing))
        words = self.words(set(found))
        young, part, parts = self.parts_memo[0], [], iter(missing)
        for piece in found:
            if piece == "\n":
                young[next(parts)] = tuple(part)
                part = []
            else:
                part += words[piece]
        young[next(parts)] = tuple(part)

    def words(self, wanted: set[str]) -> dict[str, tuple]:
        """The young memo of pieces, with all of ``wanted`` in it."""
        wanted.discard("\n")
        new = sorted(self.unknown(wanted, self.words_memo), key=len)
        young, number, coded, at = self.words_memo[0], self.numbers.__getitem__, [p.encode("utf-8", "replace") for p in new], 0
        while at < len(new):
            n = at + max(1, TOGETHER // max(1, len(coded[at])))
            for piece, ids in zip(new[at:n], self.transducer.pieces(coded[at:n])):
                young[piece] = tuple(map(number, ids))
            at = n
        return young

    def emit(self, chunks: list[str]) -> Iterator[list[str]]:
        """Ids, as text, of parts that were learned or are long."""
        known = self.parts_memo[0]
        try:
            if chunks:
                yield list(chain.from_iterable(map(known.__getitem__, chunks)))
            return
        except KeyError:
            pass
        for chunk in chunks:
            if chunk in known:
                yield known[chunk]
                continue
            for piece in self.pieces.finditer(chunk):
                for ids in self.transducer.stream(piece[0].encode("utf-8", "replace")):
                    yield list(map(self.numbers.__getitem__, ids))

    def stream(self, parts, learned: bool = False) -> Iterator[list[str]]:
        for special, chunks in parts:
            if special is not None:
                yield [self.numbers[self.vocab[special]]]
            else:
                if not learned:
                    self.learn(chunks)
                yield from self.emit(chunks)

    def ids(self, text: str) -> list[int]:
        return [int(i) for ids in self.stream(self.parts(text)) for i in ids]

    def decode(self, ids: list[int], plain: bool = False) -> str:
        reader = Decoder(plain)
        return reader.push([self.strings[i] for i in ids]) + reader.finish()

    def digest(self, parts, learned: bool = False) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of the decoded text, with nothing of them kept."""
        count, ids_hash, text_hash, reader = 0, hashlib.sha256(), hashlib.sha256(), Decoder()
        for ids in filter(None, self.stream(parts, learned)):
            ids_hash.update(((" " if count else "") + " ".join(ids)).encode())
            text_hash.update(reader.push(list(map(self.named.__getitem__, ids))).encode())
            count += len(ids)
        text_hash.update(reader.finish().encode())
        return count, ids_hash.hexdigest(), text_hash.hexdigest()

    def digests(self, texts) -> Iterator[tuple[int, str, str]]:
        """``digest`` of each text; the short parts of many texts are encoded together."""
        waiting: list = []
        held = 0
        for text in texts:
            if len(text) > BLOCK:
                yield from self._digests(waiting)
                yield self.digest(self.parts(text))
                waiting, held = [], 0
                continue
            waiting.append(list(self.parts(text)))
            held += len(text)
            if held > 16 * BLOCK:
                yield from self._digests(waiting)
                waiting, held = [], 0
        yield from self._digests(waiting)

    def _digests(self, waiting: list) -> Iterator[tuple[int, str, str]]:
        self.learn([c for parts in waiting for _, chunks in parts for c in chunks])
        for parts in waiting:
            yield self.digest(parts, learned=True)


@lru_cache(4)
def tokenizer(spec: str) -> WordTokenizer:
    return WordTokenizer(spec)


def forget() -> None:
    tokenizer.cache_clear()


KINDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(df: DataFrame, path: str, *, text: str = "text", outputs=("n_tokens", "ids", "decoded"), keep=None) -> DataFrame:
    """``df`` with the whole text encoded and decoded again: any of n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    A null text is an empty one: no tokens and an empty decoded text. Repeated rows and nulls elsewhere pass
    through; columns named as an output are replaced. ``keep`` limits the columns passed through. The
    tokenizer file is read by the driver and sent to the executors (its size is that of a vocabulary).
    """
    kept = [c for c in without(df, outputs) if keep is None or c in keep]
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    source = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text}`"].cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), *(f"{o} {KINDS[o]}" for o in outputs)])
    wants_ids = "ids" in outputs or "decoded" in outputs

    def run(batches):
        let_go("bpe")
        t = tokenizer(spec.value)
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for value, digest in zip(texts, t.digests(texts)):
                row = dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), digest))
                if wants_ids:
                    ids = t.ids(value)
                    row |= {"ids": ids} | ({"decoded": t.decode(ids)} if "decoded" in outputs else {})
                for o in outputs:
                    made[o].append(row[o])
            kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(made[o], kinds[KINDS[o]]) for o in outputs)], names=[*batch.schema.names[:-1], *outputs])

    return source.mapInArrow(run, schema)
