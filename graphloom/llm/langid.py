"""Language identification by interpolated Kneser-Ney character models.

Texts become sequences over 64 symbols: a-z, the space for everything that is not a letter, and 37 classes of
other letters. One pass counts the n-grams of the highest order for each language; all lower orders
follow from them, since Kneser-Ney's lower orders count distinct continuations. Each language's
n-grams are kept as sorted arrays of keys and looked up by binary search. The language with the least
cross-entropy per symbol wins; a text whose cross-entropy is beyond what its language's own texts show is
rejected.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, fresh, let_go, without

#: Symbols, as a power of two, and symbols in an n-gram of the highest order.
BITS, ORDER = 6, 4
#: One text in so many is not learned from but shows how far a language's own texts deviate from its mean.
CALIBRATE = 8
#: A text is rejected beyond so many times the widest deviation seen in calibration, plus so many units,
MARGIN_TIMES, MARGIN_MORE = 2.0, 6.0
#: and only if its cross-entropy is above its language's mean by so many nats a symbol.
MARGIN_NATS = 0.7
#: Characters that are turned into symbols at a time.
PIECE = 1 << 20
UNKNOWN = "und"


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 if it is no letter, 1 to 26 for a-z, else one of 37 classes."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 7919 % 37
    return table


_TABLE: list[np.ndarray] = []


def pieces(text: str) -> Iterator[str]:
    """Parts of a text, cut where its composed form does not change."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not fresh(text[end]):
            end += 1
        yield text[at:end]
        at = end


def grams(text: str, order: int) -> Iterator[np.ndarray]:
    """Keys of the n-grams of a text, one for each symbol and for the space at the end; spaces stand before the text.

    Runs of what is no letter are one space. A text without letters has no n-grams. A long text is read piece by
    piece, each with the symbols before it, so its n-grams are those of the whole.
    """
    if not _TABLE:
        _TABLE.append(_symbols())
    before = np.zeros(order - 1, dtype=np.int64)
    for piece in pieces(text):
        codes = np.frombuffer(unicodedata.normalize("NFC", piece).encode("utf-32-le", "replace"), dtype=np.uint32)
        found = np.concatenate([before[-1:], _TABLE[0][codes]]).astype(np.int64)
        found = found[1:][(found[1:] != 0) | (found[:-1] != 0)]
        if len(found):
            padded = np.concatenate([before, found])
            yield _keys(padded, order)
            before = padded[len(padded) - order + 1 :]
    if before[-1]:
        yield _keys(np.r_[before, 0], order)


def _keys(padded: np.ndarray, order: int) -> np.ndarray:
    keys = np.zeros(len(padded) - order + 1, dtype=np.int64)
    for k in range(order):
        keys = keys << BITS | padded[k : len(padded) - order + 1 + k]
    return keys


def count_grams(df: DataFrame, text: Column, lang: Column, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over whole texts. Tasks add up what they read before anything is sent."""

    def run(batches):
        let_go("langid")
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for name, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        def add(waiting):
            for name, parts in waiting.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                if name in held:
                    both = np.concatenate([held[name][0], keys])
                    keys, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[name][1], n])).astype(np.int64)
                held[name] = keys, n.astype(np.int64)

        for batch in batches:
            waiting, size = {}, 0
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in grams(t, order):
                    waiting.setdefault(name, []).append(found)
                    size += len(found)
                    if size > PIECE:
                        add(waiting)
                        waiting, size = {}, 0
            add(waiting)
            if sum(len(k) for k, _ in held.values()) > 4_000_000:
                yield from out()
        yield from out()

    rows = df.select(text.alias("text"), lang.alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def log_probabilities(keys: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For orders 1, 2, ... ``order``: sorted keys, ln p of each, and sorted contexts' ln weight of the order below.

    p_k(w | h) = (c(hw) - D) / c(h) + D * types(h) / c(h) * p_(k-1)(w | h'), D = n1 / (n1 + 2 n2); the highest order has
    raw counts, lower ones the number of distinct symbols before; below order 1 lies the uniform law.
    """
    counts = {order: (keys, n.astype(np.float64))}
    for k in range(order - 1, 0, -1):
        tails, distinct = np.unique(counts[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
        counts[k] = tails, distinct.astype(np.float64)
    levels: list = []
    lower = lambda tails: np.full(len(tails), 1.0 / (1 << BITS))
    for k in range(1, order + 1):
        keys, c = counts[k]
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = once / (once + 2 * twice) if once and twice else 0.5
        heads, at = np.unique(keys >> BITS, return_inverse=True)
        whole, types = np.bincount(at, c), np.bincount(at)
        weight = d * types / whole
        p = (c - d) / whole[at] + weight[at] * lower(keys & ((1 << BITS * (k - 1)) - 1))
        levels.append((keys, np.log(p).astype(np.float32), heads, np.log(weight).astype(np.float32)))
        lower = lambda tails, levels=tuple(levels): np.exp(look_up(levels, tails))
    return levels


def look_up(levels, keys: np.ndarray) -> np.ndarray:
    """ln p of n-grams of the order of ``levels``: by binary search, then by the weights of shorter contexts."""
    out, rest, open_ = np.zeros(len(keys)), keys, np.arange(len(keys))
    for k in range(len(levels), 0, -1):
        own, p, heads, weight = levels[k - 1]
        at = np.minimum(np.searchsorted(own, rest), len(own) - 1)
        hit = own[at] == rest
        out[open_[hit]] += p[at[hit]]
        open_, rest = open_[~hit], rest[~hit]
        head = rest >> BITS
        at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
        out[open_] += np.where(heads[at] == head, weight[at], 0.0)
        rest = rest & ((1 << BITS * (k - 1)) - 1)
    out[open_] -= math.log(1 << BITS)
    return out


#: The memo of the model in use: workers outlive a model, and an old one's memo must not stay.
_MEMO: dict = {}


def forget() -> None:
    _MEMO.clear()



@dataclass(eq=False)
class Model:
    """Sorted arrays for each language, and the calibrated mean and limit of its cross-entropy."""

    order: int
    levels: dict[str, list]
    limits: dict[str, tuple[float, float]]

    def memo(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows already looked up: row of each key (-1: not yet) and their ln p by language. A process has one."""
        if _MEMO.get("of") is not self:
            _MEMO.clear()
            _MEMO.update(of=self, memo=[np.full(1 << BITS * self.order, -1, dtype=np.int32), np.zeros((0, len(self.levels)), dtype=np.float32)])
        return _MEMO["memo"]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a symbol) of each text under each language, and the texts' lengths in symbols."""
        sums, sizes = np.zeros((len(texts), len(self.levels))), np.zeros(len(texts))
        waiting, of, held = [], [], 0
        for i, text in enumerate(texts):
            for found in grams(text or "", self.order):
                waiting.append(found)
                of.append(i)
                held += len(found)
                if held > PIECE // 2:
                    self._add(waiting, of, sums, sizes)
                    waiting, of, held = [], [], 0
        self._add(waiting, of, sums, sizes)
        return sums / np.maximum(sizes, 1)[:, None], sizes

    def _add(self, waiting, of, sums, sizes) -> None:
        if not waiting:
            return
        memo = self.memo()
        keys = np.concatenate(waiting)
        rows = memo[0][keys]
        if (rows < 0).any():
            new = np.unique(keys[rows < 0])
            memo[0][new] = np.arange(len(memo[1]), len(memo[1]) + len(new))
            memo[1] = np.concatenate([memo[1], np.stack([look_up(x, new) for x in self.levels.values()], 1).astype(np.float32)])
            rows = memo[0][keys]
        n = np.array([len(w) for w in waiting])
        starts = np.r_[0, n.cumsum()[:-1]]
        np.add.at(sizes, of, n)
        for j in range(len(self.levels)):
            np.add.at(sums[:, j], of, -np.add.reduceat(memo[1][rows, j].astype(np.float64), starts))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected): score is the best language's share of the exponentials of -cross-entropy."""
        names = list(self.levels)
        if not names:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        entropy, sizes = self.entropies(texts)
        best = entropy.argmin(1)
        share = np.exp(entropy.min(1, keepdims=True) - entropy)
        score = 1.0 / share.sum(1)
        out = []
        for i, b in enumerate(best.tolist()):
            if not sizes[i]:
                out.append((UNKNOWN, 0.0, True))
                continue
            mean, limit = self.limits[names[b]]
            out.append((names[b], float(score[i]), bool(entropy[i, b] - mean > MARGIN_NATS and (entropy[i, b] - mean) * math.sqrt(sizes[i]) > limit)))
        return out


def train(df: DataFrame, *, text: str = "text", lang: str = "lang", order: int = ORDER) -> Model:
    """A model of every language in ``df``: all rows with a text and a language count, whole.

    One text in ``CALIBRATE``, by hash, gives no counts but the limit of what is let pass; a language with such texts
    alone learns from them too. Rows with a null text or language, and texts without letters, teach nothing; repeated
    rows count as often as they occur. With no rows the model knows no language and calls everything ``und``.
    The order is the same at every size: a language has 2^(6 x order) n-grams at most (16.8 million), whatever the corpus.
    """
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    aside = F.pmod(F.xxhash64("text"), F.lit(CALIBRATE)) == 0
    table = count_grams(rows.where(~aside), F.col("text"), F.col("lang"), order).toArrow()
    known = set(table.column("lang").unique().to_pylist())
    if rows.where(aside).where(~F.col("lang").isin(*known) if known else F.lit(True)).limit(1).count():
        table = pa.concat_tables([table, count_grams(rows.where(~F.col("lang").isin(*known) if known else F.lit(True)), F.col("text"), F.col("lang"), order).toArrow()])
    coded = table.column("lang").combine_chunks().dictionary_encode()
    names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    keys, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    levels = {}
    for k in sorted(range(len(names)), key=names.__getitem__):
        own = np.flatnonzero(of == k)
        own = own[np.argsort(keys[own])]
        levels[names[k]] = log_probabilities(keys[own], n[own], order)
    model = Model(order, levels, {})
    if levels:
        model.limits = calibrate(model, rows.where(aside))
        missing = sorted(set(levels) - set(model.limits))
        if missing:
            # No text of these was set aside: their limit comes from what they were learned from.
            model.limits |= calibrate(model, rows.where(F.col("lang").isin(*missing)))
    return model


def calibrate(model: Model, rows: DataFrame) -> dict[str, tuple[float, float]]:
    """For each language in ``rows``, the mean cross-entropy of its texts and the greatest scaled deviation that is let pass."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go("langid")
        names = list(shared.value.levels)
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            # A language of which no text has letters is not in the model.
            taught = [(t, x) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x in place]
            langs = [x for _, x in taught]
            entropy, sizes = shared.value.entropies([t for t, _ in taught])
            own = np.array([place[x] for x in langs], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(entropy[np.arange(len(own)), own]), pa.array(sizes)], names=["lang", "e", "size"])

    seen = cut(rows.select("text", "lang").mapInArrow(run, "lang string, e double, size double").where("size > 0"))
    mean = seen.groupBy("lang").agg((F.sum(F.col("e") * F.col("size")) / F.sum("size")).alias("mean"))
    means = {r["lang"]: r["mean"] for r in mean.collect()}  # one row a language
    chosen = F.create_map(*[x for k, v in means.items() for x in (F.lit(k), F.lit(v))]) if means else None
    widest = seen.groupBy("lang").agg(F.max((F.col("e") - chosen[F.col("lang")]) * F.sqrt("size")).alias("z")).collect() if means else []
    return {r["lang"]: (means[r["lang"]], max(0.0, r["z"]) * MARGIN_TIMES + MARGIN_MORE) for r in widest}


def identify(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``, from the text alone.

    A null or empty text, or one without letters, is ``und`` with score 0 and is rejected. A rejected text with
    letters still carries its nearest language. Columns named as an output are replaced. The model is
    broadcast; its size is bounded by the number of languages and of n-grams a language can have.
    """
    kept = without(df, ("lang_pred", "score", "rejected"))
    source = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text}`"].cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "lang_pred string, score double, rejected boolean"])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go("langid")
        for batch in batches:
            found = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            names, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that nothing is learned from; null ids are neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned_from(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))
