"""Sketches never rule out a similar pair, and workers let go of what other operators remember."""

import random

import numpy as np
import pyarrow as pa

from graphloom.llm import bpe, langid, nearcopies
from graphloom.llm.common import let_go


def test_no_similar_pair_is_ruled_out():
    rnd = random.Random(1)
    sets = [np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)) for n in (0, 1, 3, 40, 400, 3000, 40_000)]
    pairs = []
    for own in sets:
        for share in (1.0, 0.95, 0.9, 0.89, 0.85, 0.5, 0.0):
            k = int(len(own) * share)
            pairs.append((own, np.unique(np.concatenate([own[:k], np.array([rnd.getrandbits(64) for _ in range(len(own) - k)], np.uint64)]))))
    columns = {"a": range(len(pairs)), "b": range(len(pairs)), "of_a": [0] * len(pairs), "of_b": [0] * len(pairs), "n_a": [len(a) for a, _ in pairs], "n_b": [len(b) for _, b in pairs]}
    batch = pa.RecordBatch.from_arrays([*(pa.array(list(v), pa.int64()) for v in columns.values()), *(pa.array([nearcopies.sketch(p[k]) for p in pairs], pa.binary()) for k in (0, 1))], [*columns, "sketch_a", "sketch_b"])
    kept = set(next(nearcopies.reachable([batch])).column("a").to_pylist())
    for i, (a, b) in enumerate(pairs):
        assert not nearcopies.similar(a, b) or i in kept
    # Unlike sets of usual sizes are ruled out; a set that fills a cell has no sketch and stays.
    assert not kept & {i for i, (a, b) in enumerate(pairs) if 3 <= len(a) <= 400 and not len(np.intersect1d(a, b))}
    assert nearcopies.sketch(sets[-1]) is None and {42, 48} <= kept


def test_workers_let_go():
    nearcopies.HASHES[b"a"]
    langid._MEMO["of"] = 1
    let_go("nearcopies")
    assert nearcopies.HASHES and not langid._MEMO
    let_go("bpe")
    assert not nearcopies.HASHES and bpe.tokenizer.cache_info().currsize == 0
