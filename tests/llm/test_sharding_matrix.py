"""The communication matrix's margins, uniform places, and the query against its definition."""

import zlib

from pyspark.sql import functions as F

from graphloom.llm import decontaminate, queries, sharding

SF = "/root/testdata/sf0.001"


def test_margins_are_exact(spark):
    sizes = [(b, n) for b, n in enumerate([5, 1, 40, 7, 7, 100, 3, 2, 61, 9, 33])]
    for shards in (1, 3, 7):
        m = sharding.communication_matrix(spark.createDataFrame(sizes, "blk long, n long"), shards, 16, 5).collect()
        counts = {r["blk"]: [b - a for a, b in zip([0, *r["upto"]], r["upto"])] for r in m}
        assert {k: sum(v) for k, v in counts.items()} == dict(sizes) and all(x >= 0 for v in counts.values() for x in v)
        total = sum(n for _, n in sizes)
        assert [sum(v[s] for v in counts.values()) for s in range(shards)] == [total // shards + (s < total % shards) for s in range(shards)]


def test_places_are_uniform_whatever_the_blocks(spark):
    """Where each of 12 rows goes over many seeds: every (shard, slot) about as often (chi-square, 11 degrees, far tail)."""
    seen = [[0] * 12 for _ in range(12)]
    runs = 60
    for seed in range(runs):
        out = sharding.shuffle_into_shards(spark.range(12).coalesce(1), 3, seed=seed * 17 + 3, blocks=4, parts=2).collect()
        assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(3) for k in range(4)]
        for r in out:
            seen[r["id"]][r["shard"] * 4 + r["slot"]] += 1
    expected = runs / 12
    worst = max(sum((x - expected) ** 2 / expected for x in row) for row in seen)
    assert worst < 45


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op1_sharding(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    by = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(16)]
    assert all(x == list(range(len(x))) for x in by) and max(map(len, by)) - min(map(len, by)) <= 1


def test_decontamination_without_broadcasts(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda: sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs.where(F.col("doc_id").isNotNull()), bench).collect())
    with_broadcasts = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert rows() == with_broadcasts
