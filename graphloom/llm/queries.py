"""One query for each corpus operator, over its whole table, with the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sharding import shuffle_into_shards

    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).cast("long").alias("text_crc32"))
    dealt = shuffle_into_shards(docs, 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.bpe import encode

    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs, model).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import decontaminate

    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.learned_from(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import chat

    # A null conversation is one too: inside a struct it has equals.
    given = table(spark, sf_dir, "conversations").select(F.struct(F.col("conv_id").cast("long").alias("id")).alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = chat.END + chat.START + "assistant ok"
    added = spark.range(2).select(F.struct(F.lit(-1).cast("long").alias("id")).alias("tree"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    # A turn with several rows: they follow each other by role and text. Rows without a turn come last.
    linked = chat.chain(given.unionByName(added), "tree", [F.col("turn").asc_nulls_last(), "role", "text"]).withColumn("score", F.lit(1.0))
    chats = chat.format_chats(linked).select("tree", "formatted", "spans", chat.read_back(F.col("formatted")).alias("turns"))
    learned = F.array_join(F.transform("spans", lambda s: chat.unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("tree.id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix_sources, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("text_md5"))
    return mix_sources(docs, identity=["doc_id", "text_md5"]).select("doc_id", "size", "source_size", "target", "taken")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.whitening import whiten

    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "c"), "identity_error")
    return each.select("vec_id", (F.col("component") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def queries() -> dict:
    import corpus_pipeline

    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


#: A text's words after A-Z are lower-cased, in DuckDB.
WORDS = r"[w for w in regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if w <> '']"

ORACLE: dict[str, str] = {
    "op12_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) t(m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.*, l.f AS l, r.f AS r, n, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score,
      FROM (SELECT *, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM k) k
      JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM s) WHERE q = 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, a FROM (SELECT lang, a, ws, j, unnest(range(1, m - j + 2)) AS i FROM c, range(2, 5) t(j) WHERE j < m)),
kept AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.a >= 100 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o WHERE rank <= 2000
""",
    "op11_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS lim FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT *, lim <= level * weight AS filled, arg_min(level, struct_pack(a := lim / weight, b := place)) FILTER (lim > level * weight) OVER () AS rest FROM s3),
s AS (SELECT source, source_size, place, CASE WHEN filled THEN lim ELSE rest * weight END AS target, greatest(1, least(256, source_size // 256)) AS block FROM s4),
k AS (SELECT d.*, place, CAST('0x' || substr(key, 1, 8) AS BIGINT) % greatest(64, (count(*) OVER () + 49999) // 50000) AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT place, shard, words, (words + block - 1) // block AS blocks, target, source_size FROM (SELECT place, shard, CAST(sum(size) AS BIGINT) AS words FROM k GROUP BY ALL) JOIN s USING (place)),
v AS (SELECT place, sum(blocks) AS have, CASE WHEN source_size > 0 THEN target * sum(blocks) / source_size ELSE 0.0 END AS votes FROM c GROUP BY place, target, source_size),
vq AS (SELECT place, have, votes, votes / (2 * unnest(range(0, CAST(2 * have + 64 AS BIGINT))) + 1) AS quotient, floor(sum(votes) OVER () + 0.5) AS seats FROM v),
w AS (SELECT place, least(count(*), any_value(2 * have)) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, place) AS r FROM vq) WHERE r <= seats AND quotient > 0 GROUP BY place),
cq AS (SELECT c.place, shard, blocks, CAST(blocks AS DOUBLE) / (2 * unnest(range(0, 2 * blocks + 64)) + 1) AS quotient, seats FROM c JOIN w USING (place)),
q AS (SELECT place, shard, least(count(*), any_value(2 * blocks)) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard) AS r FROM cq) WHERE r <= seats AND quotient > 0 GROUP BY place, shard),
b0 AS (SELECT place, shard, words, blocks, coalesce(quota, 0) AS quota, unnest(range(0, blocks)) AS j FROM c LEFT JOIN q USING (place, shard)),
b AS (SELECT *, quota // blocks + CASE WHEN row_number() OVER (PARTITION BY place, shard ORDER BY md5('11:' || place || ':' || shard || ':' || j), j) <= quota % blocks THEN 1 ELSE 0 END AS times FROM b0),
l AS (SELECT *, row_number() OVER () AS row, sum(size) OVER (PARTITION BY place, shard ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS start FROM k),
t AS (SELECT row, sum((least(start + size, (j + 1) * words // blocks) - greatest(start, j * words // blocks)) * times) AS taken
      FROM l JOIN b ON l.place = b.place AND l.shard = b.shard AND start < (j + 1) * words // blocks AND start + size > j * words // blocks GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM l JOIN s USING (place) LEFT JOIN t USING (row)
""",
    "op3_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_chat": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
           SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) x(t)),
e AS (SELECT *, replace(replace(text, chr(92), chr(92) || 'e'), '<|', '<' || chr(92) || 'p') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, text, i, array_to_string(ls[i:i + 2], chr(10)) AS win FROM (SELECT *, unnest(range(1, greatest(1, len(ls) - 2) + 1)) AS i FROM d)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM f WHERE k > 1),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS text FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(kept.text, '') AS text, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("text")} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS ws FROM benchmark),
win AS (SELECT item, ws[i:i + 9] AS w FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(w) AS n FROM win),
pos AS (SELECT r, i, ws[i:i + n - 1] AS w, n FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens)),
hit AS (SELECT r, i, n, item FROM pos JOIN win USING (w)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
""",
}
