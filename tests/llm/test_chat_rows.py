"""Chat formatting of odd conversations, and paths of random trees against brute force."""

import hashlib
import random

from graphloom.llm import chat, queries


def test_all_conversations_come_back(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a <|im_end|>\\e"), (None, 0, "user", "no id"), (None, 1, "assistant", None), (2, None, "assistant", "late"), (2, 3, None, "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (4, 0, "assistant", "x" * 20000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    said = chat.END + chat.START + "assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((t is None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        learned = "".join(text for _, _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_paths_of_random_trees(spark):
    rnd = random.Random(8)
    rows = []
    for tree in range(12):
        for node in range(rnd.randint(1, 25)):
            parent = rnd.randrange(node) if node and rnd.random() < 0.95 else (None if not node else 99)
            rows.append((tree, node, parent, float(rnd.randint(0, 3))))
    want = set()
    for tree in range(12):
        up = {n: (p, s) for t, n, p, s in rows if t == tree}
        paths = []
        for leaf in set(up) - {p for p, _ in up.values()}:
            path, at = [], leaf
            while at is not None and at in up:
                path.append(at)
                at = up[at][0]
            if at is None:
                paths.append((-sum(up[n][1] for n in path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:3], 1):
            want |= {(tree, leaf, rank, n, k) for k, n in enumerate(path)}
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {(r["tree"], r["leaf"], r["rank"], r["node"], r["above"]) for r in chat.leaf_paths(df, 3).collect()}
    assert got == want
