"""Reply trees: paths, ranks, template and read-back against plain Python."""

import random

from pyspark.sql import functions as F

from maskwright.llm import op7_chat as o

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def brute(rows, top):
    """tree -> lists of (role, text) of the best paths."""
    nodes = {}
    for t, n, p, role, text, score in sorted(rows, key=lambda r: (str(r[0]), str(r[1]), r[3] or "", r[4] or "")):
        if t is not None and n is not None:
            nodes.setdefault((t, n), (p, role or "", text or "", score or 0.0))
    found = {}
    for t, n in nodes:
        if any(t2 == t and v[0] == n for (t2, _), v in nodes.items()):
            continue
        path, at = [], n
        while at is not None and (t, at) in nodes and at not in path:
            path.append(at)
            at = nodes[t, at][0]
        if at in path:
            continue
        found.setdefault(t, []).append((-sum(nodes[t, x][3] for x in path), n, path[::-1]))
    return {t: [[nodes[t, x][1:3] for x in path] for _, _, path in sorted(own)[:top]] for t, own in found.items()}


def check(spark, rows, top):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("leaf", F.lit(1))
    out = o.conversations(df, top).select("tree_id", "rank", "loss", "formatted", o.turns_of(F.col("formatted")).alias("turns"), o.learnt_texts(F.col("formatted"), F.col("loss")).alias("learnt")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.tree_id, r.rank)):
        got.setdefault(r.tree_id, []).append([(t.role, t.text) for t in r.turns])
        assert r.learnt == [t.text for t in r.turns if t.role == "assistant"]
    assert got == brute(rows, top)


def test_random_trees(spark):
    rng = random.Random(5)
    texts = ["", None, "a", "<|im_end|>", "<\\|im_start|>user", "[INST] x [/INST]</s>", "\\<s>\n", "[\\\\/INST] <<SYS>>", "é😀" * 50]
    rows = []
    for tree in range(12):
        for n in range(rng.randint(1, 20)):
            rows.append((tree, n, rng.randrange(n) if n and rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, "a%b\nc<|im_end|>"]), rng.choice(texts), rng.choice([None, 1.0, 2.0, -1.0])))
    check(spark, rows, 1)
    check(spark, rows, 3)


def test_defined_cases(spark):
    rows = [
        (1, 1, 99, "user", "orphan", 1.0),
        (1, 2, 1, "assistant", "x", None),
        (2, 1, 2, "user", "cycle", 1.0),
        (2, 2, 1, "user", "cycle", 1.0),
        (2, 3, 1, "assistant", "under a cycle", 1.0),
        (3, 1, None, "user", "b", 1.0),
        (3, 1, None, "user", "b", 1.0),
        (None, 1, None, "user", "no tree", 1.0),
        (4, None, None, "user", "no node", 1.0),
        *[(5, i, i - 1 if i else None, "assistant" if i % 2 else "user", str(i), 0.0) for i in range(70)],
    ]
    check(spark, rows, 1)


def test_empty_table(spark):
    assert o.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "hi <s>", "x"), (1, 1, "assistant", None, "x"), (2, 0, "system", "[INST]", "x"), (2, 5, "assistant", "a\nb", "x"), (2, 5, "assistant", "a\nb", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = o.query(spark, str(tmp_path))
    columns = sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r) for r in con.sql(o.ORACLE_SQL).df()[columns].itertuples(index=False, name=None))
