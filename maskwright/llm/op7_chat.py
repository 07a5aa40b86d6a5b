"""Chat formatting of reply trees.

nodes: tree_id, node_id, parent_id (null at a root), role, text, score. Iterative
self-joins find each node's depth and sum of scores: in each round a node is joined to the
ancestor it has reached, so the steps double and a tree of depth d takes log2(d) rounds.
Leaves are root-to-leaf paths; they are ranked in their tree by the sum of scores (ties:
smaller leaf first), first within salts and then across them, so that no tree's leaves
meet in one task unranked. The tables of the rounds then give the nodes of the best `top`
paths, and their texts, joined last, become one conversation a path. What is moved is in
proportion to nodes, rounds and the length of the chosen paths.

The template is START role newline text END newline. Control strings inside a text get a
backslash behind their first character, and one more if backslashes stand there already;
the reverse takes one away, so every text comes back as it was and no text can open or end
a turn. In roles, % and newline are written %25 and %0A.

Defined cases: null texts and roles are empty; a parent that is not in the table makes its
node a root; nodes in or under a cycle have no root and are left out; nodes with a null
tree_id or node_id are left out; of repeated node_ids the first by role and text counts;
null scores are 0; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import let, stored, table

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, by first character and rest.
CONTROL_ANGLE = "\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|<SYS>>|</SYS>>"
CONTROL_SQUARE = "INST\\]|/INST\\]"
SALTS = 64


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, f"<(\\\\*)({CONTROL_ANGLE})", "<\\\\$1$2")
    return F.regexp_replace(out, f"\\[(\\\\*)({CONTROL_SQUARE})", "[\\\\$1$2")


def unescape(text: Column) -> Column:
    out = F.regexp_replace(text, f"\\[\\\\(\\\\*)({CONTROL_SQUARE})", "[$1$2")
    return F.regexp_replace(out, f"<\\\\(\\\\*)({CONTROL_ANGLE})", "<$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Ancestors by doubling: each node's depth and the sum of scores from its root, and a jump table a round.

    In round k a node that has not reached its root is joined to its ancestor 2 ** k steps
    up; the table of that round has these ancestors. Nodes that are still climbing after
    as many rounds as the table allows are in or under a cycle and have no depth.
    """
    slim = stored(nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    # A parent outside the table is no parent.
    found = slim.alias("n").join(slim.alias("p"), (F.col("n.tree_id") == F.col("p.tree_id")) & (F.col("n.parent_id") == F.col("p.node_id")), "left")
    steps = F.when(F.col("p.node_id").isNull(), 0).otherwise(1).cast("long").alias("depth")
    # depth and score: of the nodes from this one up to, without, the ancestor in up.
    state = stored(found.select("n.tree_id", "n.node_id", F.col("p.node_id").alias("up"), steps, "n.score"))
    limit, jumps = state.count(), []
    done, active = state.filter(F.col("up").isNull()), state.filter(F.col("up").isNotNull())
    while 1 << len(jumps) <= limit and active.limit(1).count():
        jumps.append(active.select("tree_id", "node_id", "up"))
        joined = active.alias("b").join(active.union(done).alias("a"), (F.col("b.tree_id") == F.col("a.tree_id")) & (F.col("b.up") == F.col("a.node_id")))
        state = stored(joined.select("b.tree_id", "b.node_id", F.col("a.up").alias("up"), (F.col("b.depth") + F.col("a.depth")).alias("depth"), (F.col("b.score") + F.col("a.score")).alias("score")))
        done, active = done.union(state.filter(F.col("up").isNull())), state.filter(F.col("up").isNotNull())
    return done, jumps


def leaves(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """One row a root-to-leaf path: tree_id, leaf, score."""
    parents = nodes.select("tree_id", F.col("parent_id").alias("node_id")).filter(F.col("node_id").isNotNull())
    return state.join(parents, ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf"), "score")


def on_paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """The nodes of the chosen paths: tree_id, rank, node_id.

    From the longest jump to the shortest, every node so far brings in the one that many
    steps above it, so each ancestor comes in once and no path is ever held in one row.
    """
    rows = chosen.select("tree_id", "rank", F.col("leaf").alias("node_id"))
    for jump in reversed(jumps):
        above = rows.join(jump, ["tree_id", "node_id"]).select("tree_id", "rank", F.col("up").alias("node_id"))
        rows = stored(rows.union(above))
    return rows


def ranked(found: DataFrame, top: int | None) -> DataFrame:
    """The best paths of each tree with their rank; all of them, unranked but for a unique number, if top is None."""
    if top is None:
        return found.withColumn("rank", F.monotonically_increasing_id())
    best = [F.col("score").desc(), F.col("leaf")]
    salted = Window.partitionBy("tree_id", F.pmod(F.xxhash64("leaf"), F.lit(SALTS))).orderBy(*best)
    rows = found.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(*best))).filter(F.col("rank") <= top)


def conversations(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """One row a chosen path (top=None: all of them): tree_id, rank, formatted, loss (array of start and length in code points)."""
    nodes = nodes.filter(F.col("tree_id").isNotNull() & F.col("node_id").isNotNull())
    first = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent_id", "score"))
    nodes = nodes.groupBy("tree_id", "node_id").agg(first.alias("n")).select("tree_id", "node_id", "n.*")
    nodes = stored(nodes)
    state, jumps = climbed(nodes)
    steps = on_paths(stored(ranked(leaves(nodes, state), top)), jumps)
    places = state.select("tree_id", "node_id", F.col("depth").alias("at"))
    turns = steps.join(places, ["tree_id", "node_id"]).join(nodes.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    head = lambda t: F.concat(F.lit(START), _escape_role(t.role), F.lit("\n"))
    parts = lambda turn: F.transform(turn, lambda t: F.struct(head(t).alias("head"), escape(t.text).alias("body"), (t.role == "assistant").alias("learnt")))
    rows = turns.groupBy("tree_id", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns")).select("tree_id", "rank", parts(F.col("turns")).alias("parts"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(so_far: Column, p: Column) -> Column:
        start, length = so_far.at + F.length(p.head), F.length(p.body).cast("long")
        spans = F.when(p.learnt, F.concat(so_far.spans, F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(so_far.spans)
        return F.struct((start + length + len(END) + 1).alias("at"), spans.alias("spans"))

    loss = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda s: s.spans)
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END + "\n"))), "")
    return rows.select("tree_id", "rank", whole.alias("formatted"), loss.alias("loss"))


def turns_of(formatted: Column) -> Column:
    """Reads a conversation back: array of role and text, unescaped."""
    pieces = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def learnt_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    nodes = nodes.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(1.0))
    back = conversations(nodes).select("tree_id", "formatted", turns_of(F.col("formatted")).alias("turns"), F.array_join(learnt_texts(F.col("formatted"), F.col("loss")), "").alias("learnt"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(escaped) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
