"""Reply trees: root-to-leaf paths of conversations, ranked and formatted.

``paths`` finds the paths by doubling: every node holds a pointer that first names its parent and in
each round jumps to what that node's pointer names, so a chain of n replies takes log2(n) self-joins.
Depth and score are summed along the way. Leaves are ranked in their conversation by the mean
score of their path, then depth, then node id. The chosen leaves then collect their nodes by the same
jumps, longest first, which names every ancestor once.

The template marks a turn as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash
is doubled and one is put after the first character of every control string (``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``), so none stands there whole; dropping each backslash
before any character gives the text back.

Defined results: a null text or role is empty; a null or unknown parent makes a root; of rows that
repeat a node id in a conversation the least (role, text) is read; nodes on a cycle have no root and
are on no path; a null conversation id is a conversation of its own and a null node id a node of its own in it; a
null score counts 0; turns of equal number are ordered by role and text. Very long texts are escaped whole. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estratia.llm.common import cut, drop_cut, whole

# The marks of the template and the control strings that texts must not hold.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Tree rows (conv_id, node, parent, role, text, score) of conversations that are lists of turns.

    A turn's parent is the one before it. Turns are numbered in their own conversation.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), whole(role).alias("role"), whole(text).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _keyed(nodes: DataFrame) -> DataFrame:
    """conv_id, node and parent as keys of which a null is equal to a null; a missing parent stays null."""
    key = lambda c: F.struct(F.col(c).alias("v"))
    parent = F.when(F.col("parent").isNotNull(), key("parent"))
    return nodes.select(key("conv_id").alias("conv_id"), key("node").alias("node"), parent.alias("parent"), "role", "text", "score")


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """conv_id, leaf, branch_rank, branch_score, node, depth: the nodes of the ``best`` branches of each conversation."""
    plain = [F.col(f"{c}.v").alias(c) if c in ("conv_id", "leaf", "node") else F.col(c) for c in ("conv_id", "leaf", "branch_rank", "branch_score", "node", "depth")]
    return _paths(_keyed(nodes), best).select(*plain)


def _paths(nodes: DataFrame, best: int | None) -> DataFrame:
    row = F.struct(whole("role").alias("role"), whole("text").alias("text"), "parent", "score")
    rows = nodes.groupBy("conv_id", "node").agg(F.min(row).alias("x"))
    rows = cut(rows.select("conv_id", "node", "x.parent", F.coalesce("x.score", F.lit(0.0)).alias("score")))
    parents = rows.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    rows = rows.join(parents, ["conv_id", "parent"], "left")
    up = F.when(F.col("known"), F.col("parent"))
    now = cut(rows.select("conv_id", "node", up.alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    # A path is no longer than its conversation, so pointers still open after that many rounds lie on cycles
    largest = rows.groupBy("conv_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    # Only nodes whose pointer is open jump; the others are done
    done, open_ = now.where("up is null"), now.where("up is not null")
    steps = []
    while 2 ** len(steps) <= 2 * largest and not open_.isEmpty():
        steps.append(open_.select("conv_id", "node", "up"))
        far = done.union(open_).select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        jumped = open_.join(far, ["conv_id", "up"], "left")
        depth = F.col("depth") + F.coalesce("d2", F.lit(0))
        total = F.col("total") + F.coalesce("t2", F.lit(0.0))
        stepped = cut(jumped.select("conv_id", "node", F.col("up2").alias("up"), depth.alias("depth"), total.alias("total")))
        done, open_ = done.union(stepped.where("up is null")), stepped.where("up is not null")
    now = done.union(open_)
    inner = rows.where("known").select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = now.where("up is null").join(inner, ["conv_id", "node"], "left_anti")
    leaves = leaves.withColumn("branch_score", F.col("total") / F.col("depth"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("branch_score"), F.desc("depth"), "node")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(order))
    if best is not None:
        leaves = leaves.where(F.col("branch_rank") <= best)
    # Written after each step, so that no plan holds the joins of all steps
    found = cut(leaves.select("conv_id", F.col("node").alias("leaf"), "branch_rank", "branch_score", "node"))
    for step in reversed(steps):
        near = found.join(step, ["conv_id", "node"], "left")
        both = F.explode(F.array_compact(F.array("node", "up"))).alias("node")
        longer = cut(near.select("conv_id", "leaf", "branch_rank", "branch_score", both))
        drop_cut(found)
        found = longer
    return found.join(now.select("conv_id", "node", "depth"), ["conv_id", "node"])


def formatted(nodes: DataFrame, best: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """conv_id, leaf, branch_rank, branch_score, formatted, segments: one row for each chosen branch.

    segments are the pieces of formatted in order with their loss flag, which only whole texts of
    ``trained_role`` carry.
    """
    nodes = _keyed(nodes)
    texts = nodes.groupBy("conv_id", "node").agg(F.min(F.struct(whole("role").alias("role"), whole("text").alias("text"))).alias("x"))
    rows = _paths(nodes, best).join(texts, ["conv_id", "node"])
    turn = F.struct("depth", escape(F.col("x.role")).alias("role"), escape(F.col("x.text")).alias("text"), (F.col("x.role") == trained_role).alias("loss"))
    keys = ["conv_id", "leaf", "branch_rank", "branch_score"]
    made = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
        parts = ((head, F.lit(False)), (t["text"], t["loss"]), (F.lit(END), F.lit(False)))
        return F.array(*(F.struct(p.alias("piece"), loss.alias("loss")) for p, loss in parts))

    made = made.withColumn("segments", F.flatten(F.transform("turns", pieces)))
    whole_text = F.array_join(F.transform("segments", lambda s: s["piece"]), "")
    return made.select(F.col("conv_id.v").alias("conv_id"), F.col("leaf.v").alias("leaf"), *keys[2:], whole_text.alias("formatted"), "segments")


def read_back(conversations: DataFrame) -> DataFrame:
    """``conversations`` with turns (role, text) and loss_text, read from the formatted text and segments."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.size(F.split("formatted", r"<\|turn\|>")) - 1)

    def turn(part: Column) -> Column:
        sides = F.split(part, r"<\|text\|>")
        text = F.regexp_replace(F.get(sides, F.lit(1)), r"<\|end\|>$", "")
        return F.struct(unescape(F.get(sides, F.lit(0))).alias("role"), unescape(text).alias("text"))

    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"]))
    return conversations.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(lost, ""))
