"""Chat formatting of reply trees, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that mean something to this or another chat template; inside texts they get a backslash before them.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>"]
_ANY = "(?:" + "|".join("".join("\\" + c if c in "|[]<>/" else c for c in s) for s in CONTROL) + ")"
NO_ID = -(1 << 63)


def escape(text: Column) -> Column:
    """A control string gets one backslash; one that has backslashes before it gets one more."""
    return F.regexp_replace(text, rf"(\\*{_ANY})", r"\\$1")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, rf"\\(\\*{_ANY})", "$1")


def linear_replies(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as reply trees: each row answers the one before it, by turn, role and text (nulls first).

    Null conversation ids are one conversation; null roles and texts are empty.
    """
    rows = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("tree"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_first(), "role", "text"))
    numbered = rows.withColumn("node", place.cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Columns tree, branch, leaf, place, node: the nodes of each tree's best root-to-leaf paths, place 0 at the root.

    ``nodes`` has tree, node, parent, score. A branch's score is the sum of its
    nodes'; branches rank by score, descending, then by leaf. Self-joins double the stretch
    that a node looks upwards, and nodes that see their root drop out, so a path of d nodes takes log2(d) joins to sum
    and as many to enumerate; every join is on (tree, node), so one tree's rows
    spread over all tasks. A node whose parent isn't in the tree is a root; nodes
    above which there is no root (cycles) are on no path. Repeated (tree, node) keep their least parent, and its least score.
    """
    one = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("_x")).select("tree", "node", "_x.parent", F.coalesce("_x.score", F.lit(0.0)).alias("score"))
    one = written(one, "reply-nodes")
    known = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    up = one.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("above"), F.lit(1).cast("long").alias("size"), F.col("score").alias("total"))
    up = written(up, "reply-up")
    rounds = one.count().bit_length() + 1
    active, rooted, stretches = up.where("above is not null"), up.where("above is null"), []
    while len(stretches) < rounds and active.limit(1).count():
        stretches.append(active)
        state = active.unionByName(rooted).select("tree", F.col("node").alias("above"), F.col("above").alias("_a"), F.col("size").alias("_s"), F.col("total").alias("_t"))
        step = active.join(state, ["tree", "above"]).select("tree", "node", F.col("_a").alias("above"), (F.col("size") + F.col("_s")).alias("size"), (F.col("total") + F.col("_t")).alias("total"))
        step = written(step, "reply-up")
        active, rooted = step.where("above is not null"), rooted.unionByName(step.where("above is null"))
    inner = one.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "node"))
    best = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    paths = written(best.select("tree", "branch", F.col("node").alias("leaf"), (F.col("size") - 1).alias("place"), "node"), "reply-paths")
    for k in range(len(stretches) - 1, -1, -1):
        jump = stretches[k].select("tree", "node", "above")
        higher = paths.join(jump, ["tree", "node"]).select("tree", "branch", "leaf", (F.col("place") - F.lit(1 << k)).alias("place"), F.col("above").alias("node"))
        paths = written(paths.unionByName(higher), "reply-paths")
    return paths


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Columns tree, branch, leaf, formatted, loss: one row a path.

    A turn is TURN, role, TEXT, text, END, each on lines of its own, with
    control strings in role and text escaped. ``loss`` lists (start, length) of every
    assistant text in ``formatted``, in characters from 0.
    """
    turns = paths.join(nodes.select("tree", "node", "role", "text").dropDuplicates(["tree", "node"]), ["tree", "node"])
    head = F.concat(F.lit(f"{TURN}\n"), escape(F.col("role")), F.lit(f"\n{TEXT}\n"))
    turns = turns.select("tree", "branch", "leaf", "place", head.alias("head"), escape(F.col("text")).alias("body"), (F.lower("role") == "assistant").alias("learn"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(f"\n{END}\n")))
    before = Window.partitionBy("tree", "branch", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    turns = turns.select("tree", "branch", "leaf", "place", "piece", "learn", start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))
    whole = turns.groupBy("tree", "branch", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "learn", "start", "length"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("tree", "branch", "leaf", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, from a formatted conversation."""
    pieces = F.filter(F.split(formatted, rf"\n{_literal(END)}\n"), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(p.substr(F.lit(len(TURN) + 2), F.length(p)), rf"\n{_literal(TEXT)}\n", 2))
    return F.transform(parts, lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def _literal(s: str) -> str:
    return "".join("\\" + c if c in "|[]<>/" else c for c in s)


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns id_col, formatted, loss: linear conversations through ``reply_paths``. Extra columns are ignored; an empty table gives no rows."""
    nodes = written(linear_replies(df, id_col, turn_col, role_col, text_col), "reply-turns")
    out = format_paths(nodes, reply_paths(nodes))
    return out.select(F.when(F.col("tree") != NO_ID, F.col("tree")).alias(id_col), "formatted", "loss")
