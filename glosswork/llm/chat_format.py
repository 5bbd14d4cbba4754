"""Reply trees: root-to-leaf paths, ranked by score, each chosen one formatted as a conversation.

Messages point to the one they answer. Every pass of a self-join doubles how far each message sees upwards, so that
a tree of depth ``d`` takes about ``log2(d)`` passes whatever its shape, and a thread that holds a third of all
messages is still one row for each message, joined on the message. A path is named by its leaf: its messages are
found downwards by halving the same way, so that no message list travels through the passes.

A path's score is the mean score of its messages; a tree's paths are ranked by it, ties going to the path whose leaf
comes first, and the best ``keep`` are formatted.

The template wraps each message as ``<|role|>\\n`` text ``<|end|>\\n``. Inside role and text ``\\`` becomes ``\\\\``
and ``<|`` becomes ``<\\|``, so no text can forge a mark and the original comes back exactly. The loss mask covers the
text of assistant messages, in code points of the formatted string.

Defined results: a null text or role is an empty string, a null score is 0. A message whose parent is null or absent
is a root. Messages of a cycle hang on no root and belong to no path. Repeated messages (equal tree and node) are
one: the smallest by role and text. Columns beside the named ones are left out. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.plans import written

MARK, END, LOSS_ROLE = "<|", "<|end|>\n", "assistant"  # fixed values of the template




def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Turn ``<\\|`` and ``\\\\`` back into what they stand for, read from left to right."""
    halves = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("<\\|"), F.lit("<|"))), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\!"))


def unescape_role(role: Column) -> Column:
    halves = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("\\!"), F.lit("|"))), "\\")


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, node, depth, total`` of every row that hangs on a root, and the ancestors at distance 1, 2, 4, ...

    Each pass joins an open row's ancestor at distance d with that one's ancestor at distance d; rows that have reached
    their root are done. While a row below a root is open, one at least closes in each pass; if none does, the open
    rows hang on a cycle.
    """
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    hung = nodes.join(known, nodes.tree.eqNullSafe(known["_t"]) & (nodes.parent == known["_n"]), "left")
    up = F.col("_n")
    reach = hung.select("tree", "node", up.alias("up"), up.isNotNull().cast("bigint").alias("depth"), F.col("score").alias("total"))
    levels: list[DataFrame] = []
    first = written(reach, "reach")
    closed, hanging = first.where(F.col("up").isNull()), first.where(F.col("up").isNotNull())
    open_rows = -1
    while True:
        left = hanging.count()
        if left in (0, open_rows):
            return closed.drop("up"), levels
        open_rows = left
        levels.append(hanging.select("tree", "node", "up"))
        every = closed.unionByName(hanging)
        above = every.select(*[F.col(c).alias(f"_{c}") for c in every.columns])
        joined = hanging.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_node")), "left")
        step = joined.select(
            "tree",
            "node",
            F.col("_up").alias("up"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"),
        )
        step = written(step, "reach")
        closed, hanging = closed.unionByName(step.where(F.col("up").isNull())), step.where(F.col("up").isNotNull())


def paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """The best ``keep`` (None: all) root-to-leaf paths of every tree: ``tree, leaf, path_score, depth, role, text``.

    ``messages`` has ``tree, node, parent, role, text, score``; one row comes back for each message of each path.
    """
    named = messages.select(
        "tree",
        "node",
        "parent",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    body = F.min(F.struct("role", "text", "parent", "score")).alias("m")
    nodes = written(named.groupBy("tree", "node").agg(body).select("tree", "node", "m.*"), "messages")
    settled, levels = _climb(nodes)
    parents = nodes.select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).where(F.col("_p").isNotNull()).distinct()
    leaves = settled.join(parents, settled.tree.eqNullSafe(parents["_t"]) & (settled.node == parents["_p"]), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / (F.col("depth") + 1)).alias("path_score"), "depth")
    if keep is not None:
        order = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
        leaves = leaves.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep).drop("_rank")
    members = written(leaves.withColumn("node", F.col("leaf")), "paths")
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k].select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        above = members.join(step, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        above = above.select("tree", "leaf", "path_score", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("node"))
        members = written(members.unionByName(above), "paths")
    texts = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    joined = members.join(texts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    return joined.select("tree", "leaf", "path_score", "depth", "role", "text")


def format_paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """One conversation for each chosen path: ``tree, leaf, path_score, formatted, spans``.

    ``spans`` has ``start, stop`` of every text under the loss mask, in code points of ``formatted``.
    """
    head = F.concat(F.lit(MARK), escape_role(F.col("role")), F.lit("|>\n"))
    body = escape(F.col("text"))
    pieces = paths(messages, keep).select(
        "tree", "leaf", "path_score", "depth", head.alias("head"), body.alias("body"), (F.col("role") == LOSS_ROLE).alias("loss")
    )
    long = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(long).over(before), F.lit(0)) + F.length("head"))
    row = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), "loss", "at", (F.col("at") + F.length("body")).alias("stop"))
    listed = placed.groupBy("tree", "leaf", "path_score").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(r["at"].alias("start"), r["stop"]))
    return listed.select(
        "tree", "leaf", "path_score", F.array_join(F.col("rows.piece"), "").alias("formatted"), spans.alias("spans")
    )


def read_formatted(formatted: Column) -> Column:
    """The messages of a formatted conversation: an array of ``role, text``."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)

    def message(piece: Column) -> Column:
        cut = F.locate("|>\n", piece)
        role = F.substring(piece, F.lit(len(MARK) + 1), cut - F.lit(len(MARK) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(piece, cut + 3, F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), message)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))


def threads(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: every row answers the one before it, in order of turn, role and text."""
    place = F.row_number().over(Window.partitionBy(conv_id).orderBy(turn, "role", "text")).cast("bigint")
    numbered = turns.select(F.col(conv_id).alias("tree"), place.alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.withColumn("parent", parent).withColumn("score", F.lit(0.0))
