"""Reply trees to training conversations, in DataFrame operations only.

Nodes are (tree, node, parent, role, text, score). Self-joins by doubling climb the trees: a table of jumps says
which node lies 2**k above each node, with the scores between summed up, so branches rank by their score before any
path is written out. The members of the chosen leaves' paths then double their reach with each join, so a path of n
turns takes about log n joins; each is formatted as one conversation.

Format of a turn: "<|turn|>" role "\n" text "<|end|>", with the role percent-encoded and the text escaped: a backslash
stands before each backslash, and after a "<" or "[" that would begin a control string, so no control string of
this or of common templates can stand inside a text, and unescape (a backslash gives way to what follows it)
restores every text. The loss mask is the spans of the assistant's escaped texts, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize

TURN, END = "<|turn|>", "<|end|>"
#: What begins a control string of this template or of common ones.
_CONTROL = r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def parents_of_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of linear conversations: each turn replies to the one before. Rows that share a turn follow each other by
    role, then text; null turns come first."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    return df.select(
        F.col(conv).cast("long").alias("tree"), F.row_number().over(w).cast("long").alias("node"), F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(0.0).alias("score"),
    ).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", "score")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (tree, node, above) of the node 2**k above each, for k = 0, 1, ...; and (tree, leaf, mean, depth) of the leaves.

    Each join doubles what a node knows: how many nodes its path to the root has and the sum of their scores (null as 0). So
    leaves are ranked without their paths being enumerated: n rows a join, about log n joins. A parent that isn't in the tree counts
    as none. A circle of replies has no leaf of its own; what hangs below one is an error (ValueError), for its path has no root.
    """
    ids = nodes.select("tree", "node")
    parents = nodes.where("parent is not null").select("tree", F.col("node").alias("_node"), "parent")
    known = parents.join(ids.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", F.col("_node").alias("node"), F.col("parent").alias("above"))
    told = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("steps")).join(known, ["tree", "node"], "left")
    levels = [materialize(told.select("tree", "node", "above", "total", "steps"), "climb")]
    leaves = ids.join(levels[0].where("above is not null").select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    most, reach = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1

    def at_root() -> DataFrame:
        out = levels[0].where("above is null")
        for level in levels[1:]:
            out = out.unionByName(level.where("above is null"))
        return out

    while not (going := levels[-1].where("above is not null")).isEmpty():
        if reach > most:  # only circles go on
            if not going.join(leaves, ["tree", "node"], "left_semi").isEmpty():
                raise ValueError("a reply tree has a circle above a leaf")
            break
        up = at_root().unionByName(going).select("tree", F.col("node").alias("above"), F.col("above").alias("top"), F.col("total").alias("more"), F.col("steps").alias("further"))
        further = going.join(up, ["tree", "above"])  # only nodes that have not reached their root go on
        levels.append(materialize(further.select("tree", "node", F.col("top").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps")), "climb"))
        reach *= 2
    ranks = at_root().join(leaves, ["tree", "node"], "left_semi")
    return levels, materialize(ranks.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("steps")).alias("mean"), (F.col("steps") - 1).alias("depth")), "leaves")


def members(tables: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the members of the paths from those leaves to their roots, up steps above the leaf. Each join
    doubles the reach of all paths at once."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, table in enumerate(tables[:-1]):  # of the last, all have reached their root
        further = paths.join(table.where("above is not null").select("tree", "node", "above"), ["tree", "node"])
        paths = materialize(paths.unionByName(further.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up"))), "paths")
    return paths


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the members of every root-to-leaf path."""
    tables, leaves = climb(nodes)
    return members(tables, leaves)


def best_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node, pos): members of each tree's best ``branches`` paths (None: all), root first. Only these are
    enumerated.

    A path's score is the mean of its nodes' scores, null as 0; ties go to the longer path, then the smaller leaf.
    """
    tables, leaves = climb(nodes)
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("depth"), F.asc("leaf"))
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    ranked = materialize(ranked, "ranked")
    out = members(tables, ranked).join(ranked.select("tree", "leaf", "rank", "depth"), ["tree", "leaf"])
    out = materialize(out.select("tree", "leaf", "rank", "node", (F.col("depth") - F.col("up")).alias("pos")), "chosen")
    discard(*tables, leaves, ranked)
    return out


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row a chosen path: (tree, leaf, rank, formatted, mask array<struct<start,end>> in code points)."""
    turns = chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(TURN), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"))
    pieces = turns.select("tree", "leaf", "rank", "pos", "role", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    pieces = pieces.withColumns({"lead": F.length("head").cast("long"), "size": F.length("body").cast("long")})
    packed = F.sort_array(F.collect_list(F.struct("pos", "head", "body", "lead", "size", "role")))
    rows = pieces.groupBy("tree", "leaf", "rank").agg(packed.alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("mask"))

    def step(acc, t):
        begin = acc["at"] + t["lead"]
        span = F.array(F.struct(begin.alias("start"), (begin + t["size"]).alias("end")))
        return F.struct(
            (begin + t["size"] + len(END)).alias("at"),
            F.when(t["role"].eqNullSafe("assistant"), F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"),
        )

    return rows.select(
        "tree", "leaf", "rank",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("t", start, step)["mask"].alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, rank, turns array<struct<role,text>>, loss string): what a formatted conversation says."""
    chunks = F.slice(F.split("formatted", F.lit(r"\Q" + END + r"\E"), -1), 1, F.size(F.split("formatted", F.lit(r"\Q" + END + r"\E"), -1)) - 1)
    body = F.transform(chunks, lambda c: F.substr(c, F.lit(len(TURN) + 1)))
    turns = F.transform(body, lambda c: F.struct(
        F.url_decode(F.substring_index(c, "\n", 1)).alias("role"),
        unescape(F.substr(c, F.length(F.substring_index(c, "\n", 1)) + 2)).alias("text"),
    ))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return formatted.select("tree", "leaf", "rank", "formatted", turns.alias("turns"), loss.alias("loss"))


#: Stands for a missing tree id while trees are joined.
_NO_TREE = -(1 << 63)


def conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """Reply trees to formatted conversations: (tree, leaf, rank, formatted, mask). An empty table gives none.

    Nodes without a tree id make one tree, whose id is null again in the result. Nodes without a node id cannot
    be replied to or placed and are left out. Of rows that share a node id in a tree, the least (by parent, role, text,
    score; null first) counts. Null roles and texts are empty, null scores 0. Other columns are not read.
    """
    rows = nodes.where("node is not null").select(F.coalesce("tree", F.lit(_NO_TREE)).alias("tree"), "node", F.struct("parent", "role", "text", "score").alias("n"))
    nodes = materialize(rows.groupBy("tree", "node").agg(F.min("n").alias("n")).select("tree", "node", "n.parent", "n.role", "n.text", "n.score"), "nodes")
    return format_paths(nodes, best_paths(nodes, branches)).withColumn("tree", F.nullif("tree", F.lit(_NO_TREE)))
