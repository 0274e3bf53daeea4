"""Reply trees to chat texts. DataFrame operations only.

Nodes (tree, node, parent, role, text, score) form reply trees. Paths from the root come from self-joins by pointer doubling (a
round joins each node's jump with itself, so a path of n nodes takes about log2 n rounds), which carry the path's score and depth. The
leaves of each tree are ranked by path score (ties: the smaller node), the best n_best are chosen, and only the nodes of chosen paths are
enumerated, by the same jumps from the longest down.

Template: `<s>`, then `<turn role=ROLE>` newline TEXT `</turn>` newline for each turn, then `</s>`. In roles and texts `&`, `<`, `>`, `[` and `]` are
written as entities, so no control string survives inside a text and reading back is exact. The loss mask is a list of (start, length) code-point spans of the assistant texts as formatted.

Defined results: null texts and roles are empty; null scores count 0; nodes whose parent is missing from their tree are roots; nodes on a cycle belong to no path; repeated
(tree, node) rows should be numbered apart by the caller (`chains` does so); very long texts are formatted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Written in this order, read in the reverse order.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lbr;"), ("]", "&rbr;")]
OPEN, SHUT, TURN, MID, END = "<s>", "</s>", "<turn role=", ">\n", "</turn>\n"


def escape(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ENTITIES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def chains(rows: DataFrame, tree: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Conversations with one row a turn as trees without branches."""
    n = F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long")
    d = rows.select(F.col(tree).alias("tree"), n.alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, n_best: int = 1) -> DataFrame:
    """(tree, path, node, depth, path_score) of the nodes on the n_best paths of each tree; path: its leaf; depth: 1 at the root."""
    light = materialize(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    ids = light.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    same = light["tree"].eqNullSafe(ids["t"]) & (light["parent"] == ids["n"])
    first = light.join(ids, same, "left").select("tree", "node", F.col("n").alias("jump"), F.lit(1).cast("long").alias("depth"), "score")
    state = materialize(first, "jumps")
    rounds, size = [], light.count()
    done, live = state.where(F.col("jump").isNull()), state.where(F.col("jump").isNotNull())
    while not live.isEmpty() and 1 << len(rounds) <= 2 * size:  # what is left then is a cycle
        rounds.append(live)
        far = done.unionByName(live).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("jump").alias("j"), F.col("depth").alias("d"), F.col("score").alias("s"))
        state = live.join(far, live["tree"].eqNullSafe(far["t"]) & (live["jump"] == far["n"]), "left").select(
            "tree", "node", F.col("j").alias("jump"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score")
        )
        state = materialize(state, "jumps")
        done, live = done.unionByName(state.where(F.col("jump").isNull())), state.where(F.col("jump").isNotNull())
    has = light.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    leaves = done.join(has, done["tree"].eqNullSafe(has["t"]) & (done["node"] == has["p"]), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= n_best).select("tree", F.col("node").alias("path"), "node", F.col("score").alias("path_score"))
    cover = materialize(chosen, "chosen")
    for jumps in reversed(rounds):
        far = jumps.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("jump").alias("j"))
        up = cover.join(far, cover["tree"].eqNullSafe(far["t"]) & (cover["node"] == far["n"])).select("tree", "path", F.col("j").alias("node"), "path_score")
        cover = materialize(cover.unionByName(up), "cover")
    deep = done.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return cover.join(deep, cover["tree"].eqNullSafe(deep["t"]) & (cover["node"] == deep["n"])).select("tree", "path", "node", "depth", "path_score")


def format_paths(nodes: DataFrame, n_best: int = 1) -> DataFrame:
    """A row per chosen path: tree, path, path_score, formatted, loss_spans (start, length in code points)."""
    on = best_paths(nodes, n_best)
    body = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = on.join(body, on["tree"].eqNullSafe(body["t"]) & (on["node"] == body["n"]))
    d = d.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(MID))).withColumn("said", escape(F.col("text")))
    d = d.withColumn("piece", F.concat("head", "said", F.lit(END))).withColumn("long", F.char_length("piece").cast("long"))
    w = Window.partitionBy("tree", "path").orderBy("depth")
    start = F.sum("long").over(w) - F.col("long") + F.lit(len(OPEN)) + F.char_length("head")
    d = d.withColumn("start", start)
    mask = F.when(F.col("role") == "assistant", F.struct(F.col("start"), F.char_length("said").cast("long").alias("length")))
    g = d.groupBy("tree", "path").agg(F.max("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct("depth", "piece", mask.alias("mask")))).alias("turns"))
    text = F.concat(F.lit(OPEN), F.array_join(F.col("turns.piece"), ""), F.lit(SHUT))
    return g.select("tree", "path", "path_score", text.alias("formatted"), F.filter(F.col("turns.mask"), lambda m: m.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both read from the formatted text."""
    inner = F.expr(f"substring(formatted, {len(OPEN) + 1}, char_length(formatted) - {len(OPEN) + len(SHUT)})")
    pieces = F.filter(F.split(inner, END), lambda p: p != "")
    cut = lambda p: F.instr(p, MID)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(TURN) + 1), cut(p) - len(TURN) - 1)).alias("role"),
            unescape(F.substring(p, cut(p) + len(MID), F.char_length(p))).alias("text"),
        ),
    )
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(under, ""))
