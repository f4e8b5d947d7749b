"""Chat formatting of reply trees.

1. Iterative self-joins double an ancestor table: round k holds every message's
   2**k-th ancestor and the score sum of the messages passed, so a path of d messages
   takes log2(d) joins and the tables hold one row per message each.
2. Leaves walk up the tables and get their depth and mean score; a tree's branches are
   ranked by score and the best ``top_k`` are chosen (all with ``None``).
3. The chosen paths are enumerated with the same tables (every offset from a leaf is a
   sum of distinct powers of two, so each message appears once per path) and each path
   is formatted as one conversation.

Format: ``<|im_start|>role LF text <|im_end|> LF`` for each message.  Inside roles and
texts the backslash becomes ``\\b`` and ``<|`` becomes ``<\\p``; a line feed in a role
becomes ``\\n``.  A backslash therefore always starts an escape, control strings never
appear inside a text, and ``parse`` restores everything.  ``loss`` lists the spans
[start, end) in code points of the formatted string that carry training loss: the texts
of the roles in ``loss_roles``.

Cases: null role or text is empty; a null tree id is a tree of its own; a message whose
parent is null, missing or itself is a root; messages on a cycle lie on no path from a
root and are left out; equal scores are ranked by leaf; a null score counts as 0;
(tree, node) must be unique.  One path must fit one row, since it is one output value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
MESSAGE = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def _same(a: str, b: str, *pairs: tuple[str, str]):
    on = F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    for x, y in pairs:
        on = on & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return on


def ancestor_tables(nodes: DataFrame) -> list[DataFrame]:
    """Round k: (tree, node, up, total): the 2**k-th ancestor of every message that has one
    and the score sum of the 2**k messages from ``node`` to just below ``up``."""
    step = materialize(
        nodes.alias("a").join(nodes.alias("b"), _same("a", "b", ("parent", "node")))
        .where("a.parent != a.node")
        .select("a.tree", "a.node", F.col("a.parent").alias("up"),
                F.col("a.score").alias("total")), "chat-up0")
    tables, longest = [], nodes.count()
    # A path has at most as many messages as the table, so cycles end the loop as well.
    while not step.isEmpty() and (1 << len(tables)) <= longest:
        tables.append(step)
        step = materialize(
            step.alias("a").join(step.alias("b"), _same("a", "b", ("up", "node")))
            .select("a.tree", "a.node", "b.up", (F.col("a.total") + F.col("b.total")).alias("total")),
            f"chat-up{len(tables)}")
    return tables


def ranked_leaves(nodes: DataFrame, tables: list[DataFrame], top_k: int | None) -> DataFrame:
    """(tree, leaf, depth, score, rank) of the chosen branches."""
    leaves = nodes.alias("a").join(
        nodes.where("parent != node").alias("b"), _same("a", "b", ("node", "parent")), "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"),
                         F.lit(0.0).alias("total"), F.lit(1).cast("long").alias("depth"))
    for k in reversed(range(len(tables))):
        walk = (walk.alias("a").join(tables[k].alias("b"), _same("a", "b", ("at", "node")), "left")
                .select("a.tree", "a.leaf", F.coalesce("b.up", "a.at").alias("at"),
                        (F.col("a.total") + F.coalesce("b.total", F.lit(0.0))).alias("total"),
                        (F.col("a.depth") + F.when(F.col("b.up").isNotNull(), 1 << k).otherwise(0))
                        .alias("depth")))
    scored = (walk.alias("a").join(nodes.alias("b"), _same("a", "b", ("at", "node")))
              .select("a.tree", "a.leaf", "a.depth",
                      ((F.col("a.total") + F.col("b.score")) / F.col("a.depth")).alias("score")))
    if top_k is None:
        return scored.withColumn("rank", F.lit(None).cast("int"))
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def paths(messages: DataFrame, top_k: int | None = 1) -> DataFrame:
    """(tree, leaf, score, depth, pos, node): the messages of each chosen path, pos from 1."""
    nodes = materialize(messages.select(
        "tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "chat-nodes")
    tables = ancestor_tables(nodes)
    chosen = materialize(ranked_leaves(nodes, tables, top_k), "chat-leaves")
    spread = chosen.select("tree", "leaf", "score", "depth", F.col("leaf").alias("node"),
                           F.lit(0).cast("long").alias("off"))
    for k in reversed(range(len(tables))):
        both = F.expr(f"""filter(array(struct(a.node AS node, a.off AS off),
                                       struct(b.up AS node, a.off + {1 << k} AS off)),
                                 x -> x.node IS NOT NULL)""")
        spread = (spread.alias("a").join(tables[k].alias("b"), _same("a", "b", ("node", "node")), "left")
                  .select("a.tree", "a.leaf", "a.score", "a.depth", F.inline(both)))
    return spread.select("tree", "leaf", "score", "depth",
                         (F.col("depth") - F.col("off")).alias("pos"), "node")


def _escaped(c, line_feed: bool = False):
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b")),
                  F.lit("<|"), F.lit("<\\p"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if line_feed else c


def unescape(s: str) -> str:
    """Every backslash in ``s`` starts an escape, so the order of the replacements is safe
    as long as the backslash itself comes last."""
    return s.replace("\\n", "\n").replace("\\p", "|").replace("\\b", "\\")


def format_paths(messages: DataFrame, top_k: int | None = 1,
                 loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, leaf, score, n_turns, formatted, loss of every chosen path of ``messages``
    (columns tree, node, parent, role, text, score)."""
    fixed = len(START) + 1                                  # marks before a text
    turns = (paths(messages, top_k).alias("p")
             .join(messages.select("tree", "node", "role", "text").alias("m"),
                   _same("p", "m", ("node", "node")))
             .select("p.tree", "p.leaf", "p.score", "p.pos",
                     _escaped(F.col("m.role"), True).alias("head"),
                     _escaped(F.col("m.text")).alias("body"),
                     F.coalesce(F.col("m.role").isin(*loss_roles), F.lit(False)).alias("learn")))
    whole = (Window.partitionBy("tree", "leaf").orderBy("pos")
             .rowsBetween(Window.unboundedPreceding, -1))
    size = F.length("head") + F.length("body") + fixed + len(END)
    placed = turns.withColumn("at", F.coalesce(F.sum(size).over(whole), F.lit(0))
                              + F.length("head") + fixed)
    one = (placed.groupBy("tree", "leaf").agg(
        F.first("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("pos", "head", "body", "learn", "at"))).alias("t")))
    text = F.concat_ws("", F.transform("t", lambda m: F.concat(
        F.lit(START), m["head"], F.lit("\n"), m["body"], F.lit(END))))
    loss = F.transform(F.filter("t", lambda m: m["learn"]), lambda m: F.struct(
        m["at"].alias("start"), (m["at"] + F.length(m["body"])).alias("end")))
    return one.select("tree", "leaf", "score", F.size("t").cast("long").alias("n_turns"),
                      text.alias("formatted"), loss.alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
          "loss_sha256 string, formatted_chars bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted strings and their loss spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in
                                          ("tree", "formatted", "loss")), strict=True):
                turns = parse(text)
                learnt = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
                rows.append((conv, len(turns), hashlib.sha256("".join(
                    f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt),
                    hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows, strict=True)],
                    schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()),
                                      ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
    return formatted.select("tree", "formatted", "loss").mapInArrow(run, DIGEST)


def linear_messages(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Message rows of conversations without branches: each turn replies to the one before
    it (ties of ``turn`` by role, then text)."""
    order = Window.partitionBy(id_col).orderBy(F.col(turn_col), "role", "text")
    return (turns.withColumn("n_", F.row_number().over(order))
            .select(F.col(id_col).cast("long").alias("tree"), F.col("n_").cast("long").alias("node"),
                    F.when(F.col("n_") > 1, F.col("n_") - 1).cast("long").alias("parent"),
                    "role", "text", F.lit(0.0).alias("score")))
