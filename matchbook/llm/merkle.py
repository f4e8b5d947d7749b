"""Merkle manifest of a document table, with a version of the tree per tampered leaf.

A leaf is the SHA-256 of a row's five fields; per source the leaves stand in the order of
their ids, every 16 consecutive nodes become their hash until one is left (the subroot),
and the subroots, in the order of the sources, become the root in the same way.

* **Positions.**  Leaves are range-partitioned by (source, id) and sorted; counts of
  (source, partition) give every leaf its place, so that a source with most of the rows is
  spread over all tasks.
* **Upwards.**  A task takes aligned blocks of 4,096 nodes (three levels of the tree) and
  writes the block's top node; the top nodes are the nodes of the next tier, until each
  tree has one.  Inner nodes of a block are computed where they are needed.
* **Downwards.**  From the root, each block learns the siblings on the way from its top
  node to the root: one row for a block, which meets the block's nodes in their task.
* **Versions.**  The tree is persistent: a tampered leaf creates a version that shares all
  nodes but the leaf's ancestors.  Its copies within the block are made from the shared
  siblings there, and the version continues through the blocks above along the path that
  came down.  ``copied`` holds the digests of its new nodes, from the lowest to the new
  root; the version's root is the folded root.

Cases: null fields count as ``-``; null ids come first; rows of equal source and id are
ordered by their digest, so repeated rows are leaves of their own whose order does not
matter; a null id is never tampered with; a null source is a source of its own, before the
others; a text of any length is one field of one leaf; an empty table gives an empty
result.  Only the named columns are read, so further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.common import shuffle_parts
from matchbook.operators.numbering import number_rows
from matchbook.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
DEPTH = 3                        # levels of a block
BLOCK = FANOUT ** DEPTH          # nodes of a full block

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 (binary) of the row's fields; ``changed`` replaces some of them."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                                F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered(id_col: str = "doc_id") -> Column:
    """Whether the test of the manifest tampers with a row: 5 divides the CRC of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def lower_cased() -> Column:
    return F.translate("text", UPPER, LOWER)


# ------------------------------------------------------------------ inside a block

def _h(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def _rounds(n: int) -> int:
    """Levels that a block adds in a tree which has ``n`` nodes at the block's tier."""
    k = 0
    while n > 1 and k < DEPTH:
        n, k = -(-n // FANOUT), k + 1
    return k


def _runs(digests: list[bytes], rounds: int) -> tuple[list[list[bytes]], bytes]:
    """The block's base tree: per level the joined hex digests of each run of siblings, and
    the block's top node."""
    levels, level = [], [d.hex().encode() for d in digests]
    for _ in range(rounds):
        runs = [b"".join(level[a:a + FANOUT]) for a in range(0, len(level), FANOUT)]
        levels.append(runs)
        level = [_h(r) for r in runs]
    return levels, level[0]


def _siblings(levels: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after the node's ancestors in their runs, level by level."""
    out = []
    for runs in levels:
        at, k = divmod(at, FANOUT)
        out.append((runs[at][:64 * k], runs[at][64 * k + 64:]))
    return out


def _copy_path(node: bytes, path: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The ancestors of a version's node, lowest first, made from shared siblings."""
    out = []
    for before, after in path:
        node = _h(before + node + after)
        out.append(node)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (tree, block) at a time, from batches sorted by both."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column("tree").to_numpy(), batch.column("block").to_numpy()
        cut = np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(tree)], strict=True):
            key = (tree[a], block[a])
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _by_block(rows: DataFrame) -> DataFrame:
    return (rows.repartition(shuffle_parts(rows.sparkSession), "tree", "block")
            .sortWithinPartitions("tree", "block", "pos"))


# ------------------------------------------------------------------------- tiers

NODE = "tree bigint, pos bigint, n bigint, digest binary"
PATH = "tree bigint, block bigint, before array<binary>, after array<binary>, subroot binary"


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def _top_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for rows in _blocks(batches):
        n = rows.column("n")[0].as_py()
        k = _rounds(n)
        top = _runs(rows.column("digest").to_pylist(), k)[1]
        out.append((rows.column("tree")[0].as_py(), rows.column("block")[0].as_py(),
                    -(-n // FANOUT ** k), bytes.fromhex(top.decode())))
    tree, pos, n, digest = zip(*out, strict=True) if out else ((), (), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(tree, pa.int64()), pa.array(pos, pa.int64()), pa.array(n, pa.int64()),
         pa.array(digest, pa.binary())], names=["tree", "pos", "n", "digest"])


def raise_trees(nodes: DataFrame, tag: str) -> list[DataFrame]:
    """The tiers of every tree: the given nodes (tree, pos, n, digest; n = nodes of the tree
    on the tier), the top nodes of their blocks, and so on up to one node a tree."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 1) > 1:
        blocks = _by_block(_in_blocks(tiers[-1].select("tree", "pos", "n", "digest")))
        tiers.append(materialize(blocks.mapInArrow(_top_nodes, NODE), f"{tag}-tier"))
    return tiers


def _meet(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes and, first of each block, the block's row of ``above``."""
    return _by_block(_in_blocks(nodes).unionByName(
        above.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True))


def _opened(rows: pa.Table) -> tuple[list, list, bytes | None, pa.Table]:
    """(base tree of the block, path above it as pairs, subroot, node rows)."""
    first, nodes = rows.slice(0, 1), rows.slice(1)
    above = list(zip(first.column("before")[0].as_py(), first.column("after")[0].as_py(),
                     strict=True))
    levels, _ = _runs(nodes.column("digest").to_pylist(),
                      _rounds(nodes.column("n")[0].as_py()))
    return levels, above, first.column("subroot")[0].as_py(), nodes


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        levels, above, subroot, nodes = _opened(rows)
        paths = [_siblings(levels, i) + above for i in range(nodes.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [nodes.column("tree").combine_chunks(), nodes.column("pos").combine_chunks(),
             pa.array([[b for b, _ in p] for p in paths], pa.list_(pa.binary())),
             pa.array([[a for _, a in p] for p in paths], pa.list_(pa.binary())),
             pa.array([subroot] * len(paths), pa.binary())],
            names=["tree", "block", "before", "after", "subroot"])


def lead_down(tiers: list[DataFrame], above: DataFrame, down_to: int, tag: str) -> DataFrame:
    """Paths (tree, block, before, after, subroot) of the nodes of tier ``down_to``, by which
    the blocks below them are keyed.  ``above``: the paths of the topmost tier's nodes."""
    for t in range(len(tiers) - 2, down_to - 1, -1):
        met = _meet(tiers[t].select("tree", "pos", "n", "digest"), above)
        above = materialize(met.mapInArrow(_paths, PATH), f"{tag}-paths")
    return above


# ---------------------------------------------------------------------- manifest

PROOF = ("doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string, "
         "copied array<binary>")


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        levels, above, subroot, nodes = _opened(rows)
        siblings_above = b"".join(b + a for b, a in above)
        proofs, folded, copied = [], [], []
        leaves, changed = (nodes.column(c).to_pylist() for c in ("digest", "changed"))
        for i, (leaf, other) in enumerate(zip(leaves, changed, strict=True)):
            path = _siblings(levels, i)
            proofs.append(sha256(b"".join(b + a for b, a in path) + siblings_above).hexdigest())
            node = (leaf if other is None else other).hex().encode()
            new = _copy_path(node, path + above)
            folded.append((new[-1] if new else node).decode())
            copied.append(None if other is None else [bytes.fromhex(d.decode()) for d in new])
        yield pa.RecordBatch.from_arrays(
            [nodes.column("doc_id").combine_chunks(), pa.array([d.hex() for d in leaves]),
             pa.array([subroot.hex()] * len(leaves)), pa.array(proofs), pa.array(folded),
             pa.array(copied, pa.list_(pa.binary()))],
            names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "copied"])


def place_leaves(docs: DataFrame, change: Column, changed_text: Column) -> tuple[DataFrame, DataFrame]:
    """(leaves: tree, pos, n, digest, changed, doc_id; sources: source, tree, n)."""
    at = F.monotonically_increasing_id()              # spreads repeated rows over the ranges
    leaves = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                    leaf_digest().alias("digest"),
                    F.when(change, leaf_digest(text=changed_text)).alias("changed"),
                    at.alias("at")), "merkle-leaves")
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "digest", "at")]
    ranged = materialize(
        leaves.repartitionByRange(shuffle_parts(docs.sparkSession), *order)
        .sortWithinPartitions(*order).drop("at")
        .withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id()), "merkle-ranged")
    pieces = materialize(ranged.groupBy("source", "part")
                         .agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("low")),
                         "merkle-pieces")
    sources, _ = number_rows(pieces.groupBy("source").agg(F.sum("rows").alias("n")), ["source"],
                             seq_col="tree", tag="sources", with_count=False)
    sources = materialize(sources, "merkle-sources")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
              .withColumnRenamed("source", "s")
              .join(sources, F.col("s").eqNullSafe(F.col("source")))
              .select("s", F.col("part").alias("p"), "low", "start", "tree", "n"))
    placed = ranged.join(starts, (F.col("part") == F.col("p"))
                         & F.col("source").eqNullSafe(F.col("s")))
    return placed.select("tree", (F.col("start") + F.col("seq") - F.col("low")).alias("pos"),
                         "n", "digest", "changed", "doc_id"), sources


def verify_versions(docs: DataFrame, change: Column | None = None,
                    changed_text: Column | None = None) -> DataFrame:
    """The manifest's entry of every row, and the version that its change creates.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of the unchanged tree), folded_root
    (the root of the version, or the unchanged leaf folded with its siblings), verified, and
    ``copied`` (digests of the version's own nodes; null where nothing is changed)."""
    spark = docs.sparkSession
    leaves, sources = place_leaves(docs, tampered() if change is None else change,
                                   lower_cased() if changed_text is None else changed_text)
    leaves = materialize(leaves, "merkle-placed")
    tiers = raise_trees(leaves, "merkle")
    subroots = tiers[-1].select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"),
                                F.lit(sources.count()).cast("long").alias("n"), "digest")
    tops = raise_trees(materialize(subroots, "merkle-subroots"), "merkle-sources")
    root = tops[-1].first()
    if root is None:
        return spark.createDataFrame([], PROOF).select(
            "doc_id", "leaf", "subroot", F.lit(None).cast("string").alias("root"), "proof_sha256",
            "folded_root", F.lit(None).cast("boolean").alias("verified"), "copied")
    empty = F.array().cast("array<binary>")
    start = tops[-1].select("tree", F.col("pos").alias("block"), empty.alias("before"),
                            empty.alias("after"), F.lit(None).cast("binary").alias("subroot"))
    of_sources = lead_down(tops, start, 0, "merkle-sources")       # block = place of the source
    above = (of_sources.select((F.col("block") + 1).alias("tree"), "before", "after")
             .join(tiers[-1].select("tree", F.col("digest").alias("subroot")), "tree")
             .select("tree", F.lit(0).cast("long").alias("block"), "before", "after", "subroot"))
    above = lead_down(tiers, above, 1, "merkle")
    out = _meet(leaves, above).mapInArrow(_verdicts, PROOF)
    root_text = F.lit(root["digest"].hex())
    return out.select("doc_id", "leaf", "subroot", root_text.alias("root"), "proof_sha256",
                      "folded_root", (F.col("folded_root") == root_text).alias("verified"), "copied")
