"""Exact n-gram Jaccard join of documents with set-relation skipping.

A document's set is its distinct 5-word shingles (A-Z lowered, words are runs of
``[^\\x20\\x09-\\x0D]``); with fewer words the whole sequence is one shingle; without words
the set is empty and links with nothing.  Shingles and sets are 64-bit hashes.

1. ``sets`` table: one row per document with set size and hash; equal sets are one node, the
   first of their rows, so that nodes of a task are near numbers and postings are narrow.
2. Shingles get a global order, rare ones first, from a sketch of 2**24 counts over the
   whole table (fixed size, broadcast as one byte a cell).  Any order gives the same
   result; this one keeps shingles of common passages out of the index.  A shingle is only
   told from a rare one where it is more frequent than a cell's average, so with few cells
   ever more shingles that recur by chance come into the index of a larger table.
3. Two sets of Jaccard similarity >= 4/5 share a shingle among the first
   n - ceil(4n/5) + 1 of either, so only these prefixes are indexed: lists by shingle,
   with position and size.
4. ``similar``: block and position skipping, pivots, exact comparison, components, and
   the comparisons that are left between components.

Cases: null text is empty; ids may be null or repeat (rows are told apart by an internal
number); component_id is the smallest id of the component, null if it has none; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import (U64, chunks, flat, mix64, pack, release_shuffles,
                                  rows_of, shingle_sets, shuffle_parts, squeeze, unpack, unsqueeze)
from matchbook.llm.similar import bitmap, candidate_lists, components, list_keys
from matchbook.session import materialize

NUM, DEN = 4, 5                   # similarity 0.8
WIDTH = 5
CELLS = 24                        # bits of the order sketch
PART = 1 << 18                    # sketch counts in one row of its exchange
AT_ONCE = 1 << 20                 # shingles that a task adds to its counts at once

BITS = 2                          # bits of a set's parity bitmap for each shingle

SET_COLUMNS = ("row bigint, id bigint, n_shingles bigint, node bigint, set_hash bigint, "
               "z binary, bits binary")
SET_NAMES = [c.split()[0] for c in SET_COLUMNS.split(", ")]


def _set(z: bytes) -> np.ndarray:
    data = np.frombuffer(unsqueeze(z), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), WIDTH)[0]


def set_table(rows: DataFrame, whole: bool = False) -> DataFrame:
    """SET_COLUMNS of rows (row, id, text, ...): node is the first row of the same set in the
    task, which alone carries the set's hash, z (the compressed text) and bits (the parity
    bitmap); with ``whole`` every row keeps its text, and further columns pass through."""
    extra = [f for f in rows.schema.fields if f.name not in ("row", "id", "text")] if whole else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column("text"))
            valid = batch.column("text").is_valid().to_pylist()
            number = batch.column("row").to_pylist()
            for i, j in chunks(offsets):
                part = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], WIDTH)
                hashes = [int(mix64(s).sum(dtype=U64).view(np.int64)) if len(s) else None
                          for s in part]
                node, z, bits = [], [], []
                for k, h in enumerate(hashes, i):
                    new = h is not None and h not in seen
                    node.append(None if h is None else seen.setdefault(h, number[k]))
                    if not new:
                        hashes[k - i] = None
                    z.append(squeeze(data[offsets[k]:offsets[k + 1]].tobytes())
                             if new or whole and valid[k] else None)
                    bits.append(bitmap(part[k - i], BITS) if new else None)
                yield rows_of([*SET_NAMES, *(f.name for f in extra)],
                              batch.column("row").slice(i, j - i), batch.column("id").slice(i, j - i),
                              np.array([len(s) for s in part], np.int64),
                              pa.array(node, pa.int64()), pa.array(hashes, pa.int64()),
                              pa.array(z, pa.binary()), pa.array(bits, pa.binary()),
                              *(batch.column(f.name).slice(i, j - i) for f in extra))
    schema = T.StructType(T._parse_datatype_string(SET_COLUMNS).fields + extra)
    return rows.mapInArrow(run, schema)


def _texts(batches: Iterator[pa.RecordBatch]):
    """Batches of compressed rows -> (their numbers, shingle sets), in bounded chunks."""
    for batch in batches:
        texts = [unsqueeze(z) for z in batch.column("z").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for i, j in chunks(offsets):
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            yield batch, range(i, j), shingle_sets(data, offsets[i:j + 1] - offsets[i], WIDTH)


def shingle_order(nodes: DataFrame) -> np.ndarray:
    """Logarithm of the count of every sketch cell: tasks count all their shingles (up to 255 a
    cell) and send the counts in parts, which are summed; 2**24 bytes reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.uint8)
        held, size = [], 0

        def put_in():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            total[cells] = np.minimum(total[cells] + n, 255)

        for _, _, sets in _texts(batches):
            held += [(s >> U64(64 - CELLS)).astype(np.uint32) for s in sets]
            size += sum(map(len, sets))
            if size >= AT_ONCE:
                put_in()
                held, size = [], 0
        if size:
            put_in()
        if total.any():
            yield rows_of(["bucket", "blob"], np.arange((1 << CELLS) // PART, dtype=np.int32),
                          pa.array([pack(p) for p in total.reshape(-1, PART)], pa.binary()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("bucket").to_pylist(),
                                  batch.column("blob").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + unpack(blob, ["u1"])[0].astype(np.int64)
        for part, x in sums.items():
            level = np.ceil(np.log2(x + 1)).astype(np.uint8)
            yield rows_of(["bucket", "blob"], np.array([part], np.int32),
                          pa.array([level.tobytes()], pa.binary()))

    # The fewer tasks send counts, the less is sent.
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, shuffle_parts(nodes.sparkSession) // 8)
    parts = (nodes.select("z").coalesce(tasks).mapInArrow(count, "bucket int, blob binary")
             .repartition((1 << CELLS) // PART, "bucket")
             .mapInArrow(add, "bucket int, blob binary").collect())
    order = np.zeros(1 << CELLS, np.uint8)
    for r in parts:
        order[r["bucket"] * PART:(r["bucket"] + 1) * PART] = np.frombuffer(r["blob"], np.uint8)
    return order


def prefix_length(n: int) -> int:
    return n - (n * NUM + DEN - 1) // DEN + 1


def _index(order):
    """Prefix postings: key, node, set size, position."""
    def emit(batches: Iterator[pa.RecordBatch]):
        level = order.value
        for batch, numbers, sets in _texts(batches):
            node = batch.column("node").to_numpy()
            keys, lengths, sizes, who = [], [], [], []
            for k, s in zip(numbers, sets, strict=True):
                n = len(s)
                p = prefix_length(n)
                key = (level[(s >> U64(64 - CELLS)).astype(np.int64)].astype(U64) << U64(58)) \
                    | (s & U64((1 << 58) - 1))
                if p < n:
                    key = np.partition(key, p - 1)[:p]
                key.sort()
                keys.append(key)
                lengths.append(p)
                sizes.append(n)
                who.append(k)
            lengths = np.array(lengths)
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield (list_keys(np.concatenate(keys)), np.repeat(node[who], lengths),
                   np.repeat(sizes, lengths), at)
    return emit


def set_components(sets: DataFrame) -> DataFrame:
    """row, id, n_shingles, component_id and kept (one row of each component: its smallest
    id, of equal ids the first row) of a written set table."""
    firsts = sets.where("set_hash IS NOT NULL")
    nodes = firsts.select("node", "z")
    # Equal sets of several tasks are one node, the smallest; the others are its twins.
    hashes = firsts.select("node", "set_hash")
    least = hashes.groupBy("set_hash").agg(F.min("node").alias("one"))
    twins = materialize(hashes.join(least, "set_hash").where("node != one").select("node", "one"),
                        "set-twins")
    order = sets.sparkSession.sparkContext.broadcast(shingle_order(nodes))
    release_shuffles(sets.sparkSession)
    pairs, members = candidate_lists(nodes, _index(order), NUM, DEN, True, twins)
    bits = firsts.select("node", F.col("n_shingles").alias("size"), "bits")
    labels = components(pairs, members, bits, nodes, _set, NUM, DEN)

    named = materialize(
        sets.select("row", "id", "n_shingles", "node").join(twins, "node", "left")
        .withColumn("node", F.coalesce("one", "node")).join(labels, "node", "left")
        .select("row", "id", "n_shingles", F.coalesce("label", "node").alias("label")),
        "set-labels")
    # The smallest id of each component, written before the join back: so the join stands in
    # a stage of its own, where adaptive execution can split a component of very many rows.
    least = materialize(
        named.where("label IS NOT NULL").groupBy("label")
        .agg(F.min("id").alias("component_id"),
             F.expr("min_by(row, struct(id IS NULL, id, row))").alias("first_row")), "set-least")
    return (named.join(least, "label", "left")
            .select("row", "id", "n_shingles",
                    F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id"))
                    .alias("component_id"),
                    F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("kept")))


def numbered(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: <id_col>, n_shingles, component_id, kept."""
    sets = materialize(set_table(numbered(docs, id_col, text_col)), "sets")
    return (set_components(sets)
            .select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id, or an equal one in an
    earlier row.  The set table holds the rows meanwhile, texts compressed."""
    others = [c for c in docs.columns if c != text_col]
    rows = numbered(docs, id_col, text_col, *(F.col(f"`{c}`").alias(f"other{k}")
                                             for k, c in enumerate(others)))
    sets = materialize(set_table(rows, whole=True), "sets")
    drop = materialize(set_components(sets).where("NOT kept").select("row"), "set-drop")
    release_shuffles(docs.sparkSession)
    names = [f"other{k}" for k in range(len(others))]

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("z").to_pylist()
            text = pa.array([None if x is None else unsqueeze(x).decode() for x in z], pa.string())
            yield pa.RecordBatch.from_arrays([text, *(batch.column(n) for n in names)],
                                             names=["text", *names])

    schema = T.StructType([T.StructField("text", T.StringType())]
                          + [rows.schema[n] for n in names])
    left = sets.join(drop, "row", "left_anti").select("z", *names).mapInArrow(restore, schema)
    where = dict(zip(others, names, strict=True)) | {text_col: "text"}
    return left.select(*(F.col(where[c]).alias(c) for c in docs.columns))
