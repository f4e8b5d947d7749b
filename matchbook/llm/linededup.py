"""Fuzzy line de-duplication: MinHash signatures, banding, exact Jaccard, union-find.

Lines are cut at LF and compared after lowering A-Z and collapsing white space.  A
line's set is its distinct ``WIDTH``-byte shingles (the whole line if it is shorter).

1. Equal lines are one node (64-bit hash).
2. A task sends each new line under ``BANDS`` band keys of ``ROWS`` MinHash values: lines of similarity 0.8 share a band with probability
   1 - (1 - 0.8**3)**12 = 0.9998.  Long lines hash each shingle once and take the minimum
   of each of 36 bins (empty bins borrow from others in an order fixed for the bin); lines
   of few shingles use 36 permutations.  Between ``SHORT`` and ``LONG`` shingles a line has
   both kinds of keys, so similar lines always share one kind.
   Nodes that share a band with others are written once more with line, set size and parity
   bitmap.
3. ``similar``: lines that share a band are compared exactly with the pivots of their
   lists and across components that are left, and only similarity >= 4/5 links.
4. Components by large-star / small-star over the links.
5. The first occurrence of each component, by smallest id, row and line, is kept.

Cases: null or empty text has no lines; blank lines are neither counted nor removed; a
null id comes first; rows with equal ids are told apart by an internal number; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import (LOWER, SPACE, U64, bloom_filter, chunks, flat, in_bloom, mix64,
                                  rows_of, substring_hashes, words_of)
from matchbook.llm.similar import bitmaps, candidate_lists, components, ends_of, list_keys
from matchbook.session import materialize

WIDTH = 8
BANDS, ROWS = 12, 3
NUM, DEN = 4, 5
BITS = 2                 # bits of a line's parity bitmap for each shingle
SHORT, LONG = 128, 160   # shingles; SHORT / LONG is the threshold, as sizes of similar sets are
GROUP = 1 << 16          # bytes of text handled at once
SEEN = 1 << 20           # lines that a task remembers; what it forgets it may send again

_K = BANDS * ROWS
EMPTY = U64((1 << 64) - 1)
_XOR = (mix64(np.arange(1, _K + 1, dtype=U64)) >> U64(32)).astype(np.uint32)
_TIMES = (mix64(np.arange(1001, _K + 1001, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_BAND = mix64(np.arange(5001, 2 * BANDS + 5001, dtype=U64)).reshape(2, BANDS)
#: The order in which each bin looks for a full one.
_BORROW = np.argsort(mix64(np.arange(9001, _K * _K + 9001, dtype=U64)).reshape(_K, _K), axis=1)


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def normal_lines(data: np.ndarray, offsets: np.ndarray):
    """All lines of the texts data[offsets[k]:offsets[k + 1]] that are not blank: their texts'
    numbers, line numbers, joined normalised bytes and n + 1 offsets into these."""
    low = LOWER[data]
    start, end, first = words_of(low, offsets)
    feeds = np.concatenate([[0], np.cumsum(low == 10)])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = feeds[start] - feeds[offsets[row]]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    last = np.ones(len(start), bool)
    last[:-1] = new[1:]
    # Of the white space one byte stays between two words of a line.
    keep = ~SPACE[low]
    keep[end[~last]] = True
    low[end[~last]] = 0x20
    size = np.cumsum(end - start + ~last)
    return row[new], number[new].astype(np.int32), low[keep], np.concatenate([[0], size[last]])


def line_numbers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return substring_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the distinct shingles of all lines, line by line, and the n + 1 line
    ends among them."""
    if len(data) >= WIDTH:
        grams = mix64(np.ndarray((len(data) - WIDTH + 1,), "<u8", np.ascontiguousarray(data),
                                 strides=(1,)) + U64(1))
    else:
        grams = np.empty(0, U64)
    length = np.diff(offsets)
    count = np.maximum(length - WIDTH + 1, 1)
    line = np.repeat(np.arange(len(length)), count)
    at = offsets[:-1][line] + np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    h = np.append(grams, U64(0))[np.minimum(at, len(grams))]
    short = np.flatnonzero(length < WIDTH)
    if len(short):
        first = (np.cumsum(count) - count)[short]
        h[first] = substring_hashes(data, offsets[short], offsets[short + 1])
    out = []
    for i in range(0, len(length), 1 << 16):              # 16 bits number the lines of a part
        part = (line >= i) & (line < i + (1 << 16)) if len(length) > 1 << 16 else slice(None)
        key = np.sort(((line[part] - i).astype(U64) << U64(48)) | (h[part] >> U64(16)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        out.append((key & U64((1 << 48) - 1), (key >> U64(48)).astype(np.int64) + i))
    values = np.concatenate([x for x, _ in out]) if out else np.empty(0, U64)
    lines = np.concatenate([y for _, y in out]) if out else np.empty(0, np.int64)
    return values, np.searchsorted(lines, np.arange(len(length) + 1))


def line_set(line: bytes) -> np.ndarray:
    return shingles(np.frombuffer(line, np.uint8), np.array([0, len(line)]))[0]


def _binned(values: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """One-permutation minima: n x 36, empty bins filled from the first full bin of their
    own fixed order."""
    h = mix64(values)
    out = np.full(n * _K, EMPTY, U64)
    np.minimum.at(out, line * _K + (h % U64(_K)).astype(np.int64), h >> U64(8))
    out = out.reshape(n, _K)
    full = out != EMPTY
    filled = out.copy()
    missing = ~full
    for step in range(_K):
        if not missing.any():
            break
        source = _BORROW[:, step]
        take = missing & full[:, source]
        filled[take] = out[:, source][take]
        missing &= ~take
    return filled


def _permuted(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    x = (values >> U64(16)).astype(np.uint32)
    return np.stack([np.minimum.reduceat((x ^ _XOR[k]) * _TIMES[k], begin)
                     for k in range(_K)], 1).astype(U64)


def _keys(minima: np.ndarray, kind: int) -> np.ndarray:
    sig = minima.reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(_BAND[kind], (len(minima), BANDS))
    for r in range(ROWS):
        key = mix64(key ^ sig[:, :, r] * U64(0x9E3779B97F4A7C15))
    return key


def band_keys(values: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of lines, their band keys) of the sets values[ends[k]:ends[k + 1]], by kind."""
    size = np.diff(ends)
    for kind, which in ((0, size >= SHORT), (1, size < LONG)):
        ids = np.flatnonzero(which)
        if not len(ids):
            continue
        mine = values[np.repeat(which, size)]
        n = size[ids]
        minima = _binned(mine, np.repeat(np.arange(len(ids)), n), len(ids)) if kind == 0 \
            else _permuted(mine, np.cumsum(n) - n)
        yield ids, _keys(minima, kind)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line that is not blank, and one without node per document, whose line is
    the number of such lines."""
    names = ["row", "id", "line", "node"]
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j in chunks(offsets, GROUP):
            row, number, joined, ends = normal_lines(data[offsets[i]:offsets[j]],
                                                     offsets[i:j + 1] - offsets[i])
            own = [batch.column(c).slice(i, j - i) for c in ("row", "id")]
            yield rows_of(names, *own, np.bincount(row, minlength=j - i).astype(np.int32),
                          pa.nulls(j - i, pa.int64()))
            if len(row):
                yield rows_of(names, *(c.take(pa.array(row)) for c in own), number,
                              line_numbers(joined, ends))


def _new_lines(batches: Iterator[pa.RecordBatch], wanted: Callable | None = None):
    """(nodes, joined lines, offsets) of lines that the task has not seen lately; of those that
    ``wanted`` picks, if given."""
    seen: set[int] = set()
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j in chunks(offsets, GROUP):
            _, _, joined, ends = normal_lines(data[offsets[i]:offsets[j]],
                                              offsets[i:j + 1] - offsets[i])
            node = line_numbers(joined, ends)
            pick = np.unique(node, return_index=True)[1]
            if wanted:
                pick = pick[wanted(node[pick])]
            pick = np.sort([k for k, x in zip(pick.tolist(), node[pick].tolist(), strict=True)
                            if x not in seen]).astype(np.int64)
            if len(seen) > SEEN:
                seen.clear()
            seen.update(node[pick].tolist())
            if len(pick):
                size = np.diff(ends)
                mine = np.zeros(len(node), bool)
                mine[pick] = True
                yield (node[pick], joined[np.repeat(mine, size)],
                       np.concatenate([[0], np.cumsum(size[pick])]))


def _postings(batches: Iterator[pa.RecordBatch]):
    """Postings of the bands of all lines: key, node, set size, no position."""
    for node, joined, offsets in _new_lines(batches):
        values, ends = shingles(joined, offsets)
        size = np.diff(ends)
        for ids, keys in band_keys(values, ends):
            yield (list_keys(keys.reshape(-1)), np.repeat(node[ids], BANDS),
                   np.repeat(size[ids], BANDS), np.zeros(keys.size, np.int64))


LINE_ROWS = "node bigint, size bigint, bits binary, z binary"


def _lines_of(text: DataFrame, wanted) -> DataFrame:
    """LINE_ROWS of the lines in a Bloom filter: set size, parity bitmap and the line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, joined, offsets in _new_lines(batches, lambda x: in_bloom(wanted.value, x)):
            values, ends = shingles(joined, offsets)
            body = joined.tobytes()
            yield rows_of(["node", "size", "bits", "z"], node, np.diff(ends).astype(np.int64),
                          pa.array(bitmaps(mix64(values), ends, BITS), pa.binary()),
                          pa.array([body[a:b] for a, b in zip(offsets[:-1].tolist(),
                                                              offsets[1:].tolist(), strict=True)],
                                   pa.binary()))
    return text.mapInArrow(run, LINE_ROWS)


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: <id_col>, n_lines (not blank), removed (ascending numbers of
    the removed lines, the text's first line being 0)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    text = rows.select("text")
    pairs, members = candidate_lists(text, _postings, NUM, DEN, positions=False)
    listed = bloom_filter(ends_of(pairs).unionByName(members.select("node")))
    lines = materialize(_lines_of(text, listed), "lines")
    labels = components(pairs, members, lines.select("node", "size", "bits"),
                        lines.select("node", "z"), line_set, NUM, DEN)

    seen = materialize(rows.mapInArrow(
        _occurrences, "row bigint, id bigint, line int, node bigint"), "line-rows")
    place = F.struct(F.coalesce("id", F.lit(-2**63)).alias("rank"), "row", "line")
    named = (seen.where("node IS NOT NULL").join(labels, "node", "left")
             .select(F.coalesce("label", "node").alias("label"), place.alias("place")))
    # Components of one line have nothing to remove; the others' first lines are written, so
    # that the join back is a stage that adaptive execution can split.
    first = materialize(named.groupBy("label")
                        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").drop("n"), "line-first")
    gone = (named.join(first, "label").where("place != first")
            .groupBy(F.col("place.row").alias("row"))
            .agg(F.array_sort(F.collect_list("place.line")).alias("removed")))
    return (seen.where("node IS NULL").join(gone, "row", "left")
            .select(F.col("id").alias(id_col), F.col("line").cast("long").alias("n_lines"),
                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def without_lines(text: str, removed: list[int]) -> str:
    gone = set(removed)
    return "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
