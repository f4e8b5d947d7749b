"""Candidate lists, exact verification and components, for set similarity joins.

A list is the nodes that share an index key (a prefix shingle, a band of a signature).
Joining all pairs of a list would be quadratic, so work is saved by set relations:

* a list is cut into blocks by set size; blocks too far apart for the threshold are
  skipped, and with positions so are entries whose remaining shingles cannot reach the
  overlap any more;
* a list that fills much of a map task's postings is not sent whole: its first node of each
  size block goes to the list's bucket, the postings go in slices to buckets of their own,
  and slices meet the pivots of the whole list by a salted join, so no task holds the list;
* the answers of a list's members are derived from its pivots: every member is
  compared with the first node of its own and the neighbouring size blocks only.
  Members that link to a pivot share the pivot's component and need no comparison with
  each other;
* lists of copies overlap nearly wholly, so lists with the same first node are joined to
  one group, and a group to that of the smallest first node that has the group's as a
  member; a group holds every pair of each of its lists;
* a group that still holds several components is searched by a lower bound of the
  symmetric difference: sets are folded into parity bitmaps, and no two sets differ in
  fewer elements than their bitmaps do in bits.  First a spanning forest of the pairs
  that the bound allows, closest first, is compared exactly; pairs inside a component
  need no comparison then;
* where the exact comparison refuted an edge of the forest, the group's sets themselves are
  compared inside tasks, pairs that bitmaps eight times as fine allow only, and a task gives
  no more than a spanning forest of true links.

Groups of more than ``BLOCK`` members are cut into blocks and compared block by block, so
no task holds an unbounded group.

Every pair above the threshold that shares a key is then either linked or in one
component, so the components are those of the complete join.  The bound only works
inside tasks; what is shuffled and compared exactly grows with the members of lists,
not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import (U64, bloom_filter, bucket_count, by_key, connected_components,
                                  gather, grouped, mix64, only, pack_numbers, release_shuffles,
                                  rows_of, scatter_split, shuffle_parts, unpack_numbers)
from matchbook.session import materialize

FANOUT = 256                      # members that one task compares with a pivot
BLOCK = 4096                      # members of a group that one task holds (two blocks at most)
ELEMENTS = 1 << 22                # elements of a block's sets, where a task holds the sets
FINE = 16                         # bits for each element in the bitmaps of a group compared by sets
LIST = ["<u8", "<i8", "<u4", "<u4"]                            # key, node, size, position
FOUND = "kind int, a bigint, b bigint, blob binary"
FOUND_NAMES = ["kind", "a", "b", "blob"]
PAIR, MEMBER, PIVOTS, SLICE = range(4)
HOT = 1024                        # postings of a key, of those a map task holds at once, that are a slice
PIECE = 1 << 16                   # postings in one row of a slice
FLAG = np.uint32(1 << 31)         # on a position: the posting stands for a slice


def _found(kind: int, a, b, blob=None) -> pa.RecordBatch:
    n = len(a)
    return rows_of(FOUND_NAMES, np.full(n, kind, np.int32), a, b,
                   pa.nulls(n, pa.binary()) if blob is None else pa.array(blob, pa.binary()))


def list_keys(values: np.ndarray) -> np.ndarray:
    """Keys of 48 bits: two bytes less in each posting.  Values that meet under one key only
    make a list longer; what links is decided by the sets."""
    return mix64(values) >> U64(16)


def _blocks(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Size blocks: sizes of one block differ by less than the threshold's factor."""
    return np.floor(np.log(size) / np.log(den / num) + 1e-9).astype(np.int64)


def _slices(num: int, den: int, hot: int) -> Callable:
    """For postings held together: those to send to their key's bucket, with slices replaced
    by their first posting of each size block, and the slices' postings."""
    def split(key, node, size, pos):
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        lists = np.empty(len(key), np.int64)
        lists[order] = np.cumsum(new) - 1
        large = np.bincount(lists)[lists] >= hot
        if not large.any():
            return [key, node, size, pos], None
        at = np.flatnonzero(large)
        at = at[np.lexsort((node[at], lists[at]))]
        _, first = np.unique(lists[at] * 4096 + _blocks(size[at], num, den), return_index=True)
        sent = np.sort(np.concatenate([np.flatnonzero(~large), at[first]]))
        flag = np.where(large[sent], FLAG, np.uint32(0))
        return ([key[sent], node[sent], size[sent], pos[sent].astype(np.uint32) | flag],
                [c[at] for c in (key, node, size, pos)])
    return split


def _allowed_pairs(small_size, large_size, pos_a, pos_b, size_a, size_b, num: int, den: int,
                   positions: bool) -> np.ndarray:
    ok = small_size * den >= large_size * num
    if positions:
        rest = np.minimum(size_a.astype(np.int64) - pos_a, size_b.astype(np.int64) - pos_b)
        ok &= rest >= -(-num * (small_size + large_size) // (num + den))
    return ok


def _reduce_slices(key, node, size, pos) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((pos, node, key))
    k, n = key[order], node[order]
    order = order[np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])]
    key, columns = key[order], [c[order] for c in (node, size, pos)]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        for a in range(i, j, PIECE):
            b = min(a + PIECE, j)
            yield _found(SLICE, key[a:a + 1].view(np.int64), columns[0][a:a + 1],
                         blob=[pack_numbers(*(c[a:b] for c in columns))])


def _meet(num: int, den: int, positions: bool) -> Callable:
    """Pairs and members of rows (blob, pivots) of a slice and its list's pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, pivots in zip(batch.column("blob"), batch.column("pivots"), strict=True):
                node, size, pos = unpack_numbers(blob.as_buffer(), LIST[1:])
                p_node, p_size, p_pos = unpack_numbers(pivots.as_buffer(), LIST[1:])
                block, p_block = _blocks(size, num, den), _blocks(p_size, num, den)
                for k in range(len(p_node)):
                    at = np.flatnonzero((np.abs(block - p_block[k]) <= 1) & (node != p_node[k]))
                    small = np.minimum(size[at], p_size[k]).astype(np.int64)
                    large = np.maximum(size[at], p_size[k]).astype(np.int64)
                    at = at[_allowed_pairs(small, large, pos[at], int(p_pos[k]), size[at], p_size[k],
                                           num, den, positions)]
                    if len(at):
                        yield _found(PAIR, np.minimum(p_node[k], node[at]),
                                     np.maximum(p_node[k], node[at]))
                yield _found(MEMBER, np.full(len(node), p_node.min()), node)
    return run


def _reduce_lists(num: int, den: int, positions: bool, buckets: int) -> Callable:
    def run(bucket, key, node, size, pos) -> Iterator[pa.RecordBatch]:
        if bucket >= buckets:
            yield from _reduce_slices(key, node, size, pos)
            return
        flag = pos >= FLAG
        pos = pos & ~FLAG
        hot = np.unique(key[flag])
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        keep = same | np.concatenate([same[1:], [False]]) | flag[order]
        key, node, size, pos = (key[keep], *(c[order][keep] for c in (node, size, pos)))
        if not len(key):
            return
        # One entry for each node of a list, the one of lowest position; in order of nodes.
        order = np.lexsort((pos, node, key))
        k, n = key[order], node[order]
        order = order[np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])]
        key, node, size, pos = (c[order] for c in (key, node, size, pos))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        lists = np.cumsum(new) - 1
        code = lists * 4096 + _blocks(size, num, den)
        codes, pivot = np.unique(code, return_index=True)      # first node of each block
        a, b = [], []
        for shift in (-1, 0, 1):
            at = np.minimum(np.searchsorted(codes, code + shift), len(codes) - 1)
            hit = np.flatnonzero(codes[at] == code + shift)
            a.append(pivot[at[hit]])
            b.append(hit)
        a, b = np.concatenate(a), np.concatenate(b)
        small, large = np.minimum(size[a], size[b]).astype(np.int64), \
            np.maximum(size[a], size[b]).astype(np.int64)
        ok = (a != b) & _allowed_pairs(small, large, pos[a], pos[b], size[a], size[b], num, den,
                                       positions)
        a, b = np.minimum(a, b)[ok], np.maximum(a, b)[ok]        # by node
        pairs = np.unique(np.stack([node[a], node[b]], 1), axis=0)
        if len(pairs):
            yield _found(PAIR, pairs[:, 0], pairs[:, 1])
        # Members of lists of three or more, under the list's first node.
        count = np.bincount(lists)
        lead = np.flatnonzero(new)[lists]
        sliced = np.isin(key, hot)
        large = (count[lists] >= 3) | sliced
        members = np.unique(np.stack([node[lead[large]], node[large]], 1), axis=0)
        if len(members):
            yield _found(MEMBER, *members.T)
        pivot = pivot[sliced[pivot]]
        for at in np.split(pivot, np.flatnonzero(np.diff(lists[pivot])) + 1) if len(pivot) else ():
            yield _found(PIVOTS, key[at[:1]].view(np.int64), node[at[:1]],
                         blob=[pack_numbers(node[at], size[at], pos[at])])
    return run


def postings(rows: DataFrame, emit: Callable, num: int, den: int, buckets: int) -> DataFrame:
    """Rows (bucket, blob) of the index: lists by key below ``buckets``, slices from there on."""
    return scatter_split(rows, emit, _slices(num, den, HOT), LIST, buckets)


def candidate_lists(rows: DataFrame, emit: Callable, num: int, den: int, positions: bool,
                    twins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b), (members lead, node) of the index that ``emit`` fills.

    ``twins``: nodes whose set is that of a smaller node.  A twin stands in the same lists as
    the smaller node and behind it, so it is never a pivot or a first node, and all that it
    is paired with is paired with the smaller node too: its pairs are left out."""
    buckets, salts = bucket_count(rows.sparkSession), shuffle_parts(rows.sparkSession)
    found = materialize(
        gather(postings(rows, emit, num, den, buckets),
               _reduce_lists(num, den, positions, buckets), LIST, FOUND, unpack_numbers),
        "lists")
    slices = found.where(f"kind = {SLICE}").select(
        F.col("a").alias("key"), F.pmod(F.xxhash64("blob"), F.lit(salts)).alias("salt"), "blob")
    if not slices.isEmpty():
        pivots = found.where(f"kind = {PIVOTS}").select(
            F.col("a").alias("key"), F.explode(F.expr(f"sequence(0L, {salts} - 1L)")).alias("salt"),
            F.col("blob").alias("pivots"))
        met = (slices.join(pivots, ["key", "salt"]).select("blob", "pivots")
               .mapInArrow(_meet(num, den, positions), FOUND))
        found = found.unionByName(materialize(met, "slices"))
    if twins is not None:
        found = found.join(twins.select(F.col("node").alias("b")), "b", "left_anti")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    release_shuffles(rows.sparkSession)
    members = materialize(found.where("kind = 1").select(
        F.col("a").alias("lead"), F.col("b").alias("node")).distinct(), "members")
    # A group goes to the smallest first node that has its own first node as a member: groups
    # of copies end under one of them.
    first = members.groupBy("node").agg(F.min("lead").alias("to"))
    merged = (members.join(first.withColumnRenamed("node", "lead"), "lead")
              .select(F.col("to").alias("lead"), "node").distinct())
    return materialize(pairs, "pairs"), materialize(merged, "groups")


# ------------------------------------------------------------ parity bitmaps

def bitmaps(elements: np.ndarray, ends: np.ndarray, per_element: int) -> list[bytes]:
    """For each set elements[ends[k]:ends[k + 1]] the parity of the elements that fall on each
    of 2**k >= 256 bits, about ``per_element`` for each element.  A bitmap of half the size
    is the parity of its two halves."""
    size = np.diff(ends)
    bits = 1 << np.ceil(np.log2(np.maximum(per_element * size, 256))).astype(np.int64)
    stop = np.cumsum(bits)
    owner = np.repeat(np.arange(len(size)), size)
    at = (stop - bits)[owner] + (elements & (bits[owner] - 1).astype(U64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(stop[-1]) if len(stop) else 0) & 1
    packed = np.packbits(odd.astype(bool)).tobytes()
    return [packed[a:b] for a, b in zip(((stop - bits) // 8).tolist(), (stop // 8).tolist(),
                                        strict=True)]


def bitmap(elements: np.ndarray, per_element: int) -> bytes:
    return bitmaps(elements, np.array([0, len(elements)]), per_element)[0]


def _folded(words: np.ndarray, length: int) -> np.ndarray:
    while words.shape[-1] > length:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def allowed(size_a, size_b, differing, num: int, den: int):
    """Whether sets that differ in at least so many elements can reach the threshold."""
    total = size_a + size_b
    return (differing * (den + num) <= total * (den - num)) \
        & (np.minimum(size_a, size_b) * den >= np.maximum(size_a, size_b) * num)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def prune(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps (node, size, bits) allow."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            keep = []
            for k in range(batch.num_rows):
                x, y = np.frombuffer(c["xb"][k], "<u8"), np.frombuffer(c["yb"][k], "<u8")
                n = min(len(x), len(y))
                d = int(np.bitwise_count(_folded(x, n) ^ _folded(y, n)).sum())
                if allowed(c["xs"][k], c["ys"][k], d, num, den):
                    keep.append(k)
            if keep:
                yield rows_of(["a", "b"], *(np.array(c[n])[keep] for n in ("a", "b")))

    bits = only(bits, ends_of(pairs))
    x = bits.selectExpr("node AS a", "size AS xs", "bits AS xb")
    y = bits.selectExpr("node AS b", "size AS ys", "bits AS yb")
    return (pairs.join(x, "a").join(y, "b").select("a", "b", "xs", "xb", "ys", "yb")
            .mapInArrow(test, "a bigint, b bigint").distinct())


def _near(size, label, block, words, num: int, den: int):
    """For each member i of a group: (i, earlier members j of other labels that the bitmaps
    allow, their distances); where there are two blocks, pairs between them only."""
    cross = len(np.unique(block)) > 1
    lengths = np.array([len(w) for w in words])
    tables = {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        tables[int(n)] = (rows, np.stack([words[r] for r in rows]))
    for n in list(tables):                       # each class also folded to the next smaller
        rows, m = tables[n]
        tables[n] = (rows, m, _folded(m, n // 2) if n // 2 in tables else None)
    for i in range(len(size)):
        n = int(lengths[i])
        found, far = [], []
        for k, own in ((n, words[i]), (n // 2, None), (2 * n, words[i])):
            if k not in tables:
                continue
            rows, m, half = tables[k]
            upto = int(np.searchsorted(rows, i))
            if not upto:
                continue
            j = rows[:upto]
            ok = (label[j] != label[i]) & (np.minimum(size[j], size[i]) * den
                                           >= np.maximum(size[j], size[i]) * num)
            if cross:
                ok &= block[j] != block[i]
            if not ok.any():
                continue
            table = (half if k > n else m)[:upto][ok]
            own = _folded(words[i], k) if own is None else own
            d = np.bitwise_count(table ^ own).sum(axis=1, dtype=np.int64)
            good = allowed(size[j[ok]], size[i], d, num, den)
            found.append(j[ok][good])
            far.append(d[good])
        if found and sum(map(len, found)):
            yield i, np.concatenate(found), np.concatenate(far)


def blocks_of(groups: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows (lead, node, ...) with ``task``, which two blocks of a group share, and ``block``.
    With ``weight``, a column, blocks are also bounded by its sum (``ELEMENTS``)."""
    count = F.expr(f"(count(1) - 1) div {BLOCK}")
    if weight:
        count = F.greatest(count, F.expr(f"sum({weight}) div {ELEMENTS}"))
    n = groups.groupBy("lead").agg((count + F.lit(1)).cast("long").alias("n"))
    one = groups.join(n, "lead").withColumn("block", F.pmod(F.xxhash64("node"), "n"))
    # Two blocks meet in one task; a block alone meets itself there where it is the only one,
    # or else beside its next neighbour.
    return (one.withColumn("other", F.explode(F.expr("sequence(0L, n - 1)")))
            .withColumn("task", F.xxhash64("lead", F.least("block", "other"),
                                           F.greatest("block", "other"))).drop("other", "n"))


def _roots() -> tuple[Callable, Callable]:
    """Union-find over labels: find(x), and join(x, y), which says whether they were apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    def join(x: int, y: int) -> bool:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
        return x != y
    return find, join


def open_pairs(groups: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """(lead, a, b): a spanning forest, closest first, of the pairs between components of each
    group (lead, node, label) that the bitmaps (node, size, bits) allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "task", ["lead", "node", "size", "label", "block", "bits"]):
            node, size, label, block = (np.array([r[k] for r in rows], np.int64)
                                        for k in range(1, 5))
            words = [np.frombuffer(r[5], "<u8") for r in rows]
            _, join = _roots()
            a, b = [], []
            for i, j, far in _near(size, label, block, words, num, den):
                for k in np.argsort(far, kind="stable").tolist():
                    if join(int(label[i]), int(label[j[k]])):
                        a.append(int(node[i]))
                        b.append(int(node[j[k]]))
            if a:
                yield rows_of(["lead", "a", "b"], np.full(len(a), rows[0][0], np.int64),
                              np.minimum(a, b), np.maximum(a, b))
    tasks = blocks_of(groups).join(only(bits, groups).dropDuplicates(["node"]), "node")
    return (by_key(tasks, "task", ["node"])
            .mapInArrow(run, "lead bigint, a bigint, b bigint").distinct())


def open_links(groups: DataFrame, sizes: DataFrame, texts: DataFrame,
               sets: Callable[[bytes], np.ndarray], num: int, den: int) -> DataFrame:
    """(a, b): links between components of each group (lead, node, label), of the pairs that
    two of its blocks hold a spanning forest.  A task compares the sets themselves, so pairs
    that are no link never leave it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "task", ["node", "label", "block", "z"]):
            node, label, block = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            held = [np.sort(sets(r[3])) for r in rows]
            size = np.array([len(x) for x in held], np.int64)
            words = [np.frombuffer(bitmap(mix64(x), FINE), "<u8") for x in held]
            find, join = _roots()
            a, b = [], []
            for i, j, far in _near(size, label, block, words, num, den):
                for k in j[np.argsort(far, kind="stable")].tolist():
                    if find(int(label[i])) == find(int(label[k])):
                        continue
                    both = len(np.intersect1d(held[i], held[k], assume_unique=True))
                    if both * den >= num * (len(held[i]) + len(held[k]) - both):
                        join(int(label[i]), int(label[k]))
                        a.append(int(node[i]))
                        b.append(int(node[k]))
            if a:
                yield rows_of(["a", "b"], np.minimum(a, b), np.maximum(a, b))
    groups = groups.join(only(sizes, groups).dropDuplicates(["node"]), "node")
    tasks = blocks_of(groups, "size").join(only(texts, groups).dropDuplicates(["node"]), "node")
    return by_key(tasks, "task", ["node"]).mapInArrow(run, "a bigint, b bigint").distinct()


# ------------------------------------------------------- comparison, components

def verify(pairs: DataFrame, texts: DataFrame, sets: Callable[[bytes], np.ndarray],
           num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the Jaccard threshold num / den exactly.

    ``texts``: (node, z), ``sets`` makes the set of a z; a node may come several times.  Each
    pivot ``a`` meets its partners in groups of about ``FANOUT``, so a pivot with very many
    partners is many tasks' work; a task holds one pivot's set and one partner's."""
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salts = F.expr(f"n div {FANOUT} + 1")
    partners = pairs.join(n, "a").select(
        "a", F.pmod(F.xxhash64("b"), salts).alias("salt"), "b")
    pivots = n.select("a", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"),
                      F.col("a").alias("b"))
    texts = only(texts, ends_of(pairs))
    fan = partners.unionByName(pivots).join(texts, F.col("b") == F.col("node")).drop("node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, last = None, None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, z in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                               batch.column("z").to_pylist(), strict=True):
                if (a, b) == last:
                    continue
                last = (a, b)
                other = sets(z)
                if a == b:
                    now, mine = a, other
                    continue
                assert a == now, "a pivot's own row comes first"
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both * den >= num * (len(mine) + len(other) - both):
                    out_a.append(a)
                    out_b.append(b)
            if out_a:
                yield rows_of(["a", "b"], out_a, out_b)

    return (fan.repartition(shuffle_parts(pairs.sparkSession), "a", "salt")
            .sortWithinPartitions("a", "salt", F.col("a") != F.col("b"), "b")
            .select("a", "b", "z").mapInArrow(compare, "a bigint, b bigint"))


def components(pairs: DataFrame, members: DataFrame, bits: DataFrame, texts: DataFrame,
               sets: Callable[[bytes], np.ndarray], num: int, den: int) -> DataFrame:
    """(node, label) of every node that has a link.  ``bits``: (node, size, bits) and ``texts``:
    (node, z) of every node of a pair or list, at least once, read in place: what a step needs
    of them is picked by a Bloom filter."""
    low_high = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    likely = materialize(prune(pairs, bits, num, den), "likely-pairs")
    release_shuffles(pairs.sparkSession)
    links = materialize(verify(likely, texts, sets, num, den).select(*low_high), "links")
    release_shuffles(pairs.sparkSession)
    tried = likely.select(*low_high)
    labels = materialize(connected_components(links), "labels")
    release_shuffles(pairs.sparkSession)

    def held(groups: DataFrame) -> DataFrame:
        # A node that is in the group under its own name was first in all its lists, so it
        # was compared with all it shares a list with.
        named = (groups.where("node != lead").join(labels, "node", "left")
                 .withColumn("label", F.coalesce("label", "node")))
        split = (named.groupBy("lead").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .where("lo != hi").select("lead"))
        return materialize(named.join(split, "lead", "left_semi"), "open-members")

    def joined(found: DataFrame) -> DataFrame:
        return labels if found.isEmpty() else materialize(connected_components(
            found.unionByName(labels.selectExpr("node AS a", "label AS b"))), "labels")

    edges = materialize(open_pairs(held(members), bits, num, den), "open-pairs")
    more = materialize(edges.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"),
                       "new-pairs")
    release_shuffles(pairs.sparkSession)
    found = materialize(verify(more, texts, sets, num, den), "links")
    release_shuffles(pairs.sparkSession)
    labels = joined(found)
    # Groups of which an edge proved wrong are compared in full.
    wrong = (edges.join(links.unionByName(found), ["a", "b"], "left_anti")
             .select("lead").distinct())
    groups = materialize(members.join(wrong, "lead", "left_semi"), "open-groups")
    release_shuffles(pairs.sparkSession)
    if not groups.isEmpty():
        labels = joined(materialize(open_links(held(groups), bits.select("node", "size"), texts,
                                               sets, num, den), "links"))
        release_shuffles(pairs.sparkSession)
    return labels
