"""Removal of byte strings of ``WINDOW`` bytes that repeat an earlier document.

Depth-limited radix sort of the suffixes, most significant digit first: suffixes are
only told apart through the window's length, and only groups that hold more than one
document go on to the next digit.  Ordering every position by single bytes would
shuffle each of them several times; the digits here are content-defined instead, so
that a pass moves a few numbers per hundred bytes:

1. Chunks (about ``CHUNK`` bytes, cut where a hash of 24 bytes says so) with the 49 bytes
   that follow.  Where a chunk stands in a document of smaller id, all windows that
   start in it are repeated and need no further pass, neither as copies nor as sources.
2. The smallest 24-byte hash inside each remaining window: equal windows have equal
   smallest hashes.  Windows whose hash occurs in one document only are unique.  (Strings of
   16 bytes, three or four words, recur by chance the more the larger the corpus is.)
3. Runs of neighbouring windows with the same smallest hash, as one string (about 14
   windows): where it stands in a document of smaller id, all its windows are repeated.
   Then pass 2 again over what is left.
4. The runs that are left go to the task of their smallest hash with their bytes (at most
   76 a piece).  There every window is told apart by a 128-bit hash of its whole bytes;
   equal groups are exactly the repeated windows.

A pass is a blob exchange: tasks keep the smallest id of a key and send that one, larger
ids being decided on the spot, so a string that stands in a third of all documents is a
few rows for each task.  (In pass 4, where the strings around it differ, the two ends of
such a string are a row for each document, all with one key.)  Answers go back to the documents by row number.  The compressed
texts are bucketed by row once, so the passes read them without another shuffle.

Order: smaller id first; a null id is smaller than all others.  Rows with equal ids are
not smaller than each other, so nothing is removed between them.  Null text is empty;
texts are judged as they came in; empty tables give empty results; a text is handled
whole in one task.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import (U64, bucket_count, chunks, flat, gather, mix64, regather,
                                  release_shuffles, rows_of, scatter, scatter_tagged, shuffle_parts,
                                  squeeze, substring_hashes, unsqueeze)
from matchbook.session import materialize

WINDOW = 50
GRAM = 24                     # a multiple of eight
CHUNK = 512
GROUP = 1 << 18               # bytes of text that the kernels handle at once
KEYED = ["<u8", "<u8", "<i8", "<i8", "<u8"]          # key, check, rank, row, place
BACK = ["<i8", "<u8"]                                 # row, key or place
SPAN = WINDOW - GRAM + 1                              # windows that one gram can lead
REACH = SPAN + WINDOW - 1                             # bytes of so many neighbouring windows
PIECES = ["<u8", "<i8", "<i8", "<u8", f"V{REACH}"]    # key, rank, row, place, bytes
COUNT_SHIFT = 40                                      # a place is a first window and a count
EARLIEST = -2**63


# --------------------------------------------------------------------- kernels

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position that has them."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, U64)
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = word[GRAM - 8:GRAM - 8 + n] * U64(0xD6E8FEB86659FD93)
    for at in range(GRAM - 16, -1, -8):
        h ^= h >> U64(32)
        h += word[at:at + n]
        h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def cut_points(grams: np.ndarray, offsets: np.ndarray, size: int):
    """Chunk starts and ends of rows data[offsets[k]:offsets[k + 1]]: only chunks in which a
    window starts, ends being the last start of a window plus one."""
    last = offsets[1:] - WINDOW                       # last window start of each row
    cut = np.zeros(offsets[-1] + 1, bool)
    cut[np.flatnonzero(grams % U64(size) == 0)] = True
    cut[offsets] = True
    start = np.flatnonzero(cut[:-1])
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], offsets[-1]), last[row] + 1)
    keep = end > start
    return start[keep], end[keep], row[keep]


PRIME = U64(2**31 - 1)
BASES = (1_450_232_569, 736_338_717)                  # of the two polynomials of a check
LOW = 12                                              # bits of a position in the first table


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` modulo ``PRIME``: 0 to 2**LOW - 1, and multiples of 2**LOW up to
    those of 2**LOW - 1 (positions up to 2**24; later ones are reduced to that)."""
    out = []
    for step in (base, pow(base, 1 << LOW, int(PRIME))):
        x = np.ones(1, U64)
        while len(x) < 1 << LOW:
            x = np.concatenate([x, x * U64(pow(step, len(x), int(PRIME))) % PRIME])
        out.append(x)
    return out[0], out[1]


_UP = [_powers(b) for b in BASES]
_DOWN = [_powers(pow(b, -1, int(PRIME))) for b in BASES]
_VALUE = [mix64(np.arange(1, 257, dtype=U64) * U64(k)) % PRIME for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _raise(tables, base: int, at: np.ndarray) -> np.ndarray:
    """``base`` to the power ``at`` modulo ``PRIME``."""
    low, high = tables
    mask = U64((1 << LOW) - 1)
    out = low[at & mask] * high[(at >> U64(LOW)) & mask] % PRIME
    far = at >> U64(2 * LOW)
    if len(far) and far.max():
        n, where = np.unique(far, return_inverse=True)
        step = pow(base, 1 << 2 * LOW, int(PRIME))
        out = out * np.array([pow(step, int(k), int(PRIME)) for k in n], U64)[where] % PRIME
    return out


#: Powers at the positions of a group; longer rows have theirs reckoned each time.
_NEAR = [_raise(t, b, np.arange(2 * GROUP, dtype=U64)) for t, b in zip(_UP, BASES)]


def prime_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62-bit hash of data[start:end], of polynomials modulo a prime.  Those modulo 2**64
    agree, for any base, on some pairs of periodic-looking strings (the Thue-Morse word of
    2,048 letters and its complement); these do not."""
    n = len(data)
    out = np.zeros(len(start), U64)
    for k, base in enumerate(BASES):
        up = _NEAR[k][:n] if n <= 2 * GROUP else _raise(_UP[k], base, np.arange(n, dtype=U64))
        terms = _VALUE[k][data] * up
        prefix = np.zeros(n + 1, U64)
        np.cumsum((terms & PRIME) + (terms >> U64(31)), out=prefix[1:])
        down = _raise(_DOWN[k], pow(base, -1, int(PRIME)), start.astype(U64))
        out |= ((prefix[end] - prefix[start]) % PRIME * down % PRIME) << U64(31 * k)
    return out


def double_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Key and check of data[start:end], of different rings, so that strings which meet in
    one need not meet in the other."""
    return substring_hashes(data, start, end), prime_hashes(data, start, end)


def _among(owner: np.ndarray, value: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """Whether value[i] is among the found numbers of its owner row (positions or hashes)."""
    if not any(map(len, found)):
        return np.zeros(len(value), bool)
    who = np.repeat(np.arange(len(found)), [len(f) for f in found])
    mark = lambda o, v: v.astype(U64) + o.astype(U64) * U64(0x9E3779B97F4A7C15)
    return np.isin(mark(owner, value), mark(who, np.concatenate(found)))


class Group:
    """Rows joined to one buffer: chunks, smallest hashes, and the windows still open."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, found: dict[str, list[np.ndarray]]):
        self.data, self.offsets, self.found = data, offsets, found
        self._grams = None

    @property
    def grams(self) -> np.ndarray:
        if self._grams is None:
            self._grams = gram_hashes(self.data)
        return self._grams

    def decided(self, name: str):
        """Window starts [a, b) that an earlier pass decided."""
        found = self.found.get(name)
        if not found or not any(map(len, found)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.concatenate(found)
        a = (place & U64((1 << COUNT_SHIFT) - 1)).astype(np.int64) \
            + np.repeat(self.offsets[:-1], [len(f) for f in found])
        return a, a + (place >> U64(COUNT_SHIFT)).astype(np.int64)

    def open_windows(self) -> np.ndarray:
        """By window start: in a row, in nothing decided, smallest hash alive."""
        self.least = sliding_min(self.grams, WINDOW - GRAM + 1)
        n = len(self.least)
        change = np.zeros(len(self.data) + 2, np.int8)
        last = self.offsets[1:] - WINDOW
        has = last >= self.offsets[:-1]
        change[self.offsets[:-1][has]] += 1
        change[last[has] + 1] -= 1
        for name in ("done", "fine"):                  # ranges of one pass never overlap
            start, end = self.decided(name)
            change[start] -= 1
            change[end] += 1
        live = np.cumsum(change, dtype=np.int8)[:n] > 0
        for name in ("alive", "alive2"):
            if name in self.found and n:
                begin, stop, owner = self.runs(live)
                keep = _among(owner, self.least[begin], self.found[name])
                still = np.zeros(n + 1, np.int8)
                still[begin[keep]] += 1
                still[stop[keep]] -= 1
                live = np.cumsum(still[:-1], dtype=np.int8) > 0
        return live

    def runs(self, live: np.ndarray):
        """Runs of open windows of one row with the same smallest hash: begin, end, row."""
        n = len(live)
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = (self.least[1:] != self.least[:-1]) | ~live[:-1] | ~live[1:]
        fresh[self.offsets[self.offsets < n]] = True
        begin = np.flatnonzero(live & fresh[:-1])
        stop = np.flatnonzero(live & fresh[1:]) + 1
        return begin, stop, np.searchsorted(self.offsets, begin, "right") - 1


# ------------------------------------------------------------------- exchanges

def places(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return start.astype(U64) | ((end - start).astype(U64) << U64(COUNT_SHIFT))


def lower(key, check, rank, row, place):
    """(followers, representatives): a row follows when its key has a smaller rank here."""
    order = np.lexsort((rank, check, key))
    k, c, r = key[order], check[order], rank[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    least = r[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[r > least], order[r == least]


def shared(key, check, rank, row, place):
    """(members of keys that several rows have, one row of each key)."""
    order = np.lexsort((row, key))
    k, r = key[order], row[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    most = r[np.append(begin[1:], len(r)) - 1]
    return order[(r[begin] != most)[group]], order[begin]


def _answers(split: Callable, by_place: bool, buckets: int):
    """Reduce a bucket of keys: rows that the rule decides go back, keyed by row number."""
    def run(bucket, key, check, rank, row, place):
        at = np.arange(len(key)) if bucket >= buckets else split(key, check, rank, row, place)[0]
        yield row[at].view(U64), (place if by_place else key)[at]
    return run


def _per_row(bucket, row, what) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((what, row))
    row, what = row[order], what[order]
    keep = np.concatenate([[True], (row[1:] != row[:-1]) | (what[1:] != what[:-1])])
    row, what = row[keep], what[keep]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = np.append(begin[1:], len(row))
    for i in range(0, len(begin), 4096):
        part = slice(i, i + 4096)
        yield rows_of(["row", "found"], row[begin[part]].view(np.int64), pa.array(
            [what[a:b].tobytes() for a, b in zip(begin[part].tolist(), ends[part].tolist(),
                                                 strict=True)], pa.binary()))


def decide(source: DataFrame, emit: Callable, split: Callable, by_place: bool,
           tag: str) -> DataFrame:
    """(row, found): for each row the keys (or places) that one pass decided.  Its shuffles
    are let go afterwards."""
    buckets = bucket_count(source.sparkSession)
    sent = scatter_tagged(source, emit, split, KEYED, buckets)
    back = regather(sent, _answers(split, by_place, buckets), KEYED, ["<u8", "<u8"],
                    shuffle_parts(source.sparkSession))
    out = materialize(gather(back, _per_row, BACK, "row bigint, found binary"), tag)
    del sent, back
    release_shuffles(source.sparkSession)
    return out


def _groups(batches: Iterator[pa.RecordBatch], *found: str):
    """Bounded groups of rows: row, rank, Group with the found numbers of earlier passes."""
    for batch in batches:
        texts = [unsqueeze(z) for z in batch.column("z").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        cols = {c: batch.column(c).to_pylist() for c in found}
        row, rank = batch.column("row").to_numpy(), batch.column("rank").to_numpy()
        for i, j in chunks(offsets, GROUP):
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            yield row[i:j], rank[i:j], Group(data, offsets[i:j + 1] - offsets[i], {
                c: [np.frombuffer(b or b"", "<u8") for b in cols[c][i:j]] for c in found})


def _send(g: Group, row, rank, owner, start, end):
    """Strings from each first window to the end of the last one, as keyed rows."""
    key, check = double_hash(g.data, start, end + WINDOW - 1)
    first = g.offsets[owner]
    return key, check, rank[owner], row[owner], places(start - first, end - first)


def _chunks(batches):
    for row, rank, g in _groups(batches):
        start, end, owner = cut_points(g.grams, g.offsets, CHUNK)
        yield _send(g, row, rank, owner, start, end)


def _runs(*found: str):
    def emit(batches):
        for row, rank, g in _groups(batches, *found):
            begin, stop, owner = g.runs(g.open_windows())
            yield _send(g, row, rank, owner, begin, stop)
    return emit


def _smallest(*found: str):
    def emit(batches):
        for row, rank, g in _groups(batches, *found):
            begin, _, owner = g.runs(g.open_windows())
            key = g.least[begin]
            zero = np.zeros(len(key), "<u8")
            yield key, zero, zero.view(np.int64), row[owner], zero
    return emit


def _open_pieces(*found: str):
    """Emit the open runs, at most ``SPAN`` windows a piece, with their bytes."""
    def emit(batches):
        for row, rank, g in _groups(batches, *found):
            begin, stop, owner = g.runs(g.open_windows())
            parts = -(-(stop - begin) // SPAN)
            run = np.repeat(np.arange(len(begin)), parts)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = begin[run] + nth * SPAN
            end = np.minimum(start + SPAN, stop[run])
            owner = owner[run]
            at = start[:, None] + np.arange(REACH)
            held = np.where(at < (end + WINDOW - 1)[:, None],
                            g.data[np.minimum(at, max(len(g.data) - 1, 0))], 0).astype(np.uint8) \
                if len(start) else np.zeros((0, REACH), np.uint8)
            first = g.offsets[owner]
            yield (g.least[start], rank[owner], row[owner], places(start - first, end - first),
                   np.ascontiguousarray(held).view(f"V{REACH}").reshape(-1))
    return emit


def _repeated_windows(bucket, key, rank, row, place, held):
    """The windows of the pieces that stand in a document of smaller id, keyed by row."""
    count = (place >> U64(COUNT_SHIFT)).astype(np.int64)
    piece = np.repeat(np.arange(len(key)), count)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = piece * REACH + nth
    data = np.frombuffer(held.tobytes(), np.uint8)
    one, two = double_hash(data, at, at + WINDOW)
    again = lower(one, two, rank[piece], None, None)[0]
    window = (place[piece] & U64((1 << COUNT_SHIFT) - 1)) + nth.astype(U64)
    start = window[again].astype(np.int64)
    yield row[piece][again].view(U64), places(start, start + 1)


def decide_windows(source: DataFrame, emit: Callable, tag: str) -> DataFrame:
    """(row, found): the open windows that stand in a document of smaller id."""
    buckets = bucket_count(source.sparkSession)
    back = regather(scatter(source, emit, PIECES, buckets), _repeated_windows, PIECES,
                    ["<u8", "<u8"],
                    shuffle_parts(source.sparkSession))
    out = materialize(gather(back, _per_row, BACK, "row bigint, found binary"), tag)
    del back
    release_shuffles(source.sparkSession)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, done = batch.column("id"), 0
        for row, _, g in _groups(iter([batch]), "done", "fine", "again"):
            offsets, n = g.offsets, len(g.data)
            change = np.zeros(n + 1, np.int32)
            for name in ("done", "fine", "again"):
                start, end = g.decided(name)
                np.add.at(change, start, 1)
                np.add.at(change, end + WINDOW - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.zeros(n + 1, bool)                 # runs end at their row's end as well
            edge[offsets] = True
            before = np.concatenate([[False], gone[:-1]]) if n else gone
            after = np.concatenate([gone[1:], [False]]) if n else gone
            a = np.flatnonzero(gone & (~before | edge[:-1]))
            b = np.flatnonzero(gone & (~after | edge[1:])) + 1
            spans: list[list[dict]] = [[] for _ in row]
            for k, x, y in zip((np.searchsorted(offsets, a, "right") - 1).tolist(), a.tolist(),
                               b.tolist(), strict=True):
                spans[k].append({"a": x - int(offsets[k]), "b": y - int(offsets[k])})
            kept = [g.data[offsets[k]:offsets[k + 1]][~gone[offsets[k]:offsets[k + 1]]].tobytes()
                    if spans[k] else g.data[offsets[k]:offsets[k + 1]].tobytes()
                    for k in range(len(row))]
            yield rows_of(["row", "id", "n_bytes", "spans", "kept"], row,
                          ids.slice(done, len(row)), np.diff(offsets),
                          pa.array(spans, SPAN_TYPE), pa.array(kept, pa.binary()))
            done += len(row)


SPAN_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
RESULT = ("row bigint, id bigint, n_bytes bigint, spans array<struct<a:bigint,b:bigint>>, "
          "kept binary")


# -------------------------------------------------------------------- operator

def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: <id_col>, n_bytes, spans (removed byte ranges [a, b), maximal),
    kept (the remaining bytes)."""
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets):
                yield rows_of(["row", "id", "rank", "z"],
                              *(batch.column(c).slice(i, j - i) for c in ("row", "id", "rank")),
                              pa.array([squeeze(data[offsets[k]:offsets[k + 1]].tobytes())
                                        for k in range(i, j)], pa.binary()))

    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(EARLIEST)).alias("rank"),
                       F.col(text_col).alias("text"))
    texts = materialize(
        rows.mapInArrow(compress, "row bigint, id bigint, rank bigint, z binary")
        .repartition(shuffle_parts(docs.sparkSession), "row"), "suffix-texts", bucket_by="row")
    release_shuffles(docs.sparkSession)

    def after(how: str = "left", **found: DataFrame) -> DataFrame:
        out = texts
        for name, table in found.items():
            out = out.join(table.withColumnRenamed("found", name), "row",
                           how if name == "alive" else "left")
        return out

    # Rows without a living hash have no repeated window outside their decided chunks: from
    # the third pass on they are not read.
    done = decide(texts, _chunks, lower, True, "suffix-chunks")
    alive = decide(after(done=done), _smallest("done"), shared, False, "suffix-alive")
    fine = decide(after("inner", done=done, alive=alive), _runs("done", "alive"), lower, True,
                  "suffix-runs")
    alive2 = decide(after("inner", done=done, alive=alive, fine=fine),
                    _smallest("done", "alive", "fine"), shared, False, "suffix-alive2")
    again = decide_windows(after("inner", done=done, alive=alive, fine=fine, alive2=alive2),
                           _open_pieces("done", "alive", "fine", "alive2"), "suffix-windows")
    return (after(done=done, fine=fine, again=again).mapInArrow(_cut, RESULT)
            .select(F.col("id").alias(id_col), "n_bytes", "spans", "kept"))
