"""The best subset of a cell's rows for each of its targets: a cell at a time, inside tasks.

A subset is kept as the sequence of its rows, ordered by (amount, id descending).  Of equal
amounts it takes those of the largest ids, so a row follows only the equal row before it.
Subsets of k rows meet from sequences of k // 2 and of the k - k // 2 rows before them, by sum.
Targets with a subset of quality 100 are settled, as more rows are worse.  Where all amounts
are positive, sums above the largest open target are dropped, and a target is settled when
its fewest rows are above it.

At most ``room`` sequences are held.  Where more are needed, up to ``listed`` rows are cut into
two halves whose subsets are listed; otherwise the open targets are handed back, or a task that
has only one target lists the subsets of as many small amounts and makes those of the others
in blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = 1 << 18                  # pairs of sequences compared at once
ANY = 1 << 62                    # no largest sum


class Sequences(NamedTuple):
    sums: np.ndarray
    first: np.ndarray            # place of the first and last row; of an empty sequence -1
    last: np.ndarray
    places: np.ndarray           # one row a sequence, -1 where it is shorter than others

    def take(self, at: np.ndarray) -> Sequences:
        return Sequences(*(x[at] for x in self))

    def in_order(self) -> Sequences:
        """By sum."""
        return self.take(np.argsort(self.sums, kind="stable"))

    def to(self, cap: int) -> Sequences:
        """Those, in order, up to a sum."""
        return Sequences(*(x[:np.searchsorted(self.sums, cap, "right")] for x in self))

    def many(self, at: np.ndarray) -> np.ndarray:
        """0, 1 or 2 for sequences of no, one or more rows."""
        return (self.last[at] >= 0).astype(np.int64) + (self.last[at] > self.first[at])


class Rows(NamedTuple):
    """A cell's rows in order; ``follows``: whether a row equals the one before it."""
    ranks: np.ndarray            # by id
    u: np.ndarray
    follows: np.ndarray
    heads: np.ndarray            # the rows that do not follow

    def single(self, lo: int, hi: int) -> Sequences:
        at = np.arange(lo, hi)
        return Sequences(self.u[lo:hi], at, at, at[:, None].astype(np.int32))

    def longer(self, seqs: Sequences, cap: int, room: int, hi: int) -> Sequences | None:
        """Sequences of one row more, before place ``hi``; None if they exceed ``room``."""
        left = cap - seqs.sums
        heads = self.heads[:np.searchsorted(self.heads, hi)]
        begin = np.searchsorted(heads, seqs.last, "right")
        many = np.maximum(np.searchsorted(self.u[heads], left, "right") - begin, 0)
        after = np.minimum(seqs.last + 1, len(self.u) - 1)
        again = np.flatnonzero((seqs.last + 1 < hi) & self.follows[after] & (self.u[after] <= left))
        total = int(many.sum())
        if total + len(again) > room:
            return None
        base = np.repeat(np.arange(len(many)), many)
        step = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        base = np.concatenate([base, again])
        new = np.concatenate([heads[begin[base[:total]] + step], after[again]])
        return Sequences(seqs.sums[base] + self.u[new], seqs.first[base], new,
                         np.hstack([seqs.places[base], new[:, None].astype(np.int32)]))

    def blocks(self, seqs: Sequences, cap: int, room: int) -> Iterator[Sequences]:
        """Sequences and all longer ones, about ``room`` at a time."""
        if not len(seqs.sums):
            return
        yield seqs
        made = self.longer(seqs, cap, room, len(self.u))
        if made is not None:
            yield from self.blocks(made, cap, room)
            return
        step = max(1, room // len(self.u))
        for i in range(0, len(seqs.sums), step):
            part = Sequences(*(x[i:i + step] for x in seqs))
            yield from self.blocks(self.longer(part, cap, sys.maxsize, len(self.u)), cap, room)

    def listed(self, room: int) -> int:
        """The place before which there are ``room`` subsets at most."""
        at, subsets = 0, 1
        for at, follows in enumerate(self.follows.tolist()):
            same = same + 1 if follows else 1
            subsets = subsets // same * (same + 1)
            if subsets > room:
                return at
        return at

    def subsets(self, lo: int, hi: int, cap: int) -> Sequences:
        """All sequences of the places ``lo`` to ``hi``, the empty one included."""
        none, width = np.full(1, -1), hi - lo
        found, level = [Sequences(np.zeros(1, np.int64), none, none, np.full((1, width), -1, np.int32))], self.single(lo, hi)
        while len(level.sums):
            short = np.full((len(level.sums), width - level.places.shape[1]), -1, np.int32)
            found.append(level._replace(places=np.hstack([level.places, short])))
            level = self.longer(level, cap, sys.maxsize, hi)
        return Sequences(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _best_of(target: np.ndarray, q: np.ndarray, ranks: np.ndarray, total: np.ndarray, best: dict) -> None:
    """Keep the best subset of each target: quality, fewer rows, larger ids (descending)."""
    rows = (ranks >= 0).sum(axis=1)
    keys = [ranks[:, j] for j in range(ranks.shape[1] - 1, -1, -1)] + [-rows, q, target]
    order = np.lexsort(keys)
    ends = order[np.flatnonzero(np.append(np.diff(target[order]) != 0, True))]
    for e in ends:
        made = (int(q[e]), -int(rows[e]), tuple(ranks[e, :rows[e]].tolist()), int(total[e]))
        t = int(target[e])
        if t not in best or made[:3] > best[t][:3]:
            best[t] = made


def _meet(rows: Rows, low: Sequences, high: Sequences, open_: np.ndarray, v: np.ndarray, tol: np.ndarray,
          quality: Callable, best: dict) -> None:
    """Subsets of a sequence of ``low`` and a later one of ``high``, both in order, for the targets
    ``open_``."""
    if not len(low.sums) or not len(high.sums):
        return
    # Of the shorter list each sum that leaves a rest is looked up in the longer one.
    swapped = len(high.sums) > len(low.sums)
    table, asked = (high, low) if swapped else (low, high)
    per = max(1, PAIRS // len(asked.sums))
    for k in range(0, len(open_), per):
        for cut in range(0, len(asked.sums), PAIRS):
            some = open_[k:k + per]
            ends = np.searchsorted(asked.sums, (v + tol)[some] - table.sums[0], "right")
            size = np.clip(ends - cut, 0, PAIRS)
            t, a = np.repeat(some, size), cut + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            need = v[t] - asked.sums[a]
            lo = np.searchsorted(table.sums, need - tol[t])
            some = np.flatnonzero(table.sums[np.minimum(lo, len(table.sums) - 1)] <= need + tol[t])
            some = some[lo[some] < len(table.sums)]
            t, a, lo, need = t[some], a[some], lo[some], need[some]
            many = np.searchsorted(table.sums, need + tol[t], "right") - lo
            before = np.cumsum(many) - many
            at = 0
            while at < len(many):
                to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS)))
                m = many[at:to]
                tt, aa = np.repeat(t[at:to], m), np.repeat(a[at:to], m)
                bb = np.repeat(lo[at:to], m) + np.arange(m.sum()) - np.repeat(before[at:to] - before[at], m)
                at = to
                ll, hh = (aa, bb) if swapped else (bb, aa)
                left, right = (asked, table) if swapped else (table, asked)
                last, first = left.last[ll], right.first[hh]
                total = asked.sums[aa] + table.sums[bb]
                q, ok = quality(tt, total)
                ok &= left.many(ll) + right.many(hh) >= 2
                ok &= (first < 0) | ((last < first) & (~rows.follows[first] | (last == first - 1)))
                keep = np.flatnonzero(ok)
                if not len(keep):
                    continue
                # Only the best quality of a target, where it is not worse than what it has.
                top = np.zeros(len(v), np.int64)
                np.maximum.at(top, tt[keep], q[keep])
                for x in np.unique(tt[keep]).tolist():
                    if x in best:
                        top[x] = max(top[x], best[x][0])
                keep = keep[q[keep] == top[tt[keep]]]
                if not len(keep):
                    continue
                places = np.hstack([left.places[ll[keep]], right.places[hh[keep]]])
                ranks = -np.sort(-np.where(places >= 0, rows.ranks[places], -1), axis=1)
                _best_of(tt[keep], q[keep], ranks, total[keep], best)


def search(ids: np.ndarray, u: np.ndarray, v: np.ndarray, tol: np.ndarray, quality: Callable, listed: int,
           room: int, alone: bool = False) -> tuple[dict, list[int]]:
    """({target: (q, -rows, places in ids, total)}, targets handed back: none if ``alone``).
    ``quality`` of targets and totals is (q, whether they agree).  Ids must ascend."""
    ranks = np.arange(len(ids))
    order = np.lexsort((-ranks, u))
    positive = bool(u.min() > 0)
    if positive:
        order = order[u[order] <= (v + tol).max()]
    u = u[order]
    follows = np.zeros(len(u), bool)
    follows[1:] = u[1:] == u[:-1]
    rows = Rows(ranks[order], u, follows, np.flatnonzero(~follows))
    least = np.cumsum(u)
    best: dict = {}
    open_, k = np.arange(len(v)), 2
    # Sequences by number of rows, and those of them that may begin a subset.
    lists, starts = [None], [None]

    def add(made: Sequences) -> None:
        lists.append(made.in_order())
        starts.append(begins(rows, lists[-1]))

    add(rows.single(0, len(u)))
    while k <= len(u):
        settled = np.array([best.get(int(t), (0,))[0] == 100 for t in open_], bool)
        if positive:
            settled |= (v + tol)[open_] < least[k - 1]
        open_ = open_[~settled]
        if not len(open_):
            break
        # At least ``short`` rows are added to any sequence from here on.
        cap = int((v + tol)[open_].max()) if positive else ANY
        short, long = k // 2, k - k // 2
        rest = int(cap - least[short - 1]) if positive else ANY
        if positive:
            lists[short:], starts[short:] = ([x.to(rest) for x in y[short:]] for y in (lists, starts))
        if long == len(lists):
            made = rows.longer(lists[-1], rest, room, len(u))
            if made is None:
                if len(u) > listed and not alone:
                    back = open_.tolist()
                    return {t: b for t, b in best.items() if t not in set(back)}, back
                middle = len(u) // 2 if len(u) <= listed else max(1, rows.listed(room))
                low = begins(rows, rows.subsets(0, middle, cap)).in_order()
                _meet(rows, low, rows.subsets(0, 0, cap), open_, v, tol, quality, best)
                for high in rows.blocks(rows.single(middle, len(u)).to(cap), cap, room):
                    _meet(rows, low, high.in_order(), open_, v, tol, quality, best)
                break
            add(made)
        # The sequence of the first rows starts with the largest ids of its amounts.
        _meet(rows, starts[short], lists[long], open_, v, tol, quality, best)
        k += 1
    return best, []


def begins(rows: Rows, seqs: Sequences) -> Sequences:
    """The sequences that may begin a subset: none follows an equal row that is left out."""
    return seqs.take(np.flatnonzero((seqs.first < 0) | ~rows.follows[seqs.first]))


def solver(cell: list[str], exact: bool, floor: float, scale: int, listed: int,
           room: int, alone: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (cell, m: rows (id, u), asked: targets (v, tol, within)): the best
    subset of each target (v, total, rows, ids), or ``back`` where it is handed back.  Totals must
    agree as doubles, or within ``within`` at a quality of ``floor`` to 100."""
    div = float(10 ** scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, (m, asked) in enumerate(zip(batch.column("m"), batch.column("asked"), strict=True)):
                ids, u = (np.asarray(m.values.field(c), np.int64) for c in ("id", "u"))
                v, tol = (np.asarray(asked.values.field(c), np.int64) for c in ("v", "tol"))
                within = np.asarray(asked.values.field("within"), np.float64)

                def quality(x, total, v=v / div, within=within):
                    delta = np.abs(v[x] - total / div)
                    if exact:
                        return np.full(len(x), 100), delta == 0
                    curve = 100.0 - delta / np.maximum(within[x], 1e-12) * 20.0
                    return (np.floor(np.clip(curve, floor, 100.0) + 0.5).astype(np.int64),
                            delta <= within[x])

                best, back = search(ids, u, v, tol, quality, listed, room, alone)
                made += [(int(v[x]), total, -fewer, ids[list(ranks)], False)
                         for x, (_, fewer, ranks, total) in best.items()]
                made += [(int(v[x]), None, None, None, True) for x in back]
                at += [i] * (len(best) + len(back))
            types = pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_()
            found = zip(*made, strict=True) if made else [[]] * len(types)
            keys = batch.select(cell).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                keys.columns + [pa.array(list(x), t) for x, t in zip(found, types, strict=True)],
                names=cell + ["v", "total", "rows", "ids", "back"])

    return run
