"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words go into one automaton (blocks of at most ``block_words``
item words, so what is broadcast has a fixed bound; a longer item is a block by
itself).  Training words stream through it while the longest matching length is
tracked:

* a match of at least ``window`` words means that the window ending here stands in the
  items of the state that holds its last ``window`` words;
* an item shorter than ``window`` is one window; it ends here when its state is on the
  suffix-link chain of the current state.

Word pairs that occur in no item cannot be inside a match of two words or more, so runs
of words that are too short for the shortest window are passed over in bulk (numpy)
and reset the automaton; the result is the same.

Words: A-Z in lower case, maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Cases: null text and null items have no words; an item without words is no window;
repeated items count by their item id, a null item id counts as the empty string;
repeated rows are separate documents; empty tables give empty results or clean
documents.  Input columns are passed through; the added ones are named by ``names``
and may not clash with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import CHUNK_BYTES, chunks, flat

WINDOW = 13
COVERAGE = 20                 # a document is contaminated when 20 * n_hit >= n_words
BLOCK_WORDS = 50_000          # item words of one broadcast automaton
NAMES = ("n_words", "n_hit", "items", "spans")

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_NORMAL = bytes(0x20 if _GAP[b | 0x20 if 65 <= b < 91 else b] else (b | 0x20 if 65 <= b < 91 else b)
                for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPLIT = b"|"                 # between documents; never part of a word


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[tuple[int, ...]] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)       # state of the last ``window`` words
    short: list[tuple] = field(default_factory=list)   # (length, items) of short items on the chain
    own: dict[int, tuple] = field(default_factory=dict)
    pairs: np.ndarray | None = None
    lookup: dict[bytes, int] = field(default_factory=dict)
    shortest: int = 0

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        def split(p: int, q: int) -> int:
            if self.length[p] + 1 == self.length[q]:
                return q
            copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = copy
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = copy
                p = self.link[p]
            return copy

        if c in self.next[last]:
            return split(last, self.next[last][c])
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = split(p, self.next[p][c])
        return new


def build(items: list[list[bytes]], window: int) -> Automaton:
    a = Automaton(window)
    coded = [[a.vocabulary.setdefault(w, len(a.vocabulary)) for w in item] for item in items]
    for item in coded:
        last = 0
        for c in item:
            last = a._extend(last, c)
    inside: list[set[int]] = [set() for _ in a.next]
    for k, item in enumerate(coded):
        v = 0
        for c in item:
            v = u = a.next[v][c]
            while u > 0 and k not in inside[u]:
                inside[u].add(k)
                u = a.link[u]
        if 0 < len(item) < window:
            a.own[v] = (len(item), (*a.own.get(v, (0, ()))[1], k))
    order = sorted(range(len(a.next)), key=a.length.__getitem__)
    a.cut, a.short = [0] * len(order), [()] * len(order)
    for v in order[1:]:
        up = a.link[v]
        a.cut[v] = a.cut[up] if a.length[up] >= window else v
        a.short[v] = a.short[up] + ((a.own[up],) if up in a.own else ())
    a.items = [tuple(sorted(s)) if a.length[v] >= window else () for v, s in enumerate(inside)]
    a.lookup = {**a.vocabulary, _SPLIT: -2}
    n = len(a.vocabulary) + 1
    a.pairs = np.unique(np.array([x * n + y for item in coded
                                  for x, y in zip(item, item[1:], strict=False)], np.int64))
    a.shortest = min((min(len(item), window) for item in coded if item), default=0)
    return a


def stream(a: Automaton, run: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit ranges [from, to) of a run of word numbers and the items that hit."""
    v = m = 0
    hits, found = [], set()
    for i, c in enumerate(run):
        while v and c not in a.next[v]:
            v = a.link[v]
            m = a.length[v]
        if c not in a.next[v]:
            v = m = 0
            continue
        v, m = a.next[v][c], m + 1
        if m >= a.window:
            hits.append((i - a.window + 1, i + 1))
            found.update(a.items[a.cut[v]])
        shorts = a.short[v] + ((a.own[v],) if v in a.own and m >= a.length[v] else ())
        for n, ids in shorts:
            hits.append((i - n + 1, i + 1))
            found.update(ids)
    return hits, found


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(a: Automaton, texts: list[bytes]):
    """Per text: number of words, hit ranges, items."""
    stream_words = (b" " + _SPLIT + b" ").join(t.translate(_NORMAL) for t in texts).split()
    get = a.lookup.get
    ids = np.array([get(w, -1) for w in stream_words], np.int64)
    marks = np.flatnonzero(ids == -2)
    start = np.concatenate([[0], marks + 1])
    count = np.diff(np.concatenate([start, [len(ids) + 1]])) - 1
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[int]] = [set() for _ in texts]
    if a.shortest and len(ids):
        if a.shortest == 1:
            known = ids >= 0
            extra = 0
        else:
            code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0),
                            ids[:-1] * (len(a.vocabulary) + 1) + ids[1:], -1)
            at = np.searchsorted(a.pairs, code)
            known = a.pairs[np.minimum(at, len(a.pairs) - 1)] == code if len(a.pairs) else code > 0
            extra = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for i, j in edges.reshape(-1, 2).tolist():
            if j - i + extra >= a.shortest:
                ranges, items = stream(a, ids[i:j + extra].tolist())
                if ranges:
                    d = int(np.searchsorted(start, i, "right")) - 1
                    hits[d] += [(x + i - int(start[d]), y + i - int(start[d])) for x, y in ranges]
                    found[d] |= items
    return count.tolist(), [_merge(h) for h in hits], found


def item_blocks(items: DataFrame, id_col: str, text_col: str,
                block_words: int) -> Iterator[list[tuple[str, str]]]:
    """(id, text) lists of about ``block_words`` words, collected one block at a time."""
    words_of = F.coalesce(F.regexp_count(F.lower(text_col), F.lit(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0))
    total = items.agg(F.sum(words_of)).first()[0] or 0
    n = max(1, -(-2 * total // block_words) if total > block_words else 1)
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(n))
    for b in range(n):
        yield [(r[0], r[1]) for r in items.where(block == b).select(
            F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).collect()]


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text",
                       window: int = WINDOW, block_words: int = BLOCK_WORDS,
                       names: tuple[str, ...] = NAMES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings) and spans (hit word
    ranges [a, b)).  One map pass per item block, no shuffle."""
    spark = docs.sparkSession
    n_words, n_hit, hit_items, spans = names
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    out = docs.withColumns({
        n_words: F.lit(0).cast("long"), n_hit: F.lit(0).cast("long"),
        hit_items: F.array().cast("array<string>"),
        spans: F.array().cast("array<struct<a:bigint,b:bigint>>")})
    for block in item_blocks(items, item_id_col, item_text_col, block_words):
        automaton = spark.sparkContext.broadcast(
            (vars(build([words(t) for _, t in block], window)), [i for i, _ in block]))
        out = out.mapInArrow(_scanner(automaton, text_col, names), T.StructType(
            [T.StructField(f.name, f.dataType, True) for f in out.schema.fields]))
    return out


def _scanner(automaton, text_col: str, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ids = automaton.value
        a = Automaton(**state)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column(batch.schema.names.index(text_col)))
            for i, j in chunks(offsets, CHUNK_BYTES):
                part = batch.slice(i, j - i)
                texts = [data[offsets[k]:offsets[k + 1]].tobytes() for k in range(i, j)]
                count, hits, found = scan(a, texts)
                col = {n: part.column(part.schema.names.index(n)) for n in names}
                before = zip(col[names[2]].to_pylist(), col[names[3]].to_pylist(), strict=True)
                all_items, all_spans = [], []
                for (old_items, old_spans), h, f in zip(before, hits, found, strict=True):
                    all_items.append(sorted({*old_items, *(ids[k] for k in f)}))
                    all_spans.append(_merge(h + [(s["a"], s["b"]) for s in old_spans]))
                new = {names[0]: count,
                       names[1]: [sum(y - x for x, y in s) for s in all_spans],
                       names[2]: all_items,
                       names[3]: [[{"a": x, "b": y} for x, y in s] for s in all_spans]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[f.name], f.type) if f.name in new else part.column(k)
                     for k, f in enumerate(part.schema)], schema=part.schema)
    return run


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", coverage: int = COVERAGE):
    """Hits cover at least 1 / ``coverage`` of the words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * coverage >= F.col(n_words))


def remove_spans(found: DataFrame, text_col: str = "text", min_words: int = WINDOW,
                 spans: str = "spans") -> DataFrame:
    """Cut hit ranges of at least ``min_words`` words out of the texts (from the first
    byte of the first word to the first byte of the word after the range)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.schema.names.index(text_col)
            texts = batch.column(t).to_pylist()
            for k, ranges in enumerate(batch.column(batch.schema.names.index(spans)).to_pylist()):
                ranges = [(r["a"], r["b"]) for r in ranges or [] if r["b"] - r["a"] >= min_words]
                if ranges:
                    raw = texts[k].encode()
                    at = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
                    keep, last = [], 0
                    for a, b in ranges:
                        keep.append(raw[last:at[a]])
                        last = at[b]
                    texts[k] = (b"".join(keep) + raw[last:]).decode()
            yield batch.set_column(t, batch.schema.field(t), pa.array(texts, batch.schema.field(t).type))
    return found.mapInArrow(run, found.schema)
