"""Token ids in a word-aligned binary format (Simple-8b), written and read by Spark.

A 64-bit word holds a 4-bit selector and 60 bits of data; the selector says how many
ids of which width the word packs, from 60 ids of 1 bit to one id of 60 bits.
Selector 0 is an escape: its payload is the position of a raw 64-bit value in the tail
that follows the stream's words, so any unsigned 64-bit id can be stored.  Ids are
coded in blocks of ``BLOCK`` ids; a word never crosses a block, the last word of a
block is full, and the first word of every block is listed, so blocks decode on their
own and all words of a batch decode at once (numpy).

Files are Parquet (any store that Spark writes, with its commit protocol), one row per
document: shard, doc_id, start (ids before the document in its shard), n_tokens,
words, blocks (first word of each block).  Shards are ranges of ascending doc_id, rows
in a shard are sorted, so the files in shard order are the whole stream.

Cases: null text is empty and holds only the end id; a null id sorts first; rows with
the same id are ordered by text, repeated rows are all written; an empty table writes
an empty file set; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.llm.common import U64, chunks

BLOCK = 128
#: (ids in a word, bits of an id) by selector; selector 0 is the escape, 1 is unused.
PACKS = ((1, 60), (0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
         (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
GROUP = 1 << 19                # bytes of text that are encoded at once
CACHE = 500_000                # pieces of text whose ids a worker process remembers (twice)
FILE_SCHEMA = ("shard int, doc_id bigint, start bigint, n_tokens bigint, words binary, "
               "blocks binary")


# ------------------------------------------------------------------------ codec

_BITS_16 = np.array([max(1, v.bit_length()) for v in range(1 << 16)], np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs (0 needs 1)."""
    if not len(x) or x.max() < len(_BITS_16):
        return _BITS_16[x]
    out = np.ones(len(x), np.uint8)
    for b in range(1, 64):
        over = x >= U64(1 << b)
        if not over.any():
            break
        out += over
    return out


def encode(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Code many streams at once.  ``ids`` are all streams' ids, ``bounds`` the n + 1
    stream ends.  Returns the streams' words (without tails), the word range ends by
    stream, and for every stream the first word of each block; escapes stay as payloads
    that number the values of the stream's tail (see ``encode_streams``)."""
    ids = ids.astype(U64)
    n = len(ids)
    sizes = np.diff(bounds)
    per = -(-sizes // BLOCK)                             # blocks of each stream
    owner = np.repeat(np.arange(len(sizes)), per)
    first = np.concatenate([[0], np.cumsum(per)])
    inside = np.arange(len(owner)) - first[owner]
    begin = bounds[owner] + inside * BLOCK
    end = np.minimum(begin + BLOCK, bounds[owner + 1])
    # Widths by block, padded with a width that no pack takes.
    wide = np.full(len(owner) * _ROW, 255, np.uint8)
    rows = np.repeat(np.arange(len(owner)), end - begin)
    wide[rows * _ROW + np.arange(n) - begin[rows]] = _bits(ids)
    words, at_block, step = [], [], 0
    pos, live = begin.copy(), np.arange(len(owner))
    while len(live):
        p = pos[live]
        sel = _select(wide, live * _ROW + p - begin[live])
        count, bits = _COUNT[sel], _WIDTH[sel]
        word = sel.astype(U64) << U64(60)
        use = np.arange(len(live))
        for k in range(int(count.max())):
            use = use[count[use] > k] if k else use
            word[use] |= ids[p[use] + k] << (U64(k) * bits[use].astype(U64))
        escape = sel == 0
        word[escape] = 0
        words.append(word)
        at_block.append(live + step * len(owner))
        pos[live] = p + count
        live = live[pos[live] < end[live]]
        step += 1
    if not words:
        return np.empty(0, U64), np.zeros(len(sizes) + 1, np.int64), \
            [np.empty(0, np.uint32)] * len(sizes)
    block_of = np.concatenate([k % len(owner) for k in at_block])
    order = np.argsort(block_of, kind="stable")          # block by block, steps in order
    out = np.concatenate(words)[order]
    in_block = np.bincount(block_of, minlength=len(owner))
    block_first = np.concatenate([[0], np.cumsum(in_block)])
    ends = block_first[first]
    firsts = [(block_first[first[k]:first[k + 1]] - ends[k]).astype(np.uint32)
              for k in range(len(sizes))]
    return out, ends, firsts


_COUNT = np.array([c for c, _ in PACKS], np.int64)
_WIDTH = np.array([b for _, b in PACKS], np.int64)
_ROW = BLOCK + 60


def _select(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The selector that packs most ids from each position on (0: the id needs an escape)."""
    sel = np.zeros(len(at), np.int64)
    use, most, lane = np.arange(len(at)), np.zeros(len(at), np.uint8), 0
    for s in range(len(PACKS) - 1, 1, -1):               # few wide ids to many narrow ones
        count, bits = PACKS[s]
        for k in range(lane, count):
            most = np.maximum(most, wide[at[use] + k])
        lane = count
        fits = most <= bits
        sel[use[fits]] = s
        if not fits.any():
            break
        use, most = use[fits], most[fits]
    return sel


def encode_streams(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(words with tail, block offsets) of every stream, both little-endian."""
    words, ends, firsts = encode(ids, bounds)
    wide = ids.astype(U64) >= U64(1 << 60)
    out = []
    for k in range(len(bounds) - 1):
        w = words[ends[k]:ends[k + 1]]
        tail = ids[bounds[k]:bounds[k + 1]][wide[bounds[k]:bounds[k + 1]]].astype("<u8")
        if len(tail):
            w = w.copy()
            w[(w >> U64(60)) == 0] = np.arange(len(tail), dtype=U64)
        out.append((w.astype("<u8").tobytes() + tail.tobytes(), firsts[k].astype("<u4").tobytes()))
    return out


def decode_streams(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """All ids of many streams, one after the other; ``sizes`` are their id counts.  Words
    of all streams decode together, one numpy step per selector."""
    words = np.frombuffer(b"".join(blobs), "<u8")
    sel = (words >> U64(60)).astype(np.int64)
    count = _COUNT[sel]
    ends = np.cumsum([len(b) // 8 for b in blobs])
    begin = np.concatenate([[0], ends[:-1]]) if len(blobs) else ends
    filled = np.concatenate([[0], np.cumsum(count)])
    total = filled[ends] - filled[begin] if len(blobs) else np.zeros(0, np.int64)
    tails = {}
    escapes = np.concatenate([[0], np.cumsum(sel == 0)])
    tailed = escapes[ends] > escapes[begin] if len(blobs) else np.zeros(0, bool)
    for k in np.flatnonzero(tailed | (total != sizes)).tolist():    # with a tail of raw values
        a, b = int(begin[k]), int(ends[k])
        m = int(np.searchsorted(np.cumsum(count[a:b]), sizes[k])) + 1 if sizes[k] else 0
        tails[k] = (a, a + m, b)
        count[a + m:b] = 0
        if count[a:a + m].sum() != sizes[k]:
            raise ValueError("corrupt stream")
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), U64)
    for s in range(2, len(PACKS)):
        c, b = PACKS[s]
        at = np.flatnonzero((sel == s) & (count > 0))
        if len(at):
            lanes = np.arange(c)
            out[start[at][:, None] + lanes] = (words[at][:, None] >> (lanes * b).astype(U64)) \
                & U64((1 << b) - 1)
    for a, m, b in tails.values():
        at = a + np.flatnonzero(sel[a:m] == 0)
        out[start[at]] = words[m:b][words[at].astype(np.int64)]
    if (sel[count > 0] == 1).any():
        raise ValueError("corrupt stream")
    return out


# -------------------------------------------------------------------- tokenizer

#: White space but blank and line feed, and the mark of pieces.
_OTHER = re.compile("[\\x00\t\v\f\r\\x1c-\\x1f\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ByteLetters(dict):
    """Character -> the code points that a byte-level vocabulary writes its bytes as:
    printable bytes as themselves, the others as the code points from 256 on, in order."""

    def __init__(self):
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.of_byte = [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]

    def __missing__(self, character: str) -> str:
        self[character] = out = "".join(self.of_byte[b] for b in character.encode())
        return out


class Pieces:
    """Token ids of texts, remembered by piece.

    The byte-level pattern always starts a token at a blank that stands alone before a
    visible character, and takes a line feed that stands alone as a token, so a text
    without neighbouring white space is the concatenation of its blank-separated
    pieces.  A piece of letters with marks behind them is the letters' tokens and the
    marks' tokens.  Other texts and pieces, and texts with an added token, are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = False, cache: int = CACHE):
        self.cache = cache
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (special_as_text and t.special)]
        # Ids are held as short as the vocabulary allows.
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = np.dtype("<u2" if small else "<u4")
        self.letters = ByteLetters()
        self.blank = self.letters[" "]
        letter = "H" if small else "I"
        self.packed = [struct.Struct(f"<{n}{letter}").pack for n in range(32)]
        self.feed = self._encode(["\n"])[0]
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self._turn()

    def _turn(self) -> None:
        """Forget pieces that were not met since the last turn."""
        self.old = self.known
        self.known = {"\n": self.feed, "\0": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _fresh(self, piece: str) -> bytes:
        """Ids of a piece not met before.  After '\x00' it has no blank before it."""
        core = piece.rstrip(_MARKS)
        bare = core[:1] == "\0"
        word = core[1:] if bare else core
        if not word.isalpha():
            return self._encode([piece[1:] if piece[:1] == "\0" else " " + piece])[0]
        if len(core) < len(piece):
            return self._find(core) + self._find("\0" + piece[len(core):])
        letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word))
        ids = [t.id for t in self.model.tokenize(letters if bare else self.blank + letters)]
        return self.packed[len(ids)](*ids) if len(ids) < len(self.packed) \
            else np.array(ids, self.kind).tobytes()

    def _find(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.known[piece] = self.old.get(piece) or self._fresh(piece)
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as ``kind``."""
        cut = [None if not t or "  " in t or "\n " in t or " \n" in t or "\n\n" in t
               or t[-1] in " \n" or _OTHER.search(t) or any(x in t for x in self.added)
               else ("\0" + t.replace("\n", " \n \0")).split(" ") for t in texts]
        if len(self.known) > self.cache:
            self._turn()
        known, before, fresh = self.known, self.old.get, self._fresh
        for piece in set().union(*filter(None, cut)).difference(known):
            known[piece] = before(piece) or fresh(piece)
        get = known.__getitem__
        return [b"".join(map(get, pieces)) if pieces else self._encode([t])[0] if t else b""
                for t, pieces in zip(texts, cut, strict=True)]


def worker_pieces(path: str, cache: int) -> Pieces:
    """The pieces that this worker process has met so far: tasks of one process share them."""
    import tokenizers
    kept = tokenizers.__dict__.setdefault("_pieces_by_path", {})
    if path not in kept:
        kept[path] = Pieces(path)
    kept[path].cache = cache
    return kept[path]


# ------------------------------------------------------------------- Spark files

def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 0, cache: int = CACHE) -> None:
    """Tokenise whole texts and write them, with ``end_id`` after each, in ascending id
    order.  ``cache`` bounds the memory of a worker process, about 100 bytes an entry and two
    entries a piece.  Texts are dealt to shards by id range first, so that ids are made and written
    in one pass over sorted rows and only the texts are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, at, pieces = TaskContext.get().partitionId(), 0, worker_pieces(tokenizer_path, cache)
        end, width = np.array([end_id], pieces.kind).tobytes(), pieces.kind.itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)
            offsets = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))])
            for i, j in chunks(offsets, GROUP):
                rows = batch.slice(i, j - i)
                raw = [ids + end for ids in
                       pieces([t or "" for t in rows.column("text").to_pylist()])]
                sizes = np.array([len(r) // width for r in raw], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                coded = encode_streams(np.frombuffer(b"".join(raw), pieces.kind), bounds)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(raw), pa.int32()), rows.column("id"),
                    pa.array(at + bounds[:-1]), pa.array(sizes),
                    pa.array([w for w, _ in coded], pa.binary()),
                    pa.array([b for _, b in coded], pa.binary())],
                    names=["shard", "doc_id", "start", "n_tokens", "words", "blocks"])
                at += int(bounds[-1])

    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
     .repartitionByRange("id").sortWithinPartitions("id", "text")
     .mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(path))


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    sizes = batch.column("n_tokens").to_numpy()
    for i, j in chunks(np.concatenate([[0], np.cumsum(sizes * 3)])):
        n = sizes[i:j]
        ids = decode_streams(batch.column("words").slice(i, j - i).to_pylist(), n)
        yield i, j, ids, np.concatenate([[0], np.cumsum(n)])


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids before the document in the whole stream), n_tokens, and the
    decoded token_ids, or with ``ids=False`` only ids_crc32: the CRC-32 of the decoded ids
    as little-endian unsigned 32-bit integers."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per shard: the window that numbers the shards' starts is that small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = (files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
            .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    kind = "token_ids array<bigint>" if ids else "ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, j, values, ends in _streams(batch):
                rows = batch.slice(i, j - i)
                if ids:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                    pa.array(values.view(np.int64)))
                else:
                    raw = values.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in
                                     zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
                                    pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in ("shard", "doc_id", "start", "n_tokens")] + [last],
                    names=["shard", "doc_id", "start", "n_tokens", kind.split()[0]])

    rows = files.mapInArrow(run, "shard int, doc_id bigint, start bigint, n_tokens bigint, " + kind)
    return (rows.join(base, "shard")
            .select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens",
                    kind.split()[0]))
