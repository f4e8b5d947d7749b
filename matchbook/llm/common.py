"""Shared pieces of the text operators.

* Arrow column -> flat byte buffer, cut into chunks of bounded size.
* 64-bit hashes of words, shingles and windows as numpy kernels.
* Blob exchange: a map task sends each reducer a few binary rows that hold
  packed numpy arrays, so Spark shuffles megabytes, not millions of tiny rows.
* Connected components over an edge table (large-star / small-star).
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.session import materialize

CHUNK_BYTES = 2 << 20          # text handled at once by the numpy kernels
BLOB_BYTES = 4 << 20           # largest packed row before compression

U64 = np.uint64


# ---------------------------------------------------------------- text buffers

def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null is empty."""
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    a = column.fill_null("").cast(pa.large_string())
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows whose texts together stay near ``size`` bytes.
    A longer text is a range of its own: texts are never cut."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, compressed one after the other."""
    return zstandard.ZstdCompressor(1).compress(b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, dtypes: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(d).itemsize for d in dtypes)
    out, at = [], 0
    for d in dtypes:
        out.append(np.frombuffer(raw, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """As ``pack`` for integers.  The first bytes of all numbers of an array stand together,
    then the second ones and so on, as high bytes are mostly alike; signed numbers (rows,
    mostly ascending) are differences."""
    out = []
    for a in arrays:
        a = np.diff(a, prepend=a.dtype.type(0)) if a.dtype.kind == "i" else np.ascontiguousarray(a)
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(out))


def unpack_numbers(blob: bytes, dtypes: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(d).itemsize for d in dtypes]
    n = len(raw) // sum(widths)
    out, at = [], 0
    for d, w in zip(dtypes, widths, strict=True):
        a = np.ascontiguousarray(raw[at:at + n * w].reshape(w, n).T).reshape(-1).view(d)
        out.append(np.cumsum(a, dtype=a.dtype) if a.dtype.kind == "i" else a)
        at += n * w
    return out


def squeeze(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(text)


def unsqueeze(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


# --------------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D                       # odd, so it has an inverse mod 2**64
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, base, U64)]))
    return _powers[0], _powers[1]


def substring_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every pair, equal for equal bytes wherever
    they stand (polynomial prefix sums modulo 2**64 over random byte values)."""
    power, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[:len(data)], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * inverse[start]
                 + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Start and end of every maximal run of non-gap bytes that stays in one row,
    and the row's first word number (n + 1 entries)."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~prev | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


_ROLL = mix64(np.arange(101, 117, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per row, the distinct hashes (unsorted order: ascending) of its ``width``-word
    shingles after lower-casing A-Z; a shorter row's whole sequence is one shingle and
    a row without words has none."""
    low = LOWER[data]
    start, end, first = words_of(low, offsets)
    h = substring_hashes(low, start, end)
    n = max(0, len(h) - width + 1)
    s = np.zeros(n, U64)
    for k in range(width):
        s += h[k:k + n] * _ROLL[k]
    s = mix64(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a:b - width + 1]))
        elif b > a:
            short = (h[a:b] * _ROLL[:b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix64(np.array([short], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


# -------------------------------------------------------------- Spark helpers

def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver's
    garbage collection finds that no plan refers to them, which may otherwise take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of a key in one task, sorted, so that a task holds one key at a time."""
    return (df.repartition(shuffle_parts(df.sparkSession), key)
            .sortWithinPartitions(key, *(order or [])))


def grouped(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple]:
    """(key, row tuples) of each run of equal keys in sorted batches."""
    now, rows = None, []
    for batch in batches:
        values = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        for k, v in zip(batch.column(key).to_pylist(), values, strict=True):
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append(v)
    if rows:
        yield now, rows


def rows_of(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c)
                                       for c in columns], names=names)


def packed(columns, dtypes: list[str], buckets: int, base: int = 0,
           by: np.ndarray | None = None, code: Callable = pack) -> pa.RecordBatch:
    """Rows (bucket, blob) of arrays, dealt to buckets from ``base`` on by ``by`` (the first
    array by default)."""
    columns = [c.astype(d, copy=False) for c, d in zip(columns, dtypes, strict=True)]
    by = columns[0] if by is None else by
    bucket = (mix64(by) % U64(buckets)).astype(np.int32) + np.int32(base)
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order] for c in columns], bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return rows_of(["bucket", "blob"], bucket[cut[:-1]],
                   pa.array([code(*(c[a:b] for c in columns)) for a, b in
                             zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()))


def _held(batches, emit: Callable, dtypes: list[str]) -> Iterator[list[np.ndarray]]:
    """The emitted arrays, concatenated up to a bounded size."""
    width = sum(np.dtype(d).itemsize for d in dtypes)
    held, size = [], 0
    for columns in emit(batches):
        if len(columns[0]):
            held.append(columns)
            size += len(columns[0]) * width
        if size >= 6 * BLOB_BYTES:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def scatter(df: DataFrame, emit: Callable, dtypes: list[str], buckets: int) -> DataFrame:
    """Map side of a blob exchange.  ``emit(batches)`` yields tuples of equally long arrays,
    the first of them the uint64 key; a task sends each bucket of keys rows (bucket, blob)
    of packed arrays, a few at a time, so its memory is bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _held(batches, emit, dtypes):
            yield packed(columns, dtypes, buckets)
    return df.mapInArrow(run, "bucket int, blob binary")


def scatter_tagged(df: DataFrame, emit: Callable, split: Callable, dtypes: list[str],
                   buckets: int) -> DataFrame:
    """As ``scatter`` for columns (key, check, rank, row, position), pre-aggregated:
    ``split`` gives the rows decided already, which go to the buckets from ``buckets`` on,
    dealt out by row, and the representatives, which go to their key's bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _held(batches, emit, dtypes):
            decided, send = split(*columns)
            yield packed([c[send] for c in columns], dtypes, buckets)
            if len(decided):
                yield packed([c[decided] for c in columns], dtypes, buckets, buckets,
                             columns[3][decided].view(U64))
    return df.mapInArrow(run, "bucket int, blob binary")


def scatter_split(df: DataFrame, emit: Callable, split: Callable, dtypes: list[str],
                  buckets: int) -> DataFrame:
    """As ``scatter``, for keys that may hold much of the data: ``split`` gives the rows for
    their key's bucket and the rows (or None) of large keys, which go to the buckets from
    ``buckets`` on, dealt out by key and by the time at which a task held them.  Blobs are
    those of ``pack_numbers``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for k, columns in enumerate(_held(batches, emit, dtypes)):
            send, large = split(*columns)
            yield packed(send, dtypes, buckets, code=pack_numbers)
            if large is not None:
                here = mix64(np.array([(task << 32) + k + 1], U64))
                yield packed(large, dtypes, buckets, buckets, large[0] ^ here, pack_numbers)
    return df.mapInArrow(run, "bucket int, blob binary")


def _by_bucket(batches: Iterator[pa.RecordBatch], dtypes: list[str],
               decode: Callable = unpack) -> Iterator[tuple]:
    """(bucket, its concatenated arrays), one bucket at a time."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"),
                                strict=True):
            if bucket != now and held:
                yield now, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = bucket
            held.append(decode(blob.as_buffer(), dtypes))
    if held:
        yield now, [np.concatenate(c) for c in zip(*held, strict=True)]


def _dealt(blobs: DataFrame) -> DataFrame:
    return (blobs.repartition(shuffle_parts(blobs.sparkSession), "bucket")
            .sortWithinPartitions("bucket"))


def gather(blobs: DataFrame, reduce: Callable, dtypes: list[str], schema: str,
           decode: Callable = unpack) -> DataFrame:
    """Reduce side: ``reduce(bucket, arrays...)`` yields record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, columns in _by_bucket(batches, dtypes, decode):
            yield from reduce(bucket, *columns)
    return _dealt(blobs).mapInArrow(run, schema)


def regather(blobs: DataFrame, reduce: Callable, dtypes: list[str], out: list[str],
             buckets: int) -> DataFrame:
    """Reduce side of one exchange and map side of the next: ``reduce(bucket, arrays...)``
    yields tuples of arrays, which are sent by the first of them, a task's together."""
    def emit(batches):
        for bucket, columns in _by_bucket(batches, dtypes):
            yield from reduce(bucket, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _held(batches, emit, out):
            yield packed(columns, out, buckets)
    return _dealt(blobs).mapInArrow(run, "bucket int, blob binary")


def bucket_count(spark: SparkSession) -> int:
    """Several buckets a shuffle partition, so that hashing deals them out evenly."""
    return 3 * shuffle_parts(spark)


BLOOM = 1 << 23                  # bits of a Bloom filter: one megabyte, whatever is in it


def _bloom_cells(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(nodes.view(U64))
    return (h % U64(BLOOM)).astype(np.int64), ((h >> U64(32)) % U64(BLOOM)).astype(np.int64)


def bloom_filter(nodes: DataFrame):
    """Broadcast filter of the BIGINT column ``node``: a fixed-size bitmap that only saves
    shuffling rows that a join would drop; it never loses one."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM, bool)
        for batch in batches:
            for cells in _bloom_cells(batch.column("node").to_numpy()):
                bits[cells] = True
        if bits.any():
            yield rows_of(["bits"], pa.array([np.packbits(bits).tobytes()], pa.binary()))

    total = np.zeros(BLOOM // 8, np.uint8)
    for r in nodes.select("node").coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(total.tobytes())


def in_bloom(bits: bytes, nodes: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, np.uint8)
    one, two = ((table[c >> 3] >> (7 - (c & 7))) & 1 for c in _bloom_cells(nodes))
    return (one & two).astype(bool)


def only(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``node`` passes the Bloom filter of ``nodes``, before a join."""
    wanted = bloom_filter(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bloom(wanted.value, batch.column("node").to_numpy())
            if keep.any():
                yield batch.filter(pa.array(keep))
    return df.mapInArrow(run, df.schema)


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Component label of every node of an undirected edge table.

    ``edges``: (a, b) BIGINT, any order, repeats and loops allowed.  Returns (node,
    label), label = smallest node of the component.  Alternates the large-star and
    small-star steps until the edge table no longer changes, which takes a number of
    rounds logarithmic in the size of a component.  Minima are partial aggregates and
    the join back is an equi-join that adaptive execution can split, so a node with
    very many neighbours is never one task's group.
    """
    e = materialize(edges.where("a != b")
                    .selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), tag)

    def with_low(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low, "u").withColumn("m", F.least("u", "m"))

    state = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)),
                          F.sum(F.expr("pmod(xxhash64(u, v), 1000000007)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        large = with_low(both).where("v > u").selectExpr("v AS u", "m AS v").distinct()
        small = (with_low(large)
                 .selectExpr("inline(array(struct(v AS u, m AS v), struct(u AS u, m AS v)))")
                 .where("u > v").distinct())
        e = materialize(small, tag)
    return (e.selectExpr("u AS node", "v AS label")
            .unionByName(e.selectExpr("v AS node", "v AS label")).groupBy("node")
            .agg(F.min("label").alias("label")))
