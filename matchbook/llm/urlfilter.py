"""URL rules by exact membership in Bloom filter cascades, without a join.

A rule is a host and a path prefix; it fits its host, all subdomains and every path that
starts with its path.  So a URL's possible rules are the keys (host suffix, path prefix)
of as many labels and characters as rules have, a short list made by Spark SQL.

Whether a key is listed is asked of a cascade.  Level 0 is a Bloom filter of the listed
keys; all keys of the corpus go through it once, and those that pass without being listed
(its false positives over the complete key universe) are what level 1 encodes; level 2
encodes the listed keys that level 1 passes wrongly, and so on until no key is wrong.
Every key of the corpus then has its exact answer: the first level that does not hold it
tells.  There is one cascade for each verdict.

* Keys are dealt by hash to shards of about ``SHARD_KEYS`` listed keys, and a task builds
  the levels of a shard, so no list is held whole anywhere.
* Level 0 holds log2(universe / listed) bits a key, from an approximate distinct count, so
  that its false positives are about as many as the listed keys whatever the corpus.
* Filters are broadcast in groups of shards of at most ``BROADCAST_BYTES``, measured before;
  beyond that the keys go through several passes, written between, one group each.

The longest fitting rule wins (host and path together; of equals the longer host).  A URL
that no rule fits has no rule and is allowed: the method asks for listed keys only.

Cases: a null URL or one without ``://`` has an empty host and path and is allowed; rules
without a host are not allowed (ValueError); a rule listed with both verdicts blocks;
repeated rules count once, without rules all URLs are allowed; hosts of any number of
labels and paths of any length give only keys as long as some rule; repeated rows stay
repeated; an empty table gives an empty result.  Only the named columns are read, so further
columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import U64, mix64, shuffle_parts
from matchbook.session import materialize

SHARD_KEYS = 1 << 18             # listed keys of a shard, about
BROADCAST_BYTES = 64 << 20       # filters sent to the executors at once
MAX_LEVELS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


# ---------------------------------------------------------------------- URLs, keys

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))          # 0: not found
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, verdict, labels, width) of each distinct rule (host, path, verdict)."""
    host = F.translate("host", UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    listed = rules.select(F.concat(host, path).alias("key"), "verdict",
                          F.size(F.split(host, r"\.", -1)).alias("labels"),
                          F.length(path).alias("width"), "host")
    bad = listed.where(F.col("host").isNull() | (F.col("host") == "")
                       | ~F.col("verdict").isin(ALLOW, BLOCK) | F.col("verdict").isNull())
    if not bad.isEmpty():
        raise ValueError("a rule needs a host, and allow or block as its verdict")
    return listed.groupBy("key", "labels", "width").agg(F.max("verdict").alias("verdict"))


def possible_keys(host: Column, path: Column, labels: int, widths: list[int]) -> Column:
    """Keys of the rules that could fit, the longest first."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
                           lambda k: F.array_join(F.slice(parts, -k, k), "."))
    lengths = F.filter(F.array(*map(F.lit, widths)), lambda w: w <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(
        lengths, lambda w: F.struct((-F.length(s) - w).alias("size"), (-F.length(s)).alias("host"),
                                    F.concat(s, F.substring(path, F.lit(1), w)).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda p: p["key"])


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two independent hashes (the second starts from another seed)."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


# -------------------------------------------------------------------- Bloom filters

def _cells(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """k cells a key, different for every level."""
    a = mix64(h1 ^ mix64(np.array([2 * level + 1], U64)))
    b = mix64(h2 ^ mix64(np.array([2 * level + 2], U64))) | U64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + b[:, None] * np.arange(k, dtype=U64)) % U64(bits)


def make_filter(h1: np.ndarray, h2: np.ndarray, level: int, k: int) -> tuple[int, int, bytes]:
    bits = max(64, int(1.4427 * k * len(h1)) + 1)
    table = np.zeros(bits, bool)
    table[_cells(h1, h2, level, k, bits).ravel()] = True
    return k, bits, np.packbits(table).tobytes()


def passes(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int, table: bytes) -> np.ndarray:
    cells = _cells(h1, h2, level, k, bits).astype(np.int64)
    t = np.frombuffer(table, np.uint8)
    return ((t[cells >> 3] >> (7 - (cells & 7))) & 1).all(axis=1)


def upper_levels(listed: tuple[np.ndarray, np.ndarray], wrong: tuple[np.ndarray, np.ndarray],
                 ) -> list[tuple[int, int, bytes]]:
    """Levels 1, 2, ... of a cascade whose level 0 holds ``listed`` and passes ``wrong`` of the
    other keys: each encodes the keys that the level before passes wrongly."""
    out = []
    encode, other = wrong, listed
    while len(encode[0]):
        level = len(out) + 1
        if level > MAX_LEVELS:
            raise RuntimeError("a listed key and another one agree in 128 bits of hash")
        out.append(make_filter(*encode, level, 1))
        still = passes(*other, level, *out[-1])
        encode, other = (other[0][still], other[1][still]), encode
    return out


def members(h1: np.ndarray, h2: np.ndarray, levels: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Whether keys of the universe are listed."""
    alive = np.arange(len(h1))
    found = np.zeros(len(h1), bool)
    for level, f in enumerate(levels):
        ok = passes(h1[alive], h2[alive], level, *f)
        found[alive[~ok]] = level % 2 == 1
        alive = alive[ok]
    found[alive] = len(levels) % 2 == 1
    return found


# ------------------------------------------------------------------------- cascades

FILTER = "verdict string, shard int, level int, k int, bits long, cells binary"
HASHES = "verdict string, shard int, h1 long, h2 long"


def _u64(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False)).view(U64)


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((verdict, shard), kind array, h1, h2) of one shard at a time, from sorted batches."""
    held, now = [], None

    def out():
        kind, h1, h2 = (np.concatenate(c) for c in zip(*held, strict=True))
        return now, kind, h1.view(U64), h2.view(U64)

    for batch in batches:
        if not batch.num_rows:
            continue
        verdict = np.array(batch.column("verdict").to_pylist())
        shard = batch.column("shard").to_numpy()
        cut = np.flatnonzero((verdict[1:] != verdict[:-1]) | (np.diff(shard) != 0)) + 1
        columns = [batch.column(c).to_numpy() for c in ("kind", "h1", "h2")]
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True):
            key = (str(verdict[a]), int(shard[a]))
            if held and key != now:
                yield out()
                held = []
            now = key
            held.append([c[a:b] for c in columns])
    if held:
        yield out()


def _filter_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        names=["verdict", "shard", "level", "k", "bits", "cells"])


def _by_shard(rows: DataFrame) -> DataFrame:
    return (rows.repartition(shuffle_parts(rows.sparkSession), "verdict", "shard")
            .sortWithinPartitions("verdict", "shard"))


def _groups(filters: DataFrame, limit: int) -> list[list[tuple[str, int]]]:
    """Shards whose filters are broadcast together: at most ``limit`` bytes, measured here (a
    row for each shard comes to the driver)."""
    sizes = (filters.groupBy("verdict", "shard").agg(F.sum(F.length("cells")).alias("n"))
             .orderBy("verdict", "shard").collect())
    groups, total = [], limit + 1
    for r in sizes:
        if total + r["n"] > limit:
            groups.append([])
            total = 0
        groups[-1].append((r["verdict"], r["shard"]))
        total += r["n"]
    return groups


def _send(filters: DataFrame, group: list[tuple[str, int]]):
    """Broadcast {verdict: {shard: levels}} of one group of shards."""
    first, last = group[0], group[-1]
    here = F.struct("verdict", "shard")
    bound = lambda g: F.struct(F.lit(g[0]).alias("verdict"), F.lit(g[1]).alias("shard"))
    table: dict = {}
    for r in (filters.where((here >= bound(first)) & (here <= bound(last)))
              .orderBy("verdict", "shard", "level").toLocalIterator()):
        table.setdefault(r["verdict"], {}).setdefault(r["shard"], []).append(
            (r["k"], r["bits"], bytes(r["cells"])))
    return filters.sparkSession.sparkContext.broadcast(table)


def _ask(table: dict, h1: np.ndarray, h2: np.ndarray, shards: dict, test) -> Iterator[tuple]:
    """(verdict, key positions, answers) of the shards that are in the table."""
    for verdict, filters in table.items():
        shard = h2 % U64(shards[verdict])
        for s, levels in filters.items():
            at = np.flatnonzero(shard == U64(s)) if shards[verdict] > 1 else np.arange(len(h1))
            if len(at):
                yield verdict, at, test(h1[at], h2[at], levels)


class Cascades:
    """Cascades of the listed keys of both verdicts over the keys of a corpus.

    ``keys``: DataFrame with array columns h1 and h2, the hashes of each URL's keys."""

    def __init__(self, listed: DataFrame, keys: DataFrame, limit: int = BROADCAST_BYTES,
                 shard_keys: int = SHARD_KEYS):
        self.limit = limit
        h1, h2 = _hashes(F.col("key"))
        listed = materialize(listed.select("verdict", h1.alias("h1"), h2.alias("h2")), "url-rules")
        counts = {r["verdict"]: r["count"] for r in listed.groupBy("verdict").count().collect()}
        self.shards = {v: -(-n // shard_keys) for v, n in counts.items()}
        universe = keys.agg(F.approx_count_distinct("h")).first()[0] if counts else 0
        shard = F.lit(0).cast("int")
        hashes = {}
        for v, n in counts.items():
            share = max(2.0, universe / n)
            hashes[v] = min(40, max(1, int(np.ceil(np.log2(share)))))
            modulo = F.expr(f"pmod(h2 % {self.shards[v]} + IF(h2 < 0, "
                            f"{(1 << 64) % self.shards[v]}, 0), {self.shards[v]})")
            shard = F.when(F.col("verdict") == v, modulo.cast("int")).otherwise(shard)
        listed = listed.withColumn("shard", shard).withColumn("kind", F.lit(0))

        def level0(batches):
            yield _filter_rows([(v, s, 0, *make_filter(a, b, 0, hashes[v]))
                                for (v, s), _, a, b in _shard_rows(batches)])
        first = materialize(_by_shard(listed).mapInArrow(level0, FILTER), "url-level0")

        wrong = None
        for group in _groups(first, limit):
            sent, shards = _send(first, group), self.shards

            def positives(batches, sent=sent, shards=shards):
                for batch in batches:
                    a, b = _u64(batch.column("h")), _u64(batch.column("g"))
                    for v, at, ok in _ask(sent.value, a, b, shards,
                                          lambda x, y, f: passes(x, y, 0, *f[0])):
                        hit = np.unique(np.stack([a[at[ok]], b[at[ok]]]), axis=1)
                        n = hit.shape[1]
                        if n:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([v] * n), pa.array((hit[1] % U64(shards[v])).astype(np.int32)),
                                 pa.array(hit[0].view(np.int64)), pa.array(hit[1].view(np.int64))],
                                names=["verdict", "shard", "h1", "h2"])
            found = keys.select("h", "g").mapInArrow(positives, HASHES)
            wrong = found if wrong is None else wrong.unionByName(found)
        if wrong is None:
            self.filters = first
            return
        wrong = wrong.distinct().join(listed.drop("shard", "kind"), ["verdict", "h1", "h2"], "left_anti")
        both = listed.unionByName(wrong.withColumn("kind", F.lit(1)))

        def rest(batches):
            for (v, s), kind, a, b in _shard_rows(batches):
                made = upper_levels((a[kind == 0], b[kind == 0]), (a[kind == 1], b[kind == 1]))
                yield _filter_rows([(v, s, i + 1, *f) for i, f in enumerate(made)])
        upper = materialize(_by_shard(both).mapInArrow(rest, FILTER), "url-levels")
        self.filters = first.unionByName(upper)

    def first_hits(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with arrays h1, h2) plus ``hit``: the place of the first listed key, or -1,
        and ``verdict`` of it."""
        rows = rows.withColumn("hit", F.lit(-1)).withColumn("verdict", F.lit(None).cast("string"))
        groups = _groups(self.filters, self.limit)
        for k, group in enumerate(groups):
            sent, shards = _send(self.filters, group), self.shards

            def ask(batches, sent=sent, shards=shards):
                for batch in batches:
                    yield _best(batch, sent.value, shards)
            rows = rows.mapInArrow(ask, rows.schema)
            if k + 1 < len(groups):
                rows = materialize(rows, "url-pass")
        return rows


def _best(batch: pa.RecordBatch, table: dict, shards: dict) -> pa.RecordBatch:
    """The batch with the first listed keys of this pass, where they come before the known."""
    lists = batch.column("h1")
    size = lists.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(batch.num_rows), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    a, b = _u64(lists.flatten()), _u64(batch.column("h2").flatten())
    none = np.iinfo(np.int32).max
    hit = batch.column("hit").to_numpy().astype(np.int64)
    hit[hit < 0] = none
    verdict = np.array(batch.column("verdict").to_pylist(), object)
    for v, at, ok in _ask(table, a, b, shards, members):
        here = np.full(batch.num_rows, none, np.int64)
        np.minimum.at(here, row[at[ok]], place[at[ok]])
        better = here < hit
        hit[better], verdict[better] = here[better], v
    hit[hit == none] = -1
    out = dict(zip(batch.schema.names, batch.columns, strict=True))
    out["hit"], out["verdict"] = pa.array(hit.astype(np.int32)), pa.array(verdict, pa.string())
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          limit: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(<id_col>, host, path, rule, verdict) of every row; ``rules``: host, path, verdict."""
    listed = materialize(rule_keys(rules), "url-listed")
    labels = listed.agg(F.max("labels")).first()[0] or 0
    widths = sorted(r[0] for r in listed.select("width").distinct().collect())
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not labels:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(ALLOW).alias("verdict"))
    rows = rows.withColumn("keys", possible_keys(F.col("host"), F.col("path"), labels, widths))
    one, two = (lambda k: _hashes(k)[0]), (lambda k: _hashes(k)[1])
    rows = rows.withColumn("h1", F.transform("keys", one)).withColumn("h2", F.transform("keys", two))
    keys = rows.select(F.inline(F.arrays_zip(F.col("h1").alias("h"), F.col("h2").alias("g"))))
    found = Cascades(listed, keys, limit, shard_keys).first_hits(rows)
    rule = F.when(F.col("hit") >= 0, F.element_at("keys", F.col("hit") + 1))
    return found.select(id_col, "host", "path", rule.alias("rule"),
                        F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, 'host/path') as a DataFrame."""
    rows = [(v, r[:(r + "/").index("/")], r[(r + "/").index("/"):]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")
