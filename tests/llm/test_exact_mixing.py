"""Exact de-duplication and source mixing."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.llm import exact, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


ROWS = [(1, "a b", "x"), (2, "a b", "y"), (3, None, None), (4, "", "x"), (5, "c", "x"), (5, "c", "x"),
        (None, "d", "y"), (None, "d", "y"), (7, "long " * 30000, "z"), (8, " \t\n", "z")]


def test_directory_doubles_until_buckets_fit():
    counts = np.array([50, 0, 3, 3, 1, 1, 1, 1])
    bucket, depth = exact.build_directory(counts, 6)
    load = np.bincount(bucket, weights=counts)
    assert bucket[0] != bucket[1] and depth[0] == 3          # one hash cannot be split further
    assert len(set(bucket[4:])) == 1 and depth[4] == 1       # four cells stay one bucket
    assert all(x <= 6 for b, x in enumerate(load) if b != bucket[0])


@pytest.mark.parametrize("capacity", [1, 4, 4096])
def test_exact_dedup_against_grouping(spark, capacity):
    got = exact.exact_dedup(docs(spark, ROWS).selectExpr("*", "1 AS h", "2 AS sha", "3 AS bucket"),
                            capacity=capacity).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda v: (v is None, v))):
            first = ids.count(i) == 1 or sorted(ids, key=lambda v: (v is None, v)).index(i) == n
            want[(i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want


def test_exact_dedup_of_nothing(spark):
    assert exact.exact_dedup(docs(spark, [])).count() == 0


def plan(rows, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing, as the rule is worded."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(size.values())
    while True:
        left = total - sum(target[s] for s in fixed)
        open_ = [s for s in names if s not in fixed]
        for s in open_:
            target[s] = left * w[s] / sum(w[x] for x in open_)
        over = [s for s in open_ if target[s] > cap * size[s]]
        if not over:
            return size, target
        for s in over:
            target[s] = cap * size[s]
            fixed.add(s)


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{min(i % 7, 4)}" if i % 11 else None) for i in range(300)]
    rows += [(1000, "only three words", "tiny"), (1001, None, "empty"), (1002, "x", "s0"), (1002, "x", "s0")]
    df = docs(spark, rows).selectExpr("*", "5 AS size", "6 AS key", "7 AS row_id")
    m = mixing.mix(df, block_words=16, blocks_per_shard=20)
    got = m.taken().collect()
    size, target = plan(rows)
    taken = defaultdict(int)
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    for r in got:
        s = source[(r["id"], r["size"])]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in size)

    # Shards partition every source's permuted blocks, and each shard has its share of all.
    blocks = defaultdict(list)
    per_shard = Counter()
    for r in m.shards.collect():
        blocks[r["sid"]].append((r["lo"], r["hi"]))
        per_shard[r["shard"]] += r["hi"] - r["lo"]
    for runs in blocks.values():
        runs.sort()
        assert runs[0][0] == 0 and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) > 4
    pieces = m.pieces.drop("row_id")
    again = mixing.mix(df, block_words=16, blocks_per_shard=20).pieces.drop("row_id")
    assert pieces.exceptAll(again).count() == 0 and again.exceptAll(pieces).count() == 0
    assert sum(r["w_to"] - r["w_from"] for r in pieces.collect()) == sum(taken.values())


def test_splitting_tree_draws_spread_like_an_urn(spark):
    q = spark.sql("SELECT array(1, 2) AS sids, array(400L, 1600L) AS q")
    halves = [r["q"][0] for seed in range(60) for r in
              mixing.splitting_tree(q, 1, seed).where("shard = 0").collect()]
    sd = (1000 * 0.2 * 0.8 * (1000 / 1999)) ** 0.5
    assert abs(np.mean(halves) - 200) < 4 * sd / 60 ** 0.5 and 0.6 * sd < np.std(halves) < 1.5 * sd


def test_splitting_tree_of_many_blocks_is_exact_and_cheap(spark):
    big = [0, 300_000_000, 7, 2_000_000_001, 1]
    q = spark.sql(f"SELECT array(1, 2, 3, 4, 5) AS sids, array({', '.join(f'{x}L' for x in big)}) AS q")
    leaves = [r["q"] for r in mixing.splitting_tree(q, 3, 5).collect()]
    assert len(leaves) == 8 and [sum(x) for x in zip(*leaves)] == big
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 1 and min(min(x) for x in leaves) >= 0
    assert len({x[3] for x in leaves}) > 4


@pytest.mark.parametrize("n", [1, 2, 3, 31, 33, 64, 256, 1000])
def test_block_permutation_is_one_to_one_and_keyed(spark, n):
    slots = spark.range(n).selectExpr("id AS slot", "2L AS sid", f"{n}L AS n")
    order = [[r[0] for r in slots.orderBy("slot").select(F.expr(mixing.permuted("slot", "n", seed))).collect()]
             for seed in (0, 1)]
    assert all(sorted(x) == list(range(n)) for x in order)
    if n >= 31:                       # neither the identity, a rotation nor a stride
        steps = [Counter((b - a) % n for a, b in zip(x, x[1:])) for x in order]
        assert order[0] != order[1] and all(max(c.values()) <= n / 4 for c in steps)


def test_blocks_of_a_shard_come_from_all_of_a_source(spark):
    m = mixing.mix(docs(spark, [(i, "w " * 16, "s") for i in range(512)]), block_words=16, blocks_per_shard=64)
    shards = defaultdict(list)
    for r in m.pieces.join(m.base.select("row_id", "key"), "row_id").collect():
        shards[r["shard"]].append(r["key"])
    assert len(shards) == 8
    cut = sorted(k for x in shards.values() for k in x)[256]
    assert all(10 <= sum(k < cut for k in x) <= 54 for x in shards.values())


def test_take_documents_keeps_columns_and_whole_rows(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(200)]
    df = docs(spark, rows).selectExpr("*", "doc_id AS mix_row", "1 AS times")
    got = mixing.take_documents(df, block_words=16)
    assert got.columns == df.columns
    assert max(Counter(r["doc_id"] for r in got.collect()).values()) <= 3
    assert got.distinct().exceptAll(df.distinct()).count() == 0
    size, target = plan(rows)
    taken = defaultdict(int)
    for r in got.collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - target[s]) <= 5 for s in size)


def test_mix_of_nothing(spark):
    m = mixing.mix(docs(spark, []))
    assert m.taken().count() == 0 and m.pieces.count() == 0
    assert mixing.take_documents(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "a"), (2, " ", None)])).taken().count() == 2
