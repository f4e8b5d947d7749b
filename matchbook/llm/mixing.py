"""Mixing sources to target weights, DataFrame operations only.

Targets.  Sources in code point order, null last, weigh 1, 2, 3, repeating, and share
the total size; a target stops at ``max_repeat`` times its source's size and the
excess is shared again by weight.  That is solved in closed form: with sources sorted
by cap / weight, the capped ones are a prefix.

Quotas.  A source's documents, in the order of a hash, form one stream of words, which
the mix repeats up to its target; the stream is cut into blocks of ``block_words``
words and the block quota of a source is exact.

Splitting tree.  The vector of block quotas is split in halves, level by level, until
each output shard has its quotas.  The left half's counts are a draw from the
multivariate hypergeometric distribution (conditionals drawn source by source by
inversion of a hashed uniform), so shards are random and still sum to the quotas.

Blocks.  Block numbers of a source are permuted by a keyed shuffle; a shard takes the next
run of permuted numbers, so shards are disjoint.  Inside a shard rows are ordered by a hash.

Positions in a stream are distributed prefix sums: documents are binned by hash (about
``rows_per_bin`` in each), bins are summed first, so no task sorts a whole source.

Cases: null text and texts without words have size 0 and are never taken; a null
source is a source of its own; identical rows are separate documents; an empty table
gives empty results; extra columns are ignored.  All draws are hashes of ``seed``, so
reruns agree.  A draw takes steps in the order of the square root of a source's blocks.
Texts of any length are counted whole, and cut at block ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
ROUNDS = 64              # of the permutation of a source's blocks


@dataclass
class Mix:
    base: DataFrame       # row_id, id, source, sid, size, source_size, target, quota
    pieces: DataFrame     # row_id, id, epoch, w_from, w_to, shard, pos
    shards: DataFrame     # shard, sid, lo, hi: permuted blocks of each source

    def taken(self) -> DataFrame:
        """Per input row: id, size, source_size, target and the words taken."""
        t = self.pieces.groupBy("row_id").agg(F.sum(F.expr("w_to - w_from")).alias("taken"))
        return (self.base.join(t, "row_id", "left")
                .select("row_id", "id", "size", "source_size", "target",
                        F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def source_targets(base: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sid, source, source_size, n_rows, target of every source (a table of sources:
    its windows run over one row per source)."""
    s = (base.groupBy("source")
         .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (s.withColumn("w", weight.cast("double"))
         .withColumn("cap", (F.col("source_size") * max_repeat).cast("double")))
    up = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = (s.withColumn("level", (F.sum("source_size").over(everything)
                                - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                      / F.sum("w").over(rest))
         .withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
         .withColumn("rank", F.row_number().over(up)))
    level = F.expr("min_by(if(open, level, NULL), if(open, rank, NULL))").over(everything)
    return (s.withColumn("top", level)
            .select("sid", "source", "source_size", "n_rows",
                    F.coalesce(F.least("cap", F.col("w") * F.col("top")), F.col("cap"))
                    .alias("target")))


def _hypergeometric(uniform: str) -> str:
    """SQL: the count of ``K`` good ones among ``s.take`` drawn from ``s.rest``, by inversion.

    The weights of all counts within ten standard deviations and 20 of the mode follow from
    each other by their ratio, so a draw takes steps in the order of the square root of
    ``K``; what lies further out weighs less than 1E-20."""
    share = "(cast(K AS double) / greatest(s.rest, 1L))"
    reach = (f"10 * sqrt(s.take * {share} * (1 - {share}) * (s.rest - s.take)"
             " / greatest(s.rest - 1, 1L)) + 20")
    mode = "(s.take + 1.0D) * (K + 1.0D) / (s.rest + 2.0D)"
    ratio = ("(cast(K - x AS double) * cast(s.take - x AS double)"
             " / (cast(x + 1 AS double) * cast(s.rest - K - s.take + x + 1 AS double)))")
    walk = f"""aggregate(v.xs, named_struct('w', 1.0D, 'sum', 0.0D, 'x', v.xs[0]),
        (t, x) -> named_struct('w', t.w * {ratio}, 'sum', t.sum + t.w,
                               'x', if(t.sum < %s, x, t.x)), t -> t.%s)"""
    total = walk % ("0.0D", "sum")
    counts = f"""sequence(greatest(0L, s.take - (s.rest - K), cast(floor({mode} - ({reach})) AS bigint)),
                          least(s.take, K, cast(ceil({mode} + {reach}) AS bigint)))"""
    chosen = walk % (f"{uniform} * v.total", "x")
    return f"""transform(transform(array(named_struct('xs', {counts})),
        v -> named_struct('xs', v.xs, 'total', {total})), v -> {chosen})[0]"""


def _draw(seed: int) -> str:
    """SQL: quotas array ``q`` -> array of the left and the right child's quotas."""
    total = "aggregate(q, 0L, (a, x) -> a + x)"
    uniform = f"(shiftrightunsigned(xxhash64({seed}, node, s.i), 11) / 9007199254740992.0D)"
    step = f"""transform(array({_hypergeometric(uniform)}), x -> named_struct(
        'i', s.i + 1, 'rest', s.rest - K, 'take', s.take - x,
        'l', concat(s.l, array(x)), 'r', concat(s.r, array(K - x))))[0]"""
    return f"""aggregate(q,
        named_struct('i', 0L, 'rest', {total}, 'take', {total} div 2,
                     'l', cast(array() AS array<bigint>), 'r', cast(array() AS array<bigint>)),
        (s, K) -> {step},
        s -> array(s.l, s.r))"""


def permuted(slot: str, n: str, seed: int) -> str:
    """SQL: ``slot`` of 0 to ``n`` - 1 under a permutation keyed by ``seed`` and ``sid``.

    A swap-or-not shuffle: each round pairs a number with its mirror image at a hashed
    point, and a hash of the larger one says whether the two change places.  It is one to
    one for any ``n`` and needs no sort of a source's blocks."""
    mirror = f"pmod(pmod(xxhash64({seed}, sid, r), {n}) - x, {n})"
    return f"""aggregate(sequence(1, {ROUNDS}), {slot}, (x, r) -> if(
        (xxhash64({seed}, sid, r, greatest(x, {mirror})) & 1024) = 0, x, {mirror}))"""


def splitting_tree(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """shard, sids, q of the 2**levels leaves; ``quotas`` is one row with the source
    numbers ``sids`` and their block quotas ``q``."""
    tree = quotas.select(F.lit(1).cast("long").alias("node"), "sids", "q")
    for _ in range(levels):
        tree = (tree.select("node", "sids", F.expr(_draw(seed)).alias("halves"))
                .select("node", "sids", F.posexplode("halves").alias("side", "q"))
                .select((F.col("node") * 2 + F.col("side")).alias("node"), "sids", "q"))
    return tree.select((F.col("node") - (1 << levels)).alias("shard"), "sids", "q")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, max_repeat: int = MAX_REPEAT,
        block_words: int = 4096, blocks_per_shard: int = 256, rows_per_bin: int = 1024,
        whole_documents: bool = False, seed: int = 0, row_col: str | None = None) -> Mix:
    """Plan the mix of ``docs``.  With ``whole_documents`` the last document of a source,
    which the target cuts, is taken whole or not at all, whichever is nearer.  ``row_col``
    names a unique BIGINT column to use as row_id."""
    text, source = F.col(text_col), F.col(source_col).cast("string")
    name = F.concat_ws("|", F.lit("mix"), F.lit(str(seed)),
                       F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                       F.coalesce(source, F.lit("")),
                       F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    rows = materialize(
        docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id())
                    .alias("row_id"),
                    F.col(id_col).cast("long").alias("id"), source.alias("source"),
                    F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
                    .alias("size"),
                    F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
                    .alias("key")), "mix-rows")
    targets = source_targets(rows, weights, max_repeat)
    s = targets.alias("s")
    bins = F.greatest(F.lit(1), F.ceil(F.col("s.n_rows") / rows_per_bin))
    base = materialize(
        rows.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("r.row_id", "r.id", "r.source", "s.sid", "r.size", "s.source_size", "s.target",
                F.round("s.target").cast("long").alias("quota"), "r.key",
                F.shiftright(F.shiftright("r.key", 29) * bins, 31).alias("bin")), "mix-base")

    # Distributed prefix sums: first over bins, then inside a bin.
    earlier = (Window.unboundedPreceding, -1)
    by_bin = (base.groupBy("sid", "bin").agg(F.sum("size").alias("n"))
              .withColumn("bin_start", F.coalesce(F.sum("n").over(
                  Window.partitionBy("sid").orderBy("bin").rowsBetween(*earlier)), F.lit(0)))
              .drop("n"))
    inner = (Window.partitionBy("sid", "bin").orderBy("key", "id", "size", "row_id")
             .rowsBetween(*earlier))
    placed = (base.where("size > 0")
              .withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0)))
              .join(by_bin, ["sid", "bin"]).withColumn("at", F.col("at") + F.col("bin_start")))

    # Every epoch of a document is an interval of its source's repeated stream.
    copies = (placed.withColumn("epoch", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.expr("quota div source_size"))))
              .withColumn("a", F.expr("epoch * source_size + at"))
              .withColumn("b", F.expr("least(a + size, quota)")))
    if whole_documents:
        copies = copies.withColumn("b", F.expr("if(2 * (b - a) >= size, a + size, a)"))
    copies = copies.where("b > a")
    cut = materialize(
        copies.withColumn("block", F.explode(F.expr(
            f"sequence(a div {block_words}, (b - 1) div {block_words})")))
        .select("row_id", "id", "sid", "epoch", "block",
                F.expr(f"greatest(a, block * {block_words}) - a").alias("w_from"),
                F.expr(f"least(b, (block + 1) * {block_words}) - a").alias("w_to")), "mix-blocks")

    # Block quotas by source and their split over shards (both without texts).
    quotas = cut.groupBy("sid").agg((F.max("block") + 1).alias("blocks"))
    reach = materialize(quotas, "mix-quotas")
    n_blocks = reach.agg(F.sum("blocks")).first()[0] or 0
    levels = max(0, (-(-n_blocks // blocks_per_shard) - 1).bit_length())
    root = (reach.groupBy().agg(F.expr("array_sort(collect_list(struct(sid, blocks)))").alias("s"))
            .selectExpr("transform(s, x -> x.sid) AS sids", "transform(s, x -> x.blocks) AS q"))
    leaves = (splitting_tree(root, levels, seed)
              .select("shard", F.expr("inline(arrays_zip(sids, q))"))
              .toDF("shard", "sid", "n").where("n > 0"))
    run = Window.partitionBy("sid").orderBy("shard")
    shards = materialize(
        leaves.withColumn("hi", F.sum("n").over(run))
        .select("shard", "sid", (F.col("hi") - F.col("n")).alias("lo"), "hi"), "mix-shards")

    slots = (shards.select("shard", "sid", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("slot"))
             .join(reach, "sid")
             .select("shard", "sid", F.expr(permuted("slot", "blocks", seed)).alias("block")))
    local = Window.partitionBy("shard").orderBy(
        F.xxhash64(F.lit(seed), "shard", "id", "epoch", "block"), "row_id", "epoch", "w_from")
    pieces = (cut.join(slots, ["sid", "block"])
              .withColumn("pos", F.row_number().over(local))
              .select("row_id", "id", "epoch", "w_from", "w_to", "shard", "pos"))
    return Mix(base, pieces, shards)


def take_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each repeated as often
    as the mix takes it (0 to ``max_repeat`` times), whole documents only."""
    row = "mix_row"
    while row in docs.columns:
        row += "_"
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    plan = mix(kept, id_col, text_col, source_col, whole_documents=True, row_col=row, **options)
    times = row + "_times"
    wanted = (plan.taken().where("taken > 0")
              .select(F.col("row_id").alias(row), F.expr("taken div size").alias(times)))
    return (kept.join(wanted, row)
            .withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
