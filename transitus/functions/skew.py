"""Ordered and interval operations that stay split when one key holds a large share of all rows.

A key with at least `min_rows` rows is *hot*. All hot keys are listed in a written table, which is broadcast up to
`MAX_HOT_KEYS` rows and joined by a shuffle beyond. Rows of hot keys get a `_block`: an order-preserving cut of the
key (a day, say) and, where even one cut holds `min_rows` rows, a run of at most `min_rows` of its rows in order.
Rows of other keys have a null block. Every step then works on (key, block), and what crosses a block border is
added from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitus.session import stage

HOT_ROWS = 1_000_000
# A key with more intervals than this on the probing side is hot in an interval join: pairs grow with both sides.
HOT_STAYS = 100
MAX_HOT_KEYS = 10_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with at least `min_rows` rows, as a written table with `_hot`."""
    return _listed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows), keys)


def _listed(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted once: the list itself stays distributed, and only a short one is broadcast."""
    listed = stage(counts.select(*keys, F.lit(True).alias("_hot")), "hot-keys")
    return F.broadcast(listed) if listed.count() <= MAX_HOT_KEYS else listed


def in_order(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows dealt over partitions by range of `order_by` and written with `_part` and their position `_at` (from 0) in it.

    `order_by` must be unique. Whatever its types, rows that share all but the last column still part where they must;
    nothing is ordered within one task beyond a range. The table is written, so that positions cannot change when a
    lost task is run again.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order_by]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order_by]
    )
    # the upper bits of the id are the partition, the lower 33 the position in it
    number = F.monotonically_increasing_id()
    return stage(
        dealt.withColumn("_id", number).withColumns(
            {"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}
        ).drop("_id"),
        "in-order",
    )


def with_blocks(
    df: DataFrame, keys: Sequence[str], block: Column, order_by: Sequence[str], min_rows: int = HOT_ROWS
) -> DataFrame:
    """Add `_block`, a struct<cut, run> that does not decrease along `order_by`; null for keys that are not hot.

    `block` must not decrease along `order_by`, and `order_by` must be unique within the key.
    """
    cut = df.join(hot_keys(df, keys, min_rows), list(keys), "left").withColumn("_cut", F.when(F.col("_hot"), block))
    full = hot_keys(cut.filter("_hot"), [*keys, "_cut"], min_rows)
    if full.isEmpty():
        whole, runs = cut, None
    else:
        whole = cut.join(full.drop("_hot"), [*keys, "_cut"], "left_anti")
        runs = in_order(cut.join(full.drop("_hot"), [*keys, "_cut"], "left_semi"), [*keys, "_cut", *order_by])
        runs = runs.withColumn("_run", F.shiftleft(F.col("_part").cast("bigint"), 33) + F.floor(F.col("_at") / min_rows))
    blocked = whole.withColumn("_run", F.lit(0).cast("bigint"))
    if runs is not None:
        blocked = blocked.unionByName(runs.drop("_part", "_at"))
    return blocked.withColumn("_block", F.when(F.col("_hot"), F.struct("_cut", "_run"))).drop("_hot", "_cut", "_run")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    block: Column,
    columns: Sequence[str],
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add structs `_prev` and `_next` with `columns` of the row before and after, per key.

    `block` must not decrease along `order_by`, and `order_by` must be unique within the key.
    """
    blocked = with_blocks(df, keys, block, order_by, min_rows)
    payload, order = F.struct(*columns), F.struct(*order_by)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order_by)
    outer = Window.partitionBy(*keys).orderBy("_block")
    edges = (
        blocked.filter(F.col("_block").isNotNull())
        .groupBy(*keys, "_block")
        .agg(F.max_by(payload, order).alias("_last"), F.min_by(payload, order).alias("_first"))
        .select(
            *keys,
            "_block",
            F.lag("_last").over(outer).alias("_edge_prev"),
            F.lead("_first").over(outer).alias("_edge_next"),
        )
    )
    return (
        blocked.withColumn("_prev", F.lag(payload).over(inner))
        .withColumn("_next", F.lead(payload).over(inner))
        .join(edges, [*keys, "_block"], "left")
        .withColumn("_prev", F.coalesce("_prev", "_edge_prev"))
        .withColumn("_next", F.coalesce("_next", "_edge_next"))
        .drop("_block", "_edge_prev", "_edge_next")
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    block: Column,
    sums: dict[str, Column],
    min_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add, per key, the sum of each measure over the rows strictly before this one (0 at the first).

    With `min_rows=None` all keys are cut into blocks; that saves the search for hot keys where `df` is costly
    to read twice.
    """
    if min_rows is None:
        measured = df.withColumn("_block", block)
    else:
        measured = with_blocks(df, keys, block, order_by, min_rows)
    return _block_sums(measured, keys, order_by, sums)


def _block_sums(blocked: DataFrame, keys: Sequence[str], order_by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    measured = blocked.withColumns({f"_m_{name}": measure for name, measure in sums.items()})
    inner = Window.partitionBy(*keys, "_block").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        measured.filter(F.col("_block").isNotNull())
        .groupBy(*keys, "_block")
        .agg(*[F.sum(f"_m_{name}").alias(f"_t_{name}") for name in sums])
        .select(*keys, "_block", *[F.sum(f"_t_{name}").over(outer).alias(f"_o_{name}") for name in sums])
    )
    return (
        measured.withColumns({name: F.sum(f"_m_{name}").over(inner) for name in sums})
        .join(offsets, [*keys, "_block"], "left")
        .withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums})
        .drop("_block", *[f"_m_{n}" for n in sums], *[f"_o_{n}" for n in sums])
    )


def dense_ids(df: DataFrame, at: str, tie: str, name: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """Number rows 1..n by (`at`, `tie`) without a window over the whole table; rows without `at` are left out.

    Rows are dealt over partitions by range, whatever the type of the id and however many rows a day or an instant
    holds; a row's number is its position plus the rows of earlier partitions. Offsets are one row per partition, so
    they may be broadcast. (`at`, `tie`) must be unique. `min_rows` is kept for callers and has no bearing.
    """
    placed = in_order(df.filter(F.col(at).isNotNull()), [at, tie])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    return (
        placed.join(F.broadcast(shift), "_part")
        .withColumn(name, (F.col("_at") + F.col("_shift") + 1).cast("bigint"))
        .drop("_part", "_at", "_shift")
    )


def interval_join(
    stays: DataFrame,
    facts: DataFrame,
    key: str,
    lo: str,
    hi: str,
    start: str,
    stop: str,
    min_rows: int = HOT_STAYS,
) -> DataFrame:
    """Inner join on `key` where [lo, hi] meets [start, stop]; a null `stop` means still valid.

    A key is hot by its number of stays. Rows of hot keys are spread over the months they touch and matched on (key, month) in the first month both
    touch, so each pair comes out once. Other keys use the plain key join with the range as residual; there a
    fact meets few stays, and a key with very many facts is split by the adaptive skew join.
    """
    stays = stays.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi)))
    hot = hot_keys(stays.filter(F.col(key).isNotNull()), [key], min_rows)
    met = (F.col(start) <= F.col(hi)) & (F.col(stop).isNull() | (F.col(stop) >= F.col(lo)))
    if hot.isEmpty():
        return stays.join(facts.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & met).drop("_key")
    horizon = stays.join(hot, key).groupBy(key).agg(F.max(hi).alias("_horizon"))

    def month(c: str) -> Column:
        return F.trunc(F.col(c), "month")

    def months(a: Column, b: Column) -> Column:
        return F.explode(
            F.when(F.col("_hot"), F.sequence(a, b, F.expr("interval 1 month"))).otherwise(
                F.array(F.lit(None).cast("date"))
            )
        )

    left = stays.join(hot, key, "left").withColumn("_month", months(month(lo), month(hi))).drop("_hot")
    # one row per hot key; the planner broadcasts it where it is small
    spread = facts.join(hot, key, "left").join(horizon, key, "left")
    spread = spread.filter(F.col("_hot").isNull() | (F.col(start) <= F.col("_horizon")))
    last = F.greatest(month(start), F.trunc(F.least(F.coalesce(F.col(stop), F.col("_horizon")), F.col("_horizon")), "month"))
    right = (
        spread.withColumn("_month", months(month(start), last))
        .drop("_hot", "_horizon")
        .withColumnRenamed(key, "_key")
        .withColumnRenamed("_month", "_fmonth")
    )
    return left.join(
        right,
        (F.col(key) == F.col("_key"))
        & F.col("_month").eqNullSafe(F.col("_fmonth"))
        & met
        & (F.col("_month").isNull() | (F.col("_month") == F.greatest(month(lo), month(start)))),
    ).drop("_key", "_month", "_fmonth")


def overlap_counts(
    stays: DataFrame,
    facts: dict[str, DataFrame] | tuple[DataFrame, dict[str, Column]],
    key: str,
    stay_id: str,
    lo: str,
    hi: str,
    start: str,
    stop: str,
    min_rows: int = HOT_STAYS,
) -> DataFrame:
    """Per stay, how many facts of its key meet [lo, hi], one column for each named sort of fact.

    `facts` is a table for each sort, or one table, read once, with the condition that makes a row one of a sort; a
    row may be of several. Stays of ordinary keys are joined and counted; stays of hot keys, if there are any, are
    counted without pairs by `_sweep_counts`. Stays without a usable interval or any fact are left out. `stay_id`
    must be unique.
    """
    wanted = stays.filter(F.col(lo) <= F.col(hi)).select(stay_id, key, lo, hi)
    hot = hot_keys(wanted, [key], min_rows)
    if isinstance(facts, dict):
        names, tagged = list(facts), None
        for n, table in facts.items():
            one = table.select(key, start, stop, *[F.lit(n == m).alias(f"_is_{m}") for m in names])
            tagged = one if tagged is None else tagged.unionByName(one)
    else:
        names = list(facts[1])
        tagged = facts[0].select(key, start, stop, *[F.coalesce(c, F.lit(False)).alias(f"_is_{n}") for n, c in facts[1].items()])
        tagged = tagged.filter(F.greatest(*[f"_is_{n}" for n in names], F.lit(False)))
    met = (F.col(start) <= F.col(hi)) & (F.col(stop).isNull() | (F.col(stop) >= F.col(lo)))
    swept = not hot.isEmpty()
    joined = (wanted.join(hot, key, "left_anti") if swept else wanted).join(tagged, key).filter(met).groupBy(stay_id).agg(
        *[F.count_if(f"_is_{n}").alias(n) for n in names]
    )
    if not swept:
        return joined
    crowded = stage(tagged.join(hot, key, "left_semi"), "hot-facts")
    return joined.unionByName(_sweep_counts(
        wanted.join(hot, key, "left_semi"), {n: crowded.filter(f"_is_{n}") for n in names}, key, stay_id, lo, hi, start, stop,
    ))


def _sweep_counts(
    wanted: DataFrame, facts: dict[str, DataFrame], key: str, stay_id: str, lo: str, hi: str, start: str, stop: str
) -> DataFrame:
    """Overlap counts without forming pairs.

    With start <= stop and lo <= hi the count is (facts started by hi) - (facts stopped before lo). Both are
    running counts over one ordered pass per key, in which equal instants are merged before the shuffle and a
    key is cut into months. A fact whose stop lies before its start, an error in the data, is counted by a join.
    """
    names = list(facts)
    sides = wanted.select(
        stay_id, key,
        F.inline(F.array(
            F.struct(F.col(lo).alias("_at"), F.lit(0).alias("_rank")),
            F.struct(F.col(hi).alias("_at"), F.lit(2).alias("_rank")),
        )),
    )
    zero = {f"_{side}_{n}": F.lit(0).cast("bigint") for n in names for side in ("open", "close")}
    inverted = F.coalesce(F.col(stop) < F.col(start), F.lit(False))
    # at one instant: a lower bound first, then starts and stops, then an upper bound
    line = sides.drop(stay_id).withColumns(zero)
    odd = None
    for n, table in facts.items():
        table = table.select(key, start, stop)
        turns = table.filter(~inverted & F.col(start).isNotNull()).select(
            key,
            F.inline(F.array(
                F.struct(F.col(start).alias("_at"), F.lit(1).alias("_rank"), F.lit(1).alias("_o"), F.lit(0).alias("_c")),
                F.struct(F.col(stop).alias("_at"), F.lit(1).alias("_rank"), F.lit(0).alias("_o"), F.lit(1).alias("_c")),
            )),
        ).filter(F.col("_at").isNotNull())
        line = line.unionByName(
            turns.withColumns({**zero, f"_open_{n}": F.col("_o").cast("bigint"), f"_close_{n}": F.col("_c").cast("bigint")})
            .drop("_o", "_c")
        )
        wrong = table.filter(inverted).select(key, start, stop, F.lit(n).alias("_kind"))
        odd = wrong if odd is None else odd.unionByName(wrong)
    line = line.groupBy(key, "_at", "_rank").agg(*[F.sum(c).alias(c) for c in zero])
    marks = running_sums(
        line, [key], ["_at", "_rank"], F.trunc("_at", "month"), {f"_sum{c}": F.col(c) for c in zero}, None
    ).filter(F.col("_rank") != 1)
    counted = sides.join(marks, [key, "_at", "_rank"]).select(
        stay_id,
        *[F.when(F.col("_rank") == 2, F.col(f"_sum_open_{n}")).otherwise(-F.col(f"_sum_close_{n}")).alias(n) for n in names],
    )
    repaired = wanted.join(odd, key).filter((F.col(start) <= F.col(hi)) & (F.col(stop) >= F.col(lo))).select(
        stay_id, *[F.when(F.col("_kind") == n, 1).otherwise(0).cast("bigint").alias(n) for n in names]
    )
    return (
        counted.unionByName(repaired).groupBy(stay_id).agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], width: float
) -> DataFrame:
    """Lower (discrete) quantiles per key, one row per key, without sorting a whole key in one task.

    Equal values are merged first; coarse bins of `width` find the bin with the wanted rank, and only the
    values of that bin are ordered.
    """
    merged = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.floor(F.col(value) / F.lit(width)))
    )
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranks = F.array(*[F.struct(F.lit(n).alias("q"), F.lit(p).alias("p")) for n, p in quantiles.items()])
    bins = (
        merged.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(upto))
        .withColumn("_all", F.sum("_bn").over(whole))
        .withColumn("_q", F.explode(ranks))
        .withColumn("_rank", F.greatest(F.ceil(F.col("_q.p") * F.col("_all")), F.lit(1)))
        .filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_bn")))
        .select(*keys, "_bin", F.col("_q.q").alias("_q"),
                (F.col("_rank") - (F.col("_upto") - F.col("_bn"))).alias("_rank"))
    )
    inbin = Window.partitionBy(*keys, "_bin", "_q").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        merged.join(bins, [*keys, "_bin"])
        .withColumn("_cum", F.sum("_n").over(inbin))
        .filter((F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("_n")))
    )
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == n, F.col(value))).alias(n) for n in quantiles]
    )


def salted_join(
    big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread_by: Sequence[str], salts: int = 64
) -> DataFrame:
    """Inner join in which the rows of hot keys of `big` are dealt over `salts` tasks.

    `hot` is a list such as `hot_keys` gives or a filter on known counts; `small` has few rows
    per key and is repeated `salts` times for hot keys only.
    """
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, key, "left").withColumn("_salt", dealt.cast("int")).drop("_hot")
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def heaviest(counts: DataFrame, key: str, count: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """`hot_keys` from a table that already holds the counts."""
    return _listed(counts.filter(F.col(count) >= min_rows), [key])
