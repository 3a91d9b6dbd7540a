"""Operators along time: as-of joins, islands, session lags, decayed windows, horizons.

All are window expressions over (entity, session) rows, so Catalyst shuffles once by entity. Sessions are
integers; a frame in sessions is a range frame, so gaps in an entity's sessions do not stretch it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.store import stored


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """Each left row with the values of the last right row at or before it (first at or after: forward).

    One shuffle: both sides are stacked, sorted by key and time, and the right values carried along; there is
    no range join and no pair of rows. strict leaves out equal times. Among right rows of one time the one
    with the largest values counts. Left rows keep their multiplicity; unmatched values are null.
    """
    packed = F.struct(F.col(right_on).alias("_t"), *values)
    keys = [F.col(k) for k in by]
    at_once = right.groupBy(*keys, F.col(right_on).alias("_at")).agg(F.max(packed).alias("_v"))
    # At equal times right rows go first unless strict; seen backwards (forward) the order turns around.
    first, second = (1, 0) if strict != forward else (0, 1)
    stacked = left.withColumns({"_at": F.col(left_on), "_side": F.lit(second), "_v": F.lit(None).cast(at_once.schema["_v"].dataType), "_left": F.lit(True)}).unionByName(
        at_once.withColumns({"_side": F.lit(first), "_left": F.lit(False)}), allowMissingColumns=True
    )
    order = Window.partitionBy(*by).orderBy("_at", "_side")
    if forward:
        carried = F.first("_v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    else:
        carried = F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = stacked.withColumn("_v", carried).filter("_left")
    return found.select(*left.columns, F.col("_v._t").alias(f"{right_on}_asof"), *(F.col(f"_v.{v}").alias(v) for v in values))


def islands(df: DataFrame, by: str, session: str, name: str = "run") -> DataFrame:
    """Numbers the runs of consecutive sessions of each entity from 1."""
    w = Window.partitionBy(by).orderBy(session)
    new = F.coalesce((F.col(session) - F.lag(session).over(w) != 1).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def session_frame(by: str, session: str, first: int, last: int):
    """Rows of the entity whose session lies in [s + first, s + last]."""
    return Window.partitionBy(by).orderBy(session).rangeBetween(first, last)


def decay(session: str, half_life: float, by: str) -> Column:
    """Weight that doubles every half life, 1 in the middle of the entity's sessions, so that it stays in range for 2,000 half lives.

    Ratios of sums weighted by it are exponentially weighted moments.
    """
    whole = Window.partitionBy(by)
    middle = (F.min(session).over(whole) + F.max(session).over(whole)) / 2
    return F.pow(F.lit(2.0), (F.col(session) - middle) / F.lit(float(half_life)))


def ewma_moments(df: DataFrame, by: str, session: str, x: str, window: int, half_life: float, least: int) -> DataFrame:
    """ewma_mean and ewma_std of x over the last ``window`` sessions, null under ``least`` observations."""
    w = session_frame(by, session, 1 - window, 0)
    df = df.withColumn("_k", F.when(F.col(x).isNotNull(), decay(session, half_life, by)))
    k = F.col("_k")
    n, k0 = F.count(x).over(w), F.sum(k).over(w)
    mean = F.sum(k * F.col(x)).over(w) / k0
    second = F.sum(k * F.col(x) * F.col(x)).over(w) / k0
    return df.withColumns({"ewma_mean": F.when(n >= least, mean), "ewma_std": F.when(n >= least, F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))))}).drop("_k")


def ewma_beta(df: DataFrame, by: str, session: str, x: str, market: str, window: int, half_life: float, least: int) -> DataFrame:
    """beta and sigma of x on market over decayed windows; rows without either are left out of the sums."""
    w = session_frame(by, session, 1 - window, 0)
    both = F.col(x).isNotNull() & F.col(market).isNotNull()
    df = df.withColumn("_k", F.when(both, decay(session, half_life, by)))
    k = F.col("_k")
    s = lambda c: F.sum(k * c).over(w) / F.sum(k).over(w)
    xm, ym = s(F.col(market)), s(F.col(x))
    var, cov, vary = s(F.col(market) * F.col(market)) - xm * xm, s(F.col(x) * F.col(market)) - xm * ym, s(F.col(x) * F.col(x)) - ym * ym
    enough = F.count(F.when(both, 1)).over(w) >= least
    out = df.withColumns({"_var": var, "_cov": cov, "_vary": vary, "_ok": enough & (var > 0)})
    beta = F.when(F.col("_ok"), F.try_divide("_cov", "_var"))
    return out.withColumns({"beta": beta, "sigma": F.when(F.col("_ok"), F.sqrt(F.greatest(F.col("_vary") - beta * F.col("_cov"), F.lit(0.0))))}).drop("_k", "_var", "_cov", "_vary", "_ok")


#: Half lives in a block of a scan: weights in it stay far within a double's range.
BLOCK_LIVES = 500


def decayed_sums(df: DataFrame, by: Sequence[str], position: str, terms: dict[str, Column], half_life: float, strict: bool = False) -> DataFrame:
    """df with, for each term, its sum over the key's rows up to this one, each halved for every half life of positions between.

    A scan in blocks of positions, so that calendars of any length stay in range: sums inside a block by powers
    relative to its start, what blocks leave at their ends folded along the key's blocks (one for every 500 half lives), and that
    carried into the rows. strict leaves out rows of this position. Positions are numbers and not null; null terms count as 0.
    """
    span = max(1, int(BLOCK_LIVES * half_life))
    keep = lambda n: F.pow(F.lit(0.5), n.cast("double") / F.lit(float(half_life)))
    names = list(terms)
    x = df.withColumns({"_block": F.floor(F.col(position) / span), **{f"_t{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in enumerate(terms.values())}})
    x = x.withColumn("_in", F.col(position) - F.col("_block") * span)
    order = Window.partitionBy(*by, "_block").orderBy(position).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    grow = keep(-F.col("_in"))
    x = x.withColumns({f"_s{k}": F.coalesce(F.sum(F.col(f"_t{k}") * grow).over(order), F.lit(0.0)) * keep(F.col("_in")) for k in range(len(names))})
    left = x.groupBy(*by, "_block").agg(*(F.sum(F.col(f"_t{k}") * keep(span - F.col("_in"))).alias(f"_e{k}") for k in range(len(names))))
    ends = [F.col(f"b._e{k}") for k in range(len(names))]
    blocks = left.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", *(f"_e{k}" for k in range(len(names)))))).alias("all"))
    zero = [F.lit(0.0).alias(f"_e{k}") for k in range(len(names))]
    carried = F.array().cast(f"array<struct<_block: bigint, {', '.join(f'_c{k}: double' for k in range(len(names)))}>>")
    start = F.struct(carried.alias("out"), F.lit(None).cast("bigint").alias("last"), F.struct(*zero).alias("state"))

    def step(a: Column, b: Column) -> Column:
        # The state is what is left at the end of the last block; between its end and this block's start whole blocks may lie.
        gap = F.coalesce((b["_block"] - a["last"] - 1) * span, F.lit(0))
        now = [a["state"][f"_e{k}"] * keep(gap) for k in range(len(names))]
        out = F.concat(a["out"], F.array(F.struct(b["_block"].alias("_block"), *(c.alias(f"_c{k}") for k, c in enumerate(now)))))
        after = F.struct(*((c * keep(F.lit(span)) + b[f"_e{k}"]).alias(f"_e{k}") for k, c in enumerate(now)))
        return F.struct(out.alias("out"), b["_block"].alias("last"), after.alias("state"))

    carry = blocks.select(*by, F.explode(F.aggregate("all", start, step)["out"]).alias("b")).select(*by, "b.*")
    x = x.join(carry, [*by, "_block"])
    return x.select(*df.columns, *((F.col(f"_s{k}") + F.col(f"_c{k}") * keep(F.col("_in"))).alias(n) for k, n in enumerate(names)))


def ewma_state(df: DataFrame, by: str, session: str, x: str, half_life: float, name: str = "state") -> DataFrame:
    """The recursion s = a x + (1 - a) s over the rows of each entity, seeded by its first row, at any length.

    Unrolled, s_n = sum over i <= n of w_i (1 - a)^(n - i) with w_1 = x_1 and w_i = a x_i after.
    """
    keep = 0.5 ** (1 / half_life)
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(session)))
    weighted = F.when(F.col("_n") == 1, F.col(x)).otherwise(F.lit(1 - keep) * F.col(x))
    return decayed_sums(rows, [by], "_n", {name: weighted}, half_life).drop("_n")


def horizon_sum(by: str, session: str, x: str, h: int) -> Column:
    """Sum of the next h sessions, where all are observed."""
    w = session_frame(by, session, 1, h)
    return F.when(F.count(x).over(w) == h, F.sum(x).over(w))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], n: Column, upto: str, total: str) -> DataFrame:
    """df with the sum of n over the key's rows up to this one in order, and over all of them; keys are not null.

    Rows are sorted in ranges over all keys, so a key may span many partitions; rows alike in keys and order are told apart by
    their place, so they may too. A partition sums its own rows of a key and adds the sums of the partitions before, of which
    there is one for each partition and key.
    """
    salted = df.withColumns({"_salt": F.monotonically_increasing_id(), "_add": n})
    dealt = stored(salted.repartitionByRange(*by, *order, "_salt").withColumn("_part", F.spark_partition_id()), "ranked")
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_add").alias("_of"))
    key = Window.partitionBy(*by)
    earlier = F.sum("_of").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_part", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_of").over(key).alias(total))
    own = F.sum("_add").over(Window.partitionBy(*by, "_part").orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(sums, [*by, "_part"]).withColumn(upto, own + F.col("_before")).drop("_part", "_before", "_salt", "_add")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """df with the rank of each row in its key (from 1) and the key's number of rows; rows that tie get different ranks."""
    return running(df, by, order, F.lit(1), rank, size)


def equal_groups(df: DataFrame, by: Sequence[str], x: str, tie: str, k: int, name: str = "group") -> DataFrame:
    """floor(rank * k / n): groups by rank whose sizes differ by one at most, remainders spread out."""
    found = ranked(df, by, [x, tie], "_rank", "_size")
    return found.withColumn(name, F.floor((F.col("_rank") - 1) * k / F.col("_size")).cast("int")).drop("_rank", "_size")
