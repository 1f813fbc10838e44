"""Running values over the rows of a key in an order, where one key may hold any share of the rows.

``Window.partitionBy(key)`` puts a key into one task.  Here rows are dealt by ranges of
(key, order), so a key with many rows spans several ranges; a window runs inside each
range, and what the ranges before it hold of the same key is carried over.  Only the
first and the last key of a range can reach beyond it, so at most two rows for each
range are carried, whatever the input: that is the bound of the broadcasts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.plans.scratch import materialize

_RANGE = "_range"


def _same(keys: list[str], of: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{of}.{k}")) for k in keys])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    xors: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    label: str = "ranges",
) -> DataFrame:
    """``df`` with running values by ``keys`` in ascending ``order``, nulls first.

    ``sums`` and ``xors`` go up to the row itself, ``previous`` and ``following`` are the
    values of the rows before and after (null at the ends), ``latest`` is the last value up to
    the row that is not null, ``totals`` are sums over the whole key.  Null keys are one key;
    null values count as 0, and as null in ``previous`` and ``following``.  Rows that agree in
    keys and order stay in one range and are taken in any order.  An empty table stays
    empty.  The names ``_range`` and ``_carried`` must be free.
    """
    sums, xors, totals = sums or {}, xors or {}, totals or {}
    previous, following, latest = previous or {}, following or {}, latest or {}
    place = F.struct(*order)
    dealt = materialize(df.repartitionByRange(*keys, *order).withColumn(_RANGE, F.spark_partition_id()), label)
    # What the keys at both ends of each range hold in it.
    ends = dealt.groupBy(_RANGE).agg(F.min(F.struct(*keys)).alias("_low"), F.max(F.struct(*keys)).alias("_high"))
    reaching = dealt.join(F.broadcast(ends), _RANGE).where(_same(keys, "_low") | _same(keys, "_high"))
    held = reaching.groupBy(_RANGE, *keys).agg(
        F.lit(True).alias("_held"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.bit_xor(c).alias(f"_xor_{n}") for n, c in xors.items()],
        *[F.max_by(F.struct(c.alias("value")), place).alias(f"_last_{n}") for n, c in previous.items()],
        *[F.min_by(F.struct(c.alias("value")), place).alias(f"_first_{n}") for n, c in following.items()],
        *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_known_{n}") for n, c in latest.items()],
        *[F.sum(c).alias(f"_all_{n}") for n, c in totals.items()],
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(_RANGE).rowsBetween(1, Window.unboundedFollowing)
    carried = held.select(
        F.struct(F.col(_RANGE).alias("range"), *keys).alias("_carried"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_sum_{n}") for n in sums],
        *[F.bit_xor(f"_xor_{n}").over(before).alias(f"_xor_{n}") for n in xors],
        *[F.last(f"_last_{n}").over(before).alias(f"_last_{n}") for n in previous],
        *[F.first(f"_first_{n}").over(after).alias(f"_first_{n}") for n in following],
        *[F.last(f"_known_{n}", ignorenulls=True).over(before).alias(f"_known_{n}") for n in latest],
        *[F.sum(f"_all_{n}").over(whole).alias(f"_all_{n}") for n in totals],
    )
    own = Window.partitionBy(_RANGE, *keys)
    ordered = own.orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0)
    rows = dealt.join(F.broadcast(carried), (F.col(_RANGE) == F.col("_carried.range")) & _same(keys, "_carried"), "left")
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.coalesce(F.sum(c).over(upto), none) + F.coalesce(f"_sum_{n}", none)).alias(n) for n, c in sums.items()],
        *[F.coalesce(F.bit_xor(c).over(upto), none).bitwiseXOR(F.coalesce(f"_xor_{n}", none)).alias(n) for n, c in xors.items()],
        *[F.coalesce(F.lag(F.struct(c.alias("value"))).over(ordered), F.col(f"_last_{n}"))["value"].alias(n) for n, c in previous.items()],
        *[F.coalesce(F.lead(F.struct(c.alias("value"))).over(ordered), F.col(f"_first_{n}"))["value"].alias(n) for n, c in following.items()],
        *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_known_{n}")).alias(n) for n, c in latest.items()],
        *[F.coalesce(F.col(f"_all_{n}"), F.sum(c).over(own), none).alias(n) for n, c in totals.items()],
    )
