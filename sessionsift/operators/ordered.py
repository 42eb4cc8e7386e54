"""Skew-safe ordered operators: running sums and as-of lookups per key.

A plain ``Window.partitionBy(session).orderBy(seq)`` puts a whole session in one
task; if one session holds a third of all rows that task holds a third of the
data.  Both helpers below split the ordered key into fixed-size *blocks* of the
order column, solve each block in its own window partition, and carry the
state between blocks through a per-block summary that is tiny (one row per
block), so no task ever sees more than ``block`` rows of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16


def _block(order_col: str, block: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(block)).cast("bigint")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", large: bool = False) -> DataFrame:
    """Equi-join in which a null key equals a null key; the keys come out once.

    ``large``: both sides grow with the rows.  Narrow columns of parsed JSON are estimated at a fiftieth of their
    size, so that a side of millions of rows would be broadcast; then both are shuffled by one struct of the keys,
    in which nulls are equal."""
    if large:
        out = [F.col(c) for c in left.columns] + [F.col(c) for c in right.columns if c not in keys and how not in ("left_semi", "left_anti")]
        keyed = right.withColumn("__key", F.struct(*keys)).drop(*keys)
        return left.withColumn("__key", F.struct(*keys)).join(keyed.hint("merge"), "__key", how).select(*out)
    marked = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    if how in ("left_semi", "left_anti"):
        return left.join(marked, same, how)
    return left.join(marked, same, how).drop(*(f"__r_{k}" for k in keys))


#: Stands for a null session inside a plan whose joins are plain ones.
_NO_SESSION = "\x01\x01no session"


def named_sessions(df: DataFrame, key: str = "session_id") -> DataFrame:
    """Null sessions get a name of their own, so that plain joins and groups keep them together."""
    if df.schema[key].dataType.simpleString() != "string":
        return df
    return df.withColumn(key, F.coalesce(F.col(key), F.lit(_NO_SESSION)))


def nameless_sessions(df: DataFrame, key: str = "session_id") -> DataFrame:
    """``named_sessions`` taken back."""
    if df.schema[key].dataType.simpleString() != "string":
        return df
    return df.withColumn(key, F.nullif(F.col(key), F.lit(_NO_SESSION)))


def _key(keys: list[str]) -> Column:
    """A block's key as one struct, in which nulls are equal."""
    return F.struct(*keys, "__blk").alias("__key")


def _with_summary(base: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its block's ``summary``: shuffled once, for the join and the window over the block alike, and
    never broadcast, as both sides grow with the rows whatever the estimate of their size says."""
    return base.withColumn("__key", _key(keys)).join(summary.hint("merge"), "__key")


def running_sum(df: DataFrame, keys: list[str], order_col: str, value: Column | str, out: str,
                block: int = DEFAULT_BLOCK, tiebreak: list[str] | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``order_col`` order.

    Equal to ``sum(value) over (partition by keys order by order_col rows
    between unbounded preceding and current row)`` but skew-safe: block totals
    (partially aggregated before the shuffle) give each block its offset.
    """
    value = F.col(value) if isinstance(value, str) else value
    order = [order_col] + (tiebreak or [])
    b = "__blk"
    v = "__val"
    base = df.withColumn(b, _block(order_col, block)).withColumn(v, value.cast("bigint"))
    totals = base.groupBy(*keys, b).agg(F.sum(v).alias("__bt"))
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_key(keys), F.coalesce(F.sum("__bt").over(wb), F.lit(0)).alias("__off"))
    wr = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (_with_summary(base, offsets, keys)
            .withColumn(out, (F.col("__off") + F.coalesce(F.sum(v).over(wr), F.lit(0))).cast("bigint"))
            .drop("__key", b, v, "__off"))


def last_before(df: DataFrame, keys: list[str], order_col: str, value: Column | str, out: str,
                block: int = DEFAULT_BLOCK, tiebreak: list[str] | None = None,
                inclusive: bool = False) -> DataFrame:
    """As-of lookup: the last non-null ``value`` among strictly earlier rows of the same key.

    Order is ``order_col`` then ``tiebreak``.  With ``inclusive`` the current
    row counts too.  Inside a block it is a bounded window; across blocks the
    last non-null value of every earlier block is carried forward from a
    one-row-per-block summary.
    """
    value = F.col(value) if isinstance(value, str) else value
    order = [order_col] + (tiebreak or [])
    b = "__blk"
    v = "__val"
    base = df.withColumn(b, _block(order_col, block)).withColumn(v, value)
    # Last non-null value of each block (max_by is a partial aggregate: skew-safe).
    ordkey = F.struct(*[F.col(c) for c in order])
    # Every block of the row side needs a carry, including blocks without a value: there it is null.
    blocks = base.groupBy(*keys, b).agg(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), ordkey)).alias("__blast"))
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(_key(keys), F.last("__blast", ignorenulls=True).over(wb).alias("__carry"))
    end = 0 if inclusive else -1
    wr = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return (_with_summary(base, carry, keys)
            .withColumn(out, F.coalesce(F.last(v, ignorenulls=True).over(wr), F.col("__carry")))
            .drop("__key", b, v, "__carry"))
