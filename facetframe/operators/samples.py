"""Samples of exact size per stratum, plain and weighted, the same for any partitioning.

Every key has a priority that only its value and a seed decide. A stratum's sample is
its `size` least priorities; what is sought is the priority of the last of them. It is
found digit by digit: a counting pass gives the rows per stratum and leading 15 bits
of the priority, the running count tells in which the last one lies, and the next pass
looks at the rows of that digit alone (after one or two passes hardly any are left).
Counts combine before the shuffle, and at most 32,768 numbers per stratum reach a
window, so no stratum is ranked or gathered, however large. The rows at or below the
limit are then read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.operators.frames import cell
from facetframe.session import checkpointed

#: Hexadecimal digits of the digest that make a priority, and bits looked at per pass.
PRIORITY_DIGITS = 15
PRIORITY_BITS = 4 * PRIORITY_DIGITS
PASS_BITS = 15
#: Logarithms of weights are held to this range.
MOST_LOG_WEIGHT = 50.0


def priority(key: Column, seed: str = "", weight: Column | None = None) -> Column:
    """A whole number below 2^60; null for a null key or a weight that is not positive.

    Weighted priorities are logarithms of exponential draws whose rate is the weight
    (so each draw takes a key with a chance in proportion to its weight), scaled.
    """
    digits = F.substr(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), F.lit(1), F.lit(PRIORITY_DIGITS))
    drawn = F.conv(digits, 16, 10).cast("long")
    if weight is None:
        return drawn
    even = (F.shiftright(drawn, 8) + F.lit(0.5)) / F.lit(2.0**52)
    log_weight = F.greatest(F.lit(-MOST_LOG_WEIGHT), F.least(F.lit(MOST_LOG_WEIGHT), F.ln(weight.cast("double"))))
    return F.when(weight > 0, F.floor((F.ln(-F.ln(even)) - log_weight + 64) * F.lit(2.0**50)))


def stratified(
    df: DataFrame, strata: Sequence[str], key: str, size: int, weight: str | None = None, seed: str = ""
) -> DataFrame:
    """The rows of `size` keys of every stratum, or of all if it has fewer.

    Rows that share a key within a stratum are drawn together and count as one; a
    null key, and a weight that is null, not a number or not above zero, is never
    drawn; rows with a key but different weights count as different. Nulls make a
    stratum of their own. A size below one or an empty table gives no rows.
    """
    strata = list(strata)
    own = priority(cell(key), seed, None if weight is None else F.when(~F.isnan(cell(weight).cast("double")), cell(weight)))
    if size < 1:
        return df.limit(0)
    s = [f"_s{i}" for i in range(len(strata))]
    units = checkpointed(df.select(*[cell(c).alias(n) for c, n in zip(strata, s)], own.alias("_p")).where("_p IS NOT NULL").distinct())
    state, limits = None, []
    for low in range(PRIORITY_BITS - PASS_BITS, -1, -PASS_BITS):
        if state is None:
            rows = units.withColumn("_need", F.lit(size).cast("long"))
        else:
            held = state.select(*[F.col(n).alias(f"_h{n}") for n in s], "_prefix", "_need")
            same = reduce(lambda a, n: a & F.col(n).eqNullSafe(F.col(f"_h{n}")), s, F.shiftright("_p", low + PASS_BITS) == F.col("_prefix"))
            rows = units.join(held, same).select(*s, "_p", "_need")
        counts = rows.groupBy(*s, F.shiftright("_p", low).alias("_prefix")).agg(F.count("*").alias("_n"), F.first("_need").alias("_need"))
        upto = F.sum("_n").over(W.partitionBy(*s).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0))
        last = counts.withColumn("_upto", upto).where("_upto >= _need AND _upto - _n < _need")
        found = checkpointed(last.select(*s, "_prefix", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), "_n"))
        limits.append(found.where("_need = _n").select(*s, ((F.col("_prefix") + 1) * (1 << low) - 1).alias("_limit")))
        state = found.where("_need < _n")
        if state.isEmpty():
            break
    every = reduce(DataFrame.unionByName, limits).select(*[F.col(n).alias(f"_h{n}") for n in s], "_limit")
    same = reduce(lambda a, x: a & cell(x[0]).eqNullSafe(F.col(f"_h{x[1]}")), zip(strata, s), F.lit(True))
    drawn = df.join(every, same, "left") if strata else df.crossJoin(F.broadcast(every.agg(F.max("_limit").alias("_limit"))))
    return drawn.where(own.isNotNull() & (F.col("_limit").isNull() | (own <= F.col("_limit")))).select(*map(cell, df.columns))
