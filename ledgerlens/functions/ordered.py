"""Ranks and running totals over a whole table without a one-task window.

The order's leading column is cut at its own quantiles; the totals of the
pieces (a fixed number of rows) give each piece's start, and a window inside a
piece does the rest. A value so frequent that it is a cut itself becomes a piece
of its own and is split further by the tie-breaking id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECES = 128


def steps(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at or below ``value`` (null: 0), by binary lifting."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    top = len(bounds).bit_length() - 1

    def lift(done: Column, power: Column) -> Column:
        ahead = done + power
        return F.when((ahead <= len(bounds)) & (F.element_at(table, F.least(ahead, F.lit(len(bounds)))) <= value), ahead).otherwise(done)

    powers = F.array(*[F.lit(1 << i) for i in range(top, -1, -1)])
    return F.when(value.isNull(), F.lit(0)).otherwise(F.aggregate(powers, F.lit(0), lift))


def cuts(df: DataFrame, *columns: str, pieces: int = PIECES) -> list[list]:
    """Distinct approximate quantiles of numeric columns, all from one pass."""
    levels = [k / pieces for k in range(1, pieces)]
    found = df.agg(*[F.percentile_approx(c, levels, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(q or [])) for q in found]


def _piece(lead: str, bounds: list) -> Column:
    """Piece number, ascending in ``lead``: odd for values between cuts, even for values equal to one."""
    at = steps(F.col(lead), bounds)
    if not bounds:
        return F.lit(1)
    table = F.array(*[F.lit(b) for b in bounds])
    equal = (at > 0) & (F.element_at(table, F.greatest(at, F.lit(1))) == F.col(lead))
    return F.when(equal, at * 2).otherwise(at * 2 + 1)


def positions(df: DataFrame, lead: str, tie: str, descending: bool = True, out: str = "rank") -> DataFrame:
    """``df`` with the position (from 1) of each row by ``lead`` and then ``tie`` ascending.

    ``lead`` must be numeric without nulls, ``tie`` a number that tells rows
    apart. Equal pairs get different positions in no fixed order.
    """
    bounds, ties = cuts(df, lead, tie)
    piece = _piece(lead, bounds)
    split = df.withColumn("_p", -piece if descending else piece)
    split = split.withColumn("_t", F.when(F.pmod("_p", F.lit(2)) == 0, steps(F.col(tie), ties)).otherwise(F.lit(0)))
    sizes = split.groupBy("_p", "_t").agg(F.count(F.lit(1)).alias("_n"))  # at most PIECES * (PIECES + 1) rows
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_p", "_t")) - F.col("_n")).drop("_n")
    order = [F.desc(lead) if descending else F.asc(lead), F.asc(tie)]
    inside = F.row_number().over(Window.partitionBy("_p", "_t").orderBy(*order))
    return split.join(F.broadcast(starts), ["_p", "_t"]).withColumn(out, (F.col("_start") + inside).cast("long")).drop("_p", "_t", "_start")


def pairs_at(df: DataFrame, lead: str, tie: str, shares: list[float], enough: int = 100_000) -> list[tuple | None] | None:
    """The pairs (lead, tie) at the positions int(rows * share), None for 0; None altogether if equal pairs lie on both sides of one.

    As ``positions``, but no row is moved: pieces are counted and only the one
    with the position is cut again, until at most ``enough`` rows are sorted.
    """

    def pieces(part):
        bounds, ties = cuts(part, lead, tie)
        piece = _piece(lead, bounds)
        split = part.withColumn("_p", piece).withColumn("_t", F.when(F.pmod("_p", F.lit(2)) == 0, steps(F.col(tie), ties)).otherwise(F.lit(0)))
        return split, sorted((r["_p"], r["_t"], r["count"]) for r in split.groupBy("_p", "_t").count().collect())

    whole = pieces(df.select(lead, tie))
    n, out = sum(size for _, _, size in whole[1]), []
    for share in shares:
        left, (split, sizes) = int(n * share), whole
        if not left:
            out.append(None)
            continue
        while True:
            for p, t, size in sizes:
                if left <= size:
                    break
                left -= size
            part = split.filter((F.col("_p") == p) & (F.col("_t") == t)).select(lead, tie)
            if size <= enough or len(sizes) == 1:
                break
            split, sizes = pieces(part)
        found = [tuple(r) for r in part.orderBy(F.asc(lead), F.asc(tie)).offset(left - 1).limit(2).collect()]
        if len(found) == 2 and found[0] == found[1]:
            return None
        out.append(found[0])
    return out


def running_totals(df: DataFrame, lead: str, measures: list[str], descending: bool = True) -> DataFrame:
    """``df`` with ``cum_<m>``: the total of each measure up to and with the row's ``lead``, which must be unique."""
    piece = _piece(lead, cuts(df, lead)[0])
    split = df.withColumn("_p", -piece if descending else piece)
    totals = split.groupBy("_p").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    before = Window.orderBy("_p")
    starts = totals.select("_p", *[(F.sum(f"_s_{m}").over(before) - F.col(f"_s_{m}")).alias(f"_b_{m}") for m in measures])
    inside = Window.partitionBy("_p").orderBy(F.desc(lead) if descending else F.asc(lead)).rowsBetween(Window.unboundedPreceding, 0)
    return split.join(F.broadcast(starts), "_p").withColumns({f"cum_{m}": F.col(f"_b_{m}") + F.sum(m).over(inside) for m in measures}).drop("_p", *[f"_b_{m}" for m in measures])
