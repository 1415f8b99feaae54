"""Hilbert-curve sharding: rows that are close in several metadata dimensions share a file.

Each dimension is quantised to ``bits`` bits by its own quantiles, spread over
all codes so that a dimension of few values decides the curve's coarse turns
too; the codes become an index on the Hilbert curve, rows are ordered by that
index and the order is cut into runs whose row counts differ by one at most
(law ``rows``). ``shard_ranges`` gives what a reader prunes files by.

Scale: the texts are read once, for their sizes and checksums; ids, these and
the dimensions are written and everything else works on that table. Positions
come from counts of curve cells (at most 2**(bits * dims) rows, broadcast up to
BROADCAST_BITS) and of sub-cells of about ``cell_rows`` rows, so a cell with a
third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, steps

#: Cells are broadcast if there are at most 2 to this power of them.
BROADCAST_BITS = 18


def _curve_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """Inverse Gray code, entry corner and direction of each of the 2**dims sub-cubes."""
    gray = [i ^ (i >> 1) for i in range(1 << dims)]
    inverse = [gray.index(i) for i in range(1 << dims)]
    ones = lambda i: len(bin(i)) - len(bin(i).rstrip("1"))
    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, 1 << dims)]
    turn = [0] + [ones(w - 1 if w % 2 == 0 else w) % dims for w in range(1, 1 << dims)]
    return inverse, entry, turn


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer coordinates 0 .. 2**bits - 1 (one column per dimension)."""
    n = len(codes)
    if n < 2:
        return codes[0].cast("long")
    mask = (1 << n) - 1
    inverse, entry, turn = (F.array(*[F.lit(x) for x in t]) for t in _curve_tables(n))
    digit = lambda i: sum((F.shiftright(c, i).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, c in enumerate(codes)), F.lit(0))
    digits = F.array(*[digit(i).cast("int") for i in range(bits - 1, -1, -1)])
    shl = lambda x, by: (x * F.element_at(powers, by + 1)).bitwiseAND(F.lit(mask))
    powers = F.array(*[F.lit(1 << i) for i in range(n + 1)])
    shr = lambda x, by: F.floor(x / F.element_at(powers, by + 1)).cast("int")

    def level(state: Column, x: Column) -> Column:
        e, d = state["e"], state["d"]
        by = F.pmod(d + 1, F.lit(n))
        y = x.bitwiseXOR(e)
        y = shr(y, by).bitwiseOR(shl(y, F.lit(n) - by))
        w = F.element_at(inverse, y + 1)
        corner = F.element_at(entry, w + 1)
        corner = shl(corner, by).bitwiseOR(shr(corner, F.lit(n) - by))
        return F.struct(
            (state["h"] * F.lit(1 << n) + w).alias("h"),
            e.bitwiseXOR(corner).alias("e"),
            F.pmod(d + F.element_at(turn, w + 1) + 1, F.lit(n)).alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(digits, start, level, lambda s: s["h"])


def _quantised(df: DataFrame, dims: list[str], bits: int) -> tuple[list[Column], int]:
    """A code column per dimension, and the number of rows. Strings count by the seven bytes after their common prefix, which keeps their order."""
    kinds = dict(df.dtypes)
    texts = [c for c in dims if kinds[c] == "string"]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(texts) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    keys: dict[str, Column] = {}
    for i, c in enumerate(texts):
        lo, hi = row[f"lo{i}"] or "", row[f"hi{i}"] or ""
        same = next((k for k, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
        tail = F.hex(F.encode(F.substring(F.col(c), same + 1, 7), "UTF-8"))
        keys[c] = F.conv(F.rpad(F.substring(tail, 1, 14), 14, "0"), 16, 10).cast("long")
    for c in dims:
        keys.setdefault(c, F.col(c).cast("double") if kinds[c] in ("float", "double") or kinds[c].startswith("decimal") else F.col(c).cast("long"))
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(keys[c], cuts, 10_000).alias(f"q{i}") for i, c in enumerate(dims)]).first()
    codes = []
    for i, c in enumerate(dims):
        bounds = sorted(set(found[f"q{i}"] or []))
        codes.append(F.floor(steps(keys[c], bounds) * F.lit(1 << bits) / F.lit(len(bounds) + 1)).cast("int"))
    return codes, row["n"]


def hilbert_shards(
    docs: DataFrame,
    dims: list[str] = ("source", "lang", "n_chars"),
    shards: int = 24,
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell_rows: int = 20_000,
) -> DataFrame:
    """Give every row a shard and a slot along the Hilbert order of ``dims``.

    Returns ``id_col``, size, text_crc32, law, shard, slot, grown_shard and
    curve_index; other input columns, whatever their names, are left out.

    Nulls: a null dimension takes code 0, a null text counts as empty (size 8)
    with checksum 0, a null id sorts first. Ties and repeated rows each get
    their own slot. An empty table gives an empty result. Texts of any length
    are only measured and summed, not moved. Fewer rows than shards leaves
    shards empty.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    light = materialise(
        docs.select(F.col(id_col).alias("_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *[F.col(c).alias(f"_d{k}") for k, c in enumerate(dims)]), "shard-columns"
    )
    codes, n = _quantised(light, [f"_d{k}" for k in range(len(dims))], bits)
    cell = sum((F.shiftleft(c.cast("long"), k * bits) for k, c in enumerate(codes)), F.lit(0))
    rows = light.select("_id", cell.alias("_cell"), "size", "text_crc32")
    # The curve is followed once per cell, not per row.
    places = [F.shiftright("_cell", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for k in range(len(codes))]
    counts = rows.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("_parts"))
    cells = counts.withColumn("curve_index", hilbert_index(places, bits))
    cells = F.broadcast(cells) if bits * len(codes) <= BROADCAST_BITS else cells
    dealt = rows.join(cells, "_cell").drop("_cell").withColumn("_part", F.pmod(F.xxhash64("_id", "text_crc32", "size"), F.col("_parts"))).drop("_parts")
    order = Window.orderBy("curve_index", "_part")
    starts = (
        dealt.groupBy("curve_index", "_part").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.sum("_rows").over(order) - F.col("_rows")).drop("_rows")
    )
    within = Window.partitionBy("curve_index", "_part").orderBy("_id", "text_crc32", "size")
    place = F.col("_start") + F.row_number().over(within) - 1
    return (
        dealt.join(starts, ["curve_index", "_part"])
        .withColumn("_at", place.cast("long"))
        .withColumn("shard", F.expr(f"cast((_at * {shards}L) div {max(n, 1)}L as int)"))
        .select(
            F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("_at") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "curve_index",
        )
    )


def shard_ranges(rows: DataFrame, dims: list[str] = ("source", "lang", "n_chars"), shard_col: str = "shard") -> DataFrame:
    """``shard_col``, n_rows and min_<d>, max_<d> of every dimension of ``rows`` (documents with their shard): a reader skips the shards whose range misses its filter."""
    return rows.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
