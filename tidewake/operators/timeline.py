"""Windows over event timelines that stay bounded when one key holds a large share of the rows.

Two building blocks carry the whole W group:

``prior``    row-ordered scans (counts, sums, max, last value) strictly before the current row.
             Rows are windowed inside (key, time slice); the state of earlier slices comes from
             per-slice totals, which are combined map-side before they shuffle.
``rolling``  time windows ``[t-W, t)``.  Rows are first collapsed to one row per (key, second), then
             cut into blocks of W seconds: a window is the end of one block and the start of the next,
             both running totals, so a task sees at most ``2*W`` rows of a block and reads each once.

``sec`` is the integer epoch second, ``order`` the unique row order inside a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

HOUR = 3600
_BEFORE = (Window.unboundedPreceding, -1)


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _total(kind: str, c: Column, at: Column) -> Column:
    if kind == "sum":
        return F.sum(c)
    if kind == "count":
        return F.count(c)
    if kind == "max":
        return F.max(c)
    if kind == "min":
        return F.min(c)
    if kind == "last":  # last non-null value
        return F.max_by(c, F.when(c.isNotNull(), at))
    if kind == "lag":  # value of the very last row, null or not
        return F.max_by(F.struct(c.alias("v")), at)
    raise ValueError(kind)


def _scan(kind: str, c: Column, w) -> Column:
    if kind in ("sum", "count"):
        return F.sum(c).over(w)
    if kind == "max":
        return F.max(c).over(w)
    if kind == "min":
        return F.min(c).over(w)
    return F.last(c, ignorenulls=True).over(w)


def prior(
    df: DataFrame,
    keys,
    sec: str,
    order,
    measures: dict[str, tuple[str, Column]],
    slice_secs: int = HOUR,
    include_current: bool = False,
) -> DataFrame:
    """Add one column per measure holding its value over earlier rows of the same key.

    ``measures`` maps a new column to ``(kind, expression)``; kinds are sum, count, max, min,
    last (non-null) and lag.  Sums and counts start at 0, the others at null.  With
    ``include_current`` the row itself is part of the scan.
    """
    keys, order = _names(keys), _names(order)
    rows = df.withColumn("_sl", F.floor(F.col(sec) / slice_secs)).withColumns(
        {f"_m_{n}": e for n, (_, e) in measures.items()}
    )
    at = F.struct(*[F.col(o) for o in order])
    totals = rows.groupBy(*keys, "_sl").agg(
        *[_total(k, F.col(f"_m_{n}"), at).alias(f"_t_{n}") for n, (k, _) in measures.items()]
    )
    over_slices = Window.partitionBy(*keys).orderBy("_sl").rowsBetween(*_BEFORE)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_sl").alias("_k_sl"),
        *[_scan(k, F.col(f"_t_{n}"), over_slices).alias(f"_c_{n}") for n, (k, _) in measures.items()],
    )
    on = F.col("_sl").eqNullSafe(F.col("_k_sl")) if not keys else F.col("_sl") == F.col("_k_sl")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    in_slice = (
        Window.partitionBy(*keys, "_sl")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    out = {}
    for n, (kind, _) in measures.items():
        c, v = F.col(f"_c_{n}"), F.col(f"_m_{n}")
        if kind == "count":
            out[n] = F.coalesce(c, F.lit(0)) + F.count(v).over(in_slice)
        elif kind == "sum":
            out[n] = F.coalesce(c, F.lit(0)) + F.coalesce(F.sum(v).over(in_slice), F.lit(0))
        elif kind == "max":
            out[n] = F.greatest(c, F.max(v).over(in_slice))
        elif kind == "min":
            out[n] = F.least(c, F.min(v).over(in_slice))
        elif kind == "last":
            out[n] = F.coalesce(F.last(v, ignorenulls=True).over(in_slice), c)
        else:
            held = F.last(F.struct(v.alias("v"))).over(in_slice)
            out[n] = F.coalesce(held, c)["v"]
    helper = ["_sl", "_k_sl", *[f"_k_{k}" for k in keys]]
    helper += [f"_m_{n}" for n in measures] + [f"_c_{n}" for n in measures]
    return rows.join(carry, on, "left").withColumns(out).drop(*helper)


def rolling(
    df: DataFrame,
    keys,
    sec: str,
    specs: dict[str, tuple[int, str, Column]],
    slice_secs: int = HOUR,
) -> DataFrame:
    """Add time-window statistics over ``[t-W, t)``; rows of the same second never see each other.

    ``specs`` maps a new column to ``(W seconds, kind, expression)`` with kind in sum, count, avg,
    min, max, std.  sum and count of an empty window are 0, the rest null.  Blocks are as wide as the
    window; ``slice_secs`` has no effect any more.
    """
    keys = _names(keys)
    exprs: dict[str, Column] = {}
    part: dict[str, str] = {}
    for name, (_, _, e) in specs.items():
        label = str(e)
        part.setdefault(label, f"_p{len(part)}")
        exprs[part[label]] = e
        part[name] = part[label]
    base = df.select(*keys, sec, *[e.alias(p) for p, e in exprs.items()])
    kinds = {p: {k for n, (_, k, _) in specs.items() if part[n] == p} for p in exprs}
    aggs = []
    for p, ks in kinds.items():
        c = F.col(p)
        if ks & {"sum", "avg"}:
            aggs.append(F.sum(c).alias(f"{p}s"))
        if ks & {"count", "avg", "std"}:
            aggs.append(F.count(c).alias(f"{p}n"))
        if "std" in ks:
            aggs += [F.avg(c).alias(f"{p}m"), (F.var_pop(c) * F.count(c)).alias(f"{p}v")]
        if "min" in ks:
            aggs.append(F.min(c).alias(f"{p}lo"))
        if "max" in ks:
            aggs.append(F.max(c).alias(f"{p}hi"))
    grain = base.where(F.col(sec).isNotNull()).groupBy(*keys, sec).agg(*aggs)

    # a block is as wide as the window, so [t-W, t) is the end of one block and the start of the next: both are running
    # totals, and no frame is read again for each row.  A row asks the block before it through a copy at t-W.
    holes = {c: F.when(~F.col("_tail"), F.col(c)).alias(c) for c in grain.columns if c not in (*keys, sec)}
    piece = [F.struct(F.lit(w).alias("_w"), (F.floor(F.col(sec) / w) - back).alias("_b"), (F.col(sec) - back * w).alias("_at"),
                      F.lit(bool(back)).alias("_tail")) for w in sorted({w for w, _, _ in specs.values()}) for back in (0, 1)]
    copies = grain.withColumn("_c", F.explode(F.array(*piece))).select("*", "_c.*").drop("_c")
    copies = copies.select(*keys, sec, "_w", "_b", "_at", "_tail", *holes.values())
    block = Window.partitionBy(*keys, "_w", "_b")
    up, down = block.orderBy("_at", "_tail"), block.orderBy(F.col("_at").desc(), "_tail")
    start, end = up.rowsBetween(*_BEFORE), down.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # deviations are taken around the first value met, so large means do not cancel them and later rows have no say
    for p, ks in kinds.items():
        if "std" in ks:
            for side, w in (("a", up.rowsBetween(Window.unboundedPreceding, Window.currentRow)), ("z", end)):
                gap = F.col(f"{p}m") - F.first(f"{p}m", ignorenulls=True).over(w)
                copies = copies.withColumn(f"{p}d", gap).withColumns({
                    f"{p}{side}1": F.col(f"{p}n") * F.col(f"{p}d"), f"{p}{side}2": F.col(f"{p}v") + F.col(f"{p}n") * F.col(f"{p}d") * F.col(f"{p}d")})

    def part_of(fn, head, tail=None):
        return F.when(F.col("_tail"), fn(tail or head).over(end)).otherwise(fn(head).over(start))

    parts, sides = {}, [("h", ~F.col("_tail")), ("t", F.col("_tail"))]
    for p, ks in kinds.items():
        if ks & {"sum", "avg"}:
            parts[f"{p}s"] = part_of(F.sum, f"{p}s")
        if ks & {"count", "avg", "std"}:
            parts[f"{p}n"] = part_of(F.sum, f"{p}n")
        if "min" in ks:
            parts[f"{p}lo"] = part_of(F.min, f"{p}lo")
        if "max" in ks:
            parts[f"{p}hi"] = part_of(F.max, f"{p}hi")
        if "std" in ks:
            parts |= {f"{p}f": part_of(lambda c: F.first(c, ignorenulls=True), f"{p}m"), f"{p}1": part_of(F.sum, f"{p}a1", f"{p}z1"),
                      f"{p}2": part_of(F.sum, f"{p}a2", f"{p}z2")}
    halves = copies.select(*keys, sec, "_w", "_tail", *[c.alias(n) for n, c in parts.items()])

    cols = []
    for name, (w, kind, _) in specs.items():
        p, here = part[name], F.col("_w") == w

        def both(fn, c):
            return fn(F.when(here, F.col(c)))

        if kind == "sum":
            c = F.coalesce(both(F.sum, f"{p}s"), F.lit(0.0))
        elif kind == "count":
            c = F.coalesce(both(F.sum, f"{p}n"), F.lit(0))
        elif kind == "min":
            c = both(F.min, f"{p}lo")
        elif kind == "max":
            c = both(F.max, f"{p}hi")
        elif kind == "avg":
            n = both(F.sum, f"{p}n")
            c = both(F.sum, f"{p}s") / F.when(n > 0, n)
        else:
            n, f, s, q = ({k: F.max(F.when(here & side, F.col(f"{p}{x}"))) for k, side in sides} for x in "nf12")
            mean = {k: s[k] / F.when(n[k] > 0, n[k]) for k in n}
            inner = {k: F.coalesce(q[k] - s[k] * mean[k], F.lit(0.0)) for k in n}
            total = F.coalesce(n["h"], F.lit(0)) + F.coalesce(n["t"], F.lit(0))
            gap = (f["h"] - f["t"]) + (mean["h"] - mean["t"])
            between = F.coalesce(gap * gap * n["h"] * n["t"] / F.when(total > 0, total), F.lit(0.0))
            c = F.when(total > 1, F.sqrt(F.greatest((inner["h"] + inner["t"] + between) / (total - 1), F.lit(0.0))))
        cols.append(c.alias(name))
    stats = halves.groupBy(*keys, sec).agg(*cols)
    stats = stats.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(sec).alias("_k_sec"), *[F.col(n) for n in specs]
    )
    on = F.col(sec) == F.col("_k_sec")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    fill = {n: 0 for n, (_, k, _) in specs.items() if k in ("sum", "count")}
    out = df.join(stats, on, "left").drop("_k_sec", *[f"_k_{k}" for k in keys])
    return out.fillna(fill) if fill else out


def epoch(ts: Column) -> Column:
    """Whole epoch seconds."""
    return F.unix_timestamp(ts)


def group_min(df: DataFrame, keys, col: str, name: str) -> DataFrame:
    """Smallest value per key on every row, by a map-side combined total instead of a window."""
    keys = _names(keys)
    lows = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(col).alias(name))
    on = None
    for k in keys:
        c = F.col(k) == F.col(f"_k_{k}")
        on = c if on is None else on & c
    return df.join(lows, on, "left").drop(*[f"_k_{k}" for k in keys])
