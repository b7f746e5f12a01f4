"""W: causal window features over event timelines.

"Prior" is strictly earlier in the row order of the key; rolling windows are ``[t-W, t)`` seconds.
All functions add columns and keep every row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ordering import join_scan, quantiles, value_counts_scan
from .timeline import group_min, prior, rolling

SEC, ORDER = "sec", ("ts", "trade_id")


def _ratio(a: Column, b: Column, default=None) -> Column:
    r = F.when(b != 0, a / b)
    return F.coalesce(r, F.lit(default)) if default is not None else r


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c < lo, F.lit(float(lo))).when(c > hi, F.lit(float(hi))).otherwise(c)


# ---- row-ordered prior features -------------------------------------------------------------


def prior_count(df, key, out="prior_count", sec=SEC, order=ORDER) -> DataFrame:
    """Number of earlier rows of the key, and its log1p."""
    d = prior(df, key, sec, order, {out: ("count", F.lit(1))})
    return d.withColumn(f"log_{out}", F.log1p(out))


def prior_sum(df, key, col, out="prior_sum", sec=SEC, order=ORDER) -> DataFrame:
    """Sum of ``col`` over earlier rows of the key, 0 at the first row."""
    return prior(df, key, sec, order, {out: ("sum", F.col(col))})


def prior_share(df, key, col, part: Column, out="prior_share", sec=SEC, order=ORDER) -> DataFrame:
    """Share of the prior total that came from rows where ``part`` holds; null without volume."""
    d = prior(
        df, key, sec, order,
        {"_part": ("sum", F.when(part, F.col(col)).otherwise(0.0)), "_all": ("sum", F.col(col))},
    )
    return d.withColumn(out, _clip(_ratio(F.col("_part"), F.col("_all")), 0, 1)).drop("_part", "_all")


def pre_trade_price(df, key, price="price", default=0.5, out="pre_price", sec=SEC, order=ORDER) -> DataFrame:
    """Price of the row before, ``default`` at the first row of the key."""
    d = prior(df, key, sec, order, {out: ("lag", F.col(price))})
    return d.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def gap_features(df, key, quiet_secs=3600, sec=SEC, order=ORDER) -> DataFrame:
    """Seconds since the row before (0 at the first), log1p, and a flag for quiet spells."""
    d = prior(df, key, sec, order, {"_prev": ("lag", F.col(sec))})
    gap = F.coalesce(F.col(sec) - F.col("_prev"), F.lit(0))
    return d.withColumns(
        {"gap": gap, "log_gap": F.log1p(gap), "quiet": (gap > quiet_secs).cast("int")}
    ).drop("_prev")


def prior_distinct(df, key, item, out="prior_distinct", sec=SEC, order=ORDER) -> DataFrame:
    """First time the key meets the item, and how many distinct items it met before."""
    d = prior(df, [key, item], sec, order, {"_seen": ("count", F.lit(1))})
    d = d.withColumn("first_seen", (F.col("_seen") == 0).cast("int")).drop("_seen")
    return prior(d, key, sec, order, {out: ("sum", F.col("first_seen"))})


def prior_position(df, keys, signed: Column, scale=1000.0, sec=SEC, order=ORDER) -> DataFrame:
    """Signed position held before the row and its bounded form tanh(position / scale)."""
    d = prior(df, keys, sec, order, {"position": ("sum", signed)})
    return d.withColumn("position_bounded", F.tanh(F.col("position") / scale))


def purity_same_code(df, key, code, out="purity", sec=SEC, order=ORDER) -> DataFrame:
    """Share of the key's earlier rows that carry the current row's code."""
    d = prior(df, key, sec, order, {"_n": ("count", F.lit(1))})
    d = prior(d, [key, code], sec, order, {"_same": ("count", F.lit(1))})
    return d.withColumn(out, _ratio(F.col("_same"), F.col("_n"))).drop("_n", "_same")


def two_side_mix(df, keys, side, sec=SEC, order=ORDER) -> DataFrame:
    """Purity p0^2+p1^2, both-sides flag and min/max spread over earlier rows (null if none)."""
    d = prior(
        df, keys, sec, order,
        {"_n0": ("sum", (F.col(side) == 0).cast("int")), "_n1": ("sum", (F.col(side) == 1).cast("int"))},
    )
    n0, n1 = F.col("_n0"), F.col("_n1")
    n = n0 + n1
    return d.withColumns(
        {
            "mix_purity": F.when(n > 0, (n0 * n0 + n1 * n1) / (n * n)),
            "both_sides": ((n0 > 0) & (n1 > 0)).cast("int"),
            "spread_ratio": F.when(n > 0, F.least(n0, n1) / F.greatest(n0, n1)),
        }
    ).drop("_n0", "_n1")


def causal_win_rate(df, key, won, resolved_sec, out="win_rate", sec=SEC, order=ORDER) -> DataFrame:
    """Mean outcome of the key's rows that were resolved before this row.

    Resolutions and rows become one timeline; a resolution in the same second counts as later.
    A missing resolution time means unresolved.
    """
    keys = [key] if isinstance(key, str) else list(key)
    carried = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, F.col(sec).alias("_at"), F.lit(0).alias("_kind"), F.struct(*carried).alias("_row"),
                     F.lit(None).cast("double").alias("_won"))
    done = df.where(F.col(resolved_sec).isNotNull() & F.col(won).isNotNull()).select(
        *keys, F.col(resolved_sec).cast(dict(df.dtypes)[sec]).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).alias("_row"), F.col(won).cast("double").alias("_won"),
    )
    both = rows.unionByName(done)
    d = prior(both, keys, "_at", ("_at", "_kind"), {"_w": ("sum", F.col("_won")), "_c": ("count", F.col("_won"))})
    d = d.where("_kind = 0").select(*keys, "_row.*", F.col("_w"), F.col("_c"))
    return d.withColumns(
        {out: _ratio(F.col("_w"), F.col("_c")), "has_resolved": (F.col("_c") > 0).cast("int")}
    ).drop("_w", "_c")


def win_rate_leak_gap(df, key, won, resolved_sec, sec=SEC, order=ORDER) -> DataFrame:
    """Correlation with the outcome of the leaky prior mean and of the causal one, and their gap."""
    d = prior(df, key, sec, order, {"_s": ("sum", F.col(won).cast("double")), "_n": ("count", F.col(won))})
    d = d.withColumn("leaky", _ratio(F.col("_s"), F.col("_n"))).drop("_s", "_n")
    d = causal_win_rate(d, key, won, resolved_sec, "causal", sec, order)
    g = d.agg(F.corr("leaky", won).alias("corr_leaky"), F.corr("causal", won).alias("corr_causal"))
    return g.withColumn("leak_gap", F.col("corr_leaky") - F.col("corr_causal"))


def expanding_entropy(df, key, item, category, labels, out="entropy", min_items=2, sec=SEC, order=ORDER) -> DataFrame:
    """Entropy over the categories of the distinct items met before; null below ``min_items``."""
    d = prior(df, [key, item], sec, order, {"_seen": ("count", F.lit(1))})
    first = F.col("_seen") == 0
    d = prior(
        d, key, sec, order,
        {f"_n{i}": ("sum", (first & (F.col(category) == lab)).cast("int")) for i, lab in enumerate(labels)},
    )
    ns = [F.col(f"_n{i}") for i in range(len(labels))]
    total = sum(ns[1:], ns[0])
    h = F.lit(0.0)
    for n in ns:
        h = h + F.when(n > 0, -(n / total) * F.ln(n / total)).otherwise(0.0)
    return d.withColumn(out, F.when(total >= min_items, h)).drop("_seen", *[f"_n{i}" for i in range(len(labels))])


def since_first(df, key, sec=SEC) -> DataFrame:
    """Seconds since the first event of the key, and the same with negative sign."""
    d = group_min(df, key, sec, "_t0")
    age = F.col(sec) - F.col("_t0")
    return d.withColumns({"since_first": age, "first_seen_offset": -age}).drop("_t0")


def size_vs_prior(df, own, market, col, sec=SEC, order=ORDER) -> DataFrame:
    """Size against the own prior mean, the market's prior volume and its prior mean."""
    d = prior(df, own, sec, order, {"_os": ("sum", F.col(col)), "_on": ("count", F.col(col))})
    d = prior(d, market, sec, order, {"_ms": ("sum", F.col(col)), "_mn": ("count", F.col(col))})
    v = F.col(col)
    return d.withColumns(
        {
            "size_vs_own_avg": _ratio(v * F.col("_on"), F.col("_os")),
            "size_vs_market_volume": _ratio(v, F.col("_ms")),
            "size_vs_market_avg": _ratio(v * F.col("_mn"), F.col("_ms")),
        }
    ).drop("_os", "_on", "_ms", "_mn")


def pct_elapsed(df, key, deadline_sec, start_sec=None, out="pct_elapsed", sec=SEC) -> DataFrame:
    """Elapsed share of the lifetime, clipped to [0,1]; null for a non-positive lifetime.

    The start is ``start_sec`` (creation) or, when not given, the first row of the key.
    """
    d = df.withColumn("_t0", F.col(start_sec)) if start_sec else group_min(df, key, sec, "_t0")
    life = F.col(deadline_sec) - F.col("_t0")
    return d.withColumn(out, F.when(life > 0, _clip((F.col(sec) - F.col("_t0")) / life, 0, 1))).drop("_t0")


def exit_flip(df, keys, amount, side_buy, exit_ratio=0.9, sec=SEC, order=ORDER) -> DataFrame:
    """A sell of at least ``exit_ratio`` of the long position; a trade that flips its sign."""
    signed = F.when(F.col(side_buy) == 1, F.col(amount)).otherwise(-F.col(amount))
    d = prior(df, keys, sec, order, {"position": ("sum", signed)})
    pos = F.col("position")
    return d.withColumns(
        {
            "is_exit": ((F.col(side_buy) == 0) & (pos > 0) & (F.col(amount) >= exit_ratio * pos)).cast("int"),
            "is_flip": ((pos != 0) & (F.signum(pos) * F.signum(pos + signed) < 0)).cast("int"),
        }
    )


def pre_yes_price(df, key, price, is_yes, out="pre_yes", default=0.5, sec=SEC, order=ORDER) -> DataFrame:
    """Last price seen on the YES side, else 1 - last on the NO side, else ``default``."""
    p, y = F.col(price), F.col(is_yes)
    d = prior(df, key, sec, order, {"_y": ("last", F.when(y == 1, p)), "_n": ("last", F.when(y == 0, p))})
    return d.withColumn(out, F.coalesce("_y", 1 - F.col("_n"), F.lit(default))).drop("_y", "_n")


def sell_semantics(df, keys, side_buy, sec=SEC, order=ORDER) -> DataFrame:
    """Earlier buys on the same keys, and whether a sell closes one of them."""
    d = prior(df, keys, sec, order, {"prior_buys": ("sum", (F.col(side_buy) == 1).cast("int"))})
    return d.withColumn("closing_sell", ((F.col(side_buy) == 0) & (F.col("prior_buys") > 0)).cast("int"))


def block_features(df, keys, order=ORDER) -> DataFrame:
    """Trades in the same block and the position inside it. Not causal: audit use only."""
    w = Window.partitionBy(*keys)
    return df.withColumns(
        {
            "block_trades": F.count(F.lit(1)).over(w),
            "block_position": F.row_number().over(w.orderBy(*order)).cast("bigint"),
        }
    )


def residualise_prior_mean(df, key, col, out="residual", sec=SEC, order=ORDER) -> DataFrame:
    """Value minus the mean of the key's earlier values; 0 when there are none."""
    d = prior(df, key, sec, order, {"_s": ("sum", F.col(col)), "_n": ("count", F.col(col))})
    return d.withColumn(out, F.when(F.col("_n") > 0, F.col(col) - F.col("_s") / F.col("_n")).otherwise(0.0)).drop(
        "_s", "_n"
    )


# ---- rolling time windows -------------------------------------------------------------------


def _span(w: int) -> str:
    return f"{w // 3600}h" if w % 3600 == 0 else f"{w // 60}m"


def rolling_sum(df, key, col, secs=(300, 3600, 86400), sec=SEC) -> DataFrame:
    """Volume of the last W seconds and its log1p."""
    d = rolling(df, key, sec, {f"vol_{_span(w)}": (w, "sum", F.col(col)) for w in secs})
    return d.withColumns({f"log_vol_{_span(w)}": F.log1p(f"vol_{_span(w)}") for w in secs})


def rolling_count(df, key, secs=(300, 3600, 86400), sec=SEC) -> DataFrame:
    """Number of rows in the last W seconds."""
    return rolling(df, key, sec, {f"n_{_span(w)}": (w, "count", F.lit(1)) for w in secs})


def order_flow_imbalance(df, key, amount, side_buy, secs=3600, out="imbalance", sec=SEC) -> DataFrame:
    """Signed volume over volume of the window, in [-1,1]; 0 without volume."""
    signed = F.when(F.col(side_buy) == 1, F.col(amount)).otherwise(-F.col(amount))
    d = rolling(df, key, sec, {"_s": (secs, "sum", signed), "_v": (secs, "sum", F.col(amount))})
    return d.withColumn(out, _clip(_ratio(F.col("_s"), F.col("_v"), 0.0), -1, 1)).drop("_s", "_v")


def rolling_std(df, key, col, secs=3600, out="std", sec=SEC) -> DataFrame:
    """Sample deviation over the window; null below two values."""
    return rolling(df, key, sec, {out: (secs, "std", F.col(col))})


def rolling_price_stats(df, key, price, secs=3600, sec=SEC) -> DataFrame:
    """Mean, max, min and range of the window, and the price against the window mean."""
    p = F.col(price)
    d = rolling(df, key, sec, {"w_mean": (secs, "avg", p), "w_max": (secs, "max", p), "w_min": (secs, "min", p)})
    return d.withColumns({"w_range": F.col("w_max") - F.col("w_min"), "vs_mean": p - F.col("w_mean")})


def size_vs_recent(df, key, col, secs=3600, cap=100.0, sec=SEC) -> DataFrame:
    """Value against the window volume and the window mean, clipped to [0, cap]."""
    d = rolling(df, key, sec, {"_v": (secs, "sum", F.col(col)), "_a": (secs, "avg", F.col(col))})
    return d.withColumns(
        {
            "size_vs_volume": _clip(_ratio(F.col(col), F.col("_v"), 0.0), 0, cap),
            "size_vs_avg": _clip(_ratio(F.col(col), F.col("_a"), 0.0), 0, cap),
        }
    ).drop("_v", "_a")


def rolling_share(df, key, amount, part: Column, secs=3600, out="share", default=0.5, sec=SEC) -> DataFrame:
    """Share of the window volume where ``part`` holds, and its skew around one half."""
    sub = F.when(part, F.col(amount)).otherwise(0.0)
    d = rolling(df, key, sec, {"_p": (secs, "sum", sub), "_v": (secs, "sum", F.col(amount))})
    d = d.withColumn(out, _ratio(F.col("_p"), F.col("_v"), default)).drop("_p", "_v")
    return d.withColumn(f"{out}_skew", F.col(out) - 0.5)


def _changes(df, key, price, sec, order, depth=1):
    d = prior(df, key, sec, order, {"_p1": ("lag", F.col(price))})
    d = d.withColumn("_d0", F.col(price) - F.col("_p1")).drop("_p1")
    if depth > 1:
        d = prior(d, key, sec, order, {"_d1": ("lag", F.col("_d0"))})
    return d


def realized_var(df, key, price, secs=3600, out="realized_var", sec=SEC, order=ORDER) -> DataFrame:
    """Sum of squared price changes over the window."""
    d = _changes(df, key, price, sec, order)
    return rolling(d, key, sec, {out: (secs, "sum", F.col("_d0") * F.col("_d0"))}).drop("_d0")


def jump_component(df, key, price, secs=3600, out="jump", sec=SEC, order=ORDER) -> DataFrame:
    """Realized variance above the bipower part (pi/2) * sum |d_t||d_t-1|, floored at 0."""
    d = _changes(df, key, price, sec, order, 2)
    bi = F.abs("_d0") * F.abs("_d1")
    d = rolling(d, key, sec, {"_rv": (secs, "sum", F.col("_d0") * F.col("_d0")), "_bp": (secs, "sum", bi)})
    jump = F.greatest(F.col("_rv") - (math.pi / 2) * F.col("_bp"), F.lit(0.0))
    return d.withColumn(out, jump).drop("_d0", "_d1", "_rv", "_bp")


def flow_autocorr(df, key, signed: Column, secs=3600, out="flow_autocorr", sec=SEC, order=ORDER) -> DataFrame:
    """Window mean of x_t * x_t-1 over signed flow; 0 when empty."""
    d = df.withColumn("_x", signed)
    d = prior(d, key, sec, order, {"_x1": ("lag", F.col("_x"))})
    d = rolling(d, key, sec, {out: (secs, "avg", F.col("_x") * F.col("_x1"))})
    return d.withColumn(out, F.coalesce(F.col(out), F.lit(0.0))).drop("_x", "_x1")


def burst(df, key, secs=300, flag_secs=600, flag_at=3, sec=SEC) -> DataFrame:
    """Earlier rows within ``secs`` and a flag for at least ``flag_at`` within ``flag_secs``."""
    d = rolling(df, key, sec, {"burst_n": (secs, "count", F.lit(1)), "_n": (flag_secs, "count", F.lit(1))})
    return d.withColumn("burst_flag", (F.col("_n") >= flag_at).cast("int")).drop("_n")


# ---- evolving quantiles ---------------------------------------------------------------------


def evolving_order_stat(df, key, sec, order, updates: Column, ranks: dict[str, Column], digits, base=32) -> DataFrame:
    """Order statistics of a changing multiset as of each row, exact and without collecting a key.

    After a row is read, its ``updates`` (array of structs ``code``, ``wt``) add ``wt`` copies of the
    integers ``code``.  ``ranks`` maps a new column to the 0-based rank asked for among the rows
    before; a null rank asks nothing.  One digit of each answer is found per round: an ask moves to
    the child digit that holds its rank, and the counts it needs are prior sums inside
    (key, digits so far), so a round is one bounded scan.  Rounds are cut by a reliable checkpoint.
    """
    keys = [key] if isinstance(key, str) else list(key)
    null = F.lit(None).cast("bigint")
    asks = [
        F.struct(F.lit(i).alias("q"), null.alias("code"), null.alias("wt"), rk.cast("bigint").alias("rank"))
        for i, rk in enumerate(ranks.values())
    ]
    adds = F.transform(
        updates,
        lambda u: F.struct(F.lit(len(ranks)).alias("q"), u["code"].cast("bigint").alias("code"),
                           u["wt"].cast("bigint").alias("wt"), null.alias("rank")),
    )
    oc = [f"_o{i}" for i in range(len(order))]
    d = df.select(
        *keys, F.col(sec).alias("_at"), *[F.col(o).alias(n) for o, n in zip(order, oc)],
        F.explode(F.concat(F.array(*asks), adds)).alias("_r"),
    ).select(*keys, "_at", *oc, "_r.*", F.lit(0).cast("bigint").alias("_pre"))
    d = d.where((F.col("q") == len(ranks)) | F.col("rank").isNotNull())
    is_ask = F.col("q") < len(ranks)
    for level in range(digits - 1, -1, -1):
        d = cut_lineage(d)
        digit = F.pmod(F.floor(F.col("code") / base**level), F.lit(base))
        d = prior(
            d, [*keys, "_pre"], "_at", [*oc, "q"],
            {f"_g{i}": ("sum", F.when(digit == i, F.col("wt"))) for i in range(base)},
        )
        counts = F.array(*[F.col(f"_g{i}") for i in range(base)])
        # walk the children, stepping over those that lie wholly below the rank
        start = F.struct(F.lit(0).alias("child"), F.col("rank").alias("left"), F.lit(False).alias("done"))

        def step(acc, n):
            done = acc["done"] | (acc["left"] < n)
            return F.struct(
                F.when(done, acc["child"]).otherwise(acc["child"] + 1).alias("child"),
                F.when(done, acc["left"]).otherwise(acc["left"] - n).alias("left"),
                done.alias("done"),
            )

        d = d.withColumn("_hit", F.when(is_ask, F.aggregate(counts, start, step)))
        d = d.withColumns(
            {
                "_pre": F.col("_pre") * base + F.when(is_ask, F.col("_hit.child")).otherwise(digit),
                "rank": F.when(is_ask, F.col("_hit.left")),
            }
        ).drop("_hit", *[f"_g{i}" for i in range(base)])
    got = d.where(is_ask).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], *oc).agg(
        *[F.max(F.when(F.col("q") == i, F.col("_pre"))).alias(n) for i, n in enumerate(ranks)]
    )
    on = None
    for x, y in [*[(k, f"_k_{k}") for k in keys], *zip(order, oc)]:
        on = F.col(x) == F.col(y) if on is None else on & (F.col(x) == F.col(y))
    return df.join(got, on, "left").drop(*[f"_k_{k}" for k in keys], *oc)


def _digits(largest: float, base=32) -> int:
    return max(1, math.ceil(math.log(largest + 2, base) - 1e-12))


def prior_median_gap(df, key, max_gap: int | None = None, out="prior_median_gap", sec=SEC, order=ORDER) -> DataFrame:
    """Median of the key's gaps that ended before this row; null until there is one.

    ``max_gap`` bounds the largest gap in seconds; by default it is read from the time range.
    """
    if max_gap is None:
        lo, hi = df.agg(F.min(sec), F.max(sec)).first()
        max_gap = 1 if lo is None else int(hi - lo)
    d = prior(df, key, sec, order, {"_prev": ("lag", F.col(sec)), "_i": ("count", F.lit(1))})
    d = d.withColumn("_gap", F.col(sec) - F.col("_prev")).withColumn("_n", F.col("_i") - 1)
    n = F.col("_n")
    update = F.struct(F.col("_gap").alias("code"), F.lit(1).alias("wt"))
    d = evolving_order_stat(
        d, key, sec, order,
        F.when(F.col("_gap").isNotNull(), F.array(update)).otherwise(F.slice(F.array(update), 1, 0)),
        {"_a": F.when(n > 0, F.floor((n - 1) / 2)), "_z": F.when(n > 0, F.floor(n / 2))},
        _digits(max_gap),
    )
    return d.withColumn(out, (F.col("_a") + F.col("_z")) / 2).drop("_gap", "_prev", "_i", "_n", "_a", "_z")


def whale_flag(df, market, wallet, amount, q=0.95, unit=0.01, max_total: float | None = None,
               out="whale", sec=SEC, order=ORDER) -> DataFrame:
    """Own prior volume at or above the q-quantile of all wallets' prior volumes in the market.

    The multiset of wallet volumes changes with every trade: it loses the wallet's old volume and
    gains the new one.  Volumes are compared in whole ``unit`` steps (cents).  No flag before
    ceil(1/(1-q)) wallets (at least 2) have traded.
    """
    if max_total is None:
        top = df.groupBy(market, wallet).agg(F.sum(amount).alias("v")).agg(F.max("v")).first()[0]
        max_total = float(top or 0.0)
    need = max(2, math.ceil(round(1 / max(1e-9, 1 - q), 9)))
    d = df.withColumn("_cents", F.round(F.col(amount) / unit).cast("bigint"))
    d = prior(d, [market, wallet], sec, order, {"_own": ("sum", F.col("_cents")), "_seen": ("count", F.lit(1))})
    d = prior(d, market, sec, order, {"_wallets": ("sum", (F.col("_seen") == 0).cast("int"))})
    pos = F.lit(q) * (F.col("_wallets") - 1)
    ready = F.col("_wallets") >= need
    take = F.struct(F.col("_own").alias("code"), F.lit(-1).alias("wt"))
    give = F.struct((F.col("_own") + F.col("_cents")).alias("code"), F.lit(1).alias("wt"))
    d = evolving_order_stat(
        d, market, sec, order,
        F.when(F.col("_seen") > 0, F.array(take, give)).otherwise(F.array(give)),
        {"_a": F.when(ready, F.floor(pos)), "_z": F.when(ready, F.ceil(pos))},
        _digits(max_total / unit),
    )
    frac = pos - F.floor(pos)
    tau = F.col("_a") * (1 - frac) + F.col("_z") * frac
    flag = F.coalesce((F.col("_own") >= tau).cast("int"), F.lit(0))
    return d.withColumn(out, flag).drop("_own", "_seen", "_cents", "_wallets", "_a", "_z")


# ---- keyed series (bounded: one row per period) ----------------------------------------------


def _series(key, t):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(t)


def rolling_rows(df, key, t, col, n, fn="avg", min_periods=None, out=None) -> DataFrame:
    """Statistic of the last n rows; null until ``min_periods`` (default n) values exist."""
    w = _series(key, t).rowsBetween(-(n - 1), 0)
    f = {"avg": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}[fn]
    need = n if min_periods is None else min_periods
    return df.withColumn(out or f"{fn}_{n}", F.when(F.count(col).over(w) >= need, f(col).over(w)))


def lags_leads(df, key, t, col, lags=(1, 3, 5, 7), horizons=(1, 7)) -> DataFrame:
    """Lagged values, next-step return and direction, and h-step forward returns."""
    w = _series(key, t)
    v = F.col(col)
    out = {f"lag_{n}": F.lag(col, n).over(w) for n in lags}
    out |= {f"fwd_{h}": F.lead(col, h).over(w) / v - 1 for h in horizons}
    out["up_next"] = (F.lead(col, 1).over(w) > v).cast("int")
    return df.withColumns(out)


def returns(df, key, t, col) -> DataFrame:
    """Percent change, log return and difference."""
    p = F.lag(col, 1).over(_series(key, t))
    v = F.col(col)
    return df.withColumns({"ret": v / p - 1, "log_ret": F.ln(v) - F.ln(p), "diff": v - p})


def cum_return(df, key, t, ret, out="cum_return") -> DataFrame:
    """Compounded return so far."""
    w = _series(key, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.expm1(F.sum(F.log1p(ret)).over(w)))


def drawdown(df, key, t, value) -> DataFrame:
    """Running peak, drawdown from it and the deepest drawdown so far."""
    w = _series(key, t).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.col(value) / F.col("peak") - 1)
    return d.withColumn("max_drawdown", F.min("drawdown").over(w))


def rolling_roi(df, key, t, ret, h, out="rolling_roi") -> DataFrame:
    """Compounded return over the last h rows; null until h rows exist."""
    w = _series(key, t).rowsBetween(-(h - 1), 0)
    return df.withColumn(out, F.when(F.count(ret).over(w) == h, F.expm1(F.sum(F.log1p(ret)).over(w))))


def reindex_ffill(df, key, day, cols, step="1 day") -> DataFrame:
    """One row per period between the key's first and last, values carried forward."""
    ends = df.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    spine = ends.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {step}"))).alias(day))
    w = _series(key, day).rowsBetween(Window.unboundedPreceding, 0)
    j = spine.join(df, [key, day], "left")
    return j.select(key, day, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])


def daily_drift(df, key, ts, y, min_n=50, width=7, min_periods=2) -> DataFrame:
    """Daily mean and size, thin days dropped, rolling mean over the remaining days."""
    d = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    d = d.where(F.col("n") >= min_n)
    return rolling_rows(d, key, "day", "mean", width, "avg", min_periods, "drift")


def temporal_fold(df, key, cuts=(0.6, 0.8), names=("train", "val", "test"), out="fold", sec=SEC, order=ORDER) -> DataFrame:
    """Fold label from the row's position inside its key, (row-1)/n against the cuts."""
    d = prior(df, key, sec, order, {"_i": ("count", F.lit(1))})
    sizes = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(sizes, F.col(key) == F.col("_k"), "left").drop("_k")
    pos = F.col("_i") / F.col("_n")
    c = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        c = F.when(pos < cut, name).otherwise(c)
    return d.withColumns({"position": pos, out: c}).drop("_i", "_n")


def pct_rank(df, score, by=(), out="pct_rank") -> DataFrame:
    """Average rank divided by n, ties share their mean rank."""
    s = value_counts_scan(df, score, by)
    rank = (F.col("n_below") + (F.col("n") + 1) / 2) / F.col("n_all")
    by_l = [by] if isinstance(by, str) else list(by)
    return join_scan(df, s.select(*by_l, score, rank.alias(out)), score, by_l)


def qcut(df, col, n, out="bucket") -> DataFrame:
    """Quantile buckets (right-closed, duplicate edges dropped), first bucket is 0.

    The n+1 edges are one row; they reach the rows as scalars.
    """
    qs = [i / n for i in range(n + 1)]
    names = [f"e{i}" for i in range(n + 1)]
    edges = quantiles(df, col, qs, names=names).agg(
        F.max(F.array_distinct(F.array(*names))).alias("e")
    ).scalar()
    d = df.withColumn("_e", edges)
    idx = F.size(F.filter(F.slice("_e", 2, n), lambda e: e < F.col(col)))
    return d.withColumn(out, F.when(F.col(col).isNotNull(), idx.cast("bigint"))).drop("_e")


def lock_time(df, key, price, sec=SEC, order=ORDER, lock=0.995, floor=0.9) -> DataFrame:
    """First time a price >= ``lock`` whose median of all prices from there on is >= ``floor``.

    A median is at least the floor when more than half of the values are; at exactly half it is the
    mean of the best value below and the least value above.  All four are scans from the end.
    """
    p = F.col(price)
    hi = p >= floor
    d = df.where(p.isNotNull()).withColumn("_rev", -F.col(sec))
    ordered = list(order)
    types = dict(df.dtypes)
    back = d.withColumns(
        {f"_r{i}": -(F.unix_micros(F.col(o).cast("timestamp")) if types[o].startswith("timestamp") else F.col(o)) for i, o in enumerate(ordered)}
    )
    s = prior(
        back, key, "_rev", [f"_r{i}" for i in range(len(ordered))],
        {
            "_n": ("count", F.lit(1)), "_h": ("sum", hi.cast("int")),
            "_best": ("max", F.when(~hi, p)), "_least": ("min", F.when(hi, p)),
        },
    )
    n = F.col("_n") + 1
    h = F.col("_h") + hi.cast("int")
    best = F.greatest(F.col("_best"), F.when(~hi, p))
    least = F.least(F.col("_least"), F.when(hi, p))
    ok = (h * 2 > n) | ((h * 2 == n) & ((best + least) / 2 >= floor))
    keys = [key] if isinstance(key, str) else list(key)
    return s.where((p >= lock) & ok).groupBy(*keys).agg(F.min(sec).alias("lock_sec"))
