"""F: scalar column functions; everything is a Catalyst expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(c, lo=None, hi=None) -> Column:
    """Bound a value by constants; null stays null."""
    c = _c(c)
    out = c
    if lo is not None:
        out = F.when(c < lo, F.lit(lo).cast("double")).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi).cast("double")).otherwise(out)
    return out


def num_transforms(c) -> dict[str, Column]:
    """log1p of the value floored at 0, its inverse, tanh, root of the size, sign and size."""
    c = _c(c)
    low = F.greatest(c, F.lit(0.0))
    return {
        "log1p": F.log1p(low), "expm1": F.expm1(F.log1p(low)), "tanh": F.tanh(c), "root": F.sqrt(F.abs(c)),
        "sign": F.signum(c), "size": F.abs(c),
    }


def cyclical_time(ts) -> dict[str, Column]:
    """hour and weekday (Monday = 0) on the circle, and the flag 14 <= hour < 21 UTC."""
    ts = _c(ts)
    h, d = F.hour(ts), F.weekday(ts)
    a, b = h * (2 * math.pi / 24), d * (2 * math.pi / 7)
    return {
        "hour_sin": F.sin(a), "hour_cos": F.cos(a), "dow_sin": F.sin(b), "dow_cos": F.cos(b),
        "market_hours": ((h >= 14) & (h < 21)).cast("int"),
    }


def deadline_features(sec, deadline_sec) -> dict[str, Column]:
    """seconds to the deadline (at least 1), log1p of the hours, and nearness flags."""
    left = F.greatest(_c(deadline_sec) - _c(sec), F.lit(1).cast("bigint"))
    return {
        "ttd": left, "log_ttd_hours": F.log1p(left / 3600), "last_day": (left < 86400).cast("int"),
        "last_hour": (left < 3600).cast("int"), "last_5min": (left < 300).cast("int"),
    }


def probability_transforms(p, side_buy) -> dict[str, Column]:
    """variance, distance from the boundary, consensus, contrarian score and long-shot flag."""
    p, b = _c(p), _c(side_buy)
    strength = clip(F.abs(0.5 - p) * 2, 0, 1)
    score = clip((2 * b - 1) * (0.5 - p) * 2, -1, 1)
    return {
        "implied_variance": p * (1 - p), "boundary_distance": F.least(p, 1 - p), "consensus_strength": strength,
        "contrarian_score": score, "long_shot_buy": ((b == 1) & (p < 0.20)).cast("int"),
        "contrarian_strength": clip(strength * F.greatest(score, F.lit(0.0)), 0, 1),
    }


def payoff(p, side_buy) -> dict[str, Column]:
    """log payoff and risk/reward of the side taken, price bounded to [0.01, 0.99]."""
    p, buy = clip(_c(p), 0.01, 0.99), _c(side_buy) == 1
    lp = F.ln((1 - p) / p)
    return {
        "log_payoff": F.when(buy, lp).otherwise(-lp),
        "risk_reward": F.when(buy, (1 - p) / p).otherwise(p / (1 - p)),
    }


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
           "november", "december"]


def parse_deadline(text, fallback_year: int) -> Column:
    """date of "by March 7[, 2026]"; the year defaults, an impossible date is null."""
    t = F.lower(_c(text))
    pat = r"\bby\s+([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(t, pat, 1)).cast("int")
    year = F.coalesce(F.regexp_extract(t, pat, 3).try_cast("int"), F.lit(fallback_year))
    day = F.regexp_extract(t, pat, 2)
    iso = F.format_string("%04d-%02d-%s", year, month, F.lpad(day, 2, "0"))
    return F.when((month > 0) & (day != ""), F.try_to_date(iso, "yyyy-MM-dd"))


def string_list(c) -> Column:
    """Stringified list in either quoting style as array<string>."""
    return F.from_json(F.regexp_replace(_c(c), "'", '"'), "array<string>")


def winning_side(prices, deadline_sec, event_sec, tol=0.01) -> Column:
    """index of the outcome priced at 1 within ``tol``; else 0 when the event came by the
    deadline and 1 when it did not; null when neither is known."""
    p = F.transform(string_list(prices), lambda x: x.try_cast("double"))
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    d, e = _c(deadline_sec), _c(event_sec)
    return (
        F.when((a >= 1 - tol) & (b <= tol), 0)
        .when((b >= 1 - tol) & (a <= tol), 1)
        .when(d.isNotNull() & e.isNotNull(), F.when(e <= d, 0).otherwise(1))
    )


def label_correct(buy, side, winner) -> Column:
    """a buy is right on the winning side, a sell on the other; null while unresolved."""
    return F.when(
        _c(winner).isNotNull(),
        F.when(_c(buy) == 1, (_c(side) == _c(winner)).cast("int")).otherwise((_c(side) != _c(winner)).cast("int")),
    )


def is_yes(outcomes, win_idx) -> Column:
    """1 when the winning label of a ``;`` list is yes or true."""
    lab = F.lower(F.trim(F.get(F.split(_c(outcomes), ";"), _c(win_idx))))
    return lab.isin("yes", "true").cast("int")


def side_is_yes(side_buy, outcome_yes) -> Column:
    b, y = _c(side_buy), _c(outcome_yes)
    return b * y + (1 - b) * (1 - y)


def side_probability(p_yes, side_buy, outcome_yes) -> Column:
    """market probability of the side the trade is economically on."""
    return F.when(side_is_yes(side_buy, outcome_yes) == 1, _c(p_yes)).otherwise(1 - _c(p_yes))


def cost_edge(p_hat, p_side, floor=0.05) -> dict[str, Column]:
    """cost bounded to [floor, 1-floor] and edge = p_hat - cost."""
    cost = clip(_c(p_side), floor, 1 - floor)
    return {"cost": cost, "edge": _c(p_hat) - cost}


def bin_edges(c, edges: list[float], labels: list[str] | None = None, right=True) -> Column:
    """label of the interval holding the value; outside the edges is null."""
    c = _c(c)
    labels = labels or [str(i) for i in range(len(edges) - 1)]
    out = None
    for lo, hi, lab in zip(edges, edges[1:], labels):
        inside = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        out = F.when(inside, lab) if out is None else out.when(inside, lab)
    return out


def parse_number(c) -> Column:
    """numbers with thousands separators, leading dot, plus sign and K/M/B/T suffix."""
    t = F.regexp_replace(F.trim(_c(c)), r"[,\s]", "")
    # a leading dot in front of a full number is a stray mark, ".238.00" means 238.00
    t = F.regexp_replace(t, r"^\.(?=\d+\.\d)", "")
    t = F.regexp_replace(t, r"^\+", "")
    suffix = F.upper(F.regexp_extract(t, r"([KMBTkmbt])$", 1))
    factor = (
        F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).when(suffix == "T", 1e12)
        .otherwise(1.0)
    )
    return F.regexp_replace(t, r"[KMBTkmbt]$", "").try_cast("double") * factor


def signed_log(c) -> Column:
    """sign(x) * log1p(|x|)."""
    return F.signum(_c(c)) * F.log1p(F.abs(_c(c)))


def box_cox(c, lam: float) -> Column:
    """Box-Cox transform; lambda 0 is the logarithm."""
    return F.ln(_c(c)) if lam == 0 else (F.pow(_c(c), F.lit(float(lam))) - 1) / lam


def grade_rank(c, order: list[str]) -> Column:
    """position of a grade in its order (0 first), null for unknown grades."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), _c(c))
    return F.when(pos > 0, pos - 1)


def unit_hash(*ids, seed: int = 0) -> Column:
    """Uniform number in [0,1) from the first 12 hex digits of md5("id:...:seed"); any engine can repeat it."""
    key = F.concat_ws(":", *[_c(i).cast("string") for i in ids], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / float(16**12)
