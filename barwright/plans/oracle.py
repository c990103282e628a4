"""Comparison SQL building blocks: plain unpartitioned windows over the same tables."""

from __future__ import annotations

from barwright.operators.features import FeatureSpec


def bars(minutes: int, name: str = "bars", chain: bool = False) -> str:
    width = minutes * 60_000_000
    return f"""{'' if chain else 'WITH '}{name} AS (
  SELECT 'EVT' AS symbol, bar_index, make_timestamp(bar_index * {width}) AS ts,
         arg_min(value, o) AS open, max(value) AS high, min(value) AS low, arg_max(value, o) AS close,
         count(*)::DOUBLE AS tick_volume, arg_max(k, o) AS spread, count(DISTINCT user_id)::DOUBLE AS real_volume
  FROM (SELECT *, epoch_us(ts) // {width} AS bar_index, (epoch_us(ts), event_id) AS o,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
  GROUP BY bar_index)"""


def states(spec: FeatureSpec, source: str = "bars", name: str = "states", labels: bool = True) -> str:
    """CTEs from bars to the state/label frame (to be appended after a bars CTE)."""
    s = spec
    parts = ["*"]
    parts.append("close / nullif(lag(close) OVER w, 0) - 1 AS r1")
    parts.append("""greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr""")
    for k in s.lags:
        parts.append(f"CASE WHEN bar_index - lag(bar_index, {k}) OVER w = {k} "
                     f"THEN close / nullif(lag(close, {k}) OVER w, 0) - 1 END AS state_return_{k}")
    parts.append(f"coalesce(bar_index - lag(bar_index, {s.warmup}) OVER w = {s.warmup}, false) AS warm")

    def full(agg: str, over: str, n: int, ahead: bool = False) -> str:
        frame = f"ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING" if ahead else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
        w = f"OVER (ORDER BY bar_index {frame})"
        return f"CASE WHEN count({over}) {w} = {n} THEN {agg}({over}) {w} END"

    roll = [
        "high - low AS state_bar_range",
        f"CASE WHEN warm THEN {full('avg', 'tr', s.atr)} END AS state_atr",
        f"CASE WHEN warm THEN {full('stddev_pop', 'r1', s.vol_short)} END AS state_vol_short",
        f"CASE WHEN warm THEN {full('stddev_pop', 'r1', s.vol_long)} END AS state_vol_long",
        f"CASE WHEN warm THEN ({full('max', 'high', s.extreme)} - close) / nullif(close, 0) END AS state_dist_high",
        f"CASE WHEN warm THEN (close - {full('min', 'low', s.extreme)}) / nullif(close, 0) END AS state_dist_low",
        f"CASE WHEN warm THEN state_return_{s.momentum} END AS state_momentum",
    ]
    if labels:
        for h in s.horizons:
            ok = f"CASE WHEN lead(bar_index, {h}) OVER w - bar_index = {h} THEN"
            roll += [
                f"{ok} lead(close, {h}) OVER w / nullif(close, 0) - 1 END AS label_return_{h}",
                f"{ok} ({full('max', 'high', h, True)} - close) / nullif(close, 0) END AS label_up_{h}",
                f"{ok} ({full('min', 'low', h, True)} - close) / nullif(close, 0) END AS label_down_{h}",
                (f"{ok} {full('stddev_samp', 'r1', h, True)} END" if h > 1 else "NULL::DOUBLE") + f" AS label_vol_{h}",
                f"{ok} lead(spread, {h}) OVER w END AS label_spread_{h}",
                f"{ok} lead(ts, {h}) OVER w END AS label_source_ts_{h}",
            ]
    shift = s.minutes * 60_000_000
    return f""", {name}_a AS (SELECT {', '.join(parts)} FROM {source} WINDOW w AS (ORDER BY bar_index)),
{name}_b AS (SELECT *, {', '.join(roll)} FROM {name}_a WINDOW w AS (ORDER BY bar_index)),
{name} AS (SELECT *, make_timestamp(epoch_us(ts) + {shift}) AS decision_ts,
  make_timestamp(epoch_us(ts) + {shift} - 18000000000) AS local_ts,
  (hour(make_timestamp(epoch_us(ts) + {shift} - 18000000000)) * 60
   + minute(make_timestamp(epoch_us(ts) + {shift} - 18000000000)) - {s.opening_hour * 60})::BIGINT AS minute,
  strftime(make_timestamp(epoch_us(ts) + {shift} - 18000000000), '%Y-%m-%d') AS session_id,
  CASE WHEN NOT warm THEN 'UNAVAILABLE' WHEN state_momentum > state_vol_short THEN 'TREND_UP'
       WHEN state_momentum < -state_vol_short THEN 'TREND_DOWN' ELSE 'RANGE' END AS state_regime,
  spread AS state_spread_points, spread * {s.point} AS state_spread_price, tick_volume AS state_tick_volume,
  real_volume AS state_real_volume, ts AS state_max_source_ts FROM {name}_b)"""


def canon(*columns: str, version: str = "") -> str:
    """The canonical text of columns: lengths in front, a dash for what is missing."""
    head = [f"'{len(version)}:{version}'"] if version else []
    return " || ".join(head + [f"coalesce(length(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in columns])


def r(expression: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE"


def rs(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns)
