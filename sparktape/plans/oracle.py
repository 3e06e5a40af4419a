"""ANSI SQL with the same meaning as each query of the catalogue, for an independent engine."""

from __future__ import annotations

from sparktape.plans.bindings import DEFAULTS as P
from sparktape.plans.catalogue import DYNAMIC, FAR, FAR_DYNAMIC, FOLDS, LATE_DELAY_MS, LATE_MS, LOG_KEYS, LOOSE, MANY, RANGE, SEARCH, SHORT, SIGNAL_ONLY
from sparktape.schema import Params

DAY = 86_400_000

TR = (
    "tr as (select event_type symbol, event_id a, epoch_us(ts) // 1000 t, value p, "
    "cast(json_extract_string(props, '$.k') as double) q from events)"
)
TR2 = (
    "tr2 as (select o_orderpriority symbol, o_orderkey a, epoch_us(o_orderdate) // 1000 t, o_totalprice p, "
    "cast(1 as double) q from orders)"
)


def ohlcv(source: str, width: int, order: str = "(t, a)", key: str = "symbol", extra: str = "") -> str:
    return (
        f"select {key}, (t // {width}) * {width} epoch_ms{extra}, round(arg_min(p, {order}), 8) open, "
        f"round(max(p), 8) high, round(min(p), 8) low, round(arg_max(p, {order}), 8) as close, "
        f"round(sum(q), 8) volume, count(*) trade_count from {source} group by all"
    )


CD = f"cd as ({ohlcv('tr', 3_600_000)})"
BASE = [TR, CD]
# cg: candles with gaps; cv: those of them that have a close.
GAPS = [
    "cg as (select * replace (case when (epoch_ms // 3600000) % 5 <> 2 then close end as close, "
    "case when (epoch_ms // 3600000) % 7 <> 3 then high end as high) from cd)",
    "cv as (select * from cg where close is not null)",
]


# The tape as its files keep it.
CENTS = (
    "select upper(symbol) symbol, a, t, round(p, 2) p, q, a first_id, a + 1 last_id, a % 2 = 0 is_maker, a % 7 = 0 is_best "
    "from tr"
)


# The tape as it is stored after every fifth day came a second time.
STORED = (
    f"st as (select symbol, a, t, round(p, 2) p, q * case when (t // {DAY}) % 5 = 2 then 2 else 1 end q, a first_id, a + 1 last_id, "
    f"a % 2 = 0 is_maker, a % 7 = 0 is_best, t // {DAY} as day from tr)"
)


def r(*names: str, places: int = 6) -> str:
    return ", ".join(f'round("{n}", {places}) + 0 as "{n}"' for n in names)


def r4(*names: str) -> str:
    return r(*names, places=4)


def sql(ctes: list[str], select: str) -> str:
    return f"with recursive {', '.join(ctes)} {select}"


def both(left: str, right: str, keys: list[str]) -> str:
    return " and ".join(f"{left}.{k} = {right}.{k}" for k in keys)


def values(name: str, column: str, items, kind: str) -> str:
    rows = ", ".join(f"(cast({v} as {kind}))" for v in items)
    return f"{name}({column}) as (values {rows})"


def sets(params: Params, tag: str = "") -> list[str]:
    ys = [params.y_max_s] if params.dynamic_y else params.ys
    return [
        values(f"xs{tag}", "x", params.xs, "double"),
        values(f"ys{tag}", "y", ys, "bigint"),
        values(f"zs{tag}", "z", params.zs, "double"),
        f"sets{tag} as (select cast(row_number() over (order by x, y, z) as int) combo_id, x, y, z "
        f"from xs{tag}, ys{tag}, zs{tag})",
    ]


def moves(params: Params, source: str = "cd", keys: list[str] | None = None, tag: str = "") -> list[str]:
    """mv: keys, epoch_ms, close, y, move, ya."""
    keys = keys or ["symbol"]
    k = ", ".join(keys)
    if params.dynamic_y:
        w = params.y_max_s * 1000
        ck = ", ".join(f"c.{x}" for x in keys)
        return [
            f"lo{tag} as (select {ck}, c.epoch_ms, c.close, min(p.close) low, "
            f"arg_min(p.epoch_ms, (p.close, p.epoch_ms)) low_ms from {source} c join {source} p on {both('c', 'p', keys)} "
            f"and p.epoch_ms >= c.epoch_ms - {w} and p.epoch_ms < c.epoch_ms group by all)",
            f"mv{tag} as (select {k}, epoch_ms, close, cast({params.y_max_s} as bigint) y, "
            f"(close - low) / low * 100.0 as move, (epoch_ms - low_ms) / 1000.0 as ya from lo{tag} "
            "where low < close and low <> 0)",
        ]
    return [
        f"cy{tag} as (select {source}.*, y from {source}, ys{tag})",
        f"pk{tag} as (select {k}, y, epoch_ms + y * 1000 as at_ms, close past from {source}, ys{tag})",
        f"mv{tag} as (select {', '.join(f'c.{x}' for x in keys)}, c.epoch_ms, c.close, c.y, "
        f"(c.close - p.past) / p.past * 100.0 as move, cast(null as double) ya from cy{tag} c asof join pk{tag} p on "
        f"{both('c', 'p', keys)} and c.y = p.y and c.epoch_ms >= p.at_ms where p.past <> 0)",
    ]


def exit_ctes(params: Params, source: str = "cd", keys: list[str] | None = None, tag: str = "") -> list[str]:
    """ex: keys, epoch_ms, ep, z, exit_ms, raw_exit, max_price, min_price, reason."""
    keys = keys or ["symbol"]
    k, ek = ", ".join(keys), ", ".join(f"e.{x}" for x in keys)
    sign = {"long": 1, "short": -1, "signal-only": 0}[params.direction]
    entry = f"close * (1.0 + cast({sign * params.slip} as double))" if sign else "close"
    return [
        f"en{tag} as (select distinct {k}, epoch_ms, {entry} as ep from mv{tag} where move >= {min(params.xs)})",
        f"la{tag} as (select {k}, max(epoch_ms) last_ms from {source} group by all)",
        f"hz{tag} as (select {ek}, e.epoch_ms, e.ep, f.epoch_ms mh, l.last_ms from en{tag} e asof left join {source} f "
        f"on {both('e', 'f', keys)} and e.epoch_ms + {params.hold_ms} <= f.epoch_ms "
        f"join la{tag} l on {both('e', 'l', keys)})",
        f"pa{tag} as (select {ek}, e.epoch_ms, f.epoch_ms at_ms, f.close, "
        f"greatest(e.ep, max(f.high) over w) mx, least(e.ep, min(f.low) over w) mn from hz{tag} e join {source} f "
        f"on {both('e', 'f', keys)} and f.epoch_ms > e.epoch_ms and f.epoch_ms <= coalesce(e.mh, e.last_ms) "
        f"window w as (partition by {ek}, e.epoch_ms order by f.epoch_ms))",
        f"dr{tag} as (select {k}, epoch_ms, z, min(at_ms) drop_ms from pa{tag}, zs{tag} where mx > 0 and "
        f"(mx - close) / mx * 100.0 >= z group by all)",
        f"xt{tag} as (select {ek}, e.epoch_ms, e.ep, s.z, coalesce(d.drop_ms, e.mh, e.last_ms) exit_ms, "
        f"case when d.drop_ms is not null then 'drop-z' when e.mh is not null then 'max-hold' else 'end-of-data' end "
        f"reason from hz{tag} e cross join zs{tag} s left join dr{tag} d on {both('e', 'd', keys)} "
        f"and e.epoch_ms = d.epoch_ms and s.z = d.z)",
        f"ex{tag} as (select {ek}, e.epoch_ms, e.ep, e.z, e.exit_ms, f.close raw_exit, "
        f"coalesce(p.mx, greatest(e.ep, f.high)) max_price, coalesce(p.mn, least(e.ep, f.low)) min_price, e.reason "
        f"from xt{tag} e join {source} f on {both('e', 'f', keys)} and e.exit_ms = f.epoch_ms "
        f"left join pa{tag} p on {both('e', 'p', keys)} and e.epoch_ms = p.epoch_ms and e.exit_ms = p.at_ms)",
    ]


def log_ctes(
    params: Params, source: str = "cd", keys: list[str] | None = None, tag: str = "", top: str | None = None
) -> list[str]:
    """tl: the trade log. ``top`` names a CTE (symbol, combo_id) limiting the sets."""
    keys = keys or ["symbol"]
    k, ek = ", ".join(keys), ", ".join(f"e.{x}" for x in keys)
    lane = [*keys, "combo_id"]
    size, fee = params.size, params.size * params.fee * 2.0
    out = {"long": -1, "short": 1, "signal-only": 0}[params.direction]
    leave = f"raw_exit * (1.0 + cast({out * params.slip} as double))" if out else "raw_exit"
    if params.direction == "long":
        fees, pnl = f"cast({fee} as double)", f"cast({size} as double) / ep * xp - {size} - {fee}"
        pct = f"({pnl}) / {size} * 100.0"
    elif params.direction == "short":
        fees, pnl = f"cast({fee} as double)", f"{size} - cast({size} as double) / ep * xp - {fee}"
        pct = f"({pnl}) / {size} * 100.0"
    else:
        fees, pnl, pct = "cast(0 as double)", "cast(0 as double)", "(xp - ep) / ep * 100.0"
    up = "greatest(0.0, (max_price - ep) / ep * 100.0)"
    down = "greatest(0.0, (ep - min_price) / ep * 100.0)"
    mae, mfe = (up, down) if params.direction == "short" else (down, up)
    limit = f" join {top} o on o.symbol = m.symbol and o.combo_id = s.combo_id" if top else ""
    return [
        *sets(params, tag),
        *moves(params, source, keys, tag),
        *exit_ctes(params, source, keys, tag),
        f"ca{tag} as (select {ek}, s.combo_id, s.x, s.y, s.z, e.epoch_ms, e.ep, e.exit_ms, e.raw_exit, e.max_price, "
        f"e.min_price, e.reason, m.ya from mv{tag} m join sets{tag} s on m.y = s.y and m.move >= s.x{limit} "
        f"join ex{tag} e on {both('m', 'e', keys)} and m.epoch_ms = e.epoch_ms and e.z = s.z)",
        f"nx{tag} as materialized (select {', '.join(f'a.{x}' for x in lane)}, a.epoch_ms, b.epoch_ms next_ms from ca{tag} a "
        f"asof left join ca{tag} b on {both('a', 'b', lane)} and a.exit_ms < b.epoch_ms)",
        f"wk{tag} as (select {k}, combo_id, min(epoch_ms) epoch_ms from ca{tag} group by all union all "
        f"select {', '.join(f'n.{x}' for x in lane)}, n.next_ms from wk{tag} w join nx{tag} n on {both('w', 'n', lane)} "
        f"and w.epoch_ms = n.epoch_ms where n.next_ms is not null)",
        f"tk{tag} as (select c.*, {leave} as xp from ca{tag} c join wk{tag} w on {both('c', 'w', lane)} "
        f"and c.epoch_ms = w.epoch_ms)",
        f"tl{tag} as (select {k}, combo_id, epoch_ms entry_ms, exit_ms, ep entry_price, xp exit_price, "
        f"max_price max_price_during_trade, min_price min_price_during_trade, {pnl} as pnl, {pct} as pnl_percent, "
        f"{fees} as fees, reason, x x_percent, y y_seconds, z z_percent, {mae} as mae_pct, {mfe} as mfe_pct, "
        f"ya y_actual_seconds from tk{tag})",
    ]


LOG = [*BASE, *log_ctes(P)]
LOG_COLUMNS = (
    "symbol, combo_id, entry_ms, exit_ms, reason, y_seconds, "
    + r(
        "entry_price", "exit_price", "max_price_during_trade", "min_price_during_trade", "pnl", "pnl_percent", "fees",
        "x_percent", "z_percent", "mae_pct", "mfe_pct", "y_actual_seconds",
    )
)


def log_sql(params: Params) -> str:
    return sql([*BASE, *log_ctes(params)], f"select {LOG_COLUMNS} from tl")


def falls(source: str, keys: str, pnl: str, order: str = "entry_ms", name: str = "dd") -> list[str]:
    """dd: keys, dd_u."""
    return [
        f"{name}1 as (select {keys}, {order} o, sum({pnl}) over (partition by {keys} order by {order}) cum from {source})",
        f"{name}2 as (select {keys}, max(cum) over (partition by {keys} order by o) - cum fall from {name}1)",
        f"{name} as (select {keys}, max(fall) dd_u from {name}2 group by all)",
    ]


def metric_ctes(params: Params, source: str = "tl", keys: str = "symbol, combo_id", tag: str = "") -> list[str]:
    """tm: trade metrics of key sets that have trades."""
    v = "pnl_percent" if params.direction == "signal-only" else "pnl"
    gain = f"coalesce(sum({v}) filter ({v} > 0), 0)"
    loss = f"abs(coalesce(sum({v}) filter ({v} < 0), 0))"
    return [
        *falls(source, keys, "pnl", name=f"dd{tag}"),
        f"tm{tag} as (select {keys}, count(*) total_trades, count(*) filter ({v} > 0) winning_trades, "
        f"count(*) filter ({v} <= 0) losing_trades, count(*) filter ({v} > 0) / count(*) * 100.0 win_rate, "
        f"sum(pnl) total_pnl, sum(pnl_percent) total_pnl_percent, avg({v}) average_pnl, max({v}) best_trade, "
        f"min({v}) worst_trade, case when {loss} = 0 then case when {gain} > 0 then 999.99 else 0 end "
        f"else {gain} / {loss} end profit_factor, avg(mae_pct) avg_mae, max(mae_pct) max_mae, avg(mfe_pct) avg_mfe, "
        f"max(mfe_pct) max_mfe, any_value(dd_u) / {params.capital} * 100.0 max_drawdown "
        f"from {source} join dd{tag} using ({keys}) group by {keys})",
    ]


METRIC_DOUBLES = [
    "win_rate", "total_pnl", "total_pnl_percent", "average_pnl", "best_trade", "worst_trade", "profit_factor", "avg_mae",
    "max_mae", "avg_mfe", "max_mfe", "max_drawdown",
]
METRIC_COUNTS = ["total_trades", "winning_trades", "losing_trades"]


def or_zero(names: list[str], places: int | None = None) -> str:
    if places is None:
        return ", ".join(f"coalesce({n}, 0) as {n}" for n in names)
    return ", ".join(f"round(coalesce({n}, 0), {places}) + 0 as {n}" for n in names)


SYMBOL_SETS = "ss as (select * from (select distinct symbol from cd), sets)"


def metrics_sql(params: Params) -> str:
    return sql(
        [*BASE, *log_ctes(params), *metric_ctes(params), SYMBOL_SETS],
        f"select symbol, combo_id, {or_zero(METRIC_COUNTS)}, {or_zero(METRIC_DOUBLES, 4)} "
        "from ss left join tm using (symbol, combo_id)",
    )


def merged_sql(params: Params) -> str:
    doubles = [*METRIC_DOUBLES, "sharpe_ratio", "expectancy", "avg_win", "avg_loss"]
    return sql(
        [*BASE, *log_ctes(params), *metric_ctes(params), *advanced_ctes(params, "tl", "symbol, combo_id")],
        f"select symbol, combo_id, {', '.join(METRIC_COUNTS)}, max_consecutive_losses, {r4(*doubles)} from tm join am using (symbol, combo_id)",
    )


def posthoc_ctes(params: Params, source: str, keys: str, pnl: str) -> list[str]:
    """ph: post-hoc metrics."""
    return [
        *falls(source, keys, pnl),
        f"ph0 as (select {keys}, count(*) n, count(*) filter ({pnl} > 0) nw, count(*) filter ({pnl} <= 0) nl, "
        f"coalesce(avg({pnl}) filter ({pnl} > 0), 0) avg_w, coalesce(avg({pnl}) filter ({pnl} <= 0), 0) avg_l, "
        f"coalesce(sum({pnl}) filter ({pnl} > 0), 0) gp, coalesce(sum({pnl}) filter ({pnl} <= 0), 0) gl, "
        f"sum({pnl}) total, max({pnl}) best, min({pnl}) worst from {source} group by all)",
        f"ph as (select ph0.*, dd_u, dd_u / {params.capital} * 100.0 dd_p, nw / n * 100.0 wr, "
        "case when gl < 0 then gp / abs(gl) when gp > 0 then 999.0 else 0.0 end pf, "
        "nw / n * avg_w + (1 - nw / n) * avg_l expect "
        f"from ph0 join dd using ({keys}))",
    ]


def screen_ctes(params: Params, source: str = "tl", tag: str = "", all_sets: str = "ss") -> list[str]:
    """sc: screening sums with zero rows; sd: derived and rounded."""
    v = "pnl_percent" if params.direction == "signal-only" else "pnl"
    actual = ", avg(y_actual_seconds) avg_y_actual" if params.dynamic_y else ""
    money = ["total_pnl", "gross_profit", "gross_loss", "best_trade", "worst_trade"]
    extra = ["avg_y_actual"] if params.dynamic_y else []
    wr = "case when total_trades > 0 then winning_trades / total_trades * 100.0 else 0 end"
    aw = "case when winning_trades > 0 then gross_profit / winning_trades else 0 end"
    al = "case when losing_trades > 0 then gross_loss / losing_trades else 0 end"
    dev = "case when best_trade > worst_trade then (best_trade - worst_trade) / 4.0 else 1.0 end"
    return [
        f"sc{tag}0 as (select symbol, combo_id, count(*) total_trades, count(*) filter ({v} > 0) winning_trades, "
        f"count(*) filter ({v} <= 0) losing_trades, sum({v}) total_pnl, sum({v}) filter ({v} > 0) gross_profit, "
        f"sum({v}) filter ({v} <= 0) gross_loss, max({v}) best_trade, min({v}) worst_trade{actual} "
        f"from {source} group by symbol, combo_id)",
        f"sc{tag} as (select symbol, combo_id, x, y, z, {or_zero(METRIC_COUNTS + money + extra)} from {all_sets} "
        f"left join sc{tag}0 using (symbol, combo_id))",
        f"sd{tag} as (select symbol, combo_id, x, y, z, total_trades, winning_trades, losing_trades, {r(*money)}, "
        f"round({wr}, 2) win_rate, round(case when gross_loss <> 0 then gross_profit / abs(gross_loss) "
        f"when gross_profit > 0 then 999.99 else 0 end, 4) profit_factor, round({aw}, 6) avg_win, "
        f"round({al}, 6) + 0 avg_loss, round(({wr}) / 100.0 * ({aw}) - (1 - ({wr}) / 100.0) * abs({al}), 6) + 0 expectancy, "
        f"round(abs(worst_trade) / {params.capital} * 100.0, 4) max_drawdown, "
        f"round(case when total_trades > 1 then total_pnl / total_trades / ({dev}) else 0 end, 4) + 0 sharpe_ratio "
        f"from sc{tag})",
    ]


SCORE = (
    "round(total_pnl * 0.4 + least(profit_factor, 10.0) * 0.3 + win_rate / 100.0 * 0.2 - max_drawdown * 0.3, 6)"
)
PASSES = (
    f"(total_trades >= {LOOSE.min_trades} and win_rate >= {LOOSE.min_win_rate} and "
    f"profit_factor >= {LOOSE.min_profit_factor} and max_drawdown <= {LOOSE.max_drawdown})"
)
SCREEN = [*LOG, SYMBOL_SETS, *screen_ctes(P)]


def ranked(source: str, name: str, top_n: int, where: str = "true") -> str:
    return (
        f"{name} as (select *, row_number() over (partition by symbol order by score desc, combo_id) as rank "
        f"from (select *, {SCORE} as score from {source} where {where}) qualify rank <= {top_n})"
    )


PARTS = (
    "pt as (select c.* exclude (n, rn, b), case when epoch_ms < b then 'train' else 'validation' end part from "
    "(select *, max(case when rn = cast(floor(n * cast(0.7 as double)) as bigint) then epoch_ms end) over (partition by symbol) b "
    "from (select *, count(*) over (partition by symbol) n, "
    "row_number() over (partition by symbol order by epoch_ms) - 1 rn from cd)) c)"
)


def advanced_ctes(params: Params, source: str, keys: str, tag: str = "") -> list[str]:
    """am: advanced metrics."""
    v = "pnl_percent" if params.direction == "signal-only" else "pnl"
    return [
        f"st{tag}1 as (select {keys}, {v} v, sum(case when {v} > 0 then 1 else 0 end) over (partition by {keys} "
        f"order by entry_ms) g from {source})",
        f"st{tag}2 as (select {keys}, g, count(*) filter (v <= 0) len from st{tag}1 group by all)",
        f"st{tag} as (select {keys}, max(len) max_consecutive_losses from st{tag}2 group by all)",
        f"am{tag}0 as (select {keys}, avg({v}) m, stddev_pop({v}) s, "
        f"round(coalesce(avg({v}) filter ({v} > 0), 0), 6) avg_win, "
        f"round(coalesce(avg({v}) filter ({v} <= 0), 0), 6) + 0 avg_loss, count(*) filter ({v} > 0) / count(*) wr "
        f"from {source} group by all)",
        f"am{tag} as (select {keys}, round(case when s > 0 then m / s else 0 end, 4) + 0 sharpe_ratio, "
        f"round(wr * avg_win + (1 - wr) * avg_loss, 6) + 0 expectancy, avg_win, avg_loss, max_consecutive_losses "
        f"from am{tag}0 join st{tag} using ({keys}))",
    ]


def validate_ctes() -> list[str]:
    """vc: the comparison of the best train sets, all columns."""
    counts = [*METRIC_COUNTS, "max_consecutive_losses"]
    doubles = [*METRIC_DOUBLES, "sharpe_ratio", "expectancy", "avg_win", "avg_loss"]
    sides = []
    for side in ("train", "validation"):
        sides += [f"coalesce(max({c}) filter (part = '{side}'), 0) {side}_{c}" for c in counts]
        sides += [f"coalesce(max({c}) filter (part = '{side}'), 0.0) {side}_{c}" for c in doubles]
    keys = "symbol, part, combo_id"
    return [
        *BASE,
        PARTS,
        "trn as (select * exclude (part) from pt where part = 'train')",
        *log_ctes(LOOSE, "trn", tag="a"),
        "ss as (select * from (select distinct symbol from trn), setsa)",
        *screen_ctes(LOOSE, "tla"),
        ranked("sd", "tp", LOOSE.top_n, PASSES),
        *log_ctes(LOOSE, "pt", ["symbol", "part"], "b", "tp"),
        *metric_ctes(LOOSE, "tlb", keys),
        *advanced_ctes(LOOSE, "tlb", keys),
        "tq as (select symbol, combo_id, x, y, z, score, rank from tp)",
        f"vc0 as (select t.symbol, t.combo_id, t.x, t.y, t.z, t.score, t.rank, {', '.join(sides)} from tq t "
        f"left join (select * from tm join am using ({keys})) d on t.symbol = d.symbol and t.combo_id = d.combo_id "
        "group by all)",
        "vc as (select *, case when train_total_pnl <= 0 then 'WEAK' when validation_total_pnl > 0 then 'ROBUST' "
        "else 'OVERFIT' end verdict from vc0)",
    ]


COMPARE_DOUBLES = [
    f"{side}_{c}"
    for side in ("train", "validation")
    for c in [*METRIC_DOUBLES, "sharpe_ratio", "expectancy", "avg_win", "avg_loss"]
]
COMPARE_COUNTS = [
    f"{side}_{c}" for side in ("train", "validation") for c in [*METRIC_COUNTS, "max_consecutive_losses"]
]

STOPS = "sl(level) as (values (1.0::double), (2.0), (3.0), (4.0), (5.0), (7.0), (10.0))"


def stop_ctes(direction: str) -> list[str]:
    """sp: the log under each stop level."""
    if direction == "short":
        stop, hit = "entry_price * (1.0 + level / 100.0)", "max_price_during_trade >= stop"
        pnl = f"{P.size} - {P.size} / entry_price * stop - fees"
    else:
        stop, hit = "entry_price * (1.0 - level / 100.0)", "min_price_during_trade <= stop"
        pnl = f"{P.size} / entry_price * stop - {P.size} - fees"
    return [
        *LOG,
        STOPS,
        f"sp0 as (select *, {stop} as stop from tl, sl)",
        f"sp as (select *, {hit} as sl_triggered, case when {hit} then {pnl} else pnl end new_pnl, "
        f"case when {hit} then ({pnl}) / {P.size} * 100.0 else pnl_percent end new_pnl_percent from sp0)",
    ]


def impact_ctes(direction: str) -> list[str]:
    """im: impact per stop level."""
    levels = "symbol, combo_id, level"
    return [
        *stop_ctes(direction),
        "al as (select symbol, combo_id, entry_ms, level, sl_triggered, pnl, new_pnl from sp union all "
        "select symbol, combo_id, entry_ms, 0.0, false, pnl, pnl from tl)",
        *posthoc_ctes(P, "al", levels, "new_pnl"),
        f"ht as (select {levels}, count(*) filter (sl_triggered) triggered, "
        "count(*) filter (sl_triggered and pnl > 0) cut_winners, "
        f"count(*) filter (sl_triggered and pnl <= 0) saved_losers from al group by all)",
        "im as (select p.*, triggered, cut_winners, saved_losers, p.total - b.total d_pnl, p.dd_p - b.dd_p d_dd_p "
        f"from ph p join ht using ({levels}) join ph b on b.symbol = p.symbol and b.combo_id = p.combo_id and "
        "b.level = 0 where p.level > 0)",
    ]


def impact_sql(direction: str) -> str:
    return sql(
        impact_ctes(direction),
        "select symbol, combo_id, level, triggered, cut_winners, saved_losers, "
        + r4("wr", "total", "d_pnl", "avg_w", "avg_l", "pf", "dd_p", "d_dd_p", "worst")
        + " from im",
    )


PROFILE = [
    *LOG,
    "pr as (select *, mfe_pct > mae_pct mfe_gt_mae, "
    "case when mfe_pct + mae_pct > 0 then mfe_pct / (mfe_pct + mae_pct) else 0.5 end quality from tl)",
]

HELD = [
    *LOG,
    "hd(hold_s) as (values (7200::bigint), (14400), (28800), (86400))",
    "h0 as (select tl.*, hold_s, entry_ms + hold_s * 1000 at_ms from tl, hd)",
    f"hl as (select h.*, ({P.size} - {P.size} / h.entry_price * (c.close * (1.0 + cast({P.slip} as double))) "
    f"- cast({P.fee} as double) * {P.size} * 2) / {P.size} * 100.0 pnl_at from h0 h asof left join cd c "
    "on h.symbol = c.symbol and h.at_ms <= c.epoch_ms)",
]

def timed_ctes(log: str) -> list[str]:
    """tt: seconds from each entry of ``log`` to each target."""
    return [
        "tg(target) as (values (0.5::double), (1.0), (2.0), (3.0))",
        "tt as (select t.symbol, t.combo_id, t.entry_ms, g.target, "
        f"(min(c.epoch_ms) - t.entry_ms) / 1000.0 as seconds from {log} t cross join tg g left join cd c on c.symbol = t.symbol "
        f"and c.epoch_ms >= t.entry_ms and c.epoch_ms <= t.entry_ms + {3 * DAY} "
        "and c.close <= t.entry_price * (1 - g.target / 100.0) group by t.symbol, t.combo_id, t.entry_ms, g.target)",
    ]


TIMED = [*LOG, *timed_ctes("tl")]


def late_ctes() -> list[str]:
    return [*LOG, f"lt as (select * replace (entry_ms + {LATE_MS} as entry_ms) from tl)", *timed_ctes("lt")]


SPANS = (
    f"us as (select user_id, (epoch_us(min(ts)) // 1000 // {DAY}) * {DAY} start_ms, epoch_us(max(ts)) // 1000 + 1 end_ms "
    "from events group by 1)"
)
USER_DAYS = (
    f"ud as (select user_id, unnest(generate_series(start_ms, end_ms - 1, {DAY})) day_start, end_ms from us)"
)
STATS = "".join(
    f", {f}({c}){w} {c}_{n}_{g}"
    for g, w in (("all", ""), ("win", " filter (pnl_percent > 0)"), ("lose", " filter (pnl_percent <= 0)"))
    for c in ("mae_pct", "mfe_pct")
    for f, n in (("avg", "mean"), ("stddev_samp", "std"))
)
STAT_NAMES = [
    f"{c}_{n}_{g}" for g in ("all", "win", "lose") for c in ("mae_pct", "mfe_pct") for n in ("mean", "std")
]


def fold_sql() -> str:
    k = 4
    return sql(
        [
            TR2,
            "o as (select symbol, t, row_number() over (partition by symbol order by t) - 1 rn, "
            "count(*) over (partition by symbol) n from tr2)",
            f"e as (select symbol, f.fold, max(t) filter (rn = f.fold * (n // {k + 1})) b from o, "
            f"(select unnest(generate_series(1, {k})) fold) f group by all)",
            "w as (select symbol, fold, b, lead(b) over (partition by symbol order by fold) nb from e)",
            "m as (select o.symbol, w.fold, t, case when t < b then 'train' when nb is null or t < nb then 'validation' "
            "end part from o join w using (symbol))",
            "g as (select symbol, fold, part, count(*) as rows, min(t) first_ms, max(t) last_ms from m "
            "where part is not null group by all)",
        ],
        "select symbol, cast(fold as bigint) fold, part, rows, first_ms, last_ms, "
        "round(rows / sum(rows) over (partition by symbol, fold) * 100.0, 1) pct from g",
    )


def fold_parts() -> list[str]:
    """pt: candles by fold and part."""
    return [
        "o as (select *, row_number() over (partition by symbol order by epoch_ms) - 1 rn, count(*) over (partition by symbol) n from cd)",
        f"e as (select symbol, f.fold, max(epoch_ms) filter (rn = f.fold * (n // {FOLDS + 1})) b from o, "
        f"(select unnest(generate_series(1, {FOLDS})) fold) f group by all)",
        "w as (select symbol, fold, b, lead(b) over (partition by symbol order by fold) nb from e)",
        "pt as (select cd.*, w.fold, case when epoch_ms < b then 'train' else 'validation' end part from cd join w using (symbol) "
        "where nb is null or epoch_ms < nb)",
    ]


def fold_compare_sql() -> str:
    keys = "symbol, fold, part, combo_id"
    counts, doubles = [*METRIC_COUNTS, "max_consecutive_losses"], [*METRIC_DOUBLES, "sharpe_ratio", "expectancy", "avg_win", "avg_loss"]
    sides = [f"max({c}) filter (part = '{side}') {side}_{c}" for side in ("train", "validation") for c in counts + doubles]
    return sql(
        [
            *BASE,
            *fold_parts(),
            *log_ctes(P, "pt", ["symbol", "fold", "part"]),
            *metric_ctes(P, "tl", keys),
            *advanced_ctes(P, "tl", keys),
            f"fs as (select symbol, fold, combo_id, {', '.join(sides)} from tm join am using ({keys}) group by all)",
            f"ev as (select * from (select distinct symbol from cd), (select unnest(generate_series(1, {FOLDS})) fold), sets)",
        ],
        f"select symbol, fold, combo_id, x, y, z, {or_zero([f'{s}_{c}' for s in ('train', 'validation') for c in counts])}, "
        f"{or_zero([f'{s}_{c}' for s in ('train', 'validation') for c in doubles], 4)}, case when coalesce(train_total_pnl, 0) <= 0 then 'WEAK' "
        "when validation_total_pnl > 0 then 'ROBUST' else 'OVERFIT' end verdict from ev left join fs using (symbol, fold, combo_id)",
    )


def fold_log_sql() -> str:
    from dataclasses import replace

    texts = {"combo_id", "entry_ms", "exit_ms", "reason"}
    columns = ", ".join(c if c in texts else f"round({c}, 6) {c}" for c in LOG_KEYS)
    return sql([*BASE, *fold_parts(), *log_ctes(replace(FAR, zs=(99.9,)), "pt", ["symbol", "fold", "part"])], f"select symbol, fold, part, {columns} from tl")


def plain(column: str) -> str:
    return f"regexp_replace(printf('%.10f', {column}), '\\.?0+$', '') as {column}"


RUNS = sql(
    [
        TR2,
        f"b as (select *, lag((t // {365 * DAY})) over (partition by symbol order by a) pb from tr2)",
        f"c as (select *, cast(sum(case when pb = t // {365 * DAY} then 0 else 1 end) over (partition by symbol "
        "order by a) as bigint) run from b)",
    ],
    ohlcv("c", 365 * DAY, "a", extra=", run"),
)
# Late are trades whose hour ended before the newest trade of all earlier deliveries, less the delay.
LATE = (
    f"dl as (select * from tr where a % 2 = 0 or (t // 3600000 + 1) * 3600000 > (select max(p.t) from tr p where p.a % 2 = 0 "
    f"or tr.a % 4 = 3 and p.a % 4 = 1) - {LATE_DELAY_MS})"
)


def oracle_sql() -> dict[str, str]:
    return {
        "streamed_runs": RUNS,
        "merged_metrics": merged_sql(P),
        "merged_metrics_signal_only": merged_sql(SIGNAL_ONLY),
        "signal_bounds": sql(
            [*BASE, *sets(MANY), *moves(MANY), "sg as (select symbol, x, y, count(*) signals from mv join xs on move >= x group by all)"],
            f"select symbol, x, y, signals, case when signals >= {MANY.min_trades} then {len(MANY.zs)} else 0 end sets from sg",
        ),
        "screen_ranked_bounded": sql(
            [*BASE, *log_ctes(MANY), SYMBOL_SETS, *screen_ctes(MANY), ranked("sd", "rk", MANY.top_n, f"{PASSES} and total_trades >= {MANY.min_trades}")],
            f"select symbol, rank, combo_id, x, y, z, total_trades, {r4('score')} from rk",
        ),
        "kfold_compare": fold_compare_sql(),
        "kfold_log": fold_log_sql(),
        "streamed_late": sql([TR, LATE], ohlcv("dl", 3_600_000)),
        "restated_candles": sql(
            [TR, f"cd as ({ohlcv('tr', 3_600_000)})", "v as (select symbol, t // 3600000 * 3600000 epoch_ms, "
             "count(distinct case when a % 2 = 0 then 0 else a % 4 end) - 1 restated from tr group by all)"],
            "select cd.*, restated from cd join v using (symbol, epoch_ms)",
        ),
        "ohlcv": sql([TR], ohlcv("tr", 3_600_000)),
        "ohlcv_ties": sql([TR2], ohlcv("tr2", DAY)),
        "ohlcv_runs": RUNS,
        "coverage_span": sql(
            BASE,
            "select *, round(candles / nullif(expected, 0), 6) coverage from (select symbol, count(*) candles, "
            "min(epoch_ms) first_ms, max(epoch_ms) last_ms, case when count(*) < 2 then count(*) else "
            "(max(epoch_ms) - min(epoch_ms)) // 3600000 end expected from cd group by 1)",
        ),
        "interval_cover": sql(
            [
                "s as (select o_orderpriority, o_custkey, epoch_ms(min(o_orderdate)) start_ms, "
                f"epoch_ms(max(o_orderdate)) + {DAY} end_ms from orders group by 1, 2)",
                "h as (select * from s where start_ms < epoch_ms(timestamp '2000-06-01') "
                "and end_ms > epoch_ms(timestamp '1995-06-01'))",
            ],
            "select * from h f where not exists (select 1 from h s where s.o_orderpriority = f.o_orderpriority and "
            "s.start_ms <= f.start_ms and s.end_ms >= f.end_ms and (s.end_ms - s.start_ms > f.end_ms - f.start_ms or "
            "(s.end_ms - s.start_ms = f.end_ms - f.start_ms and s.o_custkey < f.o_custkey)))",
        ),
        "day_coverage": sql(
            [SPANS, USER_DAYS],
            "select user_id, day_start day_ms, exists(select 1 from events e where e.user_id = ud.user_id and "
            f"epoch_us(e.ts) // 1000 >= day_start and epoch_us(e.ts) // 1000 < day_start + {DAY}) present from ud",
        ),
        "split_days": sql(
            [SPANS, USER_DAYS], f"select user_id, day_start, least(day_start + {DAY}, end_ms) day_end from ud"
        ),
        "hour_windows": sql(
            [
                SPANS,
                USER_DAYS,
                f"dw as (select day_start, least(day_start + {DAY}, end_ms) day_end from ud)",
                "hw as (select day_end, unnest(generate_series(day_start, day_end - 1, 3600000)) window_start from dw)",
            ],
            "select window_start, least(window_start + 3600000, day_end) window_end, count(*) users from hw group by 1, 2",
        ),
        "merge_days": sql(
            [TR],
            f"select symbol, (t // {DAY}) * {DAY} day_ms, count(*) as rows, cast(sum(count(*)) over (partition by symbol "
            f"order by (t // {DAY}) * {DAY}) as bigint) running_rows from tr group by 1, 2",
        ),
        "normalize_ts": sql([TR], "select a, t from tr"),
        "floor_bucket": sql([TR], "select a, (t // 1000) * 1000 epoch_ms from tr"),
        "iso_format": sql(
            [TR],
            "select a, strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') iso, "
            "strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day, t / 1000.0 epoch_seconds from tr",
        ),
        "date_to_ms": sql([TR2], "select a, t from tr2"),
        "parse_price": "select event_id a, case when value >= 5 then value end p from events",
        "parse_tape_lines": sql(
            [TR],
            "select symbol, a, t, p, q, a first_id, a + 1 last_id, a % 2 = 0 is_maker, "
            "case when a % 5 <> 0 then a % 7 = 0 end is_best from tr where a % 11 <> 0 and a % 13 <> 0 and a % 17 <> 0",
        ),
        "parse_bulk_rows": sql(
            [TR],
            "select symbol, a, t, p, q, a first_id, a + 1 last_id, a % 2 = 0 is_maker, a % 5 = 0 or a % 7 = 0 is_best "
            "from tr where a % 11 <> 0 and a % 13 <> 0",
        ),
        "tape_file": sql([TR], CENTS),
        "tape_file_range": sql([TR], f"{CENTS} where t >= {RANGE[0]} and t < {RANGE[1]}"),
        "stored_range": sql(
            [TR, STORED], f"select * exclude (day) from st where t >= {RANGE[0]} and t < {RANGE[1]}"
        ),
        "stored_totals": sql(
            [TR, STORED],
            "select symbol, strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') as day, count(*) as rows, min(t) first_ms, "
            "max(t) last_ms, min(a) first_id, max(a) last_id, round(sum(q), 8) volume, cast(sum(count(*)) over "
            "(partition by symbol order by day) as bigint) running_rows from st group by symbol, day",
        ),
        "bulk_file": sql([TR], CENTS),
        "candle_file": sql(BASE, "select * replace (upper(symbol) as symbol) from cd"),
        "trade_log_file": sql(
            LOG,
            f"select * exclude (y_actual_seconds) replace (upper(symbol) as symbol) from (select {LOG_COLUMNS}, "
            "(exit_ms - entry_ms) / 1000.0 as hold_seconds from tl)",
        ),
        "streamed_candles": sql([TR], ohlcv("tr", 3_600_000)),
        "plain_decimal": sql(
            BASE,
            "select symbol, strftime(make_timestamp(epoch_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp, "
            + ", ".join(plain(c) for c in ("open", "high", "low", "close", "volume"))
            + ', trade_count as "tradeCount" from cd',
        ),
        "slippage_pnl": sql(
            [
                *BASE,
                "c as (select symbol, epoch_ms, open, close from cd where open > 0)",
                f"d as (select symbol, epoch_ms, 'long' direction, open * (1.0 + {P.slip}::double) ep, "
                f"close * (1.0 - {P.slip}::double) xp from c union all select symbol, epoch_ms, 'short', "
                f"open * (1.0 - {P.slip}::double), close * (1.0 + {P.slip}::double) from c union all "
                "select symbol, epoch_ms, 'signal-only', open, close from c)",
                "e as (select *, case direction when 'long' then 100.0 / ep * xp - 100.0 - 0.2 "
                "when 'short' then 100.0 - 100.0 / ep * xp - 0.2 else 0 end pnl from d)",
                "f as (select symbol, epoch_ms, direction, ep entry_price, xp exit_price, "
                "case direction when 'signal-only' then 0.0::double else 0.2::double end fees, pnl, "
                "case direction when 'signal-only' then (xp - ep) / ep * 100.0 else pnl / 100.0 * 100.0 end pct from e)",
            ],
            "select symbol, epoch_ms, direction, entry_price, exit_price, fees, pnl, pct from f",
        ),
        "mae_mfe": sql(
            [
                *BASE,
                "u as (select symbol, epoch_ms, open, high, low, "
                "case when open > 0 then greatest(0.0, (high - open) / open * 100.0) else 0.0 end up, "
                "case when open > 0 then greatest(0.0, (open - low) / open * 100.0) else 0.0 end down from cd)",
                "m as (select symbol, epoch_ms, open entry_price, high max_price_during_trade, low min_price_during_trade, "
                "'long' direction, down mae_pct, up mfe_pct from u union all "
                "select symbol, epoch_ms, open, high, low, 'short', up, down from u)",
                "v as (select *, mfe_pct > mae_pct mfe_gt_mae, "
                "case when mfe_pct + mae_pct > 0 then mfe_pct / (mfe_pct + mae_pct) else 0.5 end quality from m)",
            ],
            "select * from v",
        ),
        "symbol_list": (
            "select symbol, count(*) n, count(distinct user_id) users from (select user_id, "
            "upper(event_type) symbol from events union all select user_id, cast(user_id as varchar) from events) group by 1"
        ),
        "range_extract": sql(
            [TR, f"k as (select * from tr where t >= {RANGE[0]} and t < {RANGE[1]})"], ohlcv("k", 3_600_000)
        ),
        "range_counts": sql(
            [TR],
            f"select symbol, count(*) filter (t >= {RANGE[0]} and t < {RANGE[1]}) kept, "
            f"count(*) filter (t < {RANGE[0]} or t >= {RANGE[1]}) skipped from tr group by 1",
        ),
        "trade_in_window": sql(
            [
                TR,
                "h as (select symbol, (t // 1800000) * 1800000 t from tr)",
                f"w as (select distinct (t // {DAY}) * {DAY} + i * 3600000 ws, (t // {DAY}) * {DAY} ds from h, "
                "(select unnest(generate_series(0, 23)) i))",
            ],
            "select symbol, ws window_start, count(*) n from h join w on t >= ws and t <= ws + 3600000 and "
            f"t >= ds and t < ds + {DAY} group by 1, 2",
        ),
        "dedupe_trades": sql([TR], "select symbol, a, t, p, q from tr"),
        "asof_back": sql(
            BASE,
            "select c.symbol, c.epoch_ms, c.close, a.close past_0, b.close past_1 from cd c "
            "asof left join (select symbol, epoch_ms + 7200000 at_ms, close from cd) a on c.symbol = a.symbol "
            "and c.epoch_ms >= a.at_ms asof left join (select symbol, epoch_ms + 21600000 at_ms, close from cd) b "
            "on c.symbol = b.symbol and c.epoch_ms >= b.at_ms",
        ),
        "asof_back_far": sql(
            BASE,
            "select c.symbol, c.epoch_ms, c.close, a.close past_0 from cd c asof left join (select symbol, "
            f"epoch_ms + {3 * DAY} at_ms, close from cd) a on c.symbol = a.symbol and c.epoch_ms >= a.at_ms",
        ),
        "asof_forward": sql(
            BASE,
            "select l.symbol, l.epoch_ms, l.at_ms, f.close from (select symbol, epoch_ms, epoch_ms + 7200000 at_ms from cd) l "
            "asof left join cd f on l.symbol = f.symbol and l.at_ms <= f.epoch_ms",
        ),
        "sliding_argmin": sql(
            [
                *BASE,
                "m as (select c.symbol, c.epoch_ms, c.close, min(p.close) lc, arg_min(p.epoch_ms, (p.close, p.epoch_ms)) lm "
                "from cd c left join cd p on p.symbol = c.symbol and p.epoch_ms >= c.epoch_ms - 21600000 "
                "and p.epoch_ms < c.epoch_ms group by all)",
            ],
            "select symbol, epoch_ms, close, case when lc < close then lc end low_close, "
            "case when lc < close then lm end low_ms from m",
        ),
        "sliding_argmin_far": sql(
            [
                *BASE,
                "m as (select c.symbol, c.epoch_ms, c.close, min(p.close) lc, arg_min(p.epoch_ms, (p.close, p.epoch_ms)) lm "
                f"from cd c left join cd p on p.symbol = c.symbol and p.epoch_ms >= c.epoch_ms - {2 * DAY} "
                "and p.epoch_ms < c.epoch_ms group by all)",
            ],
            "select symbol, epoch_ms, close, case when lc < close then lc end low_close, "
            "case when lc < close then lm end low_ms from m",
        ),
        "signal_fixed": sql(
            [*BASE, *sets(P), *moves(P)],
            f"select symbol, epoch_ms, x, y, {r('move')} from mv join xs on move >= x",
        ),
        "signal_dynamic": sql(
            [*BASE, *sets(DYNAMIC), *moves(DYNAMIC)],
            f"select symbol, epoch_ms, x, {r('move')}, ya y_actual_seconds from mv join xs on move >= x",
        ),
        "range_spec": (
            "select l_returnflag, round(v, 6) v, count(*) n from (select l_returnflag, unnest(list_transform("
            "generate_series(0, cast(floor(((l_discount + l_tax) - l_discount) / 0.01::double + 1e-9::double) as bigint)), "
            "lambda i: l_discount + i * 0.01::double)) v from lineitem) group by all"
        ),
        "param_grid": (
            "select cast((xi * l_linenumber + y - 1) * 2 + zi + 1 as int) combo_id, cast(y as int) y, count(*) n, "
            "round(sum(l_discount + xi), 2) sum_x, round(sum(round(l_tax, 2) + zi), 2) sum_z from lineitem, "
            "(values (0), (1)) a(xi), (select unnest(generate_series(1, 100)) y), (values (0), (1)) b(zi) "
            "where y <= l_linenumber group by 1, 2"
        ),
        "grid_size": (
            "select l_orderkey, l_linenumber, n_x, n_y, n_z, n_x * n_y * n_z total, n_x * n_y * n_z > 10000 as large from ("
            "select l_orderkey, l_linenumber, count(distinct l_discount + i) n_x, l_linenumber::bigint n_y, "
            "count(distinct round(l_tax, 2) + i) n_z from lineitem, (values (0), (1)) v(i) group by all)"
        ),
        "exit_search_gaps": sql(
            [*BASE, *GAPS, *sets(SEARCH), *moves(SEARCH, "cv"), *exit_ctes(SEARCH, "cv")],
            "select symbol, epoch_ms, exit_ms, reason, z, round(ep, 6) entry_price, "
            + r("raw_exit", "max_price", "min_price")
            + " from ex",
        ),
        "sliding_argmin_gaps": sql(
            [
                *BASE,
                *GAPS,
                "m as (select c.symbol, c.epoch_ms, c.close, min(p.close) lc, arg_min(p.epoch_ms, (p.close, p.epoch_ms)) lm "
                "from cg c left join cv p on p.symbol = c.symbol and p.epoch_ms >= c.epoch_ms - 21600000 "
                "and p.epoch_ms < c.epoch_ms group by all)",
            ],
            "select symbol, epoch_ms, close, case when lc < close then lc end low_close, "
            "case when lc < close then lm end low_ms from m",
        ),
        "trade_log_gaps": sql([*BASE, *GAPS, *log_ctes(P, "cv")], f"select {LOG_COLUMNS} from tl"),
        "trade_log_gaps_dynamic_y": sql([*BASE, *GAPS, *log_ctes(DYNAMIC, "cv")], f"select {LOG_COLUMNS} from tl"),
        "exit_search": sql(
            [*BASE, *sets(SEARCH), *moves(SEARCH), *exit_ctes(SEARCH)],
            "select symbol, epoch_ms, exit_ms, reason, z, round(ep, 6) entry_price, "
            + r("raw_exit", "max_price", "min_price")
            + " from ex",
        ),
        "exit_search_long_hold": sql(
            [*BASE, *sets(FAR), *moves(FAR), *exit_ctes(FAR)],
            "select symbol, epoch_ms, exit_ms, reason, z, round(ep, 6) entry_price, "
            + r("raw_exit", "max_price", "min_price")
            + " from ex",
        ),
        "trade_log_long_hold": log_sql(FAR),
        "trade_log_long_window": log_sql(FAR_DYNAMIC),
        "nonoverlap_select": sql(
            [
                "li as (select l_orderkey, epoch_ms(max(l_shipdate)) ship_ms from lineitem group by 1)",
                "iv as (select o_orderpriority symbol, o_custkey lane, epoch_ms(o_orderdate) open_ms, "
                "max(greatest(epoch_ms(o_orderdate), ship_ms)) close_ms from orders join li on o_orderkey = l_orderkey "
                "group by 1, 2, 3)",
                "nx as materialized (select a.*, b.open_ms next_ms from iv a asof left join iv b on a.symbol = b.symbol and "
                "a.lane = b.lane and a.close_ms < b.open_ms)",
                "wk as (select symbol, lane, min(open_ms) open_ms from iv group by 1, 2 union all select n.symbol, n.lane, "
                "n.next_ms from wk w join nx n on w.symbol = n.symbol and w.lane = n.lane and w.open_ms = n.open_ms "
                "where n.next_ms is not null)",
            ],
            "select iv.* from iv join wk using (symbol, lane, open_ms)",
        ),
        "trade_log": log_sql(P),
        "trade_log_short": log_sql(SHORT),
        "trade_log_signal_only": log_sql(SIGNAL_ONLY),
        "trade_log_dynamic_y": log_sql(DYNAMIC),
        "trade_metrics": metrics_sql(P),
        "trade_metrics_signal_only": metrics_sql(SIGNAL_ONLY),
        "posthoc_metrics": sql(
            [*LOG, *posthoc_ctes(P, "tl", "symbol, combo_id", "pnl")],
            "select symbol, combo_id, n, nw, nl, "
            + r4("avg_w", "avg_l", "gp", "gl", "total", "best", "worst", "dd_u", "dd_p", "wr", "pf", "expect")
            + " from ph",
        ),
        "advanced_metrics": sql(
            [*LOG, *advanced_ctes(P, "tl", "symbol, combo_id")],
            "select symbol, combo_id, max_consecutive_losses, "
            + r4("sharpe_ratio", "expectancy", "avg_win", "avg_loss")
            + " from am",
        ),
        "equity_curve": sql(
            [
                *LOG,
                f"q1 as (select symbol, combo_id, entry_ms, {P.capital} + sum(pnl) over (partition by symbol, combo_id "
                "order by entry_ms) equity from tl)",
                "q2 as (select *, max(equity) over (partition by symbol, combo_id order by entry_ms) peak from q1)",
                "q3 as (select *, peak - equity drawdown from q2)",
            ],
            f"select symbol, combo_id, entry_ms, {r4('equity', 'peak', 'drawdown')} from q3",
        ),
        "max_drawdown": sql(
            [*LOG, *falls("tl", "symbol, combo_id", "pnl")],
            f"select symbol, combo_id, round(dd_u, 4) dd_u, round(dd_u / {P.capital} * 100.0, 4) dd_p from dd",
        ),
        "loss_streak": sql(
            [*LOG, *advanced_ctes(P, "tl", "symbol, combo_id")], "select symbol, combo_id, max_consecutive_losses from st"
        ),
        "break_even": sql(
            [
                *LOG,
                *posthoc_ctes(P, "tl", "symbol, combo_id", "pnl"),
                "b1 as (select *, case when avg_w > 0 then abs(avg_l) / avg_w end loss_win_ratio from ph)",
                "b2 as (select *, coalesce(loss_win_ratio / (1.0 + loss_win_ratio) * 100.0, 100.0) break_even_wr from b1)",
                "b3 as (select *, wr - break_even_wr gap, wr - break_even_wr < 0 losing, "
                f"abs(worst) / {P.size} * 100.0 worst_pct_of_size from b2)",
            ],
            "select symbol, combo_id, losing, "
            + r4("loss_win_ratio", "break_even_wr", "gap", "worst_pct_of_size")
            + " from b3",
        ),
        "screening": sql(
            SCREEN,
            "select symbol, combo_id, total_trades, winning_trades, losing_trades, "
            + r4("total_pnl", "gross_profit", "gross_loss", "best_trade", "worst_trade")
            + " from sc",
        ),
        "dynamic_y_screen": sql(
            [*BASE, *log_ctes(DYNAMIC), SYMBOL_SETS, *screen_ctes(DYNAMIC)],
            "select symbol, combo_id, total_trades, winning_trades, losing_trades, round(avg_y_actual, 2) avg_y_actual, "
            + r4("total_pnl", "gross_profit", "gross_loss", "best_trade", "worst_trade")
            + " from sc",
        ),
        "screen_derived": sql(
            SCREEN,
            "select symbol, combo_id, total_trades, winning_trades, losing_trades, "
            + r4(
                "total_pnl", "gross_profit", "gross_loss", "best_trade", "worst_trade", "win_rate", "profit_factor",
                "avg_win", "avg_loss", "expectancy", "max_drawdown", "sharpe_ratio",
            )
            + " from sd",
        ),
        "strategy_filter": sql(
            SCREEN,
            "select symbol, combo_id, total_trades, "
            + r4("win_rate", "profit_factor", "max_drawdown")
            + f" from sd where {PASSES}",
        ),
        "filter_funnel": sql(
            SCREEN,
            f"select *, before - after removed, round((before - after) / before * 100.0, 1) removed_pct from (select symbol, "
            f"count(*) before, count(*) filter ({PASSES}) as after from sd group by 1)",
        ),
        "rank_strategies": sql(
            [*SCREEN, ranked("sd", "rk", 5)], f"select symbol, rank, combo_id, {r4('score')} from rk"
        ),
        "screen_ranked": sql(
            [*SCREEN, ranked("sd", "rk", LOOSE.top_n, PASSES)],
            f"select symbol, rank, combo_id, x, y, z, total_trades, {r4('score')} from rk",
        ),
        "topk_by_pnl": sql(
            [*LOG, *metric_ctes(P)],
            "select symbol, row_number() over (partition by symbol order by round(total_pnl, 6) desc, combo_id) as rank, "
            f"combo_id, total_trades, {r4('total_pnl')} from tm qualify rank <= 3",
        ),
        "top_set_trades": sql(
            [
                *LOG,
                *metric_ctes(P),
                "k as (select symbol, combo_id from tm qualify row_number() over (partition by symbol order by "
                "round(total_pnl, 6) desc, combo_id) <= 3)",
            ],
            f"select symbol, combo_id, entry_ms, exit_ms, reason, {r('entry_price', 'exit_price', 'pnl')} "
            "from tl join k using (symbol, combo_id)",
        ),
        "summary_rows": sql(
            [*LOG, *metric_ctes(P), SYMBOL_SETS],
            f"select symbol, combo_id, x, y, z, {or_zero(METRIC_COUNTS)}, {or_zero(['win_rate'], 2)}, "
            + or_zero(
                ["total_pnl", "total_pnl_percent", "max_drawdown", "average_pnl", "best_trade", "worst_trade", "profit_factor"],
                4,
            )
            + " from ss left join tm using (symbol, combo_id)",
        ),
        "train_val_split": sql([*BASE, PARTS], "select symbol, epoch_ms, close, part from pt"),
        "train_val_split_ties": sql(
            [
                TR2,
                "o as (select symbol, t, row_number() over (partition by symbol order by t) - 1 rn, "
                "count(*) over (partition by symbol) n from tr2)",
                "b as (select symbol, t b from o where rn = cast(floor(n * 0.7::double) as bigint))",
            ],
            "select symbol, case when t < b then 'train' else 'validation' end part, count(*) n, min(t) first_ms, "
            "max(t) last_ms from o join b using (symbol) group by 1, 2",
        ),
        "kfold_split": fold_sql(),
        "split_report": sql(
            [
                *BASE,
                PARTS,
                "g as (select symbol, part, count(*) as rows, min(epoch_ms) first_ms, max(epoch_ms) last_ms from pt group by all)",
            ],
            "select *, round(rows / sum(rows) over (partition by symbol) * 100.0, 1) pct from g",
        ),
        "split_leakage_check": sql(
            [*BASE, PARTS],
            "select symbol, 0::bigint shared_times, max(epoch_ms) filter (part = 'train') train_last_ms, "
            "min(epoch_ms) filter (part = 'validation') validation_first_ms, max(epoch_ms) filter (part = 'train') < "
            "min(epoch_ms) filter (part = 'validation') in_order from pt group by 1",
        ),
        "train_val_compare": sql(
            validate_ctes(),
            f"select symbol, combo_id, x, y, z, rank, verdict, {', '.join(COMPARE_COUNTS)}, {r4('score', *COMPARE_DOUBLES)} "
            "from vc",
        ),
        "verdict": sql(validate_ctes(), "select symbol, combo_id, rank, verdict from vc"),
        "verdict_counts": sql(
            [
                *validate_ctes(),
                "ct as (select symbol, count(*) validated, "
                "count(*) filter (train_total_pnl + train_total_pnl_percent > 0 and "
                "validation_total_pnl + validation_total_pnl_percent > 0) robust, "
                "count(*) filter (train_total_pnl + train_total_pnl_percent > 0 and "
                "validation_total_pnl + validation_total_pnl_percent <= 0) overfit, "
                "count(*) filter (train_total_pnl + train_total_pnl_percent <= 0) weak from vc group by 1)",
                f"cs as (select symbol, count(*) screened, count(*) filter ({PASSES}) filtered from sd group by 1)",
            ],
            f"select symbol, screened, filtered, {or_zero(['validated', 'robust', 'overfit', 'weak'])} "
            "from cs left join ct using (symbol)",
        ),
        "stoploss_apply": sql(
            stop_ctes("long"),
            f"select symbol, combo_id, entry_ms, level, sl_triggered, {r4('new_pnl', 'new_pnl_percent')} from sp",
        ),
        "stoploss_impact": impact_sql("long"),
        "stoploss_impact_short": impact_sql("short"),
        "stoploss_best": sql(
            impact_ctes("long"),
            "select symbol, combo_id, arg_max(level, (round(d_pnl, 6), -level)) best_pnl_level, "
            "round(max(d_pnl), 4) + 0 best_d_pnl, arg_min(level, (round(dd_p, 6), level)) least_dd_level, "
            "round(min(dd_p), 4) + 0 least_dd_p from im group by 1, 2",
        ),
        "exit_reasons": sql(
            [
                *LOG,
                "g as (select symbol, combo_id, reason, count(*) n, avg(pnl_percent) avg_pnl_percent from tl group by all)",
                "h as (select *, n / sum(n) over (partition by symbol, combo_id) * 100.0 pct from g)",
            ],
            f"select symbol, combo_id, reason, n, {r4('avg_pnl_percent', 'pct')} from h",
        ),
        "reason_codes": sql(
            LOG,
            "select reason, case reason when 'drop-z' then 1 when 'max-hold' then 2 else 3 end code, reason as label, "
            "count(*) n from tl group by 1",
        ),
        "excursion_stats": sql(
            [
                *PROFILE,
                "g as (select symbol, combo_id, count(*) n, count(*) filter (mfe_gt_mae) n_mfe_gt_mae, "
                f"avg(quality) avg_quality{STATS} from pr group by all)",
            ],
            f"select symbol, combo_id, n, n_mfe_gt_mae, {r4('avg_quality', *STAT_NAMES)} from g",
        ),
        "excursion_by_reason": sql(
            [
                *PROFILE,
                "g as (select symbol, combo_id, reason, count(*) n, avg(mae_pct) avg_mae, avg(mfe_pct) avg_mfe, "
                "avg(quality) avg_quality from pr group by all)",
            ],
            f"select symbol, combo_id, reason, n, {r4('avg_mae', 'avg_mfe', 'avg_quality')} from g",
        ),
        "maxhold_percentiles": sql(
            [
                *PROFILE,
                "g as (select symbol, combo_id, count(*) n, avg(mae_pct) avg_mae, avg(mfe_pct) avg_mfe, "
                "count(*) filter (mfe_pct > 0.1) with_mfe, count(*) filter (mfe_pct <= 0.1) without_mfe, "
                "quantile_cont(mae_pct, 0.25) mae_p25, quantile_cont(mae_pct, 0.5) mae_p50, "
                "quantile_cont(mae_pct, 0.75) mae_p75, quantile_cont(mae_pct, 0.9) mae_p90, max(mae_pct) mae_max "
                "from pr where reason = 'max-hold' group by all)",
            ],
            "select symbol, combo_id, n, with_mfe, without_mfe, "
            + r4("avg_mae", "avg_mfe", "mae_p25", "mae_p50", "mae_p75", "mae_p90", "mae_max")
            + " from g",
        ),
        "quality_band": sql(
            [
                *PROFILE,
                "g as (select symbol, combo_id, count(*) filter (reason = 'max-hold') / count(*) * 100.0 max_hold_pct, "
                "avg(mfe_pct) avg_mfe, avg(mae_pct) avg_mae, avg(quality) avg_quality from pr group by all)",
            ],
            "select symbol, combo_id, case when avg_quality < 0.3 then 'mostly-against' when avg_quality < 0.5 then "
            "'more-against-than-for' else 'mostly-for' end band, "
            + r4("max_hold_pct", "avg_mfe", "avg_mae", "avg_quality")
            + " from g",
        ),
        "extended_hold": sql(HELD, f"select symbol, combo_id, entry_ms, hold_s, {r4('pnl_at')} from hl"),
        "extended_hold_wide": sql(
            HELD,
            "select symbol, combo_id, entry_ms, "
            + ", ".join(
                f'round(max(pnl_at) filter (hold_s = {h}), 4) + 0 as pnl_at_{h}'
                for h in (7200, 14400, 28800, 86400)
            )
            + " from hl group by all",
        ),
        "extended_hold_summary": sql(
            [
                *HELD,
                "g as (select symbol, combo_id, hold_s, count(pnl_at) n, avg(pnl_at) avg_pct, "
                "avg(case when pnl_at > 0 then 100.0 when pnl_at <= 0 then 0.0 end) win_rate, max(pnl_at) best, "
                "min(pnl_at) worst, count(pnl_at) filter (reason = 'max-hold') n_max_hold, "
                "avg(pnl_at) filter (reason = 'max-hold') avg_pct_max_hold, "
                "avg(case when pnl_at > 0 then 100.0 when pnl_at <= 0 then 0.0 end) filter (reason = 'max-hold') "
                "win_rate_max_hold from hl group by all)",
            ],
            "select symbol, combo_id, hold_s, n, n_max_hold, "
            + r4("avg_pct", "win_rate", "best", "worst", "avg_pct_max_hold", "win_rate_max_hold")
            + " from g",
        ),
        "time_to_target": sql(TIMED, "select symbol, combo_id, entry_ms, target, seconds from tt"),
        "time_to_target_far": sql(TIMED, "select symbol, combo_id, entry_ms, target, seconds from tt"),
        "time_to_target_late": sql(late_ctes(), "select symbol, combo_id, entry_ms, target, seconds from tt"),
        "time_to_target_stats": sql(
            [
                *TIMED,
                "g as (select symbol, combo_id, target, count(*) n, count(seconds) reached, "
                "count(seconds) / count(*) * 100.0 reached_pct, quantile_cont(seconds, 0.5) / 3600.0 median_h, "
                "quantile_cont(seconds, 0.9) / 3600.0 p90_h from tt group by all)",
            ],
            f"select symbol, combo_id, target, n, reached, {r4('reached_pct', 'median_h', 'p90_h')} from g",
        ),
    }
