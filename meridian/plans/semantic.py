"""The semantic layer over the star: 17 measures in 11 filter contexts, their reconciliation cell by cell, and the evidence behind them.

Facts first shrink to (tier, day), so contexts meet a table of days, not facts; only the top clients go back to single rows, on one day a context.
A blank is null: sums of nothing are blank, a difference is blank only if both sides are, a ratio without a divisor is blank.
"""

from __future__ import annotations

from .dialect import Dialect, over_star

UNION = "\nUNION ALL "
#: Label, year, month, tier; null is no filter.
SLICES = (("Grand Total", None, None, None), *((f"Year={y}", y, None, None) for y in range(1996, 2001)), *((f"Year=2000|Tier={t}", 2000, None, t) for t in ("HNW", "Retail", "UHNW")), ("Month=2000-12", 2000, 12, None), ("Year=1900", 1900, None, None))
#: Measure, how it is compared, and the largest difference that counts as equal.
MEASURES = {
    "total_fees": ("currency", 0.01),
    "net_flows": ("currency", 0.01),
    "aum_naive": ("currency", 0.01),
    "ending_aum": ("currency", 0.01),
    "ending_clients": ("count", 0.0),
    "avg_aum_per_client": ("currency", 0.01),
    "ending_aum_ly": ("currency", 0.01),
    "aum_yoy": ("ratio", 0.0001),
    "ending_aum_pm": ("currency", 0.01),
    "aum_mom": ("ratio", 0.0001),
    "avg_monthly_aum": ("currency", 0.01),
    "fee_yield_bps": ("bps", 0.0001),
    "organic_growth": ("ratio", 0.0001),
    "weighted_alpha": ("ratio", 0.0001),
    "alpha_signal": ("text", 0.0),
    "top10_share": ("ratio", 0.0001),
    "effective_fee_bps": ("bps", 0.0001),
}


def _literal(v: object, kind: str) -> str:
    return f"CAST(NULL AS {kind})" if v is None else f"CAST('{v}' AS {kind})"


def _divide(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def _minus(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE coalesce({a}, 0) - coalesce({b}, 0) END"


def steps(d: Dialect) -> dict[str, str]:
    cents = lambda c: f"CAST(({d.money(c)}) AS DECIMAL(18, 2))"
    total = lambda c, where: f"sum(CASE WHEN {where} THEN {c} END)"
    slices = UNION.join(f"SELECT {_literal(label, 'STRING')} AS label, {_literal(y, 'INT')} AS y, {_literal(m, 'INT')} AS m, {_literal(t, 'STRING')} AS tier" for label, y, m, t in SLICES)
    fact = lambda table, day, rest: f"SELECT c.client_tier AS tier, f.client_id, {d.date('f.' + day)} AS day, {rest} FROM {d.t(table)} f LEFT JOIN {d.t('dim_client')} c ON f.client_id = c.client_id"
    ok = "NOT suspect AND alpha IS NOT NULL AND aum IS NOT NULL"
    inside = "((h.s = 0 AND h.y IS NULL) OR (x.in_cal AND x.day BETWEEN h.first_day AND h.last_day)) AND (h.tier IS NULL OR h.tier = x.tier)"
    return {
        "cal": f"SELECT {d.date('date')} AS day, year, month FROM {d.t('dim_date')} WHERE {d.date('date')} IS NOT NULL",
        "snaps": f"SELECT f.*, k.day IS NOT NULL AS in_cal FROM ({fact('fact_portfolio_snapshot', 'snapshot_date', cents('f.aum') + ' AS aum, CAST((' + d.money('f.active_alpha_ytd') + ') AS DECIMAL(10, 4)) AS alpha, f.is_return_suspect = ' + repr('1') + ' AS suspect, f.snapshot_id AS id')}) f LEFT JOIN cal k ON f.day = k.day",
        "fee_rows": f"SELECT f.*, k.day IS NOT NULL AS in_cal FROM ({fact('fact_fees', 'fee_date', cents('f.amount') + ' AS amount, ' + cents('f.aum_basis') + ' AS basis, f.fee_type, f.fee_id AS id')}) f LEFT JOIN cal k ON f.day = k.day",
        "flow_rows": f"SELECT f.*, k.day IS NOT NULL AS in_cal FROM ({fact('fact_transactions', 'txn_date', cents('f.amount') + ' AS amount, f.txn_type')}) f LEFT JOIN cal k ON f.day = k.day",
        "snap_days": f"SELECT tier, day, in_cal, sum(aum) AS aum, count(aum) AS filled, count(DISTINCT client_id) AS clients, count(*) AS n, sum(CASE WHEN suspect THEN 1 ELSE 0 END) AS n_suspect, {total('1', ok)} AS n_eligible, {total('alpha * aum', ok)} AS weighted, {total('aum', ok)} AS weight FROM snaps GROUP BY 1, 2, 3",
        "fee_days": "SELECT tier, day, in_cal, sum(amount) AS amount, sum(basis) AS basis FROM fee_rows GROUP BY 1, 2, 3",
        "flow_days": f"SELECT tier, day, in_cal, {total('amount', 'txn_type = ' + repr('Deposit'))} AS deposits, {total('amount', 'txn_type = ' + repr('Withdrawal'))} AS withdrawals FROM flow_rows GROUP BY 1, 2, 3",
        "slices": slices,
        "periods": "SELECT s.label, s.y, s.tier, min(k.day) AS first_day, max(k.day) AS last_day, count(k.day) AS n_days FROM slices s LEFT JOIN cal k ON (s.y IS NULL OR CAST(k.year AS INT) = s.y) AND (s.m IS NULL OR CAST(k.month AS INT) = s.m) GROUP BY 1, 2, 3",
        "contexts": UNION.join(f"SELECT label, y, tier, {s} AS s, CAST(first_day - INTERVAL {s} MONTH AS DATE) AS first_day, last_day(CAST(last_day - INTERVAL {s} MONTH AS DATE)) AS last_day FROM periods" for s in (0, 12, 1)),
        "context_days": f"SELECT h.label, h.s, x.day, x.in_cal, sum(x.aum) AS aum, sum(x.filled) AS filled, sum(x.clients) AS clients, sum(x.n) AS n, sum(x.n_suspect) AS n_suspect, sum(x.n_eligible) AS n_eligible, sum(x.weighted) AS weighted, sum(x.weight) AS weight FROM contexts h JOIN snap_days x ON {inside} GROUP BY 1, 2, 3, 4",
        "ends": "SELECT label, s, max(CASE WHEN in_cal AND filled > 0 THEN day END) AS last_day, max(day) AS latest, sum(aum) AS naive, count(DISTINCT day) AS n_dates FROM context_days GROUP BY 1, 2",
        "endings": "SELECT e.label, e.s, e.naive, e.n_dates, max(CASE WHEN x.day = e.last_day THEN x.aum END) AS ending, max(CASE WHEN x.day = e.last_day THEN x.clients END) AS clients, max(CASE WHEN x.day = e.latest AND x.in_cal THEN x.weighted END) AS weighted, max(CASE WHEN x.day = e.latest AND x.in_cal THEN x.weight END) AS weight FROM ends e JOIN context_days x ON e.label = x.label AND e.s = x.s GROUP BY 1, 2, 3, 4",
        "fee_sums": f"SELECT h.label, sum(x.amount) AS fees, sum(x.basis) AS basis FROM contexts h JOIN fee_days x ON {inside} WHERE h.s = 0 GROUP BY 1",
        "flow_sums": f"SELECT h.label, sum(x.deposits) AS deposits, sum(x.withdrawals) AS withdrawals FROM contexts h JOIN flow_days x ON {inside} WHERE h.s = 0 GROUP BY 1",
        "top_rows": "SELECT e.label, x.client_id, sum(x.aum) AS aum, row_number() OVER (PARTITION BY e.label ORDER BY sum(x.aum) DESC, x.client_id) AS place FROM ends e JOIN contexts h ON e.label = h.label AND h.s = 0 JOIN snaps x ON x.day = e.last_day AND (h.tier IS NULL OR h.tier = x.tier) WHERE e.s = 0 AND x.aum IS NOT NULL GROUP BY 1, 2",
        "measured": f"""SELECT p.label, f.fees AS fees, {_minus('w.deposits', 'w.withdrawals')} AS flows, n.naive AS naive, n.ending AS ending, n.clients AS clients, y.ending AS ly, q.ending AS pm, n.n_dates AS n_dates, f.basis AS basis, {_divide('n.weighted', 'n.weight')} AS alpha, t.top AS top
FROM periods p LEFT JOIN endings n ON p.label = n.label AND n.s = 0 LEFT JOIN endings y ON p.label = y.label AND y.s = 12 LEFT JOIN endings q ON p.label = q.label AND q.s = 1 LEFT JOIN fee_sums f ON p.label = f.label LEFT JOIN flow_sums w ON p.label = w.label LEFT JOIN (SELECT label, sum(aum) AS top FROM top_rows WHERE place <= 10 GROUP BY 1) t ON p.label = t.label""",
        "grid": _grid(d),
        "cells": UNION.join(f"SELECT '{m}' AS measure, '{kind}' AS kind, {tolerance} AS tolerance, label, {'CAST(NULL AS DOUBLE)' if kind == 'text' else f'CAST({m} AS DOUBLE)'} AS x, {m if kind == 'text' else 'CAST(NULL AS STRING)'} AS word FROM grid" for m, (kind, tolerance) in MEASURES.items()),
    }


def _grid(d: Dialect) -> str:
    money = lambda x, name: f"{d.rounded(f'CAST({x} AS DOUBLE)', 2)} AS {name}"
    ratio = lambda a, b, name: f"{d.rounded(_divide(a, b), 6)} AS {name}"
    return f"""SELECT label, {money('fees', 'total_fees')}, {money('flows', 'net_flows')}, {money('naive', 'aum_naive')}, {money('ending', 'ending_aum')}, CAST(clients AS BIGINT) AS ending_clients, {money(_divide('ending', 'clients'), 'avg_aum_per_client')},
{money('ly', 'ending_aum_ly')}, {ratio(_minus('ending', 'ly'), 'ly', 'aum_yoy')}, {money('pm', 'ending_aum_pm')}, {ratio(_minus('ending', 'pm'), 'pm', 'aum_mom')}, {money(_divide('naive', 'n_dates'), 'avg_monthly_aum')}, {ratio('fees * 120000', 'naive', 'fee_yield_bps')}, {ratio('flows', 'ly', 'organic_growth')},
{d.rounded('alpha', 6)} AS weighted_alpha, CASE WHEN alpha IS NULL THEN NULL WHEN alpha >= 0.02 THEN 'Outperforming' WHEN alpha <= -0.02 THEN 'Lagging' ELSE 'In line' END AS alpha_signal, {ratio('top', 'ending', 'top10_share')}, {ratio('fees * 120000', 'basis', 'effective_fee_bps')} FROM measured"""


def reconcile(d: Dialect) -> str:
    """CX-03, CX-04, JN-17: every cell against an exported one. The export is the grid as text with planted deviations: small and large differences, a blank, a changed word, and a cell left out; blank equals only blank."""
    moved = "CASE WHEN measure = 'total_fees' THEN x + 0.004 WHEN measure = 'ending_aum' AND label = 'Year=1998' THEN x + 0.02 WHEN measure = 'ending_clients' AND label = 'Year=1999' THEN NULL WHEN label = 'Year=1900' AND measure = 'net_flows' THEN 0 ELSE x END"
    export = f"SELECT measure, label, {moved} AS x, CASE WHEN label = 'Year=1997' AND word IS NOT NULL THEN 'None' ELSE word END AS word FROM cells WHERE NOT (measure = 'top10_share' AND label = 'Year=1996')"
    equal = "CASE WHEN c.kind = 'text' THEN c.word IS NOT DISTINCT FROM e.word WHEN c.x IS NULL AND e.x IS NULL THEN true ELSE coalesce(abs(c.x - e.x) <= c.tolerance + 1e-9, false) END"
    return f"SELECT c.measure, c.label, round(abs(c.x - e.x), 6) AS abs_diff, e.measure IS NULL AS missing, e.measure IS NOT NULL AND {equal} AS matches FROM cells c LEFT JOIN ({export}) e ON c.measure = e.measure AND c.label = e.label"


def display(d: Dialect) -> str:
    """FN-FMT: the cells as shown: money and counts with two or no decimals, ratios as percent, blanks as nothing."""
    fixed = lambda x, n: f"CAST(CAST({d.rounded(x, n)} AS DECIMAL(30, {n})) AS STRING)"
    return f"SELECT measure, label, CASE kind WHEN 'text' THEN coalesce(word, '') WHEN 'currency' THEN coalesce('$' || {fixed('x', 2)}, '') WHEN 'count' THEN coalesce({fixed('x', 0)}, '') WHEN 'ratio' THEN coalesce({fixed('x * 100', 2)} || '%', '') ELSE coalesce({fixed('x', 4)}, '') END AS shown FROM cells"


def complete_months(d: Dialect) -> str:
    """WN-11: whether a context's days are an unbroken run of whole months."""
    return "SELECT label, n_days, first_day IS NOT NULL AND n_days = datediff(last_day, first_day) + 1 AND extract(day FROM first_day) = 1 AND extract(day FROM last_day + INTERVAL 1 DAY) = 1 AS complete FROM periods".replace("datediff(last_day, first_day)", d.days("first_day", "last_day"))


def last_balances(d: Dialect) -> str:
    """EV-01, WN-03: the ending balance of all against the sum of each client's own last balance."""
    own = "SELECT client_id, day, sum(aum) AS aum, row_number() OVER (PARTITION BY client_id ORDER BY day DESC) AS back FROM snaps WHERE in_cal AND aum IS NOT NULL GROUP BY 1, 2"
    last = "(SELECT max(day) FROM snaps WHERE in_cal AND aum IS NOT NULL)"
    none = f"(SELECT count(*) FROM {d.t('dim_client')} c WHERE NOT EXISTS (SELECT 1 FROM snaps s WHERE s.client_id = c.client_id))"
    return f"WITH own AS ({own}), l AS (SELECT {last} AS day) SELECT CAST(sum(aum) AS DOUBLE) AS sum_of_last, CAST(sum(CASE WHEN own.day = l.day THEN aum END) AS DOUBLE) AS ending, CAST(sum(CASE WHEN own.day < l.day THEN aum END) AS DOUBLE) AS earlier, count(*) AS n_clients, count(*) FILTER (WHERE own.day = l.day) AS n_at_end, count(*) FILTER (WHERE own.day < l.day) AS n_before, {none} AS n_without FROM own CROSS JOIN l WHERE back = 1"


def fee_coverage(d: Dialect) -> str:
    """EV-02, AG-19, JN-10: client-months of 2000 with balances, fees or both, and how fee bases agree with the same and the prior month's balance. Each side is reduced before they meet."""
    month = lambda: "CAST(extract(year FROM day) AS INT) * 12 + CAST(extract(month FROM day) AS INT)"
    year = "day BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
    fees = f"SELECT client_id, {month()} AS m, count(*) AS n, sum(amount) AS amount, sum(basis) AS basis, max(basis) AS top_basis, count(DISTINCT basis) AS n_bases FROM fee_rows WHERE in_cal AND {year} GROUP BY 1, 2"
    balances = f"SELECT client_id, {month()} AS m, sum(aum) AS aum FROM snaps WHERE day IS NOT NULL GROUP BY 1, 2"
    b = f"SELECT *, lag(aum) OVER (PARTITION BY client_id ORDER BY m) AS before, lag(m) OVER (PARTITION BY client_id ORDER BY m) AS before_m FROM ({balances}) z"
    joined = f"SELECT f.client_id IS NOT NULL AS has_fee, s.client_id IS NOT NULL AS has_balance, f.amount, f.n_bases, s.aum, abs(f.top_basis - s.aum) <= 0.01 AS same, s.before_m = s.m - 1 AND abs(f.top_basis - s.before) <= 0.01 AS prior, abs(f.top_basis - s.aum) AS gap FROM ({fees}) f FULL JOIN (SELECT * FROM ({b}) y WHERE m BETWEEN 24001 AND 24012) s ON f.client_id = s.client_id AND f.m = s.m"
    both = "has_fee AND has_balance"
    return f"SELECT {d.if_(both)} AS n_both, {d.if_('has_balance AND NOT has_fee')} AS n_balance_only, {d.if_('has_fee AND NOT has_balance')} AS n_fee_only, {d.if_(both + ' AND same')} AS n_same_month, {d.if_(both + ' AND prior')} AS n_prior_month, {d.if_('n_bases > 1')} AS n_several_bases, CAST(sum(CASE WHEN has_balance AND NOT has_fee THEN aum END) AS DOUBLE) AS balance_without_fee, CAST(sum(CASE WHEN has_fee AND NOT has_balance THEN amount END) AS DOUBLE) AS fees_without_balance, round(avg(CAST(CASE WHEN {both} THEN gap END AS DOUBLE)), 4) AS mean_gap FROM ({joined}) j"


def fee_months(d: Dialect) -> str:
    """EV-02: fees and balances by month of 2000."""
    text = "substr(CAST(day AS STRING), 1, 7)"
    year = "day BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
    fees = f"SELECT {text} AS month, count(*) AS n_fees, sum(amount) AS fees, sum(basis) AS basis, count(DISTINCT client_id) AS fee_clients FROM fee_rows WHERE {year} GROUP BY 1"
    balances = f"SELECT {text} AS month, sum(aum) AS aum, count(DISTINCT client_id) AS clients FROM snaps WHERE {year} GROUP BY 1"
    return f"SELECT coalesce(f.month, s.month) AS month, n_fees, CAST(fees AS DOUBLE) AS fees, CAST(basis AS DOUBLE) AS basis, fee_clients, CAST(aum AS DOUBLE) AS aum, clients FROM ({fees}) f FULL JOIN ({balances}) s ON f.month = s.month"


def suspect_years(d: Dialect) -> str:
    """EV-03, WN-04: client-years whose latest rows are all suspect, so their alpha is blank; what an earlier date would have given instead."""
    rows = "SELECT client_id, CAST(extract(year FROM day) AS INT) AS y, day, suspect, alpha, aum FROM snaps WHERE in_cal"
    latest = "SELECT client_id, y, max(day) AS latest, max(CASE WHEN NOT suspect AND alpha IS NOT NULL AND aum IS NOT NULL THEN day END) AS fallback FROM r GROUP BY 1, 2"
    return f"""WITH r AS ({rows}), l AS ({latest}) SELECT l.client_id, l.y, count(*) FILTER (WHERE r.day = l.latest) AS n_latest, round(sum(CASE WHEN r.day = l.fallback AND NOT suspect THEN CAST(alpha * aum AS DOUBLE) END) / nullif(sum(CASE WHEN r.day = l.fallback AND NOT suspect THEN CAST(aum AS DOUBLE) END), 0), 6) AS fallback_alpha
FROM l JOIN r ON l.client_id = r.client_id AND l.y = r.y GROUP BY l.client_id, l.y HAVING count(*) FILTER (WHERE r.day = l.latest) = count(*) FILTER (WHERE r.day = l.latest AND r.suspect)"""


def growth(d: Dialect) -> str:
    """EV-04: what of each tier's change in balance the net flows explain."""
    change = _minus("ending", "ly")
    return f"SELECT label, CAST(flows AS DOUBLE) AS net_flows, CAST({change} AS DOUBLE) AS aum_change, CAST({_minus(f'({change})', 'flows')} AS DOUBLE) AS unexplained FROM measured WHERE label LIKE '%Tier=%'"


def alpha_rows(d: Dialect) -> str:
    """EV-04, EV-05, MS-14: the rows behind each context's alpha; the context without data has none."""
    return "SELECT p.label, CAST(coalesce(x.n, 0) AS BIGINT) AS n_at_latest, CAST(coalesce(x.n_suspect, 0) AS BIGINT) AS n_suspect, CAST(coalesce(x.n_eligible, 0) AS BIGINT) AS n_eligible, CAST(x.weight AS DOUBLE) AS weight FROM periods p LEFT JOIN ends e ON p.label = e.label AND e.s = 0 LEFT JOIN context_days x ON x.label = e.label AND x.s = 0 AND x.day = e.latest AND x.in_cal"


def validation(d: Dialect) -> str:
    """EV-06: repeated grain, blanks, unmapped clients and dates, and the span of each fact."""
    rows = []
    for fact, source, value in (("balances", "snaps", "aum"), ("fees", "fee_rows", "amount"), ("flows", "flow_rows", "amount")):
        grain = f"(SELECT count(*) FROM (SELECT client_id, day FROM {source} GROUP BY 1, 2 HAVING count(*) > 1) g)" if source != "flow_rows" else "CAST(0 AS BIGINT)"
        rows.append(f"SELECT '{fact}' AS fact, count(*) AS n_rows, {grain} AS n_repeated_grain, {d.if_(value + ' IS NULL')} AS n_blank_value, {d.if_('day IS NULL')} AS n_bad_date, {d.if_('day IS NOT NULL AND NOT in_cal')} AS n_outside_calendar, {d.if_('tier IS NULL')} AS n_unmapped_client, CAST(min(day) AS STRING) AS first_day, CAST(max(day) AS STRING) AS last_day FROM {source}")
    return UNION.join(rows)


def _all(name: str):  # noqa: ANN202
    return lambda d: f"SELECT * FROM {name}"


over_star("ms01_17_measures", _all("grid"), steps)
over_star("cx04_reconcile", reconcile, steps)
over_star("fn_fmt_display", display, steps)
over_star("wn11_complete_months", complete_months, steps)
over_star("ev01_last_balances", last_balances, steps)
over_star("ev02_fee_coverage", fee_coverage, steps)
over_star("ev02_fee_months", fee_months, steps)
over_star("ev03_suspect_years", suspect_years, steps)
over_star("ev04_growth", growth, steps)
over_star("ev05_alpha_rows", alpha_rows, steps)
over_star("ev06_validation", validation, steps)
