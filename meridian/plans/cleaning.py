"""Cleaning of the star: quarantine first, then repair, then flag; a log of every changed cell and a verification of the whole.

Repairs are only made where another column proves them; what can't be proved is counted by the stop rules, which `clean_star` enforces before it
returns anything. Nothing is overwritten: raw, clean and quarantined tables stand beside each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import RuleBroken
from ..operators.spec import CASH, STATE_NAMES, STATES
from .dialect import Dialect, over_star, run
from .star import PK, STAR

#: The tables that cleaning changes, and the flags that it adds.
CLEAN = {
    "dim_client": ("risk_profile_missing_flag",),
    "fact_fees": ("aum_basis_at_floor_flag",),
    "fact_portfolio_snapshot": ("return_outlier_flag", "aum_at_floor_flag"),
    "fact_transactions": ("shares_sign_corrected_flag", "after_last_snapshot_flag"),
}
LOW, HIGH, FLOOR = -0.6, 1.0, 1000
UNION = "\nUNION ALL "
FACTS = ("fact_fees", "fact_portfolio_snapshot", "fact_transactions")


def _flag(test: str) -> str:
    return f"CASE WHEN coalesce({test}, false) THEN '1' ELSE '0' END"


def _columns(table: str, **changed: str) -> str:
    """The table's columns in order, some with a new text."""
    extra = {"fact_portfolio_snapshot": ("is_return_suspect",)}.get(table, ())
    order = COLUMNS[table] + extra
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else f"r.{c}" for c in order)


#: Columns of the raw tables in their order.
COLUMNS = {
    "dim_client": tuple("client_id first_name last_name age city state zip_code risk_profile client_tier primary_account_type initial_aum client_since advisor_id is_active".split()),
    "fact_fees": tuple("fee_id client_id advisor_id fee_date fee_type aum_basis bps_charged amount".split()),
    "fact_portfolio_snapshot": tuple("snapshot_id client_id advisor_id benchmark_id snapshot_date year month aum return_ytd benchmark_return_ytd active_alpha_ytd cash_pct account_type".split()),
    "fact_transactions": tuple("txn_id client_id advisor_id security_id txn_date txn_type shares price amount".split()),
}


def _hundredth(d: Dialect, x: str) -> str:
    """Decimal text of a number text divided by 100: exact digits, as many places as the number has at least, no further zeros."""
    exact = f"CAST(CAST(try_cast({x} AS DECIMAL(20, 6)) * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(30, 8)) AS STRING)"
    places = f"CASE WHEN instr({x}, '.') > 0 THEN length({x}) - instr({x}, '.') ELSE 0 END"
    end = f"(instr({exact}, '.') + {places})"
    return d.replace(f"(substr({exact}, 1, {end}) || {d.replace(f'substr({exact}, {end} + 1)', '0+$', '')})", "[.]$", "")


def steps(d: Dialect) -> dict[str, str]:
    """The steps by name, in their order."""
    match = ", ".join(c for c in COLUMNS["dim_client"] if c not in ("client_id", "last_name"))
    facts = " UNION ".join(f"SELECT client_id FROM {d.t(t)}" for t in FACTS)
    short, long_ = "CASE WHEN length(la) <= length(lb) THEN la ELSE lb END", "CASE WHEN length(la) <= length(lb) THEN lb ELSE la END"
    state = "CASE r.state " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in STATE_NAMES.items()) + " ELSE r.state END"
    shares, price, amount = (f"({d.money('r.' + c)})" for c in ("shares", "price", "amount"))
    flipped = f"(r.txn_type = 'Buy' AND {shares} < 0 AND abs(abs({shares}) * {price} - {amount}) <= 0.01)"
    bare = "substr(trim(r.return_ytd), 1, length(trim(r.return_ytd)) - 1)"
    bench, alpha = f"({d.number('r.benchmark_return_ytd')})", f"({d.number('r.active_alpha_ytd')})"
    converted = f"(trim(r.return_ytd) LIKE '%!%' ESCAPE '!' AND abs(({d.number(bare)}) / 100 - {bench} - {alpha}) <= 1e-4)"
    band = lambda c: f"(({d.number(c)}) < {LOW} OR ({d.number(c)}) > {HIGH})"
    return {
        "twins": f"SELECT min(CAST(client_id AS BIGINT)) AS a, max(CAST(client_id AS BIGINT)) AS b, count(*) AS n FROM {d.t('dim_client')} GROUP BY {match} HAVING count(*) > 1",
        "twin_names": f"SELECT {d.dealt('ca', 'cb', 'fa', 'fb')}w.n, w.a, w.b, ca.last_name AS la, cb.last_name AS lb, fa.client_id IS NOT NULL AS has_a, fb.client_id IS NOT NULL AS has_b FROM twins w JOIN {d.t('dim_client')} ca ON ca.client_id = CAST(w.a AS STRING) JOIN {d.t('dim_client')} cb ON cb.client_id = CAST(w.b AS STRING) LEFT JOIN ({facts}) fa ON fa.client_id = CAST(w.a AS STRING) LEFT JOIN ({facts}) fb ON fb.client_id = CAST(w.b AS STRING)",
        "judged": f"SELECT CAST(CASE WHEN has_a THEN b ELSE a END AS STRING) AS drop_id, CAST(CASE WHEN has_a THEN a ELSE b END AS STRING) AS keep_id, n = 2 AS is_pair, has_a <> has_b AS one_side, trim(la) <> '' AND trim(lb) <> '' AND length(la) <> length(lb) AND substr({long_}, 1, length({short})) = {short} AS prefixed FROM twin_names",
        "dropped": "SELECT drop_id, keep_id FROM judged WHERE is_pair AND one_side AND prefixed",
        "clean_dim_client": f"SELECT {_columns('dim_client', state=state)}, {_flag(d.blank('r.risk_profile'))} AS risk_profile_missing_flag FROM {d.t('dim_client')} r LEFT JOIN dropped x ON r.client_id = x.drop_id WHERE x.drop_id IS NULL",
        "converted": f"SELECT {_columns('fact_portfolio_snapshot', return_ytd=f'CASE WHEN {converted} THEN {_hundredth(d, bare)} ELSE r.return_ytd END')} FROM {d.t('fact_portfolio_snapshot')} r",
        "clean_fact_portfolio_snapshot": f"SELECT r.*, {_flag(band('r.return_ytd') + ' OR ' + band('r.active_alpha_ytd'))} AS return_outlier_flag, {_flag(d.money('r.aum') + f' = {FLOOR}')} AS aum_at_floor_flag FROM converted r",
        "clean_fact_fees": f"SELECT {_columns('fact_fees')}, {_flag(d.money('r.aum_basis') + f' = {FLOOR}')} AS aum_basis_at_floor_flag FROM {d.t('fact_fees')} r",
        "last_month": f"SELECT {d.by_bucket('c')}p.client_id, max(substr(p.snapshot_date, 1, 7)) AS month FROM {d.t('fact_portfolio_snapshot')} p JOIN clean_dim_client c ON p.client_id = c.client_id WHERE c.is_active = 'False' GROUP BY 1",
        "clean_fact_transactions": f"SELECT {d.by_bucket('c', 'm')}{_columns('fact_transactions', security_id='CASE WHEN ' + d.match('r.security_id', '^[0-9]+[.]0+$') + ' THEN ' + d.replace('r.security_id', '[.]0+$', '') + ' ELSE r.security_id END', shares=f'CASE WHEN coalesce({flipped}, false) THEN substr(r.shares, 2) ELSE r.shares END')}, {_flag(flipped)} AS shares_sign_corrected_flag, {_flag('substr(r.txn_date, 1, 7) > m.month')} AS after_last_snapshot_flag FROM {d.t('fact_transactions')} r JOIN clean_dim_client c ON r.client_id = c.client_id LEFT JOIN last_month m ON r.client_id = m.client_id",
        "quarantine_clients": f"SELECT r.*, 'probable duplicate: equal but for client_id and a last_name that is a strict prefix; no facts' AS qa_reason, 'Step 1' AS qa_step, x.keep_id AS qa_retained_client_id FROM {d.t('dim_client')} r JOIN dropped x ON r.client_id = x.drop_id",
        "quarantine_transactions": f"SELECT r.*, 'orphan: client_id not found in dim_client' AS qa_reason, 'Step 2' AS qa_step FROM {d.t('fact_transactions')} r LEFT JOIN clean_dim_client c ON r.client_id = c.client_id WHERE c.client_id IS NULL",
    }


def _repairs(d: Dialect) -> dict[tuple[str, str], str]:
    """CL-10: of each repaired column the condition under which its repair says that it changed a cell, over the raw row (old_) and the clean one (new_)."""
    names = ", ".join(f"'{n}'" for n in STATE_NAMES)
    return {
        ("dim_client", "state"): f"old_state IN ({names})",
        ("fact_transactions", "security_id"): d.match("old_security_id", "^[0-9]+[.]0+$"),
        ("fact_transactions", "shares"): "new_shares_sign_corrected_flag = '1'",
        ("fact_portfolio_snapshot", "return_ytd"): "trim(old_return_ytd) LIKE '%!%' ESCAPE '!' AND new_return_ytd NOT LIKE '%!%' ESCAPE '!'",
    }


_CELL = "table_name, key_column, key_value, column_name, old_value, new_value"


def touched_cells(d: Dialect) -> str:
    """JN-14, CL-10: the cells that differ between raw and clean, or that a repair says it changed, with both marks. Raw and clean rows meet once a table, by key; rows are
    compared by 128 bits of each side, and only those that differ or are repaired are taken apart into cells. (The hash is each side's last column and nothing is renamed
    above it: Spark infers a constraint from it, which doubles with every later alias of a column.)"""
    out, repairs = [], _repairs(d)
    for t in CLEAN:
        columns = [c for c in COLUMNS[t] if c != PK[t]]
        logged = {c: f"coalesce({test}, false)" for (of, c), test in repairs.items() if of == t}

        def side(source: str, prefix: str, names: tuple[str, ...], t: str = t, columns: list[str] = columns) -> str:
            return f"SELECT {PK[t]} AS {prefix}key, " + ", ".join(f"{c} AS {prefix}{c}" for c in names) + f", {d.row_hash(columns)} AS {prefix}hash FROM {source}"

        met = f"({side(d.t(t), 'old_', COLUMNS[t][1:])}) r JOIN ({side(f'clean_{t}', 'new_', (*COLUMNS[t][1:], *CLEAN[t]))}) k ON old_key = new_key"
        changed = " OR ".join(["old_hash <> new_hash", *logged.values()])
        rows = [(f"'{t}'", f"'{PK[t]}'", "old_key", f"'{c}'", f"old_{c}", f"new_{c}", f"(old_{c} IS DISTINCT FROM new_{c})", logged.get(c, "false")) for c in columns]
        out.append(f"SELECT * FROM ({d.fan(f'(SELECT * FROM {met} WHERE {changed}) m', f'{_CELL}, differs, logged', rows)}) c WHERE differs OR logged")
    return UNION.join(out)


def change_log(d: Dialect) -> str:
    return f"SELECT {_CELL} FROM ({touched_cells(d)}) c WHERE logged"


def stop_rules(d: Dialect) -> str:
    """CL-01: what each step requires, and how many rows break it."""
    raw, traded = d.t, f"txn_type NOT IN ({', '.join(repr(c) for c in CASH)})"
    unmapped = f"state NOT IN ({', '.join(repr(s) for s in (*STATES, *STATE_NAMES))})"
    bare = "substr(trim(return_ytd), 1, length(trim(return_ytd)) - 1)"
    count = lambda step, check, source: f"SELECT '{step}' AS step, '{check}' AS requirement, count(*) AS n_failed FROM {source}"
    rows = [count("0 baseline", f"{t}.{PK[t]} unique and filled", f"(SELECT {PK[t]} FROM {raw(t)} GROUP BY 1 HAVING count(*) > 1 OR {d.blank(PK[t])}) z") for t in STAR]
    rows += [
        count("1 duplicates", "every group is a pair", "judged WHERE NOT is_pair"),
        count("1 duplicates", "one side of a pair has facts", "judged WHERE NOT one_side"),
        count("1 duplicates", "names differ by a strict prefix", "judged WHERE NOT prefixed"),
        count("1 duplicates", "no fact of a quarantined client", f"(SELECT client_id FROM {raw('fact_fees')} UNION ALL SELECT client_id FROM {raw('fact_portfolio_snapshot')} UNION ALL SELECT client_id FROM {raw('fact_transactions')}) f JOIN dropped x ON f.client_id = x.drop_id"),
        count("3 states", "every state is a code or mapped", f"{raw('dim_client')} WHERE {unmapped}"),
        count("3 states", "only codes remain", f"clean_dim_client WHERE state NOT IN ({', '.join(repr(s) for s in STATES)})"),
        count("4 security ids", "filled ids are whole numbers with .0", f"{raw('fact_transactions')} WHERE NOT ({d.blank('security_id')}) AND NOT {d.match('security_id', '^[0-9]+[.]0+$')}"),
        count("4 security ids", "every id has a parent", f"clean_fact_transactions x LEFT JOIN {raw('dim_security')} s ON x.security_id = s.security_id WHERE NOT ({d.blank('x.security_id')}) AND s.security_id IS NULL"),
        count("5 negative buys", "traded rows have numbers", f"{raw('fact_transactions')} WHERE {traded} AND ({d.number('shares')} IS NULL OR {d.number('price')} IS NULL OR {d.number('amount')} IS NULL)"),
        count("5 negative buys", "no negative shares remain", f"clean_fact_transactions WHERE ({d.number('shares')}) < 0"),
        count("6 percents", "numeric before the sign", f"{raw('fact_portfolio_snapshot')} WHERE trim(return_ytd) LIKE '%!%' ESCAPE '!' AND {d.number(bare)} IS NULL"),
        count("6 percents", "every one reconciles when divided by 100", "clean_fact_portfolio_snapshot WHERE return_ytd LIKE '%!%' ESCAPE '!'"),
        count("7 flags", "flags are 0 or 1", " UNION ALL ".join(f"SELECT {f} FROM clean_{t} WHERE {f} NOT IN ('0', '1')" for t, fs in CLEAN.items() for f in fs).join(("(", ") z"))),
    ]
    return UNION.join(rows)


def verification(d: Dialect) -> str:
    """CL-11, ST-04, ST-05, JN-14: raw is clean and quarantine together, key by key; every changed cell is logged and every log row is a change. One join and one
    aggregate by key a table."""
    keys = []
    for t in CLEAN:
        gone = {"dim_client": "quarantine_clients", "fact_transactions": "quarantine_transactions"}.get(t)
        sides = [(d.t(t), "1, 0, 0"), (f"clean_{t}", "0, 1, 0")] + ([(gone, "0, 0, 1")] if gone else [])
        marked = UNION.join(f"SELECT {PK[t]} AS k, " + ", ".join(f"{x} AS {n}" for x, n in zip(m.split(", "), ("a", "b", "c"), strict=True)) + f" FROM {source}" for source, m in sides)
        by_key = f"SELECT k, count(*) FILTER (WHERE a = 1) AS a, count(*) FILTER (WHERE b = 1) AS b, count(*) FILTER (WHERE c = 1) AS c FROM ({marked}) u GROUP BY k"
        total = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"
        broken = total("CASE WHEN a = 0 THEN b + c WHEN b + c <> 1 THEN a ELSE 0 END")
        keys.append(f"SELECT '{t}' AS table_name, {total('a')} AS n_raw, {total('b')} AS n_clean, {total('c')} AS n_quarantined, {broken} AS n_keys_broken FROM ({by_key}) g")
    cells = f"SELECT table_name, {d.if_('differs')} AS n_changed, {d.if_('differs AND NOT logged')} AS unlogged, {d.if_('logged AND NOT differs')} AS idle FROM ({touched_cells(d)}) c GROUP BY 1"
    return f"SELECT t.*, coalesce(n_changed, 0) AS n_changed, coalesce(unlogged, 0) AS n_unlogged, coalesce(idle, 0) AS n_not_applied FROM ({UNION.join(keys)}) t LEFT JOIN ({cells}) c ON t.table_name = c.table_name"


def flags(d: Dialect) -> str:
    """CL-08: how many rows each flag marks."""
    rows = [f"SELECT '{t}' AS table_name, '{f}' AS flag, count(*) FILTER (WHERE {f} = '1') AS n_marked, count(*) AS n_rows FROM clean_{t}" for t, names in CLEAN.items() for f in names]
    return UNION.join(rows)


def clean_star(spark: SparkSession, sf_dir: str, strict: bool = True) -> dict[str, DataFrame]:
    """The cleaned tables, the quarantines and the change log. With `strict`, the stop rules are evaluated first, and RuleBroken says which don't hold."""
    if strict:
        broken = run(spark, sf_dir, stop_rules, steps).where("n_failed > 0").collect()
        if broken:
            raise RuleBroken("; ".join(f"{r.step}: {r.requirement} ({r.n_failed})" for r in broken))
    names = [*(f"clean_{t}" for t in CLEAN), "quarantine_clients", "quarantine_transactions"]
    return {n: run(spark, sf_dir, _whole(n), steps) for n in names} | {"change_log": run(spark, sf_dir, change_log, steps)}


def _whole(name: str):  # noqa: ANN202
    return lambda d: f"SELECT * FROM {name}"


over_star("cl01_stop_rules", stop_rules, steps)
over_star("cl02_quarantine_clients", _whole("quarantine_clients"), steps)
over_star("cl03_quarantine_transactions", _whole("quarantine_transactions"), steps)
over_star("cl04_clean_clients", _whole("clean_dim_client"), steps)
over_star("cl05_clean_transactions", _whole("clean_fact_transactions"), steps)
over_star("cl07_clean_snapshots", _whole("clean_fact_portfolio_snapshot"), steps)
over_star("cl08_flags", flags, steps)
over_star("cl10_change_log", change_log, steps)
over_star("cl11_verification", verification, steps)
