"""Findings over the raw star: what each check of a column, a row, a table or several tables found, with severity, count and denominator.

The checks of single rows are one aggregate a table. A check that found nothing passes, whatever its severity; notes stay notes.
"""

from __future__ import annotations

from ..operators.spec import CASH, SPECS, STATES, TRADED
from .dialect import Dialect, Typed, in_parts, over_star
from .cleaning import steps
from .quality import _between, _day, calendar
from .star import PK, RELATIONSHIPS

UNION = "\nUNION ALL "
#: (severity, target, check, what is wrong, of which rows)
Check = tuple[str, str, str, str, str]


def column_checks(d: Dialect, table: str) -> list[Check]:
    """DQ-03: what the table's spec says of each column."""
    spec, out = SPECS[table], []
    filled = lambda c: f"NOT ({d.blank(c)})"
    for c, kind in spec.types.items():
        out.append(("ERROR", c, f"type validity ({kind})", f"{filled(c)} AND NOT {d.kind(c, kind)}", filled(c)))
        if kind == "float":
            out.append(("INFO", c, "scientific-notation text", f"{d.match(c, '[eE]')} AND {d.kind(c, 'float')}", filled(c)))
        out.append(("WARN", c, "leading or trailing whitespace", f"{c} <> trim({c}) AND {filled(c)}", "true"))
        out.append(("WARN", c, "repeated whitespace inside", d.match(c, "[^ ] {2,}[^ ]"), "true"))
        out.append(("INFO", c, "literal null-like token", f"{filled(c)} AND {d.token(c)}", "true"))
        if c not in spec.blank_when:
            out.append(("WARN", c, "blank values", d.blank(c), "true"))
    for c, values in spec.allowed.items():
        out.append(("WARN" if values is STATES else "ERROR", c, "allowed values", f"{filled(c)} AND NOT {d.isin(c, values)}", filled(c)))
    for c, (low, high) in spec.ranges.items():
        n = f"({d.number(c)})"
        out.append(("ERROR", c, "hard range", d.outside(n, low, high), f"{n} IS NOT NULL"))
    for c, (low, high) in spec.plausible.items():
        n = scaled(d, c)
        out.append(("WARN", c, "plausibility", d.outside(n, low, high), f"{n} IS NOT NULL"))
    for dates, severity, name in ((spec.dates, "ERROR", "date range"), (spec.plausible_dates, "WARN", "plausible date")):
        for c, (low, high) in dates.items():
            day = f"({d.date(c)})"
            out.append((severity, c, name, f"NOT ({_between(day, _day(low), _day(high))})", f"{day} IS NOT NULL"))
    for c, pattern in spec.patterns.items():
        out.append(("ERROR", c, "pattern", f"{filled(c)} AND NOT {d.match(c, pattern)}", filled(c)))
        out.append(("INFO", c, "leading zeros present", f"substr({c}, 1, 1) = '0'", "true"))
    for c, (condition, values) in spec.blank_when.items():
        expected = d.isin(condition, values)
        out.append(("INFO", c, "blank by design", f"{d.blank(c)} AND {expected}", "true"))
        out.append(("ERROR", c, "blank where a value is required", f"{d.blank(c)} AND NOT {expected}", f"NOT {expected}"))
        out.append(("WARN", c, "value where not applicable", f"{filled(c)} AND {expected}", expected))
    return out


def scaled(d: Dialect, c: str) -> str:
    """PRD-11: the number of a text, that of a text with a percent sign divided by 100."""
    bare = f"substr({c}, 1, length({c}) - 1)"
    return f"CASE WHEN {c} LIKE '%!%' ESCAPE '!' THEN ({d.number(bare)}) / 100 ELSE {d.number(c)} END"


def row_checks(d: Dialect, table: str) -> list[Check]:
    """DQ-07 to DQ-12, DQ-14: contradictions between the columns of a row."""
    n = lambda c: f"({d.number(c)})"
    known = lambda *cs: " AND ".join(f"{n(c)} IS NOT NULL" for c in cs)
    if table == "dim_date":
        day = f"({d.date('date')})"
        weekend = f"{d.day_name(day)} IN ('Saturday', 'Sunday')"
        out = [("ERROR", c, f"{c} agrees with date", f"{c} <> {want}", f"{day} IS NOT NULL") for c, want in calendar(d, day).items()]
        return [*out, ("WARN", "is_trading_day", "trading day is a weekday", f"({weekend}) = (is_trading_day = '1')", "true"), ("INFO", "is_trading_day", "non-trading days", "is_trading_day = '0'", "true")]
    if table == "dim_security":
        return [("WARN", "asset_class+is_etf", "equity flagged as ETF", "asset_class = 'Equity' AND is_etf = 'True'", "true")]
    if table == "dim_client":
        band = f"CASE WHEN {n('initial_aum')} < 0 THEN 'none' WHEN {n('initial_aum')} < 500000 THEN 'Retail' WHEN {n('initial_aum')} < 5000000 THEN 'HNW' ELSE 'UHNW' END"
        return [("WARN", "client_tier+initial_aum", "tier fits the opening balance", f"{band} <> client_tier", known("initial_aum"))]
    if table == "fact_fees":
        return [("ERROR", "amount", "amount = basis x bps / 10000 / 12", f"abs({n('amount')} - {n('aum_basis')} * {n('bps_charged')} / 120000) > 0.01", known("amount", "aum_basis", "bps_charged")), ("WARN", "fee_date", "dated on the 1st", "fee_date NOT LIKE '%-01'", "true")]
    if table == "fact_portfolio_snapshot":
        day, pct, bare = f"({d.date('snapshot_date')})", "trim(return_ytd) LIKE '%!%' ESCAPE '!'", "substr(trim(return_ytd), 1, length(trim(return_ytd)) - 1)"
        gap = lambda x: f"abs({x} - {n('benchmark_return_ytd')} - {n('active_alpha_ytd')})"
        others = known("benchmark_return_ytd", "active_alpha_ytd")
        return [
            ("ERROR", "year+month", "year and month agree with the date", f"year <> CAST(extract(year FROM {day}) AS STRING) OR month <> CAST(extract(month FROM {day}) AS STRING)", f"{day} IS NOT NULL"),
            ("WARN", "snapshot_date", "dated on the 1st", "snapshot_date NOT LIKE '%-01'", "true"),
            ("ERROR", "active_alpha_ytd", "alpha = return - benchmark", f"NOT ({pct}) AND {gap(n('return_ytd'))} > 1e-4", f"NOT ({pct}) AND {known('return_ytd')} AND {others}"),
            ("INFO", "return_ytd", "percent texts reconcile when divided by 100", f"{pct} AND {gap(f'{n(bare)} / 100')} <= 1e-4", f"{pct} AND {n(bare)} IS NOT NULL AND {others}"),
            ("INFO", "return_ytd", "percent texts reconcile undivided", f"{pct} AND {gap(n(bare))} <= 1e-4", f"{pct} AND {n(bare)} IS NOT NULL AND {others}"),
        ]
    if table == "fact_transactions":
        three, gap = known("shares", "price", "amount"), f"abs({n('amount')} - {n('shares')} * {n('price')})"
        out = [("ERROR", "amount", f"{t}: amount = shares x price", f"txn_type = '{t}' AND {gap} > 0.01", f"txn_type = '{t}' AND {three}") for t in TRADED]
        out += [("INFO", "amount", f"{t}: failures that reconcile without the sign", f"txn_type = '{t}' AND {gap} > 0.01 AND abs({n('amount')} - abs({n('shares')} * {n('price')})) <= 0.01", f"txn_type = '{t}' AND {three}") for t in TRADED]
        return [*out, ("ERROR", "shares", "negative shares", f"{n('shares')} < 0", known("shares"))]
    return []


_COLUMNS = "severity, check_group, table_name, target, check_name, affected, denominator"


def single_table(d: Dialect) -> str:
    """The checks of single rows of every table."""
    out = []
    for t in SPECS:
        typed = Typed(d)
        checks = [("1_column", *c) for c in column_checks(typed, t)] + [("2_row", *c) for c in row_checks(typed, t)]
        for part in in_parts(d, checks, lambda c: c[2]):
            codes = ", ".join(f"CASE WHEN NOT coalesce({of}, false) THEN 0 WHEN coalesce(({bad}), false) THEN 2 ELSE 1 END AS k{i}" for i, (_, _, _, _, bad, of) in enumerate(part))
            sums = ", ".join(f"{d.if_(f'k{i} = 2')} AS a{i}, {d.if_(f'k{i} > 0')} AS b{i}" for i in range(len(part)))
            rows = [(*(f"'{x}'" for x in (severity, group, t, target, name)), f"a{i}", f"b{i}") for i, (group, severity, target, name, _, _) in enumerate(part)]
            out.append(d.fan(f"(SELECT {sums} FROM (SELECT {codes} FROM {typed.source(d.t(t), codes if d.spread else None)}) coded) one", _COLUMNS, rows))
    return UNION.join(out)


def several_rows(d: Dialect) -> str:
    """DQ-04, DQ-07, DQ-11, AG-29, WN-02, WN-05: keys, repeated rows, gaps and floors: what takes more than one row of a table to see."""
    out = []
    row = lambda severity, t, target, name, affected, denominator, source: out.append(f"SELECT '{severity}' AS severity, '3_table' AS check_group, '{t}' AS table_name, '{target}' AS target, '{name}' AS check_name, {affected} AS affected, {denominator} AS denominator FROM {source}")
    total = lambda test: f"CAST(coalesce(sum(CASE WHEN {test} THEN m END), 0) AS BIGINT)"
    for t, spec in SPECS.items():
        row("ERROR", t, spec.pk, "primary key unique", total("m > 1"), total("true"), f"(SELECT count(*) AS m FROM {d.t(t)} GROUP BY {spec.pk}) g")
        row("ERROR", t, spec.pk, "primary key filled", d.if_(d.blank(spec.pk)), "count(*)", d.t(t))
        for key in spec.keys:
            blank = " OR ".join(d.blank(c) for c in key)
            row("ERROR", t, "+".join(key), "business key unique", total("m > 1"), total("true"), f"(SELECT count(*) AS m FROM {d.t(t)} WHERE NOT ({blank}) GROUP BY {', '.join(key)}) g")
        # Whole rows are told apart by 128 bits, so that no row is shuffled whole.
        row("ERROR", t, "(all columns)", "exact duplicate rows", total("m > 1"), total("true"), f"(SELECT count(*) AS m FROM {d.t(t)} GROUP BY {d.same(list(spec.types))}) g")
        row("ERROR", t, "(all but the key)", "duplicate rows ignoring the key", total("m > 1"), total("true"), f"(SELECT count(*) AS m FROM {d.t(t)} GROUP BY {d.same([c for c in spec.types if c != spec.pk])}) g")
    gaps = f"(SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT {d.date('date')} AS day FROM {d.t('dim_date')}) z WHERE day IS NOT NULL) g"
    row("ERROR", "dim_date", "date", "calendar has no gaps", d.if_(f"{d.days('before', 'day')} <> 1"), "count(*) - 1", gaps)
    x = f"({d.money('aum')})"
    row("INFO", "fact_portfolio_snapshot", "aum", "rows at the least balance", "count(*) FILTER (WHERE x = least)", "count(x)", f"(SELECT {x} AS x FROM {d.t('fact_portfolio_snapshot')}) v CROSS JOIN (SELECT min({x}) AS least FROM {d.t('fact_portfolio_snapshot')}) l")
    row("INFO", "dim_security", "name", "same name on several tickers", total("m > 1"), total("true"), f"(SELECT count(*) AS m FROM {d.t('dim_security')} GROUP BY name) g")
    return UNION.join(out)


def cross_table(d: Dialect) -> str:
    """DQ-14, DQ-17 to DQ-23, JN-12, JN-15, JN-16, JN-18: rules over several tables. Clients are one whole row a key, the first by text, and repeated keys are a finding of their own."""
    out, by_client = [], d.by_bucket("c")
    row = lambda severity, t, target, name, affected, denominator, source, hint="": out.append(f"SELECT {hint}'{severity}' AS severity, '4_cross' AS check_group, '{t}' AS table_name, '{target}' AS target, '{name}' AS check_name, {affected} AS affected, {denominator} AS denominator FROM {source}")
    fee, snap, txn, client, cal = (d.t(t) for t in ("fact_fees", "fact_portfolio_snapshot", "fact_transactions", "dim_client", "dim_date"))
    looked = ("advisor_id", "client_since", "primary_account_type", "is_active")
    whole_row = " || '|' || ".join(f"coalesce({c}, '')" for c in looked)
    one = f"(SELECT client_id, {', '.join(f'min_by({c}, row_text) AS {c}' for c in looked)} FROM (SELECT *, {whole_row} AS row_text FROM {client}) w GROUP BY 1)"
    row("WARN", "dim_client", "client_id", "lookup key unique", "count(*) FILTER (WHERE m > 1)", "count(*)", f"(SELECT count(*) AS m FROM {client} GROUP BY client_id) g")
    row("ERROR", "dim_client", "client_id", "repeated lookup keys disagree", "count(*) FILTER (WHERE a <> b)", "count(*)", f"(SELECT min(advisor_id) AS a, max(advisor_id) AS b FROM {client} GROUP BY client_id) g")
    for t, day in (("fact_fees", "fee_date"), ("fact_portfolio_snapshot", "snapshot_date"), ("fact_transactions", "txn_date")):
        joined = f"{d.t(t)} f JOIN {one} c ON f.client_id = c.client_id"
        row("ERROR", t, "advisor_id", "fact advisor is the client advisor", d.if_("f.advisor_id <> c.advisor_id"), "count(*)", joined, by_client)
        early, same = f"f.{day} < c.client_since", f"substr(f.{day}, 1, 7) = substr(c.client_since, 1, 7)"
        row("INFO", t, day, "before the client start, same month", d.if_(f"{early} AND {same}"), "count(*)", joined, by_client)
        row("WARN", t, day, "in a month before the client start", d.if_(f"{early} AND NOT {same}"), "count(*)", joined, by_client)
    row("WARN", "fact_portfolio_snapshot", "account_type", "account type is the primary one", d.if_("f.account_type <> c.primary_account_type"), "count(*)", f"{snap} f JOIN {one} c ON f.client_id = c.client_id", by_client)
    both = f"(SELECT f.fee_id, s.snapshot_id, {d.money('f.aum_basis')} AS a, {d.money('s.aum')} AS b FROM {fee} f FULL JOIN {snap} s ON f.client_id = s.client_id AND f.fee_date = s.snapshot_date) j"
    row("ERROR", "fact_fees", "aum_basis", "fee basis is the balance of the month", d.if_("abs(a - b) > 0.01"), d.if_("fee_id IS NOT NULL AND snapshot_id IS NOT NULL"), both)
    row("ERROR", "fact_fees", "fee month", "fee month has a balance", d.if_("snapshot_id IS NULL"), d.if_("fee_id IS NOT NULL"), both)
    row("WARN", "fact_portfolio_snapshot", "snapshot month", "balance month has a fee", d.if_("fee_id IS NULL"), d.if_("snapshot_id IS NOT NULL"), both)
    trading = f"{txn} f LEFT JOIN (SELECT date, min(is_trading_day) AS open FROM {cal} GROUP BY 1) k ON f.txn_date = k.date"
    for severity, name, kinds in (("WARN", "trades on a non-trading day", ("Buy", "Sell")), ("INFO", "cash events on a non-trading day", ("Dividend", *CASH))):
        row(severity, "fact_transactions", "txn_date", name, d.if_(f"{d.isin('f.txn_type', kinds)} AND k.open = '0'"), d.if_(d.isin("f.txn_type", kinds)), trading)
    months = f"(SELECT client_id, min(day) AS a, max(day) AS b, count(*) AS n FROM (SELECT client_id, {d.date('snapshot_date')} AS day FROM {snap}) z WHERE day IS NOT NULL GROUP BY 1) g"
    expected = f"({d.months('a', 'b')} + 1)"
    row("WARN", "fact_portfolio_snapshot", "client_id+snapshot_date", "missing months inside a history", f"CAST(coalesce(sum(greatest({expected} - n, 0)), 0) AS BIGINT)", f"CAST(coalesce(sum({expected}), 0) AS BIGINT)", months)
    last = f"(SELECT client_id, max(snapshot_date) AS last FROM {snap} GROUP BY 1)"
    state = f"{one} c JOIN {last} l ON c.client_id = l.client_id CROSS JOIN (SELECT max(snapshot_date) AS final FROM {snap}) z"
    row("WARN", "dim_client", "is_active", "inactive client has a last balance", d.if_("is_active = 'False' AND last = final"), d.if_("is_active = 'False'"), state, d.dealt("c", "l"))
    row("WARN", "dim_client", "is_active", "active client without a last balance", d.if_("is_active = 'True' AND last < final"), d.if_("is_active = 'True'"), state, d.dealt("c", "l"))
    late = f"{txn} f JOIN {one} c ON f.client_id = c.client_id JOIN {last} l ON f.client_id = l.client_id"
    row("WARN", "fact_transactions", "txn_date", "transaction after an inactive client last month", d.if_("c.is_active = 'False' AND substr(f.txn_date, 1, 7) > substr(l.last, 1, 7)"), d.if_("c.is_active = 'False'"), late, d.by_bucket("c", "l"))
    used = f"SELECT client_id FROM {fee} UNION SELECT client_id FROM {snap} UNION SELECT client_id FROM {txn}"
    row("INFO", "dim_client", "all facts", "client without any fact", d.if_("u.client_id IS NULL"), "count(*)", f"{client} c LEFT JOIN ({used}) u ON c.client_id = u.client_id", d.dealt("u"))
    return UNION.join(out)


_GRADED = f"CASE WHEN affected = 0 AND severity IN ('ERROR', 'WARN') THEN 'PASS' ELSE severity END"


def _graded(d: Dialect, source: str) -> str:
    """DQ-02: the findings with their severity after the fact and the share of rows."""
    return f"SELECT {_GRADED} AS severity, check_group, table_name, target, check_name, affected, denominator, {d.pct('affected', 'denominator')} AS pct_affected FROM ({source}) f"


def finding_steps(d: Dialect) -> dict[str, str]:
    return {"single_findings": single_table(d), "several_findings": several_rows(d), "cross_findings": cross_table(d)}


_EVERY = " UNION ALL ".join(f"SELECT * FROM {n}" for n in ("single_findings", "several_findings", "cross_findings"))


def report(d: Dialect) -> str:
    """SL-01, WN-07: all findings in the order of severity, group and table, with running ids. There are some hundreds of them, whatever the data's size."""
    rank = "CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END"
    place = f"row_number() OVER (ORDER BY {rank}, check_group, table_name, target, check_name)"
    return f"SELECT 'F' || lpad(CAST({place} AS STRING), 3, '0') AS finding_id, g.* FROM ({_graded(d, _EVERY)}) g"


def by_severity(d: Dialect) -> str:
    """AG-20: findings by table and severity."""
    return "SELECT table_name, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s.lower()}" for s in ("ERROR", "WARN", "INFO", "PASS")) + f" FROM ({_graded(d, _EVERY)}) g GROUP BY 1"


def difference(d: Dialect, a: str, b: str) -> str:
    """FN-PFX: how two texts differ: identical, case/whitespace, truncated/extended (a filled strict prefix, whatever its case), other."""
    x, y = f"lower(trim({a}))", f"lower(trim({b}))"
    short, long_ = f"CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END", f"CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END"
    return f"CASE WHEN {a} = {b} THEN 'identical' WHEN {x} = {y} THEN 'case/whitespace' WHEN length({x}) <> length({y}) AND length({short}) > 0 AND substr({long_}, 1, length({short})) = {short} THEN 'truncated/extended' ELSE 'other' END"


def near_pairs(d: Dialect) -> str:
    """DQ-05, JN-11, FN-PFX: pairs that agree on the match columns, and how their names differ. Rows are told apart by the numeric key."""
    match, compare = SPECS["dim_client"].near or ((), ())
    same = " AND ".join(f"a.{c} = b.{c}" for c in match)
    return f"SELECT a.client_id AS a, b.client_id AS b, " + ", ".join(f"{difference(d, f'a.{c}', f'b.{c}')} AS {c}_differs" for c in compare) + f" FROM {d.t('dim_client')} a JOIN {d.t('dim_client')} b ON {same} AND CAST(a.client_id AS BIGINT) < CAST(b.client_id AS BIGINT)"


def near_steps(d: Dialect) -> dict[str, str]:
    """The near-duplicate groups, one row each."""
    match, compare = SPECS["dim_client"].near or ((), ())
    rest = [c for c in SPECS["dim_client"].types if c not in (*match, *compare, "client_id")]
    differ = " || ".join(f"CASE WHEN min({c}) < max({c}) THEN '+{c}' ELSE '' END" for c in rest)
    return {"near_client_groups": f"SELECT {', '.join(match)}, min(CAST(client_id AS BIGINT)) AS first_id, substr({differ}, 2) AS others_differ FROM {d.t('dim_client')} GROUP BY {', '.join(match)} HAVING count(*) > 1"}


def near_evidence(d: Dialect) -> str:
    """DQ-06, WN-06, JN-06, AG-22: of each member of a near-duplicate group, the facts that refer to it and the other attributes that differ in its group. Groups
    are numbered by their first member, in ranges."""
    match, compare = SPECS["dim_client"].near or ((), ())
    facts = lambda t, day: f"(SELECT client_id, count(*) AS n, min({day}) AS a, max({day}) AS b FROM {d.t(t)} GROUP BY 1)"
    parts = (("fees", "fact_fees", "fee_date"), ("snapshots", "fact_portfolio_snapshot", "snapshot_date"), ("transactions", "fact_transactions", "txn_date"))
    joins = " ".join(f"LEFT JOIN {facts(t, day)} {n} ON c.client_id = {n}.client_id" for n, t, day in parts)
    shown = ", ".join(f"coalesce({n}.n, 0) AS n_{n}, coalesce({n}.a, '') AS {n}_first, coalesce({n}.b, '') AS {n}_last" for n, _, _ in parts)
    numbered = d.numbered("near_client_groups", "first_id", "group_no")
    return f"SELECT CAST(g.group_no AS BIGINT) AS group_no, c.client_id, {', '.join('c.' + x for x in compare)}, g.others_differ, {shown} FROM ({numbered}) g JOIN {d.t('dim_client')} c ON {' AND '.join(f'g.{m} = c.{m}' for m in match)} {joins}"


def move_steps(d: Dialect) -> dict[str, str]:
    """Every movement of a position with its size; whole and decimal shares are added exactly."""
    n, key = f"({d.money('shares')})", d.key("security_id")
    signed = f"CASE txn_type WHEN 'Buy' THEN abs({n}) WHEN 'Sell' THEN -abs({n}) ELSE 0 END"
    day = d.days("DATE '1970-01-01'", f"({d.date('txn_date')})")
    return {"security_moves": f"SELECT txn_id, client_id, {key} AS sec, {day} AS day_no, txn_type, {d.number('shares')} AS shares, coalesce({signed}, 0) AS moved FROM {d.t('fact_transactions')} WHERE NOT ({d.blank('security_id')})"}


def dividend_holdings(d: Dialect) -> str:
    """DQ-13, WN-01: shares of dividends against what earlier trades add up to, per client and security. A position is summed in ranges of days, so that none is held whole."""
    before = d.running("security_moves", "client_id, sec", "day_no", "day_no, CAST(txn_id AS BIGINT)", "moved", "held_exactly")
    held = f"SELECT *, CAST(held_exactly AS DOUBLE) AS held FROM ({before}) b"
    return f"SELECT txn_id, shares, held, held > 0 AS has_position, held > 0 AND abs(abs(shares) / nullif(held, 0) - 1) <= 0.01 AS equals_position FROM ({held}) h WHERE txn_type = 'Dividend'"


def benchmark_profiles(d: Dialect) -> str:
    """AG-17: the benchmarks that each risk profile's balances use, the usual one, and rows that use another."""
    joined = f"SELECT c.risk_profile AS p, f.benchmark_id AS b, count(*) AS n FROM {d.t('fact_portfolio_snapshot')} f JOIN (SELECT client_id, min(risk_profile) AS risk_profile FROM {d.t('dim_client')} GROUP BY 1) c ON f.client_id = c.client_id GROUP BY 1, 2"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, b) AS place FROM ({joined}) j"
    return f"SELECT p AS risk_profile, {d.joined('b || chr(58) || CAST(n AS STRING)', ', ', 'place')} AS used, max(CASE WHEN place = 1 THEN b END) AS usual, CAST(sum(CASE WHEN place > 1 THEN n ELSE 0 END) AS BIGINT) AS n_other FROM ({ranked}) r GROUP BY p"


def star_validation(d: Dialect) -> str:
    """SV-01: shape, keys, foreign keys, structural blanks, dates, grain, advisor paths and measures: 56 checks, each PASS, FAIL or, if it only informs, INFO."""
    tests = []

    def add(group: str, name: str, source: str, bad: str = "count(*)", info: bool = False, hint: str = "") -> None:
        status = "'INFO'" if info else f"CASE WHEN {bad} = 0 THEN 'PASS' ELSE 'FAIL' END"
        tests.append(f"SELECT {hint}'{group}' AS check_group, '{name}' AS check_name, {bad} AS n_bad, {status} AS status FROM {source}")

    facts = {"fact_fees": "fee_date", "fact_portfolio_snapshot": "snapshot_date", "fact_transactions": "txn_date"}
    n, money, blank = (lambda c: f"({d.number(c)})"), (lambda c: f"({d.money(c)})"), (lambda c: f"({d.blank(c)})")
    txn, fees, snaps = (d.t(t) for t in ("fact_transactions", "fact_fees", "fact_portfolio_snapshot"))
    for t in SPECS:
        add("row counts", f"{t} has rows", d.t(t), "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END")
        add("primary keys", f"{t}.{PK[t]}", f"(SELECT {PK[t]} FROM {d.t(t)} GROUP BY 1 HAVING count(*) > 1 OR {blank(PK[t])}) g")
    for child, ck, parent, pk in RELATIONSHIPS:
        if parent != "dim_date":
            key = d.key(f"c.{ck}") if ck == "security_id" else f"c.{ck}"
            if d.spread:  # keys of both sides are counted together, so that no parent's are sent through the driver
                filled = f" WHERE NOT {blank('c.' + ck)}" if ck == "security_id" else ""
                both = f"SELECT {key} AS k, 1 AS m, 0 AS p FROM {d.t(child)} c{filled} UNION ALL SELECT {pk}, 0, 1 FROM {d.t(parent)} WHERE {pk} IS NOT NULL"
                add("foreign keys", f"{child}.{ck}", f"(SELECT sum(m) AS m, max(p) AS p FROM ({both}) u GROUP BY k) g", "CAST(coalesce(sum(CASE WHEN p = 0 THEN m END), 0) AS BIGINT)")
                continue
            add("foreign keys", f"{child}.{ck}", f"{d.t(child)} c LEFT JOIN (SELECT DISTINCT {pk} AS k FROM {d.t(parent)}) p ON {key} = p.k WHERE p.k IS NULL" + (f" AND NOT {blank('c.' + ck)}" if ck == "security_id" else ""))
    cash = d.isin("txn_type", CASH)
    add("security blanks", "blank on cash rows", f"{txn} WHERE {blank('security_id')} AND {cash}", info=True)
    add("security blanks", "blank on traded rows", f"{txn} WHERE {blank('security_id')} AND NOT {cash}")
    add("security blanks", "filled on cash rows", f"{txn} WHERE NOT {blank('security_id')} AND {cash}")
    day = f"({d.date('date')})"
    add("dates", "calendar dates parse and are unique", f"(SELECT date FROM {d.t('dim_date')} GROUP BY 1 HAVING count(*) > 1 OR min(CASE WHEN {day} IS NULL THEN 0 ELSE 1 END) = 0) g")
    add("dates", "calendar is contiguous", f"(SELECT count(DISTINCT day) AS n, min(day) AS a, max(day) AS b FROM (SELECT {day} AS day FROM {d.t('dim_date')}) z) g", f"CAST(max(coalesce({d.days('a', 'b')} + 1 - n, 0)) AS BIGINT)")
    for t, c in facts.items():
        add("dates", f"{t}.{c} is in the calendar", f"{d.t(t)} c LEFT JOIN (SELECT DISTINCT date AS k FROM {d.t('dim_date')}) p ON c.{c} = p.k WHERE p.k IS NULL OR ({d.date(f'c.{c}')}) IS NULL")
    add("dates", "fact dates are calendar dates", f"{fees} WHERE ({d.date('fee_date')}) IS NOT NULL", info=True)
    add("dates", "balances on the last day of a month", f"{snaps} c JOIN (SELECT DISTINCT date AS k FROM {d.t('dim_date')} WHERE is_month_end = '1') p ON c.snapshot_date = p.k", info=True)
    add("dates", "clients since a day outside the calendar", f"{d.t('dim_client')} c LEFT JOIN (SELECT DISTINCT date AS k FROM {d.t('dim_date')}) p ON c.client_since = p.k WHERE p.k IS NULL", info=True)
    extra = lambda t, key: f"(SELECT count(*) AS m FROM {d.t(t)} GROUP BY {key} HAVING count(*) > 1) g"
    repeated = "CAST(coalesce(sum(m - 1), 0) AS BIGINT)"
    for t, key in (("fact_fees", "client_id, fee_date"), ("fact_portfolio_snapshot", "client_id, snapshot_date"), ("fact_transactions", "txn_id")):
        add("grain", f"{t} unique on {key}", extra(t, key), repeated)
    for t in ("fact_fees", "fact_portfolio_snapshot"):
        add("grain", f"{t}.{facts[t]} is the 1st of a month", f"{d.t(t)} WHERE substr({facts[t]}, 9, 2) <> '01'")
    on = f"({d.date('snapshot_date')})"
    add("grain", "year and month agree with the date", f"{snaps} WHERE coalesce(year <> CAST(extract(year FROM {on}) AS STRING) OR month <> CAST(extract(month FROM {on}) AS STRING), true)")
    add("grain", "transactions identical but for the key", extra("fact_transactions", ", ".join(c for c in SPECS["fact_transactions"].types if c != "txn_id")), repeated, info=True)
    for t in facts:
        add("advisor paths", f"{t} advisor differs from the client advisor", f"{d.t(t)} f JOIN (SELECT client_id, min(advisor_id) AS advisor_id FROM {d.t('dim_client')} GROUP BY 1) c ON f.client_id = c.client_id WHERE f.advisor_id <> c.advisor_id", info=True, hint=d.by_bucket("c"))
    add("advisor paths", "transactions after an inactive client last month", "clean_fact_transactions WHERE after_last_snapshot_flag = '1'", info=True)
    add("measures", "fee amount = basis x bps / 10000 / 12", f"{fees} WHERE NOT coalesce(abs({n('amount')} - {n('aum_basis')} * {n('bps_charged')} / 120000) <= 0.01, false)")
    add("measures", "fee basis = balance of the client and month", f"{fees} f LEFT JOIN (SELECT client_id, snapshot_date, min(aum) AS aum FROM {snaps} GROUP BY 1, 2) s ON f.client_id = s.client_id AND f.fee_date = s.snapshot_date WHERE NOT coalesce(abs({money('f.aum_basis')} - {money('s.aum')}) <= 0.01, false)", hint=d.dealt("s"))
    add("measures", "alpha = return - benchmark within 1e-5", f"{snaps} WHERE NOT coalesce(abs({n('return_ytd')} - {n('benchmark_return_ytd')} - {n('active_alpha_ytd')}) <= 1e-5, false)")
    add("measures", "rows flagged as suspect returns", f"{snaps} WHERE is_return_suspect = '1'", info=True)
    add("measures", "no negative amounts", f"(SELECT amount FROM {txn} UNION ALL SELECT amount FROM {fees}) a WHERE {n('amount')} < 0")
    add("measures", "traded amount = shares x price", f"{txn} WHERE {d.isin('txn_type', TRADED)} AND NOT coalesce(abs({n('amount')} - {n('shares')} * {n('price')}) <= 0.01, false)")
    add("measures", "shares and price are blank on cash rows", f"{txn} WHERE {cash} AND NOT ({blank('shares')} AND {blank('price')})")
    cents = lambda t, where: f"(SELECT coalesce(sum({money('amount')}), 0) FROM {t}{where})"
    advisory = " WHERE txn_type = 'Advisory Fee'"
    add("measures", "cents between advisory debits and billed fees", f"(SELECT {cents(txn, advisory)} - {cents(fees, '')} AS gap) g", "CAST(round(max(abs(gap)) * 100) AS BIGINT)", info=True)
    return UNION.join(tests)


over_star("dq03_column_findings", lambda d: _graded(d, "SELECT * FROM single_findings"), finding_steps)
over_star("dq04_table_findings", lambda d: _graded(d, "SELECT * FROM several_findings"), finding_steps)
over_star("dq17_cross_findings", lambda d: _graded(d, "SELECT * FROM cross_findings"), finding_steps)
over_star("sl01_findings", report, finding_steps)
over_star("ag20_severities", by_severity, finding_steps)
over_star("dq05_near_pairs", near_pairs)
over_star("dq06_near_evidence", near_evidence, near_steps)
over_star("dq13_dividend_holdings", dividend_holdings, move_steps)
over_star("ag17_benchmark_profiles", benchmark_profiles)
over_star("sv01_star_validation", star_validation, steps)
