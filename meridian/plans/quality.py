"""Data quality over the star: profiles, findings, rules, integrity, reconciliations, outliers and the scorecard.

Everything is compiled from the specs: all rules of a table are one aggregate, all integrity checks one union. Blank, invalid and non-finite cells
never reach a comparison; what can't be judged is counted apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from ..operators.spec import HARD_LISTS, INFERRED_SIGNS, SPECS, TRADED, TableSpec
from .cleaning import CLEAN, steps
from .dialect import Dialect, Typed, in_parts, over_star
from .star import PK, RELATIONSHIPS

#: (rule, class, kind, applies, assessable, passes)
Rule = tuple[str, str, str, str, str, str]
Build = Callable[[Dialect], str]
UNION = "\nUNION ALL "
#: What follows a value in a list of frequent ones.
MARK = " || ':' || CAST(m AS STRING)"


def _applies(d: Dialect, spec: TableSpec, c: str) -> str:
    return f"NOT {d.isin(*spec.blank_when[c])}" if c in spec.blank_when else "true"


def _between(x: str, low: object, high: object) -> str:
    return " AND ".join([f"{x} >= {low}"] * (low is not None) + [f"{x} <= {high}"] * (high is not None))


def _day(x: str | None) -> str | None:
    return x and f"DATE '{x}'"


def calendar(d: Dialect, day: str) -> dict[str, str]:
    """What the attributes of a calendar row must be for its day."""
    part = lambda p: f"CAST(extract({p} FROM {day}) AS STRING)"
    ends = f"extract(day FROM {day} + INTERVAL 1 DAY) = 1"
    month = f"CAST(extract(month FROM {day}) AS INT)"
    flag = lambda test: f"CASE WHEN {test} THEN '1' ELSE '0' END"
    return {**{c: part(p) for c, p in (("year", "year"), ("quarter", "quarter"), ("month", "month"), ("week_of_year", "week"))}, "is_month_end": flag(ends), "is_quarter_end": flag(f"{ends} AND {month} % 3 = 0"), "is_year_end": flag(f"{ends} AND {month} = 12"), "month_name": d.month_name(day), "day_of_week": d.day_name(day)}


def rules_of(d: Dialect, table: str) -> list[Rule]:
    """The rules of one table that look at single rows."""
    spec, out = SPECS[table], []
    for c, values in spec.allowed.items():
        out.append((f"{c}.allowed", "hard" if (table, c) in HARD_LISTS else "inferred", "code_list", _applies(d, spec, c), f"NOT ({d.blank(c)})", d.isin(c, values)))
    for c, (low, high) in spec.ranges.items():
        sign = (table, c) in INFERRED_SIGNS
        out.append((f"{c}.range", "inferred" if sign else "hard", "sign" if sign or high is None and low in (0, 0.01, 0.0001) else "bound", _applies(d, spec, c), f"{d.number(c)} IS NOT NULL", _between(f"({d.number(c)})", low, high)))
    for c, (low, high) in spec.dates.items():
        out.append((f"{c}.date_range", "hard", "bound", "true", f"({d.date(c)}) IS NOT NULL", _between(f"({d.date(c)})", _day(low), _day(high))))
    for c, pattern in spec.patterns.items():
        out.append((f"{c}.pattern", "hard", "pattern", "true", f"NOT ({d.blank(c)})", d.match(c, pattern)))
    for c, (condition, values) in spec.blank_when.items():
        out.append((f"{c}.conditional_blank", "inferred", "structural", "true", f"NOT ({d.blank(condition)})", f"({d.blank(c)}) = {d.isin(condition, values)}"))
    for c, (low, high) in spec.plausible.items():
        out.append((f"{c}.plausible", "plausibility", "band", _applies(d, spec, c), f"{d.number(c)} IS NOT NULL", _between(f"({d.number(c)})", low, high)))
    for c, (low, high) in spec.plausible_dates.items():
        out.append((f"{c}.plausible_date", "plausibility", "band", "true", f"({d.date(c)}) IS NOT NULL", _between(f"({d.date(c)})", _day(low), _day(high))))
    n = lambda c: f"({d.number(c)})"
    known = lambda *cs: " AND ".join(f"{n(c)} IS NOT NULL" for c in cs)
    if table == "dim_date":
        day = f"({d.date('date')})"
        out += [(f"{c}.derived", "hard", "derived", "true", f"{day} IS NOT NULL", f"{c} = {want}") for c, want in calendar(d, day).items()]
        weekend = f"{d.day_name(day)} IN ('Saturday', 'Sunday')"
        out.append(("is_trading_day.weekend", "hard", "derived", f"coalesce({weekend}, true)", f"{day} IS NOT NULL", "is_trading_day = '0'"))
    if table in ("fact_portfolio_snapshot", "fact_fees"):
        c = "snapshot_date" if table == "fact_portfolio_snapshot" else "fee_date"
        day = f"({d.date(c)})"
        out.append((f"{c}.first_of_month", "inferred", "structural", "true", f"{day} IS NOT NULL", f"extract(day FROM {day}) = 1"))
    if table == "fact_portfolio_snapshot":
        out.append(("year_month.derived", "hard", "derived", "true", f"{day} IS NOT NULL", f"year = CAST(extract(year FROM {day}) AS STRING) AND month = CAST(extract(month FROM {day}) AS STRING)"))
        three = ("return_ytd", "benchmark_return_ytd", "active_alpha_ytd")
        out.append(("alpha_identity", "inferred", "within_table", "true", known(*three), f"abs({n(three[0])} - {n(three[1])} - {n(three[2])}) <= 1e-4"))
    if table == "fact_fees":
        out.append(("amount_formula", "inferred", "within_table", "true", known("aum_basis", "bps_charged", "amount"), f"abs({n('amount')} - {n('aum_basis')} * {n('bps_charged')} / 120000) <= 0.01"))
    if table == "fact_transactions":
        out += [(f"{t.lower()}_amount", "inferred", "within_table", f"txn_type = '{t}'", known("shares", "price", "amount"), f"abs({n('amount')} - {n('shares')} * {n('price')}) <= 0.01") for t in TRADED]
    return out


_COLUMNS = "stage, table_name, rule, rule_class, kind, n_rows, not_applicable, unassessable, passed, failed"


def _rules(d: Dialect, stage: str, table: str, name: str) -> str:
    """All rules of a table: cells are parsed once a row, each rule is then one small code a row (not applicable, not assessable, passed, failed), and one aggregate counts the codes. Keys that must be unique are one more aggregate each."""
    typed = Typed(d)
    out = []
    for part in in_parts(d, rules_of(typed, table), lambda r: r[0]):
        codes, counts, rows = [], ["count(*) AS n"], []
        for i, (rule, kind_of, kind, applies, ready, ok) in enumerate(part):
            codes.append(f"CASE WHEN NOT coalesce({applies}, false) THEN 0 WHEN NOT coalesce({ready}, false) THEN 1 WHEN coalesce({ok}, false) THEN 2 ELSE 3 END AS r{i}")
            counts += [f"{d.if_(f'r{i} = {k}')} AS {x}{i}" for k, x in enumerate("abcd")]
            rows.append((*(f"'{x}'" for x in (stage, table, rule, kind_of, kind)), "n", f"a{i}", f"b{i}", f"c{i}", f"d{i}"))
        out.append(d.fan(f"(SELECT {', '.join(counts)} FROM (SELECT {', '.join(codes)} FROM {typed.source(name, ', '.join(codes) if d.spread else None)}) coded) one", _COLUMNS, rows))
    for key in SPECS[table].keys:
        blank = " OR ".join(d.blank(c) for c in key)
        groups = f"SELECT CASE WHEN {blank} THEN 0 ELSE 1 END AS ready, count(*) AS m FROM {name} GROUP BY {', '.join(key)}"
        total = lambda test: f"CAST(coalesce(sum(CASE WHEN {test} THEN m END), 0) AS BIGINT)"
        out.append(f"SELECT '{stage}', '{table}', '{'+'.join(key)}.unique', 'hard', 'uniqueness', {total('true')}, CAST(0 AS BIGINT), {total('ready = 0')}, {total('ready = 1 AND m = 1')}, {total('ready = 1 AND m > 1')} FROM ({groups}) g")
    return UNION.join(out)


def _stages(d: Dialect) -> list[tuple[str, Callable[[str], str]]]:
    return [("raw", d.t), ("clean", lambda t: f"clean_{t}" if t in CLEAN else d.t(t))]


def rulebook(d: Dialect) -> str:
    """DQ-24: every rule of every table, on the raw and on the cleaned stage."""
    rows = [r for stage, name in _stages(d) for t in SPECS if (r := _rules(d, stage, t, name(t)))]
    return f"SELECT {_COLUMNS}, passed + failed AS eligible, {d.pct('passed', '(passed + failed)')} AS pass_pct FROM ({UNION.join(rows)}) x"


def _integrity(d: Dialect, stage: str, name: Callable[[str], str]) -> list[str]:
    """One row a relationship: exact text and normalised keys, blanks apart; the child is reduced to its keys before it meets the parent."""
    out = []
    for child, ckey, parent, pkey in RELATIONSHIPS:
        total = lambda test: f"CAST(coalesce(sum(CASE WHEN {test} THEN m END), 0) AS BIGINT)"
        keys = f"SELECT {ckey} AS k, count(*) AS m FROM {name(child)} GROUP BY 1"
        owners = f"SELECT DISTINCT {pkey} AS k FROM {name(parent)} WHERE NOT ({d.blank(pkey)})"
        bare = f"SELECT DISTINCT {d.key(pkey)} AS k FROM {name(parent)} WHERE NOT ({d.blank(pkey)})"
        used = f"SELECT DISTINCT {d.key(ckey)} AS k FROM {name(child)} WHERE NOT ({d.blank(ckey)})"
        counted = f"SELECT c.k, c.m, {d.blank('c.k')} AS is_blank, p.k IS NOT NULL AS exact, b.k IS NOT NULL AS loose FROM ({keys}) c LEFT JOIN ({owners}) p ON c.k = p.k LEFT JOIN ({bare}) b ON {d.key('c.k')} = b.k"
        unused = f"SELECT count(*) AS unused FROM ({bare}) b LEFT JOIN ({used}) u ON b.k = u.k WHERE u.k IS NULL"
        sums = f"SELECT {total('true')} AS n_rows, {total('is_blank')} AS n_blank, {total('NOT is_blank AND exact')} AS matched, {total('NOT is_blank AND loose')} AS loosely, {total('NOT is_blank AND NOT loose')} AS orphans, {d.if_('NOT is_blank AND NOT loose')} AS orphan_keys FROM ({counted}) z"
        out.append(f"SELECT '{stage}' AS stage, '{child}' AS child, '{child}.{ckey} -> {parent}.{pkey}' AS relationship, n_rows, n_blank, matched, loosely, orphans, orphan_keys, unused FROM ({sums}) s CROSS JOIN ({unused}) u")
    return out


def _met_keys(d: Dialect) -> str:
    """The same rows without a join, for Spark may broadcast whole keys of a parent, whose compressed files look small: keys of both sides are counted together, first by their text, then by the
    normalised key. Rows of no weight keep relationships of empty tables."""
    every = [(stage, name, r) for stage, name in _stages(d) for r in RELATIONSHIPS]
    entries = []
    for i, (_, name, (child, ckey, parent, pkey)) in enumerate(every):
        entries += [f"SELECT {i} AS r, {ckey} AS k, 1 AS m, 0 AS p FROM {name(child)}", f"SELECT {i} AS r, {pkey} AS k, 0 AS m, 1 AS p FROM {name(parent)} WHERE NOT ({d.blank(pkey)})"]
    entries.append(f"SELECT explode(sequence(0, {len(every) - 1})) AS r, CAST(NULL AS STRING) AS k, 0 AS m, 0 AS p")
    texts = f"SELECT r, k, sum(m) AS m, max(p) AS p FROM ({UNION.join(entries)}) e GROUP BY r, k"
    total = lambda test, x="m": f"CAST(coalesce(sum(CASE WHEN {test} THEN {x} END), 0) AS BIGINT)"
    keys = f"SELECT r, max(p) AS p, {total('true')} AS n_rows, {total('is_blank')} AS n_blank, {total('NOT is_blank AND p = 1')} AS matched, {total('NOT is_blank')} AS filled, {d.if_('NOT is_blank AND m > 0')} AS n_keys FROM (SELECT *, {d.key('k')} AS g, {d.blank('k')} AS is_blank FROM ({texts}) t) z GROUP BY r, g"
    sums = f"SELECT r, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('n_rows', 'n_blank', 'matched'))}, {total('p = 1', 'filled')} AS loosely, {total('p = 0', 'filled')} AS orphans, {total('p = 0', 'n_keys')} AS orphan_keys, {d.if_('p = 1 AND n_rows = 0')} AS unused FROM ({keys}) y GROUP BY r"
    shown = lambda x: f"element_at(array({', '.join(repr(x(*e)) for e in every)}), r + 1)"
    relation = lambda _, __, r: f"{r[0]}.{r[1]} -> {r[2]}.{r[3]}"
    return f"SELECT {shown(lambda s, _, r: s)} AS stage, {shown(lambda s, _, r: r[0])} AS child, {shown(relation)} AS relationship, n_rows, n_blank, matched, loosely, orphans, orphan_keys, unused FROM ({sums}) s"


def integrity(d: Dialect) -> str:
    """DQ-15: the relationships on both stages, with rates."""
    rows = [_met_keys(d)] if d.spread else [r for stage, name in _stages(d) for r in _integrity(d, stage, name)]
    return f"SELECT *, {d.pct('n_blank', 'n_rows')} AS null_key_rate, {d.pct('matched', '(n_rows - n_blank)')} AS raw_match_rate, {d.pct('loosely', '(n_rows - n_blank)')} AS normalized_match_rate FROM ({UNION.join(rows)}) x"


def parent_keys(d: Dialect) -> str:
    """DQ-16: blank and repeated keys of every parent, on both stages."""
    rows = []
    for stage, name in _stages(d):
        for _, _, parent, key in dict.fromkeys((None, None, p, k) for _, _, p, k in RELATIONSHIPS):
            groups = f"SELECT {d.blank(key)} AS is_blank, count(*) AS m FROM {name(parent)} GROUP BY {key}"
            total = lambda test: f"CAST(coalesce(sum(CASE WHEN {test} THEN m END), 0) AS BIGINT)"
            rows.append(f"SELECT '{stage}' AS stage, '{parent}' AS parent, '{key}' AS key_name, {total('true')} AS parent_rows, {total('is_blank')} AS blank_keys, {total('NOT is_blank AND m > 1')} AS duplicate_rows, {d.if_('NOT is_blank AND m > 1')} AS duplicate_keys, coalesce(max(CASE WHEN is_blank OR m > 1 THEN 1 ELSE 0 END), 0) = 0 AS is_unique FROM ({groups}) g")
    return UNION.join(rows)


def _counted_cells(d: Dialect, spec: TableSpec, table: str) -> str:
    """The cells of a table that apply, are filled and are valid, in parts: each cell is one small code (not applicable, blank, invalid, valid), and codes are counted."""
    names = ("cells_applicable", "cells_filled", "cells_valid")
    out = []
    for part in in_parts(d, list(spec.types), lambda c: c):
        typed = Typed(d)
        codes = ", ".join(f"CASE WHEN NOT ({_applies(d, spec, c)}) THEN 0 WHEN {typed.blank(c)} THEN 1 WHEN {typed.valid(c, spec.types[c])} THEN 3 ELSE 2 END AS c{i}" for i, c in enumerate(part))
        sums = ", ".join(f"{' + '.join(d.if_(f'c{i} > {least}') for i in range(len(part)))} AS {n}" for least, n in enumerate(names))
        out.append(f"SELECT count(*) AS row_count, {sums} FROM (SELECT {codes} FROM {typed.source(table)}) coded")
    return f"SELECT max(row_count) AS row_count, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in names)} FROM ({UNION.join(out)}) p"


def scorecard(d: Dialect) -> str:
    """DQ-26: completeness, key uniqueness, type validity, rule pass and referential match of each table and stage; ratios of sums, null without a denominator."""
    cells = []
    for stage, name in _stages(d):
        for t, spec in SPECS.items():
            applies = [_applies(d, spec, c) for c in spec.types]
            typed = Typed(d)
            filled = [f"({a}) AND NOT ({typed.blank(c)})" for a, c in zip(applies, spec.types, strict=True)]
            valid = [f"{f} AND {typed.valid(c, k)}" for f, (c, k) in zip(filled, spec.types.items(), strict=True)]
            total = lambda tests: f"CAST(coalesce(sum({' + '.join(f'CASE WHEN {x} THEN 1 ELSE 0 END' for x in tests)}), 0) AS BIGINT)"
            a = f"SELECT count(*) AS row_count, {total(applies)} AS cells_applicable, {total(filled)} AS cells_filled, {total(valid)} AS cells_valid FROM {typed.source(name(t))}"
            if d.spread:
                a = _counted_cells(d, spec, name(t))
            groups = f"SELECT count(*) AS m FROM {name(t)} WHERE NOT ({d.blank(spec.pk)}) GROUP BY {spec.pk}"
            cells.append(f"SELECT '{stage}' AS stage, '{t}' AS table_name, a.*, u.uniq FROM ({a}) a CROSS JOIN (SELECT count(*) FILTER (WHERE m = 1) AS uniq FROM ({groups}) g) u")
    counted = "rule_class <> 'plausibility'"
    ruled = f"SELECT stage, table_name, CAST(sum(CASE WHEN rule_class <> 'plausibility' THEN passed ELSE 0 END) AS BIGINT) AS rule_passed, CAST(sum(CASE WHEN rule_class <> 'plausibility' THEN passed + failed ELSE 0 END) AS BIGINT) AS rule_eligible, CAST(sum(CASE WHEN rule_class <> 'plausibility' THEN unassessable ELSE 0 END) AS BIGINT) AS rule_unassessable, {d.if_(counted)} AS rules_counted, CAST(sum(CASE WHEN rule_class = 'plausibility' THEN failed ELSE 0 END) AS BIGINT) AS warnings FROM rule_results r GROUP BY 1, 2"
    linked = f"SELECT stage, child, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(n_rows - n_blank) AS BIGINT) AS eligible, count(*) AS relationships FROM link_results l GROUP BY 1, 2"
    return f"""SELECT c.stage, c.table_name, row_count, {d.pct('cells_filled', 'cells_applicable')} AS pct_completeness, {d.pct('uniq', 'row_count')} AS pct_key_uniqueness, {d.pct('cells_valid', 'cells_filled')} AS pct_type_validity,
{d.pct('rule_passed', 'rule_eligible')} AS pct_rule_pass, rule_unassessable, rules_counted, {d.pct('matched', 'eligible')} AS pct_referential_match, coalesce(relationships, 0) AS relationships, warnings
FROM ({UNION.join(cells)}) c LEFT JOIN ({ruled}) r ON c.stage = r.stage AND c.table_name = r.table_name LEFT JOIN ({linked}) l ON c.stage = l.stage AND c.table_name = l.child"""


def rule_totals(d: Dialect) -> str:
    """AG-26: the rule results by stage, table and class."""
    return f"SELECT stage, table_name, rule_class, count(*) AS n_rules, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed FROM rule_results r GROUP BY 1, 2, 3"


def examples(d: Dialect) -> str:
    """AG-27, SL-03: of each failed check the first three rows by key, as text."""
    bad = {"fact_transactions": ("shares", f"({d.number('shares')}) < 0"), "dim_client": ("state", f"NOT {d.isin('state', SPECS['dim_client'].allowed['state'])}"), "fact_fees": ("amount", f"NOT {d.valid('amount', 'float')}")}
    rows = []
    for t, (c, test) in bad.items():
        ranked = f"SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k) AS place FROM (SELECT '{c}' AS column_name, CAST({PK[t]} AS BIGINT) AS k, '{PK[t]}=' || {PK[t]} || ', {c}=' || {c} AS shown FROM {d.t(t)} WHERE {test}) f"
        rows.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {d.joined('shown', ' | ', 'place')} AS examples FROM ({ranked}) r WHERE place <= 3")
    return UNION.join(rows)


def rule_examples(d: Dialect) -> str:
    """AG-27, SL-03: of every rule that a raw table breaks, the first three rows by key. All rules of a table are judged in one pass; of each rule a task keeps no more than
    three rows before anything is exchanged (a limit within the window), however many fail."""
    out = []
    for t in SPECS:
        typed = Typed(d)
        rules = rules_of(typed, t)
        if not rules:
            continue
        failed = [f"(coalesce({applies}, false) AND coalesce({ready}, false) AND NOT coalesce({ok}, false))" for _, _, _, applies, ready, ok in rules]
        marks = ", ".join(f"{f} AS f{i}" for i, f in enumerate(failed))
        key = f"try_cast({PK[t]} AS BIGINT)"
        rows = [(f"'{rule}'", "k", "shown", f"f{i}") for i, (rule, *_) in enumerate(rules)]
        every = d.fan(f"(SELECT {key} AS k, {PK[t]} AS shown, {marks} FROM {typed.source(d.t(t))}) one", "rule, k, shown, failed", rows)
        ranked = f"SELECT *, row_number() OVER (PARTITION BY rule ORDER BY k, shown) AS place FROM ({every}) e WHERE failed"
        out.append(f"SELECT '{t}' AS table_name, rule, {d.joined('shown', ', ', 'place')} AS first_keys FROM ({ranked}) r WHERE place <= 3 GROUP BY rule")
    return UNION.join(out)


def column_profile(d: Dialect, tables: tuple[str, ...]) -> str:
    """DQ-01: the metrics of every column of the specs, also of a table without rows. A column is first reduced to its distinct values with counts, so all metrics come from one small table."""
    values, kinds = [], {}
    for t in tables:
        for c, kind in SPECS[t].types.items():
            kinds[(t, c)] = kind
            values.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS kind, coalesce({c}, '') AS v, count(*) AS m FROM {d.t(t)} GROUP BY {c}")
    total = lambda test: f"CAST(coalesce(sum(CASE WHEN {test} THEN m END), 0) AS BIGINT)"
    if d.spread:
        return _spread_profile(d, values, kinds)
    ok = "CASE kind " + " ".join(f"WHEN '{k}' THEN {d.kind('v', k)}" for k in ("int", "float", "date", "bool", "str")) + " END"
    cells = f"SELECT *, NOT ({d.blank('v')}) AS filled, {ok} AS ok, {d.shape('v')} AS shape, lower({d.replace('trim(v)', '[ ]+', ' ')}) AS folded, {d.number('v')} AS x, {d.date('v')} AS day FROM ({UNION.join(values)}) u"
    signless = d.replace("shape", "^[+-]+", "")
    shapes = "SELECT table_name, column_name, shape, CAST(sum(m) AS BIGINT) AS m FROM cells GROUP BY 1, 2, 3"
    quoted = lambda what: f"'\'\'' || {what} || '\'\''"
    top = lambda source, what: f"SELECT table_name, column_name, {d.joined(quoted(what) + MARK, '; ', 'place')} AS shown FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY m DESC, {what}) AS place FROM {source}) r WHERE place <= 5 GROUP BY 1, 2"
    fails = f"SELECT table_name, column_name, {d.joined(quoted('v'), '; ', 'place')} AS shown FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY v) AS place FROM cells WHERE filled AND NOT ok) r WHERE place <= 5 GROUP BY 1, 2"
    formats = f"count(DISTINCT CASE WHEN filled THEN {signless} END)"
    variants = "count(DISTINCT CASE WHEN filled THEN v END) - count(DISTINCT CASE WHEN filled THEN folded END)"
    typed = "kind IN ('int', 'float', 'date', 'bool')"
    bound = lambda f: f"CASE WHEN kind IN ('int', 'float') THEN CAST({f}(CAST(x AS DECIMAL(30, 4))) AS STRING) WHEN kind = 'date' THEN CAST({f}(day) AS STRING) END"
    one = f"""SELECT table_name, column_name, kind AS expected_type, {total('true')} AS n_rows, {total('NOT filled')} AS n_blank, {total('filled AND ' + d.token('v'))} AS n_null_tokens, {total('filled')} AS n_filled, {d.if_('filled')} AS n_distinct,
count(DISTINCT shape) AS n_shapes, {total('filled AND NOT ok')} AS n_parse_fails, {total('v <> trim(v)')} AS n_edge_space, {total(d.match('v', '[ ]{2,}'))} AS n_inner_space, CASE WHEN {typed} THEN {formats} > 1 ELSE {variants} > 0 END AS mixed_formats,
CAST(min(CASE WHEN filled THEN length(v) END) AS INT) AS min_len, CAST(max(CASE WHEN filled THEN length(v) END) AS INT) AS max_len, {bound('min')} AS least, {bound('max')} AS most FROM cells GROUP BY 1, 2, 3"""
    specs = UNION.join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS expected_type" for (t, c), kind in kinds.items())
    counts = ("n_rows", "n_blank", "n_null_tokens", "n_filled", "n_distinct", "n_shapes", "n_parse_fails", "n_edge_space", "n_inner_space")
    shown = ", ".join(f"coalesce(o.{c}, 0) AS {c}" for c in counts)
    same = lambda x: f"s.table_name = {x}.table_name AND s.column_name = {x}.column_name"
    return f"""WITH cells AS ({cells}), one AS ({one}), specs AS ({specs}) SELECT s.table_name, s.column_name, s.expected_type, {shown}, coalesce(o.mixed_formats, false) AS mixed_formats, o.min_len, o.max_len, o.least, o.most,
{d.pct('n_blank', 'n_rows')} AS pct_blank, {d.pct('n_distinct', 'n_filled')} AS pct_distinct, {d.pct('n_parse_fails', 'n_filled')} AS pct_parse_fails, tv.shown AS top_values, ts.shown AS top_shapes, coalesce(pf.shown, '') AS parse_fail_examples
FROM specs s LEFT JOIN one o ON {same('o')} LEFT JOIN ({top('cells', 'v')}) tv ON {same('tv')} LEFT JOIN ({top('(' + shapes + ') q', 'shape')}) ts ON {same('ts')} LEFT JOIN ({fails}) pf ON {same('pf')}"""


def _spread_profile(d: Dialect, values: list[str], kinds: dict[tuple[str, str], str]) -> str:
    """The same metrics where rows are spread over tasks: distinct values are counted and written once, read again to be summed by shape (no other metric but the foldings needs distinct ones), and
    the first five of a column are kept as such by each task, so that no column's values are sorted or expanded."""
    found = d.once("profile_values", UNION.join(values))
    sum_if = lambda test: f"CAST(coalesce(sum(CASE WHEN {test} THEN m END), 0) AS BIGINT)"
    ok = "CASE kind " + " ".join(f"WHEN '{k}' THEN {d.kind('v', k)}" for k in ("int", "float", "date", "bool", "str")) + " END"
    cells = f"SELECT *, NOT ({d.blank('v')}) AS filled, {ok} AS ok, {d.shape('v')} AS shape, CASE WHEN kind IN ('int', 'float') THEN CAST({d.number('v')} AS DECIMAL(30, 4)) END AS x, CASE WHEN kind = 'date' THEN {d.date('v')} END AS day FROM {found}"
    sums = {"n_rows": sum_if("true"), "n_blank": sum_if("NOT filled"), "n_null_tokens": sum_if("filled AND " + d.token("v")), "n_filled": sum_if("filled"), "n_distinct": d.if_("filled"), "n_parse_fails": sum_if("filled AND NOT ok"), "n_edge_space": sum_if("v <> trim(v)"), "n_inner_space": sum_if(d.match("v", "[ ]{2,}"))}
    ends = {f"{f}_{name}": (f, x) for f in ("min", "max") for name, x in (("len", "CASE WHEN filled THEN length(v) END"), ("x", "x"), ("day", "day"))}
    shapes = d.once("profile_shapes", f"SELECT table_name, column_name, kind, shape, {', '.join(f'{x} AS {n}' for n, x in sums.items())}, {', '.join(f'{f}({x}) AS {n}' for n, (f, x) in ends.items())} FROM ({cells}) c GROUP BY 1, 2, 3, 4")
    signless = d.replace("shape", "^[+-]+", "")
    bound = lambda f: f"CASE WHEN kind IN ('int', 'float') THEN CAST({f}({f}_x) AS STRING) WHEN kind = 'date' THEN CAST({f}({f}_day) AS STRING) END"
    one = f"SELECT table_name, column_name, kind, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in sums)}, count(*) AS n_shapes, count(DISTINCT CASE WHEN shape <> '<blank>' THEN {signless} END) AS n_formats, CAST(min(min_len) AS INT) AS min_len, CAST(max(max_len) AS INT) AS max_len, {bound('min')} AS least, {bound('max')} AS most FROM {shapes} GROUP BY 1, 2, 3"
    folded = f"SELECT table_name, column_name, count(DISTINCT lower({d.replace('trim(v)', '[ ]+', ' ')})) AS n_folded FROM {found} WHERE kind = 'str' AND NOT ({d.blank('v')}) GROUP BY 1, 2"
    first = lambda t, c, test, order: f"SELECT * FROM (SELECT table_name, column_name, v, m FROM {found} WHERE table_name = '{t}' AND column_name = '{c}'{test} ORDER BY {order} LIMIT 5) f_{t}_{c}"
    frequent = UNION.join(first(t, c, "", "m DESC, v") for t, c in kinds)
    failing = UNION.join(first(t, c, f" AND NOT ({d.blank('v')}) AND NOT {d.kind('v', k)}", "v") for (t, c), k in kinds.items() if k != "str") or f"SELECT table_name, column_name, v, m FROM {found} WHERE false"
    quoted = lambda what: f"'\'\'' || {what} || '\'\''"
    shown = lambda source, text, order: f"SELECT table_name, column_name, {d.joined(text, '; ', 'place')} AS shown FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY {order}) AS place FROM ({source}) s) r WHERE place <= 5 GROUP BY 1, 2"
    specs = UNION.join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS expected_type" for (t, c), kind in kinds.items())
    counts = ("n_rows", "n_blank", "n_null_tokens", "n_filled", "n_distinct", "n_shapes", "n_parse_fails", "n_edge_space", "n_inner_space")
    same = lambda x: f"s.table_name = {x}.table_name AND s.column_name = {x}.column_name"
    mixed = "CASE WHEN o.kind = 'str' THEN o.n_distinct > coalesce(fo.n_folded, 0) ELSE o.n_formats > 1 END"
    return f"""WITH specs AS ({specs}) SELECT s.table_name, s.column_name, s.expected_type, {', '.join(f'coalesce(o.{c}, 0) AS {c}' for c in counts)}, coalesce({mixed}, false) AS mixed_formats, o.min_len, o.max_len, o.least, o.most,
{d.pct('n_blank', 'n_rows')} AS pct_blank, {d.pct('n_distinct', 'n_filled')} AS pct_distinct, {d.pct('n_parse_fails', 'n_filled')} AS pct_parse_fails, tv.shown AS top_values, ts.shown AS top_shapes, coalesce(pf.shown, '') AS parse_fail_examples
FROM specs s LEFT JOIN ({one}) o ON {same('o')} LEFT JOIN ({folded}) fo ON {same('fo')} LEFT JOIN ({shown(frequent, quoted('v') + MARK, 'm DESC, v')}) tv ON {same('tv')}
LEFT JOIN ({shown(f'SELECT table_name, column_name, shape, n_rows AS m FROM {shapes}', quoted('shape') + MARK, 'm DESC, shape')}) ts ON {same('ts')} LEFT JOIN ({shown(failing, quoted('v'), 'v')}) pf ON {same('pf')}"""


def inferred_types(d: Dialect, tables: tuple[str, ...]) -> str:
    """PRD-06: the kind that most filled cells parse as, the narrowest on ties, if at least half do; leading zeros make codes of numbers."""
    values = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS v, count(*) AS m FROM {d.t(t)} GROUP BY {c}" for t in tables for c in SPECS[t].types]
    if d.spread:  # keys and amounts hardly repeat: their rows are judged where they are, not shuffled to be counted first
        single = lambda t, c, kind: c == SPECS[t].pk or kind == "float"
        values = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS v, CAST(1 AS BIGINT) AS m FROM {d.t(t)}" if single(t, c, k) else v for v, (t, c, k) in zip(values, ((t, c, k) for t in tables for c, k in SPECS[t].types.items()), strict=True)]
    share = lambda k: f"coalesce(sum(CASE WHEN {d.kind('v', k)} THEN m ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN {d.blank('v')} THEN 0 ELSE m END), 0), 0)"
    shares = f"SELECT table_name, column_name, {share('bool')} AS b, {share('int')} AS i, {share('float')} AS f, {share('date')} AS t, max(CASE WHEN {d.match('trim(v)', '^0[0-9]')} THEN 1 ELSE 0 END) AS zeros FROM ({UNION.join(values)}) u GROUP BY 1, 2"
    plain = "SELECT table_name, column_name, CAST(b AS DOUBLE) AS b, CASE WHEN zeros = 1 THEN 0.0 ELSE CAST(i AS DOUBLE) END AS i, CASE WHEN zeros = 1 THEN 0.0 ELSE CAST(f AS DOUBLE) END AS f, CAST(t AS DOUBLE) AS t FROM s"
    best = "greatest(b, i, f, t)"
    return f"WITH s AS ({shares}), p AS ({plain}) SELECT table_name, column_name, CASE WHEN {best} < 0.5 THEN 'str' WHEN b = {best} THEN 'bool' WHEN i = {best} THEN 'int' WHEN f = {best} THEN 'float' ELSE 'date' END AS kind FROM p"


def iqr(d: Dialect) -> str:
    """DQ-27, AG-14, AG-15: fences of the cleaned stage by group, applied to both stages; what lies outside them, low and high."""
    source = {"dim_client": ("initial_aum", "'(all)'"), "fact_transactions": ("amount", "txn_type")}
    fences, counts = [], []
    for t, (c, group) in source.items():
        cells = f"SELECT {group} AS g, ({d.number(c)}) AS x FROM clean_{t}"
        fences.append(d.quartiles(cells, f"'{t}' AS table_name, g, reference_n, q1, q3"))
        for stage, name in _stages(d):
            counts.append(f"SELECT '{stage}' AS stage, '{t}' AS table_name, {group} AS g, ({d.number(c)}) AS x FROM {name(t)}")
    return f"""WITH fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM ({UNION.join(fences)}) f), cells AS ({UNION.join(counts)})
SELECT {d.small('f')}c.stage, c.table_name, coalesce(f.g, '(no reference group)') AS group_name, max(f.reference_n) AS reference_n, {d.rounded('max(f.low)', 4)} AS lower_fence, {d.rounded('max(f.high)', 4)} AS upper_fence, count(*) AS n_rows, {d.if_('x IS NOT NULL AND f.g IS NOT NULL')} AS assessable, {d.if_('x < low')} AS flagged_low, {d.if_('x > high')} AS flagged_high
FROM cells c LEFT JOIN fences f ON c.table_name = f.table_name AND c.g = f.g GROUP BY 1, 2, 3"""


def iqr_row_flags(d: Dialect) -> str:
    """DQ-27: for every row of both tables on both stages, whether it can be judged and lies outside its group's fences, which come from the cleaned stage."""
    fences, rows = [], []
    for t, (c, group) in {"dim_client": ("initial_aum", "'(all)'"), "fact_transactions": ("amount", "txn_type")}.items():
        cells = f"SELECT {group} AS g, ({d.number(c)}) AS x FROM clean_{t}"
        fences.append(d.quartiles(cells, f"'{t}' AS table_name, g, q1, q3"))
        for stage, name in _stages(d):
            rows.append(f"SELECT '{stage}' AS stage, '{t}' AS table_name, {PK[t]} AS key_value, {group} AS g, {c} AS value_text, ({d.number(c)}) AS x FROM {name(t)}")
    known = "CASE WHEN x IS NULL OR f.g IS NULL THEN 0 ELSE 1 END"
    return f"""WITH fences AS (SELECT table_name, g, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM ({UNION.join(fences)}) q), cells AS ({UNION.join(rows)})
SELECT {d.small('f')}c.stage, c.table_name, c.key_value, c.value_text, {known} AS assessable, CASE WHEN x < low OR x > high THEN 1 ELSE 0 END AS iqr_outlier_flag FROM cells c LEFT JOIN fences f ON c.table_name = f.table_name AND c.g = f.g"""


def iqr_flags(d: Dialect) -> str:
    """DQ-27: the flag of every client's opening balance on the raw stage."""
    x = f"({d.number('initial_aum')})"
    fence = d.fence(x, "clean_dim_client")
    return f"WITH f AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM ({fence}) q) SELECT client_id, initial_aum, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS assessable, CASE WHEN {x} < low OR {x} > high THEN 1 ELSE 0 END AS iqr_outlier_flag FROM {d.t('dim_client')} CROSS JOIN f"


def _keys(d: Dialect, key: str, day: str) -> str:
    return f"{d.valid(key, 'int')} AND {d.valid(day, 'date')}"


def reconciliations(d: Dialect) -> str:
    """DQ-25 (with DQ-17, 19, 20, 21): R1 fee basis against balance, R2 advisors, R3 account types, R4 fee debits against billed fees, on both stages. Rows of invalid keys are excluded before a join; sums are exact."""
    rows = []
    for stage, name in _stages(d):
        fee, snap, txn, client = (name(t) for t in ("fact_fees", "fact_portfolio_snapshot", "fact_transactions", "dim_client"))
        left, right = f"SELECT client_id, fee_date AS day, aum_basis AS a FROM {fee} WHERE {_keys(d, 'client_id', 'fee_date')}", f"SELECT client_id, snapshot_date AS day, aum AS b FROM {snap} WHERE {_keys(d, 'client_id', 'snapshot_date')}"
        both = f"SELECT l.client_id IS NOT NULL AS has_left, r.client_id IS NOT NULL AS has_right, {d.money('a')} AS x, {d.money('b')} AS y FROM ({left}) l FULL JOIN ({right}) r ON l.client_id = r.client_id AND l.day = r.day"
        excluded = lambda t, test: f"(SELECT count(*) FROM {t} WHERE NOT ({test}))"
        tally = "{0} AS matched, {1} AS unmatched_left, {2} AS unmatched_right, {3} AS unassessable, {4} AS passed, {5} AS failed"
        known, agree = "x IS NOT NULL AND y IS NOT NULL", "abs(x - y) <= 0.01"
        sums = tally.format(d.if_("has_left AND has_right"), d.if_("has_left AND NOT has_right"), d.if_("NOT has_left AND has_right"), d.if_(f"has_left AND has_right AND NOT ({known})"), d.if_(f"has_left AND has_right AND {known} AND {agree}"), d.if_(f"has_left AND has_right AND {known} AND NOT ({agree})"))
        rows.append(f"SELECT '{stage}' AS stage, 'R1' AS recon, {excluded(fee, _keys(d, 'client_id', 'fee_date'))} AS excluded_left, {excluded(snap, _keys(d, 'client_id', 'snapshot_date'))} AS excluded_right, {sums} FROM ({both}) j")
        for recon, t, mine, theirs in (("R2a", fee, "advisor_id", "advisor_id"), ("R2b", snap, "advisor_id", "advisor_id"), ("R2c", txn, "advisor_id", "advisor_id"), ("R3", snap, "account_type", "primary_account_type")):
            one = f"SELECT client_id, min({theirs}) AS b FROM {client} WHERE {d.valid('client_id', 'int')} GROUP BY 1"
            joined = f"SELECT c.client_id IS NOT NULL AS hit, f.{mine} AS x, c.b AS y FROM {t} f LEFT JOIN ({one}) c ON f.client_id = c.client_id WHERE {d.valid('f.client_id', 'int')}"
            known2 = f"NOT ({d.blank('x')}) AND NOT ({d.blank('y')})"
            sums = tally.format(d.if_("hit"), d.if_("NOT hit"), "CAST(0 AS BIGINT)", d.if_(f"hit AND NOT ({known2})"), d.if_(f"hit AND {known2} AND x = y"), d.if_(f"hit AND {known2} AND x <> y"))
            rows.append(f"SELECT '{stage}', '{recon}', {excluded(t, d.valid('client_id', 'int'))}, {excluded(client, d.valid('client_id', 'int'))}, {sums} FROM ({joined}) j")
        month = lambda t, day, where: f"SELECT client_id, substr({day}, 1, 7) AS month, min(CASE WHEN {d.money('amount')} IS NULL THEN 0 ELSE 1 END) AS complete, sum({d.money('amount')}) AS total FROM {t} WHERE {_keys(d, 'client_id', day)}{where} GROUP BY 1, 2"
        debit = " AND txn_type = 'Advisory Fee'"
        both = f"SELECT l.client_id IS NOT NULL AS has_left, r.client_id IS NOT NULL AS has_right, CASE WHEN l.complete = 1 THEN l.total END AS x, CASE WHEN r.complete = 1 THEN r.total END AS y FROM ({month(txn, 'txn_date', debit)}) l FULL JOIN ({month(fee, 'fee_date', '')}) r ON l.client_id = r.client_id AND l.month = r.month"
        sums = tally.format(d.if_("has_left AND has_right"), d.if_("has_left AND NOT has_right"), d.if_("NOT has_left AND has_right"), d.if_(f"has_left AND has_right AND NOT ({known})"), d.if_(f"has_left AND has_right AND {known} AND {agree}"), d.if_(f"has_left AND has_right AND {known} AND NOT ({agree})"))
        ok = _keys(d, "client_id", "txn_date")
        rows.append(f"SELECT '{stage}', 'R4', (SELECT count(*) FROM {txn} WHERE txn_type = 'Advisory Fee' AND NOT ({ok})), {excluded(fee, _keys(d, 'client_id', 'fee_date'))}, {sums} FROM ({both}) j")
    return f"SELECT *, {d.pct('passed', '(passed + failed)')} AS pass_pct FROM ({UNION.join(rows)}) x"


def result_steps(d: Dialect) -> dict[str, str]:
    """The steps of cleaning, and what rules and relationships give on both stages."""
    return steps(d) | {"rule_results": rulebook(d), "link_results": integrity(d)}


DIMENSIONS = ("dim_advisor", "dim_benchmark", "dim_client", "dim_security")
over_star("dq24_rulebook", lambda d: "SELECT * FROM rule_results", result_steps)
over_star("dq15_integrity", lambda d: "SELECT * FROM link_results", result_steps)
over_star("dq16_parent_keys", parent_keys, steps)
over_star("dq26_scorecard", scorecard, result_steps)
over_star("ag26_rule_totals", rule_totals, result_steps)
over_star("ag27_examples", examples)
over_star("ag27_rule_examples", rule_examples)
over_star("dq01_profile_dimensions", partial(column_profile, tables=DIMENSIONS))
over_star("dq01_profile_snapshots", partial(column_profile, tables=("fact_portfolio_snapshot",)))
over_star("dq01_profile_facts", partial(column_profile, tables=("dim_date", "fact_fees", "fact_transactions")))
over_star("prd06_infer_types", partial(inferred_types, tables=(*DIMENSIONS, "fact_fees", "fact_transactions")))
over_star("dq27_iqr", iqr, steps)
over_star("dq27_iqr_flags", iqr_flags, steps)
over_star("dq27_row_flags", iqr_row_flags, steps)
over_star("dq25_reconciliations", reconciliations, steps)
