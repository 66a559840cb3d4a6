"""The measures against a plain pandas version of their definitions, context by context."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from meridian.catalog import QUERIES
from meridian.plans.semantic import SLICES
from meridian.plans.star import star

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    t = {n: df.toPandas() for n, df in star(spark, DATA, "dim_client", "dim_date", "fact_fees", "fact_portfolio_snapshot", "fact_transactions").items()}
    tier = t["dim_client"].set_index("client_id")["client_tier"]
    number = lambda s: pd.to_numeric(s, errors="coerce")
    out = {"cal": sorted(pd.to_datetime(t["dim_date"]["date"]))}
    for name, day, cols in (("fact_fees", "fee_date", ("amount", "aum_basis")), ("fact_portfolio_snapshot", "snapshot_date", ("aum", "active_alpha_ytd")), ("fact_transactions", "txn_date", ("amount",))):
        f = t[name].assign(day=pd.to_datetime(t[name][day]), tier=t[name]["client_id"].map(tier))
        out[name] = f.assign(**{c: number(f[c]) for c in cols})
    return out


def total(s):
    return None if s.dropna().empty else s.sum()


def minus(a, b):
    return None if a is None and b is None else (a or 0) - (b or 0)


def divide(a, b):
    return None if a is None or b is None or b == 0 else a / b


def plain(m, year, month, tier):
    cal = pd.Series(m["cal"])
    chosen = cal if year is None else cal[(cal.dt.year == year) & ((cal.dt.month == month) if month else True)]

    def rows(name, days):
        f = m[name]
        keep = f["day"].isin(days) if days is not None else pd.Series(True, index=f.index)
        return f[keep & ((f["tier"] == tier) if tier else True)]

    def ending(days):
        s = rows("fact_portfolio_snapshot", days)
        s = s[s["day"].isin(m["cal"])]
        s = s[s["day"] == s.loc[s["aum"].notna(), "day"].max()]
        return (None if s.empty else s["aum"].sum()), s

    def shifted(months):
        if chosen.empty:
            return []
        first, last = chosen.min() - pd.DateOffset(months=months), chosen.max() - pd.DateOffset(months=months) + pd.offsets.MonthEnd(0)
        return cal[(cal >= first) & (cal <= last)]

    days = None if year is None else chosen
    fees, flows, snaps = rows("fact_fees", days), rows("fact_transactions", days), rows("fact_portfolio_snapshot", days)
    amount = lambda kind: total(flows.loc[flows["txn_type"] == kind, "amount"])
    end, at_end = ending(days)
    ly, pm = ending(shifted(12))[0], ending(shifted(1))[0]
    naive, fee, net = total(snaps["aum"]), total(fees["amount"]), minus(amount("Deposit"), amount("Withdrawal"))
    good = snaps[(snaps["day"] == snaps["day"].max()) & (snaps["is_return_suspect"] != "1") & snaps["aum"].notna() & snaps["active_alpha_ytd"].notna()]
    top = at_end.groupby("client_id")["aum"].sum().sort_values(ascending=False).head(10).sum() if end is not None else None
    return {
        "total_fees": fee,
        "net_flows": net,
        "aum_naive": naive,
        "ending_aum": end,
        "ending_clients": None if at_end.empty else at_end["client_id"].nunique(),
        "ending_aum_ly": ly,
        "aum_yoy": divide(minus(end, ly), ly),
        "ending_aum_pm": pm,
        "aum_mom": divide(minus(end, pm), pm),
        "avg_monthly_aum": divide(naive, snaps["day"].nunique()),
        "fee_yield_bps": divide(None if fee is None else fee * 120000, naive),
        "organic_growth": divide(net, ly),
        "weighted_alpha": divide(total(good["active_alpha_ytd"] * good["aum"]), total(good["aum"])),
        "top10_share": divide(top, end),
    }


def test_measures_match_their_definitions(spark, model):
    got = {r.label: r.asDict() for r in QUERIES["ms01_17_measures"](spark, DATA).collect()}
    assert len(got) == len(SLICES)
    for label, year, month, tier in SLICES:
        for name, want in plain(model, year, month, tier).items():
            x = got[label][name]
            assert (x is None) == (want is None) and (want is None or math.isclose(float(x), want, rel_tol=1e-5, abs_tol=0.011 if abs(want) > 10 else 2e-6)), (label, name, x, want)
    assert all(v is None for k, v in got["Year=1900"].items() if k != "label")
    assert got["Grand Total"]["ending_aum_ly"] is not None and got["Grand Total"]["aum_mom"] is not None


def test_roundings_are_those_of_duckdb(spark):
    """Halves in decimal that aren't halves in binary: a ratio as percent, a share, a count."""
    import duckdb  # noqa: PLC0415

    from meridian.plans.dialect import _Duck, _Spark  # noqa: PLC0415
    from meridian.plans.semantic import display  # noqa: PLC0415

    cells = "SELECT 'm' || k || kind AS measure, 'l' AS label, kind, CAST(k AS DOUBLE) / 100000 AS x, CAST(NULL AS STRING) AS word FROM (SELECT k, unnest(['ratio', 'bps', 'currency', 'count']) AS kind FROM range(-500, 2000) r(k)) t"
    duck = duckdb.sql(f"WITH cells AS ({cells}) {display(_Duck())}").fetchall()
    spark_cells = cells.replace("unnest(['ratio', 'bps', 'currency', 'count'])", "explode(array('ratio', 'bps', 'currency', 'count'))")
    assert sorted(map(tuple, spark.sql(f"WITH cells AS ({spark_cells}) {display(_Spark({}))}").collect())) == sorted(duck)
    pct = lambda d: f"SELECT p, {d.pct('p', 'w')} AS x FROM (SELECT k AS p, 200000 AS w FROM range(20000) r(k)) t"
    assert sorted(map(tuple, spark.sql(pct(_Spark({}))).collect())) == sorted(duckdb.sql(pct(_Duck())).fetchall())


def test_balance_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """1080.87 of 24 clients is 45.03625 each, a half: sums of doubles in some orders lie below it."""
    from datetime import datetime  # noqa: PLC0415

    import numpy as np  # noqa: PLC0415

    for seed in range(6):
        rng = np.random.default_rng(seed)
        cents = rng.integers(100, 9000, 24)
        cents[-1] += 108087 - cents.sum()
        d = tmp_path / str(seed)
        spark.createDataFrame([(i, datetime(2024, 1, 28, 1), i, float(c) / 100) for i, c in enumerate(cents)], "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{d}/events.parquet")
        spark.createDataFrame([(i, "FURNITURE") for i in range(24)], "c_custkey long, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
        (row,) = QUERIES["ms_day_balance"](spark, str(d)).collect()
        assert (row.ending_balance, row.ending_clients, row.balance_per_client) == (1080.87, 24, 45.0363), seed
