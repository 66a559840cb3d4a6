"""What a table of text cells must hold: a declaration that profiles, checks, rules and scorecards are compiled from."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """Bounds are (low, high), either open. `blank_when`: column to (condition column, its values for which the column doesn't apply)."""

    pk: str
    types: dict[str, str]
    keys: tuple[tuple[str, ...], ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    plausible: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    dates: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    plausible_dates: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    blank_when: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    near: tuple[tuple[str, ...], tuple[str, ...]] | None = None


def _types(**kinds: str) -> dict[str, str]:
    """Columns by kind, each list parted by spaces."""
    return {c: kind.rstrip("_") for kind, names in kinds.items() for c in names.split()}


FIRST, LAST = "1995-01-01", "2001-12-31"
ACCOUNTS = ("Taxable", "IRA", "Roth IRA", "Trust", "529")
CASH, TRADED = ("Deposit", "Withdrawal", "Advisory Fee"), ("Buy", "Dividend", "Sell")
#: The codes of states, and names that stand for them.
STATES = tuple("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split())
STATE_NAMES = {"Pennsylvania": "PA", "Florida": "FL", "New York": "NY", "New Jersey": "NJ", "California": "CA", "Illinois": "IL", "Texas": "TX"}
_FLAG = ("0", "1")

SPECS: dict[str, TableSpec] = {
    "dim_advisor": TableSpec(
        "advisor_id",
        _types(int="advisor_id years_experience aum_target_mm", str="first_name last_name region certifications"),
        allowed={"region": ("Northeast", "Mid-Atlantic", "Southeast", "Midwest", "West", "Southwest")},
        ranges={"years_experience": (0, None), "aum_target_mm": (0.01, None)},
        plausible={"years_experience": (None, 50), "aum_target_mm": (1, 10000)},
    ),
    "dim_benchmark": TableSpec("benchmark_id", _types(int="benchmark_id", str="name asset_class ticker_proxy"), keys=(("ticker_proxy",), ("name",))),
    "dim_client": TableSpec(
        "client_id",
        _types(int="client_id age advisor_id", str="first_name last_name city state zip_code risk_profile client_tier primary_account_type", float="initial_aum", date="client_since", bool="is_active"),
        allowed={"risk_profile": ("Conservative", "Moderately Conservative", "Balanced", "Moderately Aggressive", "Aggressive"), "client_tier": ("Retail", "HNW", "UHNW"), "primary_account_type": ACCOUNTS, "state": STATES},
        ranges={"age": (0, None), "initial_aum": (0.01, None)},
        plausible={"age": (18, 80)},
        dates={"client_since": (None, LAST)},
        plausible_dates={"client_since": ("1991-01-01", None)},
        patterns={"zip_code": "^[0-9]{5}(-[0-9]{4})?$"},
        near=(("age", "city", "state", "zip_code", "initial_aum", "client_since", "advisor_id"), ("first_name", "last_name")),
    ),
    "dim_date": TableSpec(
        "date_id",
        _types(int="date_id year quarter month week_of_year is_month_end is_quarter_end is_year_end is_trading_day", date="date", str="month_name day_of_week"),
        keys=(("date",),),
        allowed={**dict.fromkeys(("is_month_end", "is_quarter_end", "is_year_end", "is_trading_day"), _FLAG), "day_of_week": ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")},
        ranges={"quarter": (1, 4), "month": (1, 12), "week_of_year": (1, 53)},
    ),
    "dim_security": TableSpec(
        "security_id",
        _types(int="security_id benchmark_id", str="ticker name asset_class sector", bool="is_etf", float="expense_ratio_bps"),
        keys=(("ticker",),),
        allowed={"asset_class": ("Equity", "Fixed Income", "Alternative", "Cash Equivalent")},
        ranges={"expense_ratio_bps": (0, None)},
        plausible={"expense_ratio_bps": (None, 45)},
        blank_when={"sector": ("asset_class", ("Alternative", "Cash Equivalent", "Fixed Income")), "expense_ratio_bps": ("is_etf", ("False",))},
        near=(("name",), ("ticker",)),
    ),
    "fact_fees": TableSpec(
        "fee_id",
        _types(int="fee_id client_id advisor_id", date="fee_date", str="fee_type", float="aum_basis bps_charged amount"),
        keys=(("client_id", "fee_date"),),
        allowed={"fee_type": ("Management", "Advisory", "Custodial", "Performance")},
        ranges={"aum_basis": (0.01, None), "bps_charged": (0, None), "amount": (0.01, None)},
        plausible={"bps_charged": (None, 85)},
        dates={"fee_date": (FIRST, LAST)},
    ),
    "fact_portfolio_snapshot": TableSpec(
        "snapshot_id",
        _types(int="snapshot_id client_id advisor_id benchmark_id year month", date="snapshot_date", float="aum return_ytd benchmark_return_ytd active_alpha_ytd cash_pct", str="account_type"),
        keys=(("client_id", "snapshot_date"),),
        allowed={"account_type": ACCOUNTS},
        ranges={"aum": (0.01, None), "cash_pct": (0, 1), "month": (1, 12), "return_ytd": (-1, None), "benchmark_return_ytd": (-1, None)},
        plausible={"return_ytd": (-0.6, 1.0), "active_alpha_ytd": (-0.6, 1.0)},
        dates={"snapshot_date": (FIRST, LAST)},
    ),
    "fact_transactions": TableSpec(
        "txn_id",
        _types(int="txn_id client_id advisor_id security_id", date="txn_date", str="txn_type", float="shares price amount"),
        allowed={"txn_type": (*TRADED, *CASH)},
        ranges={"shares": (0.0001, None), "price": (0.01, None), "amount": (0.01, None)},
        dates={"txn_date": (FIRST, LAST)},
        blank_when={c: ("txn_type", CASH) for c in ("security_id", "shares", "price")},
    ),
}
#: Code lists and sign rules that are standard or by definition; the others are inferred from the data.
HARD_LISTS = {("dim_client", "state"), *(("dim_date", c) for c in SPECS["dim_date"].allowed)}
INFERRED_SIGNS = {("fact_fees", "amount"), ("fact_transactions", "shares"), ("fact_transactions", "amount")}
