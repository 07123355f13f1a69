"""Common equity among listed names, by what a screener says of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that mark a fund, with the values that do; columns that say a type.
FLAGS = ("etf", "is_etf", "fund", "isfund")
FLAGGED = ("1", "true", "yes", "y", "etf", "fund")
TYPES = ("type", "security type", "security_type", "asset type", "asset_type", "class")
#: Parts of a type that is no common equity (longer forms that contain one of these are covered by it).
BLOCKED_TYPES = ("ETF", "ETN", "EXCHANGE TRADED FUND", "EXCHANGE TRADED NOTE", "CEF", "FUND", "PREFERRED", "PFD", "WARRANT", "RIGHT", "UNIT")
#: Parts of a name that is none.
BLOCKED_NAMES = (" ETF", " ETN", "CLOSED END FUND", "CLOSED-END FUND", "TRUST PREFERRED", "PREFERRED SECURITIES", "PREFERRED STOCK", "PREFERRED SHARES", "DEPOSITARY SHARE", "WARRANT", " RIGHT", " UNIT", "SENIOR NOTE", " NOTE DUE", " NOTES DUE", " BOND", "BENEFICIAL INTEREST")
#: What a common share is called.
EQUITY_NAMES = ("COMMON STOCK", "COMMON SHARES", "ORDINARY SHARES", "CLASS A COMMON", "CLASS B COMMON", "CLASS C COMMON")
#: Fixed values on names with "trust": vehicles, industries and names of operating companies.
TRUST_VEHICLES = (" INCOME TRUST", " MUNICIPAL TRUST", " OPPORTUNITY TRUST", " EQUITY TRUST", " CREDIT TRUST", " TRUST FOR INVESTMENT", " SMALL-CAP TRUST", " MICRO-CAP TRUST")
TRUST_INDUSTRIES = ("REAL ESTATE INVESTMENT TRUSTS", "MAJOR BANKS", "REGIONAL BANKS", "S&LS/SAVINGS BANKS", "BUILDING OPERATORS")
TRUST_COMPANIES = ("REALTY TRUST", "NORTHERN TRUST", "TRUSTCO BANK", "TRUSTMARK", "WASHINGTON TRUST", "WINTRUST", "COMMUNITY TRUST BANCORP", "ADAMAS TRUST")
#: Industries and styles of finance vehicles with bland names.
VEHICLE_INDUSTRIES = ("INVESTMENT MANAGERS", "TRUSTS EXCEPT EDUCATIONAL RELIGIOUS AND CHARITABLE", "FINANCE/INVESTORS SERVICES", "FINANCE COMPANIES")
VEHICLE_STYLES = ("TOTAL RETURN", "TAX-ADVANTAGE", "DIVIDEND OPP", "MUNICIPAL", "CONVERTIBLE", "HIGH YIELD", "HIGH INCOME", "STRATEGIC", "ALLOCATION", "INFRASTRUCTURE", "OPPORTUNITY", "GLOBAL DYNAMIC", "NEXTGEN")


def _has(text: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def common_equity(rows: DataFrame) -> Column:
    """Whether a row of a screener is common equity. Columns are found by name in any case: flags of funds, a type, name or company name, sector, industry; those that lack say nothing.

    No: a flag, a blocked type or name, or the word fund. A name with "trust": no if a vehicle, yes if its industry or name is that of an operating company, else no in finance, and elsewhere only with an equity marker.
    Else no only for finance vehicles by industry and style.
    """
    have = {c.lower(): F.col(f"`{c}`") for c in rows.columns}
    flagged = F.lit(False)
    for c in FLAGS:
        if c in have:
            flagged = flagged | F.coalesce(F.lower(F.trim(have[c].cast("string"))).isin(*FLAGGED), F.lit(False))
    kind = next((F.upper(F.trim(F.coalesce(have[c].cast("string"), F.lit("")))) for c in TYPES if c in have), F.lit(""))
    text = lambda *names: F.upper(F.coalesce(*[F.nullif(have[n].cast("string"), F.lit("")) for n in names if n in have], F.lit("")))
    name, sector, industry = text("name", "company name"), text("sector"), text("industry")
    finance = sector == "FINANCE"
    trust = F.when(_has(name, TRUST_VEHICLES), False).when(industry.isin(*TRUST_INDUSTRIES) | _has(name, TRUST_COMPANIES), True).when(finance | ~_has(name, EQUITY_NAMES), False)
    vehicle = finance & industry.isin(*VEHICLE_INDUSTRIES) & _has(name, VEHICLE_STYLES)
    out = F.when(flagged | _has(kind, BLOCKED_TYPES) | _has(name, BLOCKED_NAMES) | name.rlike(r"\bFUNDS?\b"), False)
    return out.otherwise(F.coalesce(F.when(name.contains("TRUST"), trust), ~vehicle))
