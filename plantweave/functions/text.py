"""Column functions on names and labels; all JVM-side but ``name_similarity``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that company keys drop, labels that name no company, and state codes.
DROPPED_WORDS = (
    "INCORPORATED", "INC", "CORPORATION", "CORP", "COMPANY", "CO", "LLC", "LLP", "LP", "LTD", "LIMITED", "PLC", "GROUP", "HOLDINGS", "ENTERPRISES", "INDUSTRIES", "THE",
)
SITE_LABELS = (
    "plant", "building", "warehouse", "service", "parts", "admin", "administration", "headquarters", "main facility", "corporate", "audit", "machine shop", "facility",
    "site", "location", "office", "hq",
)
STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE",
    "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)
LEGAL_TAIL = ("inc", "llc", "lp", "co", "corp", "ltd", "plc")
STREET_TAIL = ("st", "rd", "dr", "ave", "ln", "blvd", "hwy", "ct", "pl", "way")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def company_key(name: Column) -> Column:
    """Grouping key: upper case, "&" as AND, other signs as blanks, dropped words anywhere; '' for null."""
    t = F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" AND "))
    t = F.regexp_replace(F.regexp_replace(t, "[^A-Z0-9 ]", " "), rf"\b({'|'.join(DROPPED_WORDS)})\b", " ")
    return squeezed(t)


def sorted_tokens(key: Column) -> Column:
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the token-sorted keys, in [0, 1]; 0 if a side is empty. The one function here that
    needs Python: no built-in computes this ratio. It runs in Arrow batches."""
    return _ratio(sorted_tokens(company_key(a)), sorted_tokens(company_key(b)))


def identity_prefix(name: Column) -> Column:
    """The name from its own first word on: without a leading registry code (with a digit) and article."""
    t = F.trim(F.upper(F.coalesce(name, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(t, r"^(?=[A-Z0-9]*\d)[A-Z0-9]{2,}\s*-\s*", ""), r"^(THE|A|AN)\s+", "")


def leads_with(name: Column, company: str) -> Column:
    """The name starts with ``company`` as whole words."""
    own, want = identity_prefix(name), company.upper()
    return own.startswith(want) & ~F.substring(own, F.lit(len(want) + 1), F.lit(1)).rlike(r"^[\p{L}\p{N}]")


def first_company(name: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """The first company of which a pattern leads the name; null if none does."""
    out = None
    for company, own in patterns.items():
        for p in own:
            out = F.when(leads_with(name, p), company) if out is None else out.when(leads_with(name, p), company)
    return out if out is not None else F.lit(None).cast("string")


def _code_only(t: Column) -> Column:
    return t.rlike(r"^[\d\s_.\-]+$")


def _city_state(t: Column, tail: str) -> Column:
    return F.upper(F.regexp_extract(t, rf"^[A-Za-z .'\-]+,\s*([A-Za-z]{{2}}){tail}$", 1)).isin(*STATES)


def company_shaped(name: Column) -> Column:
    """Could be a company's name: not null, three characters or more, no bare code, "City, ST" or site label."""
    t = F.trim(name)
    label = squeezed(F.lower(t)).rlike(rf"^({'|'.join(SITE_LABELS)})\s*#?\d*$")
    return F.coalesce((F.length(t) >= 3) & ~_code_only(t) & ~_city_state(t, r"(?:\s*\(\w+\))?") & ~label, F.lit(False))


def displayable(name: Column) -> Column:
    """Fit to be shown: as ``company_shaped``, and no bare street; a legal form after a comma is no state."""
    t = F.trim(name)
    label = squeezed(F.lower(t)).rlike(rf"^({'|'.join(SITE_LABELS)})(\s*#?\d+)?$")
    legal = F.lower(t).rlike(rf",\s*({'|'.join(LEGAL_TAIL)})\.?$")
    street = F.lower(t).rlike(rf"^(\d+\s+)?[\w.]+(\s+[\w.]+){{0,2}}\s+({'|'.join(STREET_TAIL)})\.?$")
    return F.coalesce((F.length(t) >= 3) & ~_code_only(t) & ~(_city_state(t, "") & ~legal) & ~street & ~label, F.lit(False))


def shown_name(own: Column, registered: Column, parent: Column, city: Column) -> Column:
    """The own name if fit, else the registered one, else the parent's with the city."""
    fallback = F.when(F.coalesce(city, F.lit("")) != "", F.concat(parent, F.lit(" — "), city)).otherwise(parent)
    return F.when(displayable(own), F.trim(own)).when(displayable(registered), F.trim(registered)).otherwise(fallback)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, ..."""
    last = n % 10
    tail = F.when((n % 100).between(10, 20), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def sentences(*clauses: Column, default: str) -> Column:
    """The clauses that are not null, each ended by a full stop; ``default`` if all are null."""
    text = F.concat_ws(". ", *clauses)
    return F.when(text == "", default).otherwise(F.concat(text, F.lit(".")))


def money(amount: Column) -> Column:
    """$1.23B, $4.5M, $678K or $90; null stays null."""
    return (
        F.when(amount >= 1e9, F.concat(F.lit("$"), F.format_string("%.2f", amount / 1e9), F.lit("B")))
        .when(amount >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", amount / 1e6), F.lit("M")))
        .when(amount >= 1e3, F.concat(F.lit("$"), F.format_string("%.0f", amount / 1e3), F.lit("K")))
        .when(amount.isNotNull(), F.concat(F.lit("$"), F.format_string("%.0f", amount)))
    )


def badge(name: Column, public: Sequence[str], customer: Column) -> Column:
    """government for a name of the set (case and outer blanks aside), else customer or prospect."""
    return F.when(F.lower(F.trim(name)).isin(*public), "government").when(customer, "customer").otherwise("prospect")


def reasons(*parts: Column) -> Column:
    """The distinct reasons that are not null, in order of the alphabet, with "; " between them."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), "; ")


# Street words and their abbreviations, and states by region.
STREET_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "ROAD": "RD", "LANE": "LN", "COURT": "CT", "CIRCLE": "CIR", "HIGHWAY": "HWY", "PARKWAY": "PKWY",
    "PLACE": "PL", "SUITE": "STE", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
REGIONS = {
    "Northeast": "CT ME MA NH RI VT NJ NY PA",
    "Southeast": "AL AR FL GA KY LA MS NC SC TN VA WV DC",
    "Midwest": "IL IN IA KS MI MN MO NE ND OH SD WI",
    "Southwest": "AZ NM OK TX",
    "West": "AK CA CO HI ID MT NV OR UT WA WY",
}


def region_of(state: Column) -> Column:
    """The region of a state code; null for others."""
    known = F.create_map(*(F.lit(x) for region, states in REGIONS.items() for s in states.split() for x in (s, region)))
    return known[state]


def address_key(line: Column, city: Column, state: Column, code: Column) -> Column:
    """"<number> <street>, <CITY> <ST> <zip5>", or null without a number and street: suites are dropped, words are
    abbreviated, signs are blanks. A grammar in the JVM; writings it can't read keep their words."""
    t = F.regexp_replace(F.upper(F.coalesce(line, F.lit(""))), r"(\b(SUITE|STE|UNIT|APT|BLDG|BUILDING|ROOM|RM|FLOOR|FL|DOCK|LOT)\b\.?\s*#?\s*[A-Z0-9-]+|#\s*[A-Z0-9-]+)", " ")
    t = squeezed(F.regexp_replace(t, "[^A-Z0-9 -]", " "))
    number, street = F.regexp_extract(t, r"^(\d+[A-Z]?)\s+(\S.*)$", 1), F.regexp_extract(t, r"^(\d+[A-Z]?)\s+(\S.*)$", 2)
    short = F.create_map(*(F.lit(x) for kv in STREET_WORDS.items() for x in kv))
    words = F.array_join(F.transform(F.split(street, " "), lambda w: F.coalesce(short[w], w)), " ")
    tail = F.concat_ws(" ", F.nullif(F.upper(F.trim(city)), F.lit("")), F.nullif(F.upper(F.trim(state)), F.lit("")), F.nullif(F.left(F.trim(code), F.lit(5)), F.lit("")))
    return F.when(number != "", F.concat(number, F.lit(" "), words, F.lit(", "), tail))
