"""Display text for feeds and charts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.values import money

# Country code and the name shown for it.
COUNTRY_NAMES = {
    "US": "United States of America",
    "GB": "United Kingdom",
    "DE": "Germany",
    "FR": "France",
    "IN": "India",
    "JP": "Japan",
    "BR": "Brazil",
    "CN": "China",
    "CA": "Canada",
    "AU": "Australia",
    "NL": "Netherlands",
    "ES": "Spain",
    "IT": "Italy",
    "MX": "Mexico",
    "KR": "South Korea",
    "PL": "Poland",
    "SE": "Sweden",
    "NO": "Norway",
    "RU": "Russia",
    "ZA": "South Africa",
    "NG": "Nigeria",
    "EG": "Egypt",
    "AR": "Argentina",
    "CL": "Chile",
    "TR": "Turkey",
    "SA": "Saudi Arabia",
    "PK": "Pakistan",
    "ID": "Indonesia",
    "TH": "Thailand",
    "MY": "Malaysia",
    "PH": "Philippines",
    "SG": "Singapore",
    "AE": "United Arab Emirates",
    "NZ": "New Zealand",
    "PT": "Portugal",
    "BE": "Belgium",
    "CH": "Switzerland",
    "AT": "Austria",
    "DK": "Denmark",
    "FI": "Finland",
    "CZ": "Czech Republic",
}


def plain_number(amount: Column) -> Column:
    """A decimal as text without trailing zeros: 35, 35.5, 35.55."""
    return F.regexp_replace(money(amount).cast("string"), r"\.?0+$", "")


def grouped_number(amount: Column) -> Column:
    """Thousands separators and no trailing zeros: 1,234.5."""
    return F.regexp_replace(F.format_number(money(amount), 2), r"\.?0+$", "")


def money_label(amount: Column) -> Column:
    return F.concat(F.lit("$"), grouped_number(amount))


def money_tick(amount: Column, *, from_exactly_1000: bool) -> Column:
    """Axis label: `$12k` for thousands (half up), the plain amount below.

    The sales axis switches at 1000, the category axis only above it.
    """
    cents = money(amount)
    large = cents >= 1000 if from_exactly_1000 else cents > 1000
    thousands = F.floor((cents + 500) / 1000).cast("string")
    return F.when(large, F.concat(F.lit("$"), thousands, F.lit("k"))).otherwise(
        F.concat(F.lit("$"), plain_number(cents))
    )


def product_fallback(product_id: Column) -> Column:
    return F.concat(F.lit("product_"), product_id.cast("string"))


def event_label(user_id: Column, product_id: Column) -> Column:
    return F.concat(
        F.lit("user_"), user_id.cast("string"), F.lit(" → "), product_fallback(product_id)
    )


def score_label(points: Column) -> Column:
    return F.concat(F.lit("+"), points.cast("string"))


def clock(timestamp: Column) -> Column:
    return F.date_format(timestamp, "HH:mm:ss")


def day_label(timestamp: Column) -> Column:
    return F.date_format(timestamp, "dd MMM yyyy")


def iso(timestamp: Column) -> Column:
    """ISO-8601 with microseconds."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
