"""Column functions for seasons, names, numbers and money. All stay in the JVM but for names outside ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Forms of the apostrophe that names drop (fixed values).
APOSTROPHES = "'‘’ʼ´`"


def season_code(season: Column) -> Column:
    """1994 -> 9394."""
    two = lambda y: F.lpad(F.pmod(y, F.lit(100)).cast("string"), 2, "0")
    return F.concat(two(season - 1), two(season))


def season_of_code(code: Column) -> Column:
    """9394 -> 1994; the last two digits under 94 are of this century."""
    y = F.substring(code, 3, 2).try_cast("int")
    return y + F.when(y < 94, 2000).otherwise(1900)


def season_label(season: Column, mark: str = "/") -> Column:
    """2024 -> 2023/24."""
    return F.concat((season - 1).cast("string"), F.lit(mark), F.lpad(F.pmod(season, F.lit(100)).cast("string"), 2, "0"))


def season_of_date(date: Column) -> Column:
    return F.year(date) + F.when(F.month(date) >= 7, 1).otherwise(0)


def is_published(season: Column, today: Column) -> Column:
    """A season's files exist from 1 August of the year before."""
    return today >= F.make_date(season - 1, F.lit(8), F.lit(1))


def decomposed(name: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks: Spark has no function for it."""

    def of(names: pd.Series) -> pd.Series:  # a local function travels with the job, so executors need no copy of the package
        return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))

    return F.pandas_udf(of, StringType())(name)


def name_key(name: Column) -> Column:
    """Letters and digits of a name: decomposed, marks, apostrophes and all else dropped. Only names outside ASCII leave the JVM."""
    plain = F.coalesce(decomposed(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name)
    return F.regexp_replace(F.translate(F.lower(plain), APOSTROPHES, ""), "[^a-z0-9]+", "")


def search_key(name: Column) -> Column:
    """Lower case, anything but letters and digits as blanks, which do not collapse."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", " "))


def ordinal(n: Column) -> Column:
    last = F.pmod(n, F.lit(10))
    suffix = F.when(F.pmod(n, F.lit(100)).between(10, 20), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def money(v: Column) -> Column:
    """£1.2m, £450k or £7; a minus sign for losses. Rounding is half to even."""
    a = F.abs(v).cast("double")
    text = (
        F.when(a >= 1_000_000, F.concat(F.lit("£"), F.bround(a / 1_000_000, 1).cast("decimal(18,1)").cast("string"), F.lit("m")))
        .when(a >= 1_000, F.concat(F.lit("£"), F.bround(a / 1_000, 0).cast("long").cast("string"), F.lit("k")))
        .otherwise(F.concat(F.lit("£"), F.bround(a, 0).cast("long").cast("string")))
    )
    return F.concat(F.when(v < 0, "−").otherwise(""), text)


def tolerant_int(text: Column) -> Column:
    """Blanks and commas dropped, decimals cut off, anything else null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double").try_cast("long")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def match_date(text: Column) -> Column:
    """Day first; two-digit years up to 69 are of this century."""
    long, short = F.try_to_timestamp(text, F.lit("dd/MM/yyyy")), F.try_to_timestamp(text, F.lit("dd/MM/yy"))
    long = F.when(F.trim(text).rlike(r"/\d{4}$"), long).cast("date")
    short = F.when(F.trim(text).rlike(r"/\d{2}$"), short).cast("date")
    return F.coalesce(long, F.when(F.year(short) > 2069, F.add_months(short, -1200)).otherwise(short))


def first_year(text: Column) -> Column:
    """The first year of 1800 to 2099 in a text; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(1[89]\d{2}|20\d{2})", 1), F.lit("")).cast("int")


def season_of_year(year: Column, calendar: Column) -> Column:
    return year + F.when(calendar, 1).otherwise(0)


def json_strings(text: Column) -> Column:
    """A JSON array of strings; malformed and null give an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def wage_ratio(staff: Column, turnover: Column) -> Column:
    return F.when(turnover != 0, staff * 100.0 / turnover)


def source_name(season: Column, tier: Column) -> Column:
    return F.concat_ws("/", F.lit("football-data.co.uk"), season_code(season), F.concat(F.lit("E"), (tier - 1).cast("string")))


#: Radius of the earth in miles (fixed value).
EARTH_MILES = 3958.8


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance with a radius of 3958.8 miles."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return EARTH_MILES * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def labelled(key: Column, labels: dict) -> Column:
    """The label of a key in a short literal table; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for p in labels.items() for x in p)), key)


def thousands(n: Column) -> Column:
    """12345 -> 12,345."""
    return F.format_number(n, 0)
