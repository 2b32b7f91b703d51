"""Cleaning, formatting and classification of single values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "missing" in the source files, and the token written for missing.
NULL_TOKENS = ["", "null", "NULL", "nan", "NaN", "NA"]
NULL_LITERAL = "NULL"
# Cluster quality labels, best first, with the least silhouette of each.
QUALITY_LEVELS = [("EXCELENTE", 0.7), ("BUENA", 0.5), ("REGULAR", 0.25)]
QUALITY_LOWEST = "POBRE"
# Fixed text for a value that is missing or zero.
NOT_VALUED = "No valorado"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens_to_null(c, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    c = column(c)
    return F.when(~F.trim(c).isin(list(tokens)), c)


def blank_to_literal(c, literal: str = NULL_LITERAL) -> Column:
    """Missing or blank text becomes the literal; anything else is kept as it is."""
    c = column(c).cast("string")
    missing = c.isNull() | (F.trim(c) == "") | (c == "NaN")
    return F.when(missing, literal).otherwise(c)


def inf_to_null(c) -> Column:
    c = column(c)
    finite = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(finite, c)


def to_number(c) -> Column:
    return column(c).try_cast("double")


def parse_decimal_comma(c, places: int = 2) -> Column:
    return F.bround(F.replace(column(c), F.lit(","), F.lit(".")).try_cast("double"), places)


def rounded(c, places: int = 2) -> Column:
    """Half-even rounding of the scaled value; adding zero turns a negative zero into zero.

    Noise of the summation order (beyond nine places) is removed first, so that a mean lying on a
    tie rounds the same way whatever the partitioning.
    """
    scale = F.lit(float(10**places))
    return F.rint(F.round(column(c), 9) * scale) / scale + F.lit(0.0)


def is_digits_only(c) -> Column:
    """Text that is all digits once dots, commas and hyphens are removed."""
    return F.regexp_replace(column(c), "[.,-]", "").rlike("^[0-9]+$")


def title_case(c) -> Column:
    """Hyphens to spaces, runs of spaces to one, words capitalised; digits-only text unchanged."""
    c = column(c)
    spaced = F.trim(F.regexp_replace(F.replace(c, F.lit("-"), F.lit(" ")), r"\s+", " "))
    return F.when(is_digits_only(c), c).otherwise(F.initcap(spaced))


def tidy_cell(c) -> Column:
    """Text cell of a display table: a number in text is rounded to two places, a name title-cased."""
    c = column(c)
    number = parse_decimal_comma(c)
    return F.when(is_digits_only(c) & number.isNotNull(), number.cast("string")).otherwise(title_case(c))


def name_from_file(c, prefix: str) -> Column:
    """``.../prefix_<name>.csv`` to ``Name``."""
    stem = F.regexp_extract(column(c), rf"{prefix}([^/]*?)\.csv", 1)
    return F.concat(F.upper(F.substring(stem, 1, 1)), F.lower(F.substr(stem, F.lit(2))))


def format_currency(c) -> Column:
    """Millions with one decimal, thousands without, smaller amounts in full."""
    c = column(c)
    tenths = F.floor(c / 100_000 + 0.5)
    millions = F.concat(F.lit("€"), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("M"))
    thousands = F.concat(F.lit("€"), F.floor(c / 1000 + 0.5).cast("string"), F.lit("K"))
    plain = F.concat(F.lit("€"), _plain(c))
    return (
        F.when(c.isNull() | F.isnan(c) | (c == 0), NOT_VALUED)
        .when(c >= 1_000_000, millions)
        .when(c >= 1000, thousands)
        .otherwise(plain)
    )


def _plain(c: Column) -> Column:
    fixed = F.format_number(c, 3)
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def format_percent(c) -> Column:
    """At most three decimals and no trailing zeros, with a percent sign; missing is zero."""
    number = F.coalesce(column(c).try_cast("double"), F.lit(0.0))
    fixed = F.format_string("%.3f", number)
    short = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    return F.concat(F.when(short == "-0", "0").otherwise(short), F.lit("%"))


def truncate_text(c, length: int = 20) -> Column:
    c = column(c)
    cut = F.concat(F.substring(c, 1, length), F.lit("..."))
    return F.when(F.length(c) > length, cut).otherwise(F.coalesce(c, F.lit("")))


def direction_class(predicted, actual) -> Column:
    p, a = (F.coalesce(column(x), F.lit(0.0)) for x in (predicted, actual))
    return F.when(p > a, "higher").when(p < a, "lower").otherwise("neutral")


def default_text(c, default: str = "N/A") -> Column:
    c = column(c).cast("string")
    return F.when(c.isNull() | (c == ""), default).otherwise(c)


def lower_contains(c, text: str) -> Column:
    return F.contains(F.lower(column(c).cast("string")), F.lit(text.lower()))


def extract_number(c) -> Column:
    """The first run of digits as an integer, null without digits."""
    digits = F.regexp_extract(column(c), "[0-9]+", 0)
    return F.when(digits != "", digits).try_cast("bigint")


def ratio(a, b) -> Column:
    return F.try_divide(column(a), column(b))


def quality_band(silhouette) -> Column:
    """Quality of a whole clustering by its mean silhouette."""
    s = column(silhouette)
    (first, least), *others = QUALITY_LEVELS
    band = F.when(s >= least, first)
    for label, least in others:
        band = band.when(s >= least, label)
    return band.otherwise(QUALITY_LOWEST)


def cluster_band(silhouette) -> Column:
    """Quality of one cluster; the highest label is not given to single clusters."""
    s = column(silhouette)
    (_, _), (good, least_good), (fair, least_fair) = QUALITY_LEVELS
    return F.when(s >= least_good, good).when(s >= least_fair, fair).otherwise(QUALITY_LOWEST)


def overall_band(good, poor, k) -> Column:
    """Overall quality of k clusters by how many are good and how many poor."""
    good, poor, k = column(good), column(poor), column(k)
    (best, _), (second, _), (third, _) = QUALITY_LEVELS
    return (
        F.when((poor == 0) & (good >= F.floor(k / 2)), best)
        .when(poor <= F.floor(k / 4), second)
        .when(poor <= F.floor(k / 2), third)
        .otherwise(QUALITY_LOWEST)
    )


def overfit_band(value) -> Column:
    v = column(value)
    return F.when(v > 3, "severe").when(v > 2, "moderate").otherwise("acceptable")


def fit_recommendation(r2) -> Column:
    r2 = column(r2)
    return F.when(r2 < 0.5, "low").when(r2 > 0.8, "excellent").otherwise("acceptable")


def overfit_recommendation(value) -> Column:
    return F.when(column(value) > 2, "regularise").otherwise("low overfit")


def mape_recommendation(mape) -> Column:
    m = column(mape)
    return F.when(m.isNull(), None).when(m < 10, "very low").when(m < 20, "acceptable").otherwise("high")


def variation_class(relative_std) -> Column:
    """How much a target varies around its mean: above three times the mean, or under a tenth."""
    v = column(relative_std)
    return F.when(v > 3, "high").when(v < 0.1, "low").otherwise("normal")


def correlation(x, y) -> Column:
    """Pearson r of the rows where both are present; null where either is constant (the built-in
    aggregate divides by zero there and fails)."""
    x, y = column(x), column(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
