"""Numbers and codes of records, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Maintenance event codes by the year of the fee.
FEE_CODES = {
    4: ["M1551", "M170", "M173", "M183", "M2551", "M273", "M283"],
    8: ["M1552", "M171", "M174", "M184", "M2552", "M274", "M284"],
    12: ["M1553", "M172", "M175", "M185", "M2553", "M275", "M285"],
}


def prune_number(raw: Column, maxlen: int = 7) -> Column:
    """One or two letters (a leading 0 counts as none) before the digits; digits cut to maxlen, zeros stripped; other text just cut and stripped."""
    form = r"^([a-zA-Z]{1,2}|0)?([0-9]+)"
    digits = F.regexp_extract(raw, form, 2)
    prefix = F.regexp_extract(raw, form, 1)
    body = F.when(digits == "", raw).otherwise(digits)
    return F.concat(F.when((prefix == "0") | (digits == ""), "").otherwise(prefix), F.ltrim(F.substring(body, 1, maxlen), F.lit("0")))


def pad_class(code: Column) -> Column:
    """Class codes of 8 or more characters: blanks of the group to 0 and a slash before the rest."""
    padded = F.concat(F.substring(code, 1, 4), F.translate(F.substring(code, 5, 3), " ", "0"), F.lit("/"), F.substring(code, 8, 1 << 20))
    return F.when(F.length(code) >= 8, padded).otherwise(code)


def zero_fill(text: Column, width: int) -> Column:
    """Zeros to the left up to width, never cut."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def industry_code(code: Column) -> Column:
    """Six digits, zeros to the right; null is 000000."""
    text = F.coalesce(code, F.lit(0)).cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.rpad(text, 6, "0"))


def fee_lag(code: Column) -> Column:
    pairs = [x for lag, codes in FEE_CODES.items() for c in codes for x in (F.lit(c), F.lit(lag))]
    return F.try_element_at(F.create_map(*pairs), code)


def year_of(date: Column) -> Column:
    """First four characters of a YYYYMMDD string as a number, null if they are none."""
    return F.substring(date, 1, 4).try_cast("int")
