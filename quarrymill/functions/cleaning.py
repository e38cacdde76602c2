"""Cleaning of feed fields: strings, numbers, dates, codes, places. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import PROVINCES


def clean(c: Column) -> Column:
    """Trimmed; an empty string is null, one of blanks alone is ''."""
    return F.when(c != "", F.trim(c))


def null_token(c: Column, token: str = "..") -> Column:
    """Trimmed; empty or the feed's sign for a missing value is null."""
    t = F.trim(c)
    return F.when((t != "") & (t != token), t)


def decimal(c: Column, scale: int = 6) -> Column:
    return F.trim(c).try_cast(f"decimal(38,{scale})")


def iso_date(c: Column) -> Column:
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-M-d")


def date_part(c: Column) -> Column:
    """What stands before a 'T'."""
    return F.substring_index(c, "T", 1)


MONTHS = "january february march april may june july august september october november december".split()


def english_date(c: Column) -> Column:
    """'March 3rd, 2025' as '2025-03-03'; null if it is no such date."""
    pattern = r"(?i)([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, pattern, 1)))
    out = F.concat_ws("-", F.regexp_extract(c, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, pattern, 2), 2, "0"))
    return F.when(c.rlike(pattern) & (month > 0), out)


def postal_code(c: Column) -> Column:
    return F.nullif(F.left(F.upper(F.replace(F.trim(c), F.lit(" "), F.lit(""))), F.lit(6)), F.lit(""))


def state_code(c: Column) -> Column:
    """The first two letters, upper case."""
    return F.nullif(F.upper(F.left(F.trim(c), F.lit(2))), F.lit(""))


def city_key(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def split_present(c: Column, separators: tuple[str, ...] = ("*", ";", "|", ",")) -> Column:
    """Split at the first of the separators that occurs at all; parts trimmed, empty ones dropped."""
    cut = reduce(lambda rest, s: F.when(F.contains(c, F.lit(s)), F.split(c, "\\" + s if s in "*|" else s)).otherwise(rest), reversed(separators), F.array(c))
    return F.when(c.isNotNull(), F.filter(F.transform(cut, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def path_parts(c: Column) -> Column:
    """Parts of an organisation path: at '>>' if there is one, else at '>'."""
    cut = F.when(F.contains(c, F.lit(">>")), F.split(c, ">>")).otherwise(F.split(c, ">"))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def city_province(c: Column) -> Column:
    """'City, Province' as a struct; a lone part is the province."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).alias("city"),
        F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).alias("state_province"),
    )


def province_forms(province: str) -> list[str]:
    """The forms in which a province may be written: as given, and its abbreviation or full name."""
    if len(province) > 2:
        return [province, *([PROVINCES[province]] if province in PROVINCES else [])]
    full = {v: k for k, v in reversed(PROVINCES.items())}
    full["QC"] = "Quebec"
    return [province, *([full[province.upper()]] if province.upper() in full else [])]


def external_id(source: str, name: Column, postal: Column | None = None, city: Column | None = None) -> Column:
    """The key of a vendor within its source."""
    postal = F.lit(None).cast("string") if postal is None else postal
    if source == "canada_odbus":
        place = F.coalesce(F.nullif(postal, F.lit("")), city)
        return F.upper(F.concat_ws("_", name, place, F.lit("ODBUS")))
    if source == "canada_pspc_payments":
        return F.upper(F.concat_ws("_", name, F.lit("PSPC_CONTRACTOR")))
    if source in ("cid", "ccc"):
        return F.left(F.concat_ws("_", F.lit(source), name, F.coalesce(city, F.lit(""))), F.lit(255))
    return F.concat_ws("_", name, F.coalesce(postal, F.lit("NO_POSTAL")))


def naics_list(*codes: Column) -> Column:
    """Distinct codes in order, each cut at its point."""
    cut = F.transform(F.array(*codes), lambda c: F.substring_index(F.trim(c), ".", 1))
    return F.array_distinct(F.filter(cut, lambda c: c.isNotNull() & (c != "")))


def content_digest(*cols: Column) -> Column:
    """A digest of a record, stable for equal values."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
