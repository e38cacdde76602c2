"""Company names, web addresses and the keys that identify a vendor. All are column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import DEDUP_SUFFIXES

# Legal suffixes that are cut from a name before two registries are matched; endings of page titles.
MATCH_SUFFIXES = (
    r"(?iU)\b(?:INC\.?|INCORPORATED|CORP\.?|CORPORATION|LTD\.?|LIMITED|LLC\.?|LTÉE\.?|LIMITÉE|CO\.?|COMPANY|GMBH|SA|SARL|PLC|PTY|LTDA|"
    r"GROUP|ENTERPRISES?)$"
)
TITLE_ENDINGS = [
    " - Home", " | Home", " - Official Site", " | Official Site", " - Wikipedia", " | About Us", " - Company Profile", " - Contact",
    " | Contact", " - Products", " | Products", " - Official Website", " | Official Website",
]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once for a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def given(c: Column) -> Column:
    """A string that is neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def truthy(c: Column) -> Column:
    """A number that is neither null nor zero."""
    return F.coalesce(c.cast("double"), F.lit(0.0)) != 0


def dedup_name(name: Column) -> Column:
    """Lower-cased, legal suffixes cut one after the other, punctuation dropped, white space single."""
    cut = reduce(lambda c, s: F.regexp_replace(c, "(?U)" + s, ""), DEDUP_SUFFIXES, F.lower(F.trim(F.coalesce(name, F.lit("")))))
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def match_name(name: Column) -> Column:
    """Upper-cased, the part before a slash, one legal suffix cut, punctuation dropped."""
    first = F.trim(F.substring_index(F.upper(F.trim(F.coalesce(name, F.lit("")))), "/", 1))
    cut = F.trim(F.regexp_replace(first, MATCH_SUFFIXES, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def name_tokens(name: Column) -> Column:
    return F.filter(F.array_distinct(F.split(match_name(name), " ")), lambda t: t != "")


def authority(url: Column) -> Column:
    """Host and port of a url with a scheme, null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def website_key(url: Column) -> Column:
    """Lower-cased authority without any 'www.'; a missing scheme is added. Null for a missing url."""
    u = F.lower(F.trim(url))
    u = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(given(url), F.replace(F.coalesce(authority(u), F.lit("")), F.lit("www."), F.lit("")))


def domain(url: Column) -> Column:
    """Lower-cased authority without a leading 'www.'; '' without a scheme."""
    return F.regexp_replace(F.lower(F.coalesce(authority(url), F.lit(""))), r"^www\.", "")


def domain_root(name: Column) -> Column:
    """The label before the last one."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(name)


def base_url(url: Column) -> Column:
    """Scheme and authority, https by default; null if that is no http address."""
    u = F.trim(url)
    u = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    out = F.regexp_extract(u, r"^(https?://[^/?#]+)", 1)
    return F.when(given(url), F.nullif(out, F.lit("")))


def identifier_key(uei: Column, duns: Column, cage: Column) -> Column:
    """The first identifier that is given, with its kind."""
    return F.coalesce(
        F.when(given(uei), F.concat(F.lit("uei:"), F.upper(F.trim(uei)))),
        F.when(given(duns), F.concat(F.lit("duns:"), F.trim(duns))),
        F.when(given(cage), F.concat(F.lit("cage:"), F.upper(F.trim(cage)))),
    )


def stream_key(uei: Column, duns: Column, found_domain: Column, name: Column) -> Column:
    """What a running job knows a vendor by: uei, else duns, else the domain it was found under, else its name."""
    return F.coalesce(
        F.when(given(uei), F.concat(F.lit("uei:"), uei)), F.when(given(duns), F.concat(F.lit("duns:"), duns)),
        F.when(given(found_domain), F.concat(F.lit("domain:"), F.lower(found_domain))), F.concat(F.lit("name:"), F.lower(F.coalesce(name, F.lit("")))),
    )


def title_to_name(title: Column) -> Column:
    """A page title cut at the first place of each known ending, whatever its case; the title itself if nothing is left."""
    endings = "|".join(e.replace("|", r"\|") for e in TITLE_ENDINGS)
    cut = F.regexp_replace(title, f"(?is)(?:{endings}).*$", "")
    return F.coalesce(F.nullif(F.trim(cut), F.lit("")), title)


def flags(value: Column, count: Column, high: float = 100_000_000, many: int = 50) -> Column:
    """Supplier flags from contract history."""
    return F.array_compact(F.array(F.when(value > high, F.lit("high_value_supplier")), F.when(count > many, F.lit("frequent_supplier"))))
