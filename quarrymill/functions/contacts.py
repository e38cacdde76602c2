"""Contact details in texts. All are column expressions over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata as R
from .names import compact, domain, domain_root, given, once


def _any(c: Column, test, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [test(c, w) for w in words])


def _starts(c: Column, words: list[str]) -> Column:
    return _any(c, lambda x, w: x.startswith(w), words)


def _ends(c: Column, words: list[str]) -> Column:
    return _any(c, lambda x, w: x.endswith(w), words)


def mail_domain(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def is_spam(email: Column) -> Column:
    low = F.lower(email)
    return _starts(low, R.SPAM_PREFIXES + R.TECHNICAL_PREFIXES) | mail_domain(email).isin(R.SPAM_DOMAINS)


def email_priority(email: Column) -> Column:
    """Points of the first keyword, in fixed order, that the address holds."""
    low = F.lower(email)
    return reduce(lambda rest, kp: F.when(F.contains(low, F.lit(kp[0])), kp[1]).otherwise(rest), reversed(R.EMAIL_PRIORITY), F.lit(1))


def emails(text: Column) -> Column:
    """Addresses in order of business value, then of place; each once, in lower case, placeholders dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(R.EMAIL_PATTERN), F.lit(0))
    distinct = F.array_distinct(F.transform(F.filter(found, lambda e: ~is_spam(e)), F.lower))
    ranked = F.array_sort(F.transform(distinct, lambda e, i: F.struct((-email_priority(e)).alias("p"), i.alias("i"), e.alias("e"))))
    return F.transform(ranked, lambda s: s["e"])


def normal_phone(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"[^\d]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))


def phones(text: Column) -> Column:
    """Numbers as +1 and ten digits, by pattern, then by place; each once."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in R.PHONE_PATTERNS])
    return F.array_distinct(F.filter(F.transform(found, normal_phone), lambda p: p.isNotNull()))


def people(text: Column) -> Column:
    """Names of two to four words that stand beside a title."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in R.NAME_PATTERNS])
    tidy = F.transform(found, lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    return F.array_distinct(F.filter(tidy, lambda n: F.size(F.split(n, " ")).between(2, 4)))


def contact_bundle(text: Column) -> Column:
    """Five addresses, three numbers, three names and how sure they are; names alone count for nothing."""
    e, p = emails(text), phones(text)
    some = (F.size(e) > 0) | (F.size(p) > 0)
    none = F.array().cast("array<string>")
    return F.struct(
        F.slice(e, 1, 5).alias("emails"), F.slice(p, 1, 3).alias("phones"), F.when(some, F.slice(people(text), 1, 3)).otherwise(none).alias("names"),
        F.when(some, "regex").otherwise("none").alias("method"),
        F.when((F.size(e) > 0) & (F.size(p) > 0), 0.9).when(some, 0.7).otherwise(0.0).alias("confidence"),
    )


SNIPPET_PHONE = r"(?U)\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"


def valid_snippet_email(email: Column) -> Column:
    low = F.lower(email)
    return ~_ends(low, R.SNIPPET_BAD_DOMAINS) & ~_starts(low, R.SNIPPET_BAD_PREFIXES)


def valid_snippet_phone(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"\D", "")
    return (F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1"))


def snippet_contacts(results: Column) -> Column:
    """Addresses and numbers in the first five search results (structs with title and snippet), sorted."""
    text = F.array_join(F.transform(F.slice(results, 1, 5), lambda r: F.concat_ws(" ", r["title"], r["snippet"])), "\n")
    e = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(R.EMAIL_PATTERN), F.lit(0)), valid_snippet_email)))
    p = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(SNIPPET_PHONE), F.lit(0)), lambda x: F.trim(x)), valid_snippet_phone)))
    return F.struct(e.alias("emails"), p.alias("phones"), (F.when(F.size(e) > 0, 0.5).otherwise(0.0) + F.when(F.size(p) > 0, 0.5).otherwise(0.0)).alias("confidence"))


def vendor_emails(found: Column, website: Column, company: Column) -> Column:
    """The addresses that fit the vendor best: on its domain; else of its domain's root or its name; else
    any other, government inboxes only for government vendors."""
    def vendor(own: Column) -> Column:
        government = given(own) & _ends(own, R.GOVERNMENT_SUFFIXES)
        return F.struct(own.alias("own"), domain_root(own).alias("root"), compact(company).alias("token"), government.alias("government"))

    def rank(d: Column, v: Column) -> Column:
        plain = F.regexp_replace(d, "[-.]", "")
        return (
            F.when(given(v["own"]) & d.endswith(v["own"]), 0)
            .when(given(v["root"]) & (domain_root(d) == v["root"]), 1)
            .when(given(v["token"]) & F.contains(plain, v["token"]), 1)
            .when(_ends(d, R.GOVERNMENT_SUFFIXES) & ~v["government"], F.lit(None).cast("int"))
            .otherwise(2)
        )

    def best(ranks: Column) -> Column:
        least = F.struct(ranks.alias("all"), F.array_min(ranks).alias("least"))
        return once(least, lambda r: F.filter(found, lambda e, i: F.get(r["all"], i) == r["least"]))

    # the vendor's domain and name, an address's domain and the ranks are each worked out once
    ranks = once(once(domain(website), vendor), lambda v: F.transform(found, lambda e: once(F.trim(mail_domain(e)), lambda d: rank(d, v))))
    return once(ranks, best)


def contact_status(email: Column, phone: Column) -> Column:
    return F.when(given(email) & given(phone), "complete").when(given(email) | given(phone), "partial").otherwise("missing")


def has_real_contacts(email: Column, email_source: Column, phone: Column, phone_source: Column) -> Column:
    """An address or number that does not come from a fallback; one of unknown source does not count."""
    real = lambda c, source: given(c) & F.coalesce(~source.isin("fallback_static", "fallback_na"), F.lit(False))
    return real(email, email_source) | (real(phone, phone_source) & (phone != "N/A"))


def email_candidates(website: Column, prefixes: list[str], most: int = 3) -> Column:
    d = domain(website)
    return F.when(given(d), F.array(*[F.concat(F.lit(p + "@"), d) for p in prefixes[:most]])).otherwise(F.array().cast("array<string>"))


def company_prefix(name: Column) -> Column:
    """The first word of a name without brackets and marks, if it has three letters or more."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)", ""), r"[^a-zA-Z\s]", ""))
    return F.nullif(F.lower(F.regexp_extract(plain, r"^([A-Za-z]{3,})(?:\s|$)", 1)), F.lit(""))


def generated_confidence(text: Column, email: Column, company: Column, site_domain: Column) -> Column:
    """How sure a guessed address is, given the text it was seen in; null if the very address is not in it."""
    low, e, d = F.lower(text), F.lower(email), F.lower(site_domain)
    name = F.lower(F.trim(F.regexp_replace(company, r"\s*\([^)]*\)", "")))
    plus = lambda test, n: F.when(test, n).otherwise(0.0)
    exact = F.concat(F.lit(r"(?<![\w.+-])\Q"), e, F.lit(r"\E(?![\w.-])"))
    sure = F.lit(0.4) + plus(F.contains(low, e), 0.2) + plus(F.contains(low, name) | F.contains(compact(low), compact(name)), 0.3)
    return F.when(F.regexp_like(low, exact), F.least(F.lit(1.0), sure + plus(F.contains(F.replace(low, e, F.lit("")), d), 0.1)))
