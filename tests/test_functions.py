"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import cleaning, contacts, documents, geo, names, pages, scoring, similarity


def one(spark, build, *values):
    """The value of an expression over columns a, b, ... that hold these values."""
    kinds = ", ".join(f"{c} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long'}" for c, v in zip("abcdefgh", values))
    df = spark.createDataFrame([values], kinds)
    return df.select(build(*[F.col(c) for c in "abcdefgh"[: len(values)]]).alias("x")).first().x


@pytest.mark.parametrize(
    "raw,dedup,match",
    [
        ("  Acme Corp.  ", "acme", "ACME"), ("Québec-Ltée Inc", "québecltée", "QUÉBECLTÉE"), ("Foo Co Ltd", "foo", "FOO CO"), ("Company", "company", ""), ("A & B, LLC", "a b", "A B"), ("", "", ""), (None, "", ""), ("Nord Pty Ltd / Sud", "nord pty ltd sud", "NORD PTY"),
    ],
)
def test_names(spark, raw, dedup, match):
    assert one(spark, names.dedup_name, raw) == dedup
    assert one(spark, names.match_name, raw) == match


@pytest.mark.parametrize(
    "url,key,domain,base",
    [("www.Foo.com/a", "foo.com", "", "https://www.Foo.com"), ("http://WWW.foo.com:8080/x?y", "foo.com:8080", "foo.com:8080", "http://WWW.foo.com:8080"), (None, None, "", None), ("", None, "", None), ("https://a.www.b.ca", "a.b.ca", "a.www.b.ca", "https://a.www.b.ca"), ("ftp://x.y", "ftp:", "x.y", None)],
)
def test_addresses(spark, url, key, domain, base):
    assert one(spark, names.website_key, url) == key
    assert one(spark, names.domain, url) == domain
    assert one(spark, names.base_url, url) == base


def test_keys(spark):
    assert one(spark, names.identifier_key, " u1 ", "d", "c") == "uei:U1"
    assert one(spark, names.identifier_key, "", " 7 ", "c") == "duns:7"
    assert one(spark, names.identifier_key, None, None, None) is None
    assert one(spark, names.stream_key, None, "", "X.com", "N") == "domain:x.com"
    assert one(spark, names.stream_key, None, None, None, "Big Co") == "name:big co"
    assert one(spark, names.title_to_name, "Acme Tools - HOME | Contact") == "Acme Tools"
    assert one(spark, names.title_to_name, " - Home") == " - Home"
    assert one(spark, names.domain_root, "shop.acme.co") == "acme"


def test_cleaning(spark):
    assert one(spark, cleaning.clean, "  ") == "" and one(spark, cleaning.clean, "") is None and one(spark, cleaning.clean, " a ") == "a"
    assert one(spark, cleaning.null_token, " .. ") is None
    assert float(one(spark, cleaning.decimal, "1e3")) == 1000 and one(spark, cleaning.decimal, "x") is None and one(spark, cleaning.decimal, "NaN") is None
    assert str(one(spark, cleaning.iso_date, "2025-1-1")) == "2025-01-01" and one(spark, cleaning.iso_date, "2025-13-01") is None
    assert one(spark, cleaning.postal_code, " k1a 0b1 2") == "K1A0B1" and one(spark, cleaning.postal_code, " ") is None
    assert one(spark, cleaning.state_code, " Alberta") == "AL"
    assert one(spark, cleaning.english_date, "due March 3rd, 2025 at noon") == "2025-03-03" and one(spark, cleaning.english_date, "Foo 3, 2025") is None
    assert one(spark, cleaning.split_present, "a;b|c") == ["a", "b|c"] and one(spark, cleaning.split_present, "*a *b") == ["a", "b"] and one(spark, cleaning.split_present, None) == []
    assert one(spark, cleaning.path_parts, "A >> B > C") == ["A", "B > C"]
    assert tuple(one(spark, cleaning.city_province, "Ottawa, Ontario")) == ("Ottawa", "Ontario") and tuple(one(spark, cleaning.city_province, "Ontario")) == (None, "Ontario")
    assert cleaning.province_forms("Ontario") == ["Ontario", "ON"] and cleaning.province_forms("QC") == ["QC", "Quebec"] and cleaning.province_forms("ZZ") == ["ZZ"]
    assert one(spark, cleaning.naics_list, "5413.0", "5413", None) == ["5413"]


def test_similarity(spark):
    assert similarity.indel_ratio("", "") == 1.0 and similarity.indel_ratio("abcd", "bcde") == 0.75 and similarity.indel_ratio("abc", "xyz") == 0.0
    import random

    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert similarity.lcs_length(a, b) == row[-1]
    assert one(spark, similarity.token_overlap, ["a", "b"], ["b", "c", "d"]) == pytest.approx(1 / 3)
    assert one(spark, similarity.jaccard, [], ["a"]) == 0.0
    assert one(spark, similarity.code_similarity, ["541330"], ["541399"]) == 0.7 and one(spark, similarity.code_similarity, ["54"], ["541399"]) == 0.4
    assert one(spark, similarity.specificity, "OEM manufacturer of the steel service boats") == 8


def test_places(spark):
    lit = F.lit
    assert one(spark, lambda v: geo.geo_tier(lit("MA"), v, lit("United States")), "Connecticut") == "national"  # its first letters are CO
    assert one(spark, lambda v: geo.geo_tier(lit("MA"), v, lit("United States")), "CT") == "regional"
    assert one(spark, lambda v: geo.geo_tier(lit("ON"), v, lit("Canada")), "qc") == "regional"
    assert one(spark, lambda v: geo.geo_tier(lit("ON"), v, lit("Canada")), None) == "national"
    assert one(spark, lambda v: geo.geo_score(lit(None).cast("string"), lit("MA"), v, lit("US")), "MA") == 0.0
    assert one(spark, lambda v: geo.geo_score(lit("x"), lit("MA"), v, lit("US")), "ma") == 20.0
    assert one(spark, geo.miles, 40.7128, -74.0060, 34.0522, -118.2437) == pytest.approx(2445, rel=0.005)
    assert [one(spark, geo.distance_score, d) for d in (50.0, 51.0, 2500.0, 9999.0)] == [1.0, 0.9, 0.1, 0.05]


def test_scores(spark):
    assert one(spark, lambda c, t: scoring.set_aside_reason(c, t), "8A", ["8(A)"]) is None
    assert one(spark, lambda c, t: scoring.set_aside_reason(c, t), "WOSB", []) == "set_aside_missing_WOSB"
    assert one(spark, lambda c, t: scoring.set_aside_reason(c, t), "HZC", ["Large"]) == "set_aside_mismatch_HZC"
    assert one(spark, lambda c, t: scoring.set_aside_reason(c, t), "8a", []) is None
    assert one(spark, scoring.size_reason, 1000.0, 99.0) == "insufficient_contract_history" and one(spark, scoring.size_reason, 1000.0, 0.0) is None
    for text, score in (('{"score": 140}', 100.0), ('```json\n{"score": "12.5"}\n```', 12.5), ('{"score": NaN}', None), ('{"x": 1}', None), ("no", None), ('{"score": -3}', 0.0)):
        assert one(spark, scoring.parsed_score, text) == score
    assert one(spark, lambda m, s: scoring.match_status(m, s, 40.0), "rule_based", 95.0) == "needs_review"
    assert one(spark, lambda m, s: scoring.match_status(m, s, 40.0), "llm", 40.0) == "selected"


def test_contacts(spark):
    text = "Write to Info@Acme.com, sales@acme.com or noreply@acme.com; call (613) 555-0100 or 613.555.0100 or +1 613-555-0199. Contact: Jane Mary Doe"
    assert one(spark, contacts.emails, text) == ["sales@acme.com", "info@acme.com"]
    assert one(spark, contacts.phones, text) == ["+16135550199", "+16135550100"]
    b = one(spark, contacts.contact_bundle, text)
    assert b.confidence == 0.9 and b.names == ["Jane Mary Doe"]
    assert one(spark, contacts.contact_bundle, None).method == "none"
    pick = lambda e, w, c: one(spark, contacts.vendor_emails, e, w, c)
    assert pick(["a@acme.com", "b@x.org"], "https://www.acme.com", "Acme") == ["a@acme.com"]
    assert pick(["b@x.org", "c@y.gc.ca"], "https://acme.com", "Acme") == ["b@x.org"]
    assert pick(["c@y.gc.ca"], "https://z.gc.ca", "Dept") == ["c@y.gc.ca"]
    assert pick(["x@acme-group.net"], None, "Acme Group") == ["x@acme-group.net"]
    assert one(spark, contacts.company_prefix, "Bennett Group (CANADA)") == "bennett" and one(spark, contacts.company_prefix, "AB Co") is None
    sure = lambda t: one(spark, contacts.generated_confidence, t, "info@acme.com", "Acme Ltd", "acme.com")
    assert sure("mail xinfo@acme.com") is None and sure("mail info@acme.com now") == pytest.approx(0.6) and sure("Acme Ltd: info@acme.com, www.acme.com") == 1.0
    assert one(spark, contacts.has_real_contacts, "a@b.c", "scraped", None, None) is True and one(spark, contacts.has_real_contacts, "a@b.c", None, "N/A", "x") is False


def test_documents(spark):
    assert one(spark, documents.heading_field, "2. STATEMENT OF WORK") == "scope_of_work" and one(spark, documents.heading_field, "Intro") is None
    assert one(spark, documents.context_field, "within 5 calendar days") == "timeline_details"
    assert one(spark, documents.section_class, "Legal", "about delivery") == "gold" and one(spark, documents.section_class, "Legal", "none") == "junk"
    assert one(spark, documents.table_type, "| Q1 | What? |\n|---|---|\n| A1 | That |") == "qa" and one(spark, documents.table_type, "| a |") == "unknown"
    assert one(spark, documents.document_type, "x.pdf", "This Amendment No 3 shall meet") == "tech_amendment" and one(spark, documents.document_type, "addendum.pdf", None) == "addendum"
    v = one(spark, documents.volumes, "10,000 rounds and 3 vehicles, 2.5 kg")
    assert [(x.quantity, x.unit) for x in v] == [(10000.0, "rounds"), (2.5, "kg"), (3.0, "vehicles")]
    r = one(spark, documents.requirements, "At least 5 years experience, ISO 9001, Canadian small business, pallet, within 10 business days")
    assert (r.min_years, r.certificates, r.jurisdictions, r.business_size, r.lead_days) == (5, ["iso", "iso 9001"], ["Canada"], "SMALL_ONLY", 10)
    i = one(spark, documents.identifiers, "Solicitation No: AB-12. RFB # OPP-77 Tender: 991")
    assert (i.solicitation, i.rfb, i.tender) == ("AB-12", "OPP-77", "991")
    t = one(spark, documents.contract_terms, "a (3) year with one (2) additional; irrevocable for 90 calendar days; insurance")
    assert (t.term_years, t.extension_years, t.irrevocable_days, t.insurance, t.clearance) == (3, 2, 90, True, False)
    e = one(spark, documents.evaluation, "Stage 1 then price evaluation. Technical: 60% Price: 40%")
    assert [s.number for s in e.stages] == [1, 4] and (e.technical, e.price) == (0.6, 0.4)
    assert one(spark, documents.naics_codes, "NAICS: 541330 and primary naics: 541330, NAICS code 111111") == ["541330", "111111"]
    assert one(spark, documents.deadline, "Closing Date: March 3rd, 2025") == "2025-03-03"
    assert one(spark, documents.scope_title, "\n  Title here \nmore") == "Title here"
    assert one(spark, documents.buyer_name, "Issued by:  Town  of X\nfoo") == "Town of X"
    p = one(spark, documents.place, "The site is located in Austin, Texas today")
    assert (p.city, p.state_province) == ("Austin", "TX") and one(spark, documents.place, "Nationwide work").city == "Nationwide"
    grid = one(spark, lambda a: documents.markdown_table(F.array(F.array(a, F.lit("x|y")), F.array(F.lit("1"), F.lit("2")))), "h")
    assert grid == "| h | x\\|y |\n| --- | --- |\n| 1 | 2 |"


def test_pages(spark):
    html = "<nav>menu</nav><p>Hello <b>world</b></p><script>x</script><a href='mailto:a@b.c?x'>m</a><footer>f</footer>"
    assert pages.page_text(html) == "Hello world m" and pages.page_text(html, navigation=True, mails=True) == "menu Hello world m f a@b.c"
    assert pages.page_text(None) is None and pages.page_text("<p></p>") is None and pages.page_text("�" * 50 + "abc") is None
    site = lambda rows: spark.createDataFrame([(rows,)], "p array<struct<tier:int,ord:int,text:string,status:int>>").select(pages.site_text(F.col("p"), 30, 10, 15).alias("x")).first().x
    assert site([(1, 1, "abc", 200), (2, 1, "defgh", 200), (3, 1, "z" * 40, 200)]) == "abc\n\ndefgh\n\n" + "z" * 30
    assert site([(1, 1, "a" * 12, 200), (2, 1, "no", 200)]) == "a" * 12
    assert site([(1, 1, "abc", 200), (1, 2, None, 403), (2, 1, "no", 200)]) == "abc" and site([]) is None


def test_readable_gets_pages_in_small_lots(spark):
    """However many pages a task has, a Python worker holds a hundred at a time."""
    df = spark.createDataFrame([("<p>some words</p>",), (None,), ("",)], "html string").select(pages.readable()(F.col("html")).alias("t"))
    assert [r.t for r in df.collect()] == ["some words", None, None]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
