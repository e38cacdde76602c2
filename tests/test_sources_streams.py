"""Readers, writers and streams on small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.names import stream_key
from quarrymill.operators import discovery, enrich, ingest
from quarrymill.sources import documents, feeds, sinks
from quarrymill.sources.store import Store
from quarrymill.streaming import flows


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_contract_feed(spark, tmp_path):
    h = feeds.CONTRACTS
    head = ",".join([h["legal_name"], h["postal_code"], h["value"], h["date"], h["gsin"]])
    path = write(tmp_path / "c.csv", head + '\n"Acme, Inc",k1a 0b1,10.5,2024-01-02,N1\n"Line\nbreak",,x,,\n', "utf-8-sig")
    rows = ingest.contract_rollup(ingest.contract_rows(feeds.route(spark, "canada_contracts", path)))
    got = {r.legal_name: r for r in rows.collect()}
    assert got["Acme, Inc"].total_contract_value == 10.5 and got["Acme, Inc"].postal_code == "K1A0B1" and got["Line\nbreak"].contract_count is None
    with pytest.raises(ValueError):
        feeds.route(spark, "nothing", path)
    with pytest.raises(ValueError):
        feeds.route(spark, "ccc", None)


def test_award_feed(spark, tmp_path):
    h = feeds.AWARDS
    path = write(tmp_path / "a.csv", ",".join([h["legal_name"], h["value"], h["amount"], h["gsin"]]) + '\nA,,5,"N1\nN2"\nA,0,6,N2\n')
    feed = feeds.awards(spark, path)
    rows = ingest.contract_rows(feed).join(feed.select("ord", F.col("amount").cast("decimal(38,6)").alias("amount")), "ord")
    assert ingest.award_rollup(rows).first().total_contract_value == 11.0
    assert sorted(r.code for r in ingest.split_codes(rows).collect()) == ["N1", "N2"]


def test_other_feeds(spark, tmp_path):
    odbus = write(tmp_path / "o.csv", "business_name,city,postal_code,derived_NAICS,source_NAICS_primary\nA,Hull,..,5413.0,5413\nA,Hull,..,1,2\nB,..,K1A,1,2\n")
    r = feeds.business_registry(spark, odbus).collect()
    assert [(x.external_id, x.naics_codes) for x in r] == [("A_HULL_ODBUS", ["5413"])]
    sam = write(tmp_path / "s.csv", "UEI,LEGAL BUSINESS NAME,BUSINESS TYPES,SMALL BUSINESS\nu1,Acme,A~ ~B,Y\n,None,,\n")
    x = feeds.sam_export(spark, sam).collect()
    assert len(x) == 1 and x[0].business_types == ["A", "B"] and x[0].is_small
    ccc = tmp_path / "c.json"
    ccc.write_text(json.dumps([{"Company Name": "X", "City": "Y", "NAICS": ["11-a", "22"]}]))
    assert feeds.capabilities(spark, str(ccc)).first().naics_codes == ["11", "22"]
    cid = write(tmp_path / "i.csv", "Importer Name,City,HS Code,HS Description\nImp,Y,01,a\nImp,Y,01,a\nImp,Y,02,b\n")
    assert len(ingest.importer_rollup(feeds.importers(spark, cid)).first().products) == 2
    t = feeds.TENDERS
    tenders = write(tmp_path / "t.csv", ",".join([t["reference"], t["regions"], t["attachments"], t["notice_url"], t["gsin"]]) + '\nR1,"Ottawa, Ontario","http://a/x, ftp://b",https://n,*N1*N2\n')
    r = feeds.tender_by_reference(feeds.open_tenders(spark, tenders), "R1").first()
    assert r.attachments == ["http://a/x", "https://n"] and r.gsin == ["N1", "N2"] and r.place.city == "Ottawa"
    offers = write(tmp_path / "f.csv", "supplier-legal-name,supplier-operating-name,commodity,award-date,expiry-date\nA,A,c,2020-01-01,2021-01-01\nA,B,d,2019-01-01,2106-01-01\n")
    o = ingest.standing_offers(feeds.standing_offers(spark, offers)).first()
    assert (str(o.first_contract_date), str(o.last_expiry_date), o.commodities, o.operating_names) == ("2019-01-01", "2106-01-01", ["c", "d"], ["B"])


def test_payloads(spark, tmp_path):
    def read(x):
        p = tmp_path / f"{abs(hash(str(x)))}.json"
        p.write_text(json.dumps(x))
        return spark.read.option("multiLine", True).json(str(p))

    opp = read({"opportunitiesData": [{"solicitationNumber": "S", "title": "T", "description": "d", "naicsCode": "1", "classificationCode": "c", "organizationName": "O", "fullParentPathName": "A > B", "postedDate": "2024-01-02T00", "responseDeadLine": "2024-02-03", "setAsideCode": "8A", "setAside": "x", "baseAndAllOptionsValue": "12", "resourceLinks": ["u"]}]})
    r = feeds.sam_opportunities(opp).first()
    assert (r.buyer_path, r.posted, r.estimated_value, r.set_aside) == (["A", "B"], "2024-01-02", 12.0, "8A")
    ck = read({"result": {"records": [{"reference_number": "R", "title_en": "T", "naics_code": "1,2", "delivery_city": "X", "doc_url": "http://d", "a_link": "no"}]}})
    r = feeds.ckan_records(ck).first()
    assert (r.naics, r.city, r.attachments) == (["1", "2"], "X", ["http://d"])
    sba = read({"results": [{"uei": "u", "cage_code": "c", "businessName": "B", "url": "w", "sam_address_city": "X", "sam_address_state": "tx", "email": "e", "phone": "p", "naics_codes": ["11"], "certifications": [{"certification_name": "HUBZone"}], "self_certifications": [{"certification_name": "SDVOSB"}]}]})
    assert feeds.small_business_companies(sba, "hubzone", state="TX").first().is_sdvosb and feeds.small_business_companies(sba, naics=["99"]).count() == 0
    assert feeds.company_by_uei(feeds.small_business_companies(sba), "U").count() == 1
    assert feeds.fits("sam_entity", "USA", ["1"]) and not feeds.fits("sam_entity", "Canada", ["1"]) and not feeds.fits("canada_contracts", None) and feeds.fits("canada_contracts", None, province="ON")
    both = feeds.discover({"a": feeds.demo_vendors(spark), "b": feeds.demo_vendors(spark, 2)})
    assert both.count() == 7 and both.where("source_rank = 1").count() == 2


def test_documents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    md = "intro\n# One\ntext\n```\n# Not a heading\n```\n## Two ##\nmore"
    (tmp_path / "d/a.md").write_text(md)
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", doc)
    (tmp_path / "d/b.docx").write_bytes(buffer.getvalue())
    (tmp_path / "d/c.docx").write_bytes(b"broken")
    (tmp_path / "d/e.xyz").write_text("?")
    got = {}
    for r in documents.parse(documents.read_files(spark, str(tmp_path / "d"))).orderBy("path", "ord").collect():
        got.setdefault(r.path[-6:].split("/")[-1], []).append((r.title, r.content, r.section_type))
    assert [(t, s) for t, _, s in got["a.md"]] == [("", "text"), ("One", "text"), ("Two", "text")] and "# Not a heading" in got["a.md"][1][1]
    assert ("Head", "Body", "text") in got["b.docx"] and ("Table 1", "| a\\|b |\n| --- |", "table") in got["b.docx"]
    assert got["c.docx"][0][2] == got["e.xyz"][0][2] == "error"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("p/a.txt", "1")
        z.writestr("q/a.txt", "2")
        z.writestr("q/a.exe", "3")
    (tmp_path / "out").mkdir()
    assert sorted(p.rsplit("/", 1)[1] for p in documents.unzip(str(tmp_path / "x.zip"), str(tmp_path / "out"))) == ["a.txt", "a_1.txt"]
    files = spark.createDataFrame([("/x/Cover page.pdf", 90_000), ("/x/small.pdf", 10), ("/x/big.pdf", 80_000)], "path string, length long")
    assert documents.type_histogram(spark.createDataFrame([("a",), ("a",)], "doc_type string")).first().n == 2
    assert [r.path for r in documents.relevant(files).collect()] == ["/x/big.pdf"] and [r.path for r in documents.relevant(files.where("length < 100")).collect()] == ["/x/small.pdf"]


def test_search_pages(spark):
    html = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.Acme.com%2Fx&a=1"> Acme <b>Tools</b></a><a class="result__snippet">Best &amp; first</a></div><div class="result"><a class="result__a" href="https://linkedin.com/a">L</a></div><div class="result ad"><a class="result__a" href="/rel">R</a></div>'
    df = spark.createDataFrame([("k", html), ("n", None)], "vendor_key string, html string")
    got = discovery.parse_result_pages(df).collect()
    assert [(r.vendor_key, r.position, r.url, r.domain, r.title, r.snippet) for r in got] == [("k", 1, "https://www.Acme.com/x", "acme.com", "Acme Tools", "Best & first")]
    v = spark.createDataFrame([("Acme Ltd", "Hull", "QC", "Canada", "https://www.acme.com"), ("Hull Works", "Hull", None, None, None)], "company_name string, city string, state string, country string, website string")
    q = v.select(discovery.website_query(*[F.col(c) for c in ("company_name", "city", "state", "country")]).alias("w"), discovery.contact_query(*[F.col(c) for c in ("company_name", "website", "city", "state")]).alias("c")).collect()
    assert [r.w for r in q] == ["Acme Hull QC Canada", "Hull Works"]
    assert q[0].c.startswith('site:acme.com ("sales@"') and q[1].c == '"Hull Works" sales@ OR contact@ OR info@ OR email contact "Hull"'


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "A, b", ["x"], 1.5), (1, "B", [], 2.5)], "ord long, company_name string, tags array<string>, capability_match_score double")
    sinks.export(rows, str(tmp_path / "e"))
    back = spark.read.option("header", True).csv(str(tmp_path / "e"))
    assert back.columns == sinks.EXPORT and {r.company_name for r in back.collect()} == {"A, b", "B"}
    sinks.export(rows.limit(0), str(tmp_path / "z"))
    assert spark.read.option("header", True).csv(str(tmp_path / "z")).columns == sinks.EXPORT
    with pytest.raises(ValueError):
        sinks.export(rows, str(tmp_path / "q"), "xls")
    assert sinks.nested(sinks.flat(rows), {"tags": "array<string>"}).orderBy("ord").collect() == rows.orderBy("ord").collect()
    assert sinks.write_run(spark, {"t": (rows, "ord")}, str(tmp_path / "run")) == 0
    sinks.update_row(spark, str(tmp_path / "run"), "t", 1, {"company_name": "New"})
    assert {r.company_name for r in documents.read_run(spark, str(tmp_path / "run"), "t", ["company_name"]).collect()} == {"A, b", "New"}
    path = str(tmp_path / "jobs")
    for run, status, at in (("a", "running", "2024-01-01 00:00:00"), ("b", "running", "2024-01-02 00:00:00"), ("a", "completed", "2024-01-03 00:00:00"), ("c", "removed", "2024-01-03 00:00:00")):
        sinks.register_job(spark, path, run, status, at, at)
    jobs = sinks.jobs(spark, path)
    assert {r.run_id: r.status for r in jobs.collect()} == {"a": "completed", "b": "running"}
    assert sinks.pick_job(jobs.withColumn("k", F.lit(1)), "k").first().run_id == "b"


def test_sites_and_overrides(spark):
    pages = spark.createDataFrame([("acme.com", "/", 1, 0, "<p>Home text</p>", 200, False), ("acme.com", "/about", 1, 1, "<p>About</p>", 200, False), ("acme.com", "/contact", 0, 2, "<p>Call 613-555-0100</p>", 200, True), ("y.com", "/", 1, 0, "<p>Only home</p>", 200, False)], "domain string, path string, tier int, ord int, html string, status int, is_contact boolean")
    site = enrich.sites(pages)
    v = spark.createDataFrame([("a", "https://acme.com"), ("b", "https://facebook.com/b"), ("c", None), ("d", "z.com")], "vendor_key string, website string")
    got = {r.vendor_key: r for r in enrich.with_content(v, site).collect()}
    assert got["a"].website_content == "Home text\n\nAbout" and got["b"].website_content is None and got["d"].scrape_error == "no_content"
    ready, rest = enrich.split_ready(enrich.with_content(v, site))
    assert ready.count() == 1 and {r.vendor_key: r.needs_data for r in rest.collect()} == {"b": "no_content", "c": "no_website", "d": "no_content"}
    assert {r.domain: r.contact_text for r in enrich.contact_pages(pages).collect()} == {"acme.com": "Call 613-555-0100", "y.com": "Only home"}
    o = enrich.override(v, spark.createDataFrame([("c", "new.com"), ("a", "https://acme.com")], "vendor_key string, website string"), "vendor_key", ["website"])
    changes = {r.vendor_key: [tuple(c) for c in r.changes] for r in o.collect()}
    assert changes["c"] == [("website", None, "new.com")] and changes["a"] == []


def test_unique_stream_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Vendor {i % 7}") for i in range(40)], "ord long, company_name string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    none = F.lit(None).cast("string")
    stream = flows.unique_stream(flows.read_stream(spark, str(tmp_path / "in"), rows.schema), stream_key(none, none, none, F.col("company_name")))
    q = flows.enrich_stream(stream, lambda b: b.withColumn("website_content", F.lit("x")), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 7 and out.select("vendor_key").distinct().count() == 7
    s = flows.summary(q)
    assert s["rows"] == 40 and s["batches"] >= 4
    assert flows.streams(True, 50) and not flows.streams(True, 49)


def test_ingest_stream_is_idempotent(spark, tmp_path):
    cols = [*feeds.CONTRACTS]
    rows = spark.createDataFrame([(i, *[{"legal_name": f"V{i % 3}", "value": "2", "date": "2024-01-01"}.get(c) for c in cols]) for i in range(30)], "ord long, " + ", ".join(f"{c} string" for c in cols))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for n in range(2):  # the second stream starts without a checkpoint, so the same rows come again
        flows.ingest_stream(flows.read_stream(spark, str(tmp_path / "in"), rows.schema), "canada_contracts", str(tmp_path / "root"), str(tmp_path / f"cp{n}")).awaitTermination()
    store = Store(spark, str(tmp_path / "root"))
    assert store.version() == 0 and sorted(r.total_contract_value for r in store.read("vendors").collect()) == [20.0, 20.0, 20.0]
    assert store.read("ledger").count() == 1


def test_steps_can_be_cleaned_up(spark):
    import os

    from quarrymill import session

    kept = session.checkpointed(spark.range(3))
    assert kept.count() == 3
    folder = session.step_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    session.cleanup(spark)
    assert not os.path.exists(folder)
