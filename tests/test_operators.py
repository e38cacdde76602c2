"""Operators against small cases and plain replays."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import discovery, enrich, filtering, ingest, registry, resolve, sections
from quarrymill.operators.filtering import FilterConfig, Tender
from quarrymill.plans import batches

VENDOR = "ord long, company_name string, website string, email string, phone string, location string, city string, state string, country string, source string, is_past_winner boolean, uei string, duns string, cage_code string, total_contract_value double, contract_count long, enrichment_flags array<string>, business_types array<string>"


def vendor(ord_, name, **k):
    fields = [f.split()[0] for f in VENDOR.split(", ")]
    base = {"ord": ord_, "company_name": name, "is_past_winner": False, "enrichment_flags": [], "business_types": []} | k
    return tuple(base.get(f) for f in fields)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), VENDOR)


def replay(keyed):
    """The plain statement of the rule: one vendor after the other, only kept ones hold keys."""
    held, out = {}, {}
    for o in sorted(keyed):
        match = next((held[k] for k in keyed[o] if k in held), None)
        out[o] = o if match is None else match
        if match is None:
            held |= dict.fromkeys(keyed[o], o)
    return out


def test_resolution_is_the_ordered_replay(spark):
    rng = random.Random(5)
    rows = [vendor(i, f"n{rng.randint(0, 40)} {rng.choice(['Inc', 'LLC', ''])}", website=rng.choice([None, "", f"www.s{rng.randint(0, 30)}.com"]), uei=rng.choice([None, f"u{rng.randint(0, 25)}"]), cage_code=rng.choice([None, "", f"c{rng.randint(0, 9)}"])) for i in range(150)]
    df = frame(spark, *rows)
    keyed = {}
    for r in resolve.keys(df).orderBy("ord", "kind").collect():
        keyed.setdefault(r.ord, []).append((r.kind, r.key))
    assert {r.ord: r.survivor for r in resolve.survivors(df).collect()} == replay(keyed)


def test_matching_is_not_transitive(spark):
    df = frame(spark, vendor(1, "A", website="x.com"), vendor(2, "A", website="y.com"), vendor(3, "B", website="y.com"), vendor(4, "", uei=None), vendor(5, None))
    assert {r.ord: r.survivor for r in resolve.survivors(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert resolve.survivors(df.limit(0)).count() == 0


def test_survivorship(spark):
    df = frame(
        spark,
        vendor(1, "Acme Inc", email="", source="s1", total_contract_value=5.0, enrichment_flags=["a"], business_types=["x"]),
        vendor(2, "ACME", email="b@c.d", phone="1", source="s2", total_contract_value=9.0, contract_count=0, is_past_winner=True, enrichment_flags=["b", "a"], business_types=["y"]),
        vendor(3, "Acme LLC", email="z@c.d", source="s2", total_contract_value=None, contract_count=3),
    )
    r = resolve.deduplicate(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.company_name, r.email, r.phone, r.total_contract_value, r.contract_count, r.is_past_winner) == ("Acme Inc", "b@c.d", "1", 9.0, 3, True)
    assert (r.enrichment_flags, r.business_types, r.merged_sources) == (["a", "b"], ["x", "y"], ["s2"])
    assert resolve.deduplicate(df, merge_duplicates=False).first().email == ""


def test_filter_stages(spark):
    """A duplicate, a vendor without the needed status, one without history, a near one and a local one."""
    df = frame(
        spark,
        vendor(1, "Bay Works", city="Boston", state="MA", business_types=["8(a)"], total_contract_value=2e6, source="sam_entity"),
        vendor(2, "Bay Works Inc", state="MA"),
        vendor(3, "Elm Supply", state="CT", business_types=["8(a)"], total_contract_value=5e5),
        vendor(4, "Far Co", state="CA", business_types=["Large"]),
        vendor(5, "Oak", state="NY", business_types=["8(a)"], total_contract_value=10.0),
    )
    tender = Tender(city="Boston", state="MA", set_aside="8A", value=1_000_000.0)
    out, metrics = filtering.run_filter(df, tender)
    assert [r.company_name for r in out.collect()] == ["Bay Works", "Elm Supply"]
    m = metrics.first()
    assert (m.total_input, m.duplicates_removed, m.local_vendors, m.national_vendors, m.eligibility_filtered, m.final_count) == (5, 1, 1, 1, 2, 2)
    assert m.filter_reasons == {"set_aside_mismatch_8A": 1, "insufficient_contract_history": 1}
    strict, _ = filtering.run_filter(df, tender, FilterConfig(expansion_threshold=0, eligibility=False, max_candidates=2))
    assert [r.company_name for r in strict.collect()] == ["Bay Works", "Oak"]
    none, m = filtering.run_filter(df.limit(0), tender)
    assert none.count() == 0 and m.first().final_count == 0


def test_ranking_ties_and_cap(spark):
    df = frame(spark, *[vendor(i, n, state=s) for i, (n, s) in enumerate([("a", "TX"), ("c", "MA"), ("b", "MA"), ("b", "MA")])])
    rows = filtering.ranked(filtering.with_preliminary(filtering.with_geo(df, Tender(city="x", state="MA")), Tender()))
    assert [(r.company_name, r.ord) for r in rows.collect()] == [("c", 1), ("b", 2), ("b", 3), ("a", 0)]
    gov = frame(spark, *[vendor(i, "x", source="sam_entity" if i % 2 else None) for i in range(20)])
    kept = filtering.government_cap(gov, 10).collect()
    assert sorted(r.ord for r in kept if r.is_government) == [1, 3, 5, 7, 9, 11, 13] and len(kept) == 17


REG = "vendor_key string, legal_name string, city string, state string, source string, total_contract_value double, contract_count long"


def test_registry_search(spark):
    rows = [("1", "Ring Works", "X", "ON", "canada_contracts", 9.0, 1), ("2", "Tube", "X", "Ontario", "canada_odbus", None, None), ("3", "Ring 9mm", "X", "QC", "canada_sosa", 8.0, None), ("4", "Ring", "X", "ON", "elsewhere", 99.0, 1)]
    v = spark.createDataFrame(rows, REG)
    codes = spark.createDataFrame([("2", "N12"), ("3", "N"), ("4", "N12")], "vendor_key string, code string")
    keys = lambda df: {r.vendor_key for r in df.collect()}
    assert keys(registry.search(v, codes, gsin_codes=["N1299"])) == {"2", "3"} - {"3"}
    assert keys(registry.search(v, codes, gsin_codes=["N"])) == {"3"}
    assert keys(registry.search(v, keywords=["ring tube"])) == {"1", "2", "3"}
    assert keys(registry.search(v, keywords=["9mm ring"])) == set()  # a technical term is looked for as a whole
    assert keys(registry.search(v, province="Ontario")) == {"1", "2"}
    found = registry.search_with_fallback(v, keywords=["truck"], province="ON").collect()
    assert found == [] or {r.vendor_key for r in found} <= {"1", "2", "3"}
    arms = registry.two_arms(registry.search(v), 10).collect()
    assert [(r.vendor_key, r.arm) for r in arms] == [("1", 1), ("3", 1), ("2", 2)]
    assert registry.expand_keywords(["12 gauge shells", "a b", ""]) == ["12 gauge shells", "a", "b"]


def test_cross_reference(spark):
    v = spark.createDataFrame([("a", "Acme Tools Inc", "Ottawa"), ("b", "Nothing", "Ottawa"), ("c", "Acme Tools", None)], "vendor_key string, company_name string, city string")
    r = spark.createDataFrame([(str(i), n, c) for i, (n, c) in enumerate([("Acme Tool Ltd", "OTTAWA"), ("Tools Acme", "ottawa"), ("Acme Tools", "Hull"), ("Zebra", "Ottawa")])], "vendor_key string, legal_name string, city string")
    got = registry.cross_reference(v, r).orderBy("place").collect()
    assert [(x.vendor_key, x.match_key) for x in got] == [("a", "1"), ("a", "0")]
    codes = spark.createDataFrame([("0", "11"), ("1", "22"), ("1", "11")], "vendor_key string, code string")
    assert registry.cross_referenced_codes(registry.cross_reference(v, r), codes).first().naics_codes == ["11", "22"]


def feed(spark, rows):
    cols = ["legal_name", "standardized_name", "address", "city", "state", "postal_code", "employee_count_range", "gsin", "unspsc", "contract_number", "value", "date", "description", "category", "contact_name", "contact_email", "contact_phone"]
    return spark.createDataFrame([(i, *[r.get(c) for c in cols]) for i, r in enumerate(rows)], "ord long, " + ", ".join(f"{c} string" for c in cols))


def test_rollup_and_upsert(spark):
    rows = [
        {"legal_name": " Acme ", "postal_code": "k1a 0b1", "city": "Hull", "gsin": "N1", "value": "10.5", "date": "2024-02-01"},
        {"legal_name": "Acme", "postal_code": "K1A0B1", "city": "Other", "gsin": "N2", "value": "bad", "date": "2023-1-5"},
        {"legal_name": "Acme", "value": "0", "date": ""}, {"legal_name": "", "value": "5"}, {"legal_name": "Acme", "postal_code": "K1A0B1"},
    ]
    out = {r.external_id: r for r in ingest.contract_rollup(ingest.contract_rows(feed(spark, rows))).collect()}
    a, b = out["Acme_K1A0B1"], out["Acme_NO_POSTAL"]
    assert (a.city, a.total_contract_value, a.contract_count, str(a.first_contract_date), str(a.last_contract_date), a.gsin_codes) == ("Hull", 10.5, 2, "2023-01-05", "2024-02-01", ["N1", "N2"])
    assert (b.total_contract_value, b.contract_count, len(b.contract_history)) == (None, 1, 1)
    delta = ingest.contract_rollup(ingest.contract_rows(feed(spark, rows)))
    twice = {r.external_id: r for r in ingest.upsert_vendors(delta, delta).collect()}
    assert twice["Acme_K1A0B1"].total_contract_value == 21.0 and twice["Acme_K1A0B1"].contract_count == 4 and len(twice["Acme_K1A0B1"].contract_history) == 2
    assert ingest.upsert_vendors(delta.limit(0), delta).count() == 2


def test_replay_and_bridges(spark):
    rows = ingest.chunks(spark.range(25).withColumnRenamed("id", "ord").withColumn("x", F.col("ord") % 7), 10)
    ledger = ingest.chunk_digests(rows.where("chunk = 1"), "s")
    new, digests = ingest.unseen(rows.repartition(5), ledger, "s")
    assert sorted({r.chunk for r in new.collect()}) == [0, 2] and digests.count() == 2
    again, none = ingest.unseen(rows, ledger.select("source", "digest").unionByName(digests), "s")
    assert again.count() == 0 and none.count() == 0
    stored = spark.createDataFrame([("v", "1")], "vendor_key string, code string")
    codes = spark.createDataFrame([("v", "1"), ("v", "2"), ("v", "2")], "vendor_key string, code string")
    assert [r.code for r in ingest.new_bridge_rows(stored, codes).collect()] == ["2"]
    people = spark.createDataFrame([("v", 0, "Ann B Cee", "a@x.y", "1"), ("v", 1, "Zed", "a@x.y", "2"), ("w", 2, None, None, "3")], "vendor_key string, ord long, contact_name string, contact_email string, contact_phone string")
    got = sorted((r.vendor_key, r.first_name, r.last_name, r.phone) for r in ingest.new_contacts(spark.createDataFrame([], "vendor_key string, email string"), people).collect())
    assert got == [("v", "Ann", "B Cee", "1"), ("w", None, None, "3")]


def test_sections(spark):
    rows = [(1, 0, "Intro", "hello", "text"), (1, 1, "Scope of Work", "do it", "text"), (1, 2, "", "and that", "text"), (1, 3, "Evaluation Criteria", "| a |", "table"), (1, 4, "", "more", "text"), (2, 0, "x", "must submit it", "text")]
    s = spark.createDataFrame(rows, "tender_id long, ord long, title string, content string, section_type string")
    got = {(r.tender_id, r.ord): r.field for r in sections.with_field(s).collect()}
    assert got == {(1, 0): None, (1, 1): "scope_of_work", (1, 2): "scope_of_work", (1, 3): None, (1, 4): "scope_of_work", (2, 0): "mandatory_requirements"}
    wide = {r.tender_id: r for r in sections.wide(sections.with_field(s)).collect()}
    assert wide[1].scope_of_work == "do it\n\nand that\n\nmore" and wide[2].scope_of_work == "must submit it"
    assert sections.structured(sections.wide(sections.with_field(s))).count() == 2
    assert [r.ord for r in sections.budget_prefix(s.where("tender_id = 1"), ["tender_id"], ["ord"], "content", 11).orderBy("ord").collect()] == [0, 1]
    assert "do it" in sections.smart_context(s.where("tender_id = 1")).first().context


def test_requirements_and_profile(spark):
    from quarrymill.plans import tender as T

    rows = [(1, 0, "Scope of Work", "Trucks. NAICS: 541330. Minimum of 5 years experience, licensed, ISO 9001", "text"), (1, 1, "Vendor qualifications", "At least 3 years experience, must hold a licence, ISO 9001", "text"), (2, 0, "Scope of Work", "paint", "text")]
    s = spark.createDataFrame(rows, "tender_id long, ord long, title string, content string, section_type string")
    done = sections.structured(sections.wide(sections.with_field(s)))
    got = [(r.tender_id, r.requirement_id, r.type) for r in T.key_requirements(done).orderBy("requirement_id").collect()]
    assert got == [(1, "REQ-001", "experience"), (1, "REQ-002", "license"), (1, "REQ-003", "certification")]
    more = T.key_requirements(done.withColumn("technical_keywords", F.array(F.lit("a")))).where("tender_id = 2").first()
    assert (more.description, more.must_have) == ("Capabilities: a", False)
    api = spark.createDataFrame([(1, ["111111"], "X", None), (2, ["222222"], None, "ON")], "tender_id long, naics array<string>, city string, state_province string")
    p = {r.tender_id: r for r in T.profile(api, done).collect()}
    assert p[1].naics == ["541330"] and p[2].naics == ["222222"] and p[2].state_province == "ON"
    meta = done.withColumns({"external_id": F.lit(""), "title": F.lit(None).cast("string"), "buyer": F.lit("B"), "city": F.lit(None).cast("string"), "state_province": F.lit(None).cast("string"), "country": F.lit(None).cast("string"), "response_deadline": F.lit(None).cast("string"), "posted": F.lit("2024-01-01"), "tender_start": F.lit(None).cast("string"), "tender_end": F.lit(None).cast("string"), "naics": F.array().cast("array<string>"), "technical_keywords": F.array(*map(F.lit, "abcd"))})
    b = {r.tender_id: r for r in sections.backfill(meta).collect()}
    assert b[2].title == "paint" and b[2].buyer == "B" and b[2].naics == ["a", "b", "c"] and b[2].posted == "2024-01-01"


def test_tables(spark):
    t = "| Line No | Caliber | Description | Qty | Unit |\n|--|--|--|--|--|\n| | Primary | | | |\n| 1 | 9mm | ball | 1,000 ea | box |\n| 2 | x |\n| | | - | | |"
    one = lambda content: spark.createDataFrame([(1, 0, content)], "tender_id long, ord long, content string")
    items = lambda content: [tuple(x) for x in one(content).select(sections.line_items(sections.grid(F.col("content"))).alias("x")).first().x or []]
    assert [x[1:] for x in items(t)] == [("#1 - 9mm - ball", 1000.0, "box")]
    assert items("| a |\n|--|") == [] and items("| Product |\n|--|\n| " + "x" * 200 + " |")[0][1:] == ("x" * 100, None, None)
    pairs = lambda content: [(r.question_id, r.question, r.answer) for r in sections.stitched(sections.question_rows(one(content))).orderBy("pos").collect()]
    qa = "| Q1 | Why? |\n| A1 | So. |\n| Q2 | When? |\n| Q3 | x | A3 | y |\n| A9 | lone |"
    assert pairs(qa) == [("Q1", "Why?", "So."), ("Q2", "When?", ""), ("Q3", "x", "y"), ("Q9", "", "lone")]
    assert pairs("| Question | Answer |\n|---|---|\n| a | b |") == [("Q2", "a", "b")]
    assert pairs("| Q4 | Who? |\n| A5 | other |\n| R4 | me |\n| A4 | again |") == [("Q4", "Who?", "me"), ("Q5", "", "other"), ("Q4", "", "again")]
    two = spark.createDataFrame([(1, 0, "| Question No | Answer |\n|---|---|\n| Q1 | " + "w" * 600 + " |"), (1, 1, "| Question No | Answer |\n|---|---|\n| A1 | So. |\n| Q2 | open |")], "tender_id long, ord long, content string")
    assert [(r.question_id, len(r.question), r.answer) for r in sections.clarifications(two).collect()] == [("Q1", 500, "So.")]


def test_terms(spark):
    def chosen(terms, target):
        rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(terms)], "tender_id long, ord long, term string")
        return [r.term for r in sections.cluster_terms(rows, target=target).orderBy("place").collect()]

    q = [f"steel {w} supply" for w in "pipe pipe2 beam".split()] + ["steel pipe supply oem manufacturer"]
    assert chosen(q, 20) == q
    assert chosen(["red steel pipe", "red steel pipe oem maker", "blue cloth"], 2) == ["red steel pipe oem maker", "blue cloth"]
    many = ["".join(f"word{chr(97 + i)}{chr(97 + j)}{chr(97 + k)} " for k in range(1 + (i + j) % 3)).strip() for i in range(6) for j in range(6)]
    score = {t: len(t.split()) for t in many}
    got = chosen(many, 9)
    assert len(got) == 9 == len(set(got)) and [score[t] for t in got] == [3, 3, 3, 1, 1, 1, 3, 3, 3]


def test_discovery(spark):
    rows = [("q", 0, 1, "Acme | Home", "", "acme.com", "https://acme.com/x"), ("q", 0, 2, "Acme 2", "", "acme.com", "https://acme.com/y"), ("q", 0, 3, "News", "a blog", "blog.io", "https://blog.io/p"), ("q", 1, 1, "Dept", "", "x.gc.ca", "https://x.gc.ca"), ("q", 1, 2, "B Inc blog", "", "b.com", "https://b.com/blog"), ("q", 0, 4, "L", "", "ca.linkedin.com", "https://ca.linkedin.com/x")]
    r = spark.createDataFrame(rows, "query string, level int, position int, title string, snippet string, domain string, url string")
    got = discovery.candidates(r).orderBy("domain").collect()
    assert [(x.domain, x.company_name) for x in got] == [("acme.com", "Acme"), ("b.com", "B Inc blog")]
    assert discovery.candidates(r, spark.createDataFrame([("ACME.com",)], "domain string")).count() == 1
    assert discovery.query_budget(100, 50, 10) == 26
    terms = spark.createDataFrame([(0, "steel pipe"), (1, "Steel Pipe")], "ord long, term string")
    assert discovery.geo_queries(terms, [("city", "Hull"), ("global", None)]).count() == 2


def test_contact_ladder(spark):
    v = spark.createDataFrame([("a", "Acme", "https://acme.com", None, None), ("b", "Beta", None, "old@b.c", None), ("c", "Cee", "https://cee.com", None, None)], "vendor_key string, company_name string, website string, email string, phone string")
    cand = spark.createDataFrame(
        [("a", 2, "serper_backup", 0.7, ["x@other.gc.ca"], ["p2"]), ("a", 4, "generated", 0.8, ["info@acme.com"], ["no"]), ("b", 1, "scraped_regex", 0.9, ["new@b.c"], []), ("b", 2, "serper_backup", 0.7, ["z@b.c"], ["p"])],
        "vendor_key string, level int, source string, confidence double, emails array<string>, phones array<string>",
    )
    got = {r.vendor_key: r for r in enrich.contact_ladder(v, cand).collect()}
    assert (got["a"].email, got["a"].email_source, got["a"].phone) == ("info@acme.com", "generated", "p2")
    assert (got["b"].email, got["b"].phone, got["b"].contact_status) == ("new@b.c", "p", "complete") and got["c"].contact_status == "missing"


def test_quality_gate(spark):
    v = spark.range(400).select(F.col("id").alias("place"), F.lit("https://x.y").alias("website"))

    def run(good, content=lambda p: F.lit("text"), **k):
        enrich_ = lambda b: b.withColumn("website_content", content(F.col("place"))).withColumn("scrape_error", F.lit(None).cast("string"))
        score = lambda b: b.withColumn("capability_match_score", F.when(good(F.col("place")), 90.0).otherwise(0.0)).withColumn("scoring_method", F.lit("llm"))
        return batches.run_gated(v, enrich_, score, batches.Gate(**k))

    assert [t[:2] for t in run(lambda p: p % 2 == 0, target=60).trace] == [(0, 100), (100, 200)]
    assert [t[:2] for t in run(lambda p: p < 120, target=1000).trace] == [(0, 100), (100, 200), (200, 300)]
    assert [t[:2] for t in run(lambda p: p >= 150, target=1000).trace][:2] == [(0, 100), (150, 250)]
    none = run(lambda p: p >= 0, content=lambda p: F.lit(None).cast("string"))
    assert [t for t in none.trace] == [(0, 100, 0, 0)]


@pytest.mark.parametrize("name", ["vendor_shortlist", "quality_gate", "streamed_vendors"])
def test_catalog_runs(spark, name):
    from quarrymill import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_texts_are_taken_apart_once(spark):
    """However many words are looked for: the lines of a table, the columns of its header, a vendor's domain and an address's rank are worked out once."""
    from quarrymill.functions import contacts, documents

    df = spark.createDataFrame([("| Item No | Qty |\n|---|---|\n| 1 | 2 |", "https://www.acme.com", "Acme", ["a@acme.com", "b@x.gc.ca"])], "t string, w string, c string, e array<string>")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(documents.table_type(F.col("t"))).count("split(") <= 2
    assert plan(sections.line_items(sections.grid(F.col("t")))).count("array_position(") <= 2 * len(sections.ITEM_COLUMNS)
    found = contacts.vendor_emails(F.col("e"), F.col("w"), F.col("c"))
    assert plan(found).count("substring_index(") == 1 and plan(found).count("www") == 1
    assert df.select(found.alias("x")).first().x == ["a@acme.com"]
    empty = df.select(contacts.vendor_emails(F.array().cast("array<string>"), F.col("w"), F.col("c")), contacts.vendor_emails(F.array(F.lit("b@x.gc.ca")), F.col("w"), F.col("c")), contacts.vendor_emails(F.lit(None).cast("array<string>"), F.col("w"), F.col("c"))).first()
    assert tuple(empty) == ([], [], None)
