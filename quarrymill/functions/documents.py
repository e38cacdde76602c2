"""Tender documents: sections, tables and the fields in them. Column expressions over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import MONTHS
from .names import once

# Phrases of headings that open a field, in the order in which fields are tried.
HEADINGS = {
    "scope_of_work": ["scope of work", "statement of work", "sow", "project scope", "work description", "description of work", "project overview", "background and scope"],
    "mandatory_requirements": ["mandatory requirements", "mandatory criteria", "minimum requirements", "minimum mandatory", "must meet requirements", "pre-qualification requirements", "mandatory submission", "mandatory documents", "qualification envelope"],
    "vendor_qualifications": ["vendor qualifications", "bidder qualifications", "proponent qualifications", "qualification requirements", "experience and qualifications", "eligibility requirements", "proponent experience", "minimum experience"],
    "technical_requirements": ["technical requirements", "technical specifications", "specifications", "technical spec", "performance requirements", "performance specifications", "technical scope"],
    "evaluation_criteria": ["evaluation criteria", "evaluation and scoring", "basis of award", "bid evaluation", "selection criteria", "rated criteria", "scoring matrix", "evaluation process", "stages of evaluation", "technical response evaluation", "commercial response evaluation"],
    "location_details": ["location of work", "place of performance", "site location", "site information", "work site", "delivery location", "place of delivery", "delivery requirements", "on-site", "facility", "facilities", "service location", "performance location", "work location", "project location", "geographic", "nationwide", "multiple locations"],
    "timeline_details": ["project schedule", "timeline", "milestones", "schedule of work", "completion schedule", "delivery schedule", "contract duration", "term of contract", "anticipated timeline", "contract term", "key dates"],
}
# Hints in a text without a heading.
HINTS = {
    "scope_of_work": ["includes but not limited to", "the contractor shall perform", "work to be performed", "the work includes", "services to be provided"],
    "mandatory_requirements": ["shall be considered non-compliant", "must submit", "failure to provide", "is required to", "must meet all"],
    "vendor_qualifications": ["past experience", "similar projects", "references", "completed at least", "proven track record", "prior work"],
    "technical_requirements": ["shall conform to", "must comply with", "in accordance with", "technical standard", "minimum rating", "acceptable manufacturers"],
    "evaluation_criteria": ["points will be awarded", "scored out of", "weighting", "evaluation team", "evaluated based on"],
    "timeline_details": ["substantial completion", "final completion", "calendar days", "business days", "no later than", "within"],
    "location_details": ["located at", "located in", "delivery to", "deliver to", "ship to", "shipped to", "address:", "facility address", "site address", "place of performance", "work will be performed", "services will be performed"],
}
# What makes a section gold or junk, and a table important.
GOLD = ["scope of work", "specifications", "technical specifications", "requirements", "deliverables", "commodity", "line item", "pricing form", "statement of work", "technical requirements", "product specifications", "service specifications", "materials", "equipment", "supply", "delivery", "schedule of requirements"]
JUNK = ["instruction to bidders", "submission instructions", "definitions", "legal", "insurance", "etendering", "portal", "how to bid", "submission process", "terms and conditions", "general conditions", "payment terms", "invoicing", "contract award", "evaluation criteria"]
IMPORTANT = ["price", "amount", "cost", "$", "cad", "quantity", "qty", "volume", "unit", "item", "line", "specification", "requirement", "deadline", "delivery", "date", "timeline", "supplier", "vendor", "contractor", "category", "type", "description"]
# Words of table headers, by kind of table.
LINE_ITEMS = ["line item", "line-item", "item no", "item #", "line no", "caliber", "calibre", "description", "product", "material", "specification"]
TECHNICAL = ["specification", "requirement", "standard", "performance", "technical", "characteristic", "property", "parameter"]
QUALITY = ["defect", "quality", "allowable", "aql", "acceptance", "inspection", "sampling"]
PRICING = ["price", "cost", "unit price", "total price", "amount", "rate", "bid price"]
QA_ROWS = r"\bq\d+\b|\ba\d+\b|\br\d+\b|\bquestion\s*\d+\b|\banswer\s*\d+\b|\bresponse\s*\d+\b|questions\s+and\s+answers"
TABLE_PRIORITY = {"line_items": 1, "technical_specs": 2, "quality": 3}
# Points of a document's type.
DOCUMENT_POINTS = {"core_rfp": 1000, "core_scope": 1000, "tech_amendment": 900, "tech_spec": 850, "appendix": 700, "addendum": 600, "presentation": 400, "legal": 300, "other": 100}
# Vendor requirements.
LICENCES = ["licensed", "license", "licence", "licensed in", "hold a valid", "must hold", "must be licensed", "shall be licensed", "trade license", "contractor license", "electrical contractor licence", "plumbing licence"]
CERTIFICATES = ["iso", "iso 9001", "iso 14001", "saami", "cip", "csa", "astm", "cor certification", "certificate of recognition", "ulc", "ul listed", "nema"]
SPECIAL = ["indigenous supplier", "indigenous-owned", "aboriginal business", "first nations", "women-owned", "woman-owned", "women owned", "minority-owned", "small business", "service-disabled veteran-owned", "sdvosb", "hubzone"]
NAICS = [r"NAICS[:\s]+(\d{6})", r"NAICS\s+[Cc]ode[:\s]+(\d{6})", r"(?:Primary|Main)\s+NAICS[:\s]+(\d{6})", r"COMPETITIVE\s+NAICS[:\s]+(\d{6})", r"8\(A\)\s+COMPETITIVE\s+NAICS[:\s]+(\d{6})"]
EXPERIENCE = [r"(\d+)\s+(?:years|year)\s+of\s+experience", r"minimum\s+of\s+(\d+)\s+(?:years|year)\s+experience", r"at\s+least\s+(\d+)\s+(?:years|year)\s+experience", r"completed\s+at\s+least\s+(\d+)\s+projects"]
VOLUMES = [r"(\d[\d,\.]+)\s*(square\s*meters?|sq\.?\s*m|m2)", r"(\d[\d,\.]+)\s*(square\s*feet|sq\.?\s*ft|ft2)", r"(\d[\d,\.]+)\s*(rounds|cartridges|pcs|pieces)", r"(\d[\d,\.]+)\s*(kg|kilograms?|lbs|pounds?)", r"(\d+)\s+(?:utility\s+)?(vehicles?|utvs?|units?)"]
STATES = {"New Mexico": "NM", "Georgia": "GA", "South Carolina": "SC", "California": "CA", "Texas": "TX", "New York": "NY", "Florida": "FL", "Virginia": "VA", "Maryland": "MD"}

# Patterns of numbers, contacts, terms and places in tender texts.
SOLICITATION = [r"(?:solicitation|rfb|rfp|rfq|tender|bid)\s*(?:no\.?|number|#)?\s*[:=]?\s*([A-Za-z0-9\-_/]+)", r"(opp\s*-\s*\d{3,})"]
REFERENCE = [r"reference\s*(?:no\.?|number|#)?\s*[:=]?\s*([A-Za-z0-9\-_/]+)", r"tender\s*(?:no\.?|number|#)?\s*[:=]?\s*(\d+)", r"(pw-\d{2}-\d{8})"]
RFB = [r"(?i)RFB[:\s#\-\)]*[#\s]*(OPP-\d+)", r"(?i)RFB[:\s#\-\)]*[#\s]*([A-Z0-9]+-\d+)"]
TENDER_NUMBER = [r"[Tt]ender[:\s#]*(\d+)"]
RFX = [r"(?i)RFX[:\s#-]*(\d+)"]
BUYER_EMAIL = [r"(?i)([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})"]
BUYER_PERSON = [r"(?:[Cc]ontact|[Nn]ame)[:\s]*([A-Z][a-z]+\s+[A-Z][a-z]+)"]
BUYER_PHONE = [r"(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})"]
BUYER_NAME = [
    r"(?im)(?:Issued by|Buyer|Purchaser|Client|Contracting Authority):\s*([^\n]+)",
    r"(?im)(Ontario Provincial Police|OPP|Government of [A-Z][a-z]+)",
    r"(?im)([A-Z][A-Za-z\s&]+(?:Police|Department|Ministry|Agency|Government))",
]
DEADLINE = [
    r"(?i)(?:Closing Date|Deadline|Due Date|Bid Due):\s*([A-Za-z]+\s+\d{1,2}[a-z]{0,2},?\s+\d{4})",
    r"(?i)((?:December|November|October|January|February)\s+\d{1,2}[a-z]{0,2},?\s+\d{4})",
]
LEAD_DAYS = [r"(?i)within\s+(\d+)\s+(?:calendar|business)\s+days"]
MAX_BIDS = r"(?:maximum|up\s+to)(?:\s+of)?\s+(?:\w+\s+)?\(?(\d+)\)?\s+bids?\s+per"
STAGES = [
    (1, r"stage\s*1|mandatory\s+submission|qualification\s+envelope", True), (2, r"stage\s*2|technical\s+(?:response\s+)?evaluation|technical\s+envelope", True),
    (3, r"stage\s*3|sample\s+evaluation|sample\s+testing", False), (4, r"stage\s*4|price\s+evaluation|financial\s+evaluation", False),
]
SAMPLE_DAYS = [r"(?:thirty\s*\(\s*)?(\d+)\s*\)?\s*(?:calendar|business)\s*days.*?(?:submit|provide).*?sample", r"sample.*?(?:thirty\s*\(\s*)?(\d+)\s*\)?\s*(?:calendar|business)\s*days"]
START_DATE = [r"(?i)(?:commence|start|effective)[:\s]+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})"]
TERM_AND_EXTENSION = r"\(?\s*(\d+)\s*\)?\s+years?\s+with\s+(?:one\s+\(?\s*)?(\d+)\s*\)?\s+additional"
TERM = [r"\(?\s*(\d+)\s*\)?\s+years?\s+(?:contract\s+)?(?:term)?", r"(?:term|duration)[:\s\-–]+\(?\s*(\d+)\s*\)?\s+year"]
EXTENSION = [r"(?:extension|additional\s+period)[:\s\-–]+(?:up\s+to\s+)?(?:one\s+)?\(?\s*(\d+)\s*\)?\s+year"]
IRREVOCABLE = [r"irrevocable.*?(\d+)\s+(?:calendar\s+)?days"]
CITY_STATE = [
    (r"\b(Washington)\s+(DC)\b", False),
    (
        r"(?:in|at|located in)\s+([A-Za-z]+(?:\s+[A-Z][a-z]+)?),\s*("
        r"Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|"
        r"Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|"
        r"North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|"
        r"Washington|West Virginia|Wisconsin|Wyoming|DC"
        r")\b", True,
    ),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})\s+\d{5}\b", True),
]
NO_CITIES = ["facilities", "systems", "information", "resources", "services", "operations"]
WIDE_PLACES = [
    ("Nationwide", "United States", ["nationwide", "throughout the united states", "conus", "all states"]),
    ("International", "Multiple countries", ["overseas", "oconus", "international"]),
    ("Multiple locations", "United States", ["multiple locations", "various locations"]),
]

#: Words by sector, smallest useful default; a fuller dictionary is a parameter of every function that takes one.
SECTORS = {
    "construction": ["construction", "roofing", "renovation", "concrete", "demolition"],
    "it": ["software", "cloud", "network", "database", "cybersecurity"],
    "medical": ["medical supplies", "hospital", "clinical", "surgical", "laboratory"],
    "vehicle": ["vehicle", "fleet", "truck", "ambulance"],
    "uniforms": ["uniform", "apparel", "garment", "textile"],
    "security": ["security guard", "surveillance", "patrol", "cctv"],
    "transportation": ["logistics", "freight", "shipping", "courier"],
}


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def has_any(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def hits(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def _vote(low: Column, words: dict[str, list[str]]) -> Column:
    """The key with the most words in the text, the first one if several have as many; null without any."""
    votes = F.array(*[F.struct(hits(low, v).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(words.items())])
    best = F.array_max(votes)
    return F.when(best["n"] > 0, best["k"])


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that is found anywhere."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, group), F.lit("")) for p in patterns])


def heading_field(title: Column) -> Column:
    low = _low(title)
    return reduce(lambda rest, kv: F.when(has_any(low, kv[1]), kv[0]).otherwise(rest), reversed(HEADINGS.items()), F.lit(None).cast("string"))


def context_field(content: Column) -> Column:
    return _vote(_low(content), HINTS)


def section_class(title: Column, content: Column) -> Column:
    low = F.concat(_low(title), F.lit(" "), F.lower(F.left(F.coalesce(content, F.lit("")), F.lit(200))))
    return F.when(has_any(low, GOLD), "gold").when(has_any(low, JUNK), "junk").otherwise("neutral")


def section_text(title: Column, content: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("\n\n## "), title, F.lit("\n"), content)).otherwise(F.concat(F.lit("\n\n"), content))


def important_table(title: Column, content: Column) -> Column:
    return has_any(_low(content), IMPORTANT) | has_any(_low(title), IMPORTANT)


def _table_lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(_low(content), "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("|")))


def _cells(line: Column) -> Column:
    return once(F.split(line, r"\|"), lambda parts: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.trim(x)))


def table_type(content: Column) -> Column:
    def judged(t: Column) -> Column:
        header, low = t["header"], t["low"]
        return (
            F.when(t["n"] < 2, "unknown")
            .when(t["top"].rlike(QA_ROWS) | has_any(header, ["question", "answer", "q&a", "q/a"]), "qa")
            .when((hits(header, LINE_ITEMS) >= 2) | has_any(header, ["line item", "line-item"]), "line_items")
            .when(has_any(header, TECHNICAL), "technical_specs")
            .when(has_any(header, QUALITY) | (F.contains(low, F.lit("defect description")) & F.contains(low, F.lit("allowable"))), "quality")
            .when(has_any(header, PRICING), "pricing")
            .otherwise("unknown")
        )

    # the lines, then the header, are worked out once for all the words that are looked for in them
    def parts(lines: Column) -> Column:
        header = F.array_join(_cells(F.get(lines, F.lit(0))), " ")
        return F.struct(F.size(lines).alias("n"), header.alias("header"), F.array_join(F.slice(lines, 1, 5), "\n").alias("top"), _low(content).alias("low"))

    return once(once(_table_lines(content), parts), judged)


def table_priority(kind: Column) -> Column:
    return reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), TABLE_PRIORITY.items(), F.lit(99))


def table_summary(number: Column, title: Column, source: Column, content: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.greatest(F.lit(0), F.size(F.filter(lines, lambda x: x.startswith("|"))) - 2)
    header = F.coalesce(F.get(F.filter(lines, lambda x: F.contains(x, F.lit("|"))), F.lit(0)), F.lit(""))
    return F.concat(F.lit("Table "), number.cast("string"), F.lit(" ["), title, F.lit("] from "), source, F.lit(": "), rows.cast("string"), F.lit(" data rows, columns: "), F.left(header, F.lit(100)))


def markdown_table(rows: Column) -> Column:
    """A grid of cells as a Markdown table; bars in cells are escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), body), "\n")).otherwise("")


def document_number(name: Column) -> Column:
    return first_match(_low(name), [r"addendum\s*#(\d+)", r"amendment\s*no\.?\s*(\d+)", r"addenda\s*#(\d+)"]).cast("int")


def type_by_content(text: Column) -> Column:
    low, has = _low(text), lambda *w: has_any(_low(text), list(w))
    return (
        F.when(low == "", F.lit(None).cast("string"))
        .when(has("amendment no") & has("requirement", "specification", "shall meet", "general requirments"), "tech_amendment")
        .when(has("addendum no") & has("notice to all"), "addendum")
        .when(has("addendum no", "amendment no", "addenda"), "addendum")
        .when(has("request for proposal", "request for quotation", "rfp", "rfq", "rfb", "solicitation"), "core_rfp")
        .when(has("appendix") & has("table", "schedule"), "appendix")
        .when(has("technical specification", "attachment", "schedule a", "schedule b"), "tech_spec")
        .when(has("terms and conditions", "general conditions", "contract agreement"), "legal")
    )


def type_by_name(name: Column) -> Column:
    has = lambda *w: has_any(_low(name), list(w))
    return (
        F.when(has("amendment") & has("pr-", "spec", "requirement", "technical"), "tech_amendment")
        .when(has("amendment", "addendum", "addenda"), "addendum")
        .when(has("solicitation", "rfp", "rfq", "rfb", "sow", "scope", "bid document", "request for"), "core_rfp")
        .when(has("appendix", "schedule", "table"), "appendix")
        .when(has("presentation", "briefing", "info session"), "presentation")
        .when(has("spec", "technical", "boq", "schedule", "attachment"), "tech_spec")
        .when(has("terms", "agreement", "contract", "legal"), "legal")
        .otherwise("other")
    )


def document_type(name: Column, sample: Column) -> Column:
    """By what the document begins with, else by its name."""
    return F.coalesce(type_by_content(sample), type_by_name(name))


def document_priority(kind: Column, number: Column, size: Column) -> Column:
    points = reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), DOCUMENT_POINTS.items(), F.lit(100))
    return points + F.coalesce(number, F.lit(0)) * 10 + F.least(size / 1_000_000 * 50, F.lit(200.0))


def project_type(text: Column, sectors: dict[str, list[str]] | None = None) -> Column:
    low = _low(text)
    named = reduce(lambda rest, kv: F.when(has_any(low, kv[1]), F.lit(kv[0].title() + " project")).otherwise(rest), reversed((sectors or SECTORS).items()), F.left(F.substring_index(text, ".", 1), F.lit(120)))
    return F.when(low == "", "Unknown Project").otherwise(named)


def sector(text: Column, sectors: dict[str, list[str]] | None = None) -> Column:
    return F.coalesce(_vote(_low(text), sectors or SECTORS), F.lit("general"))


def keywords_in(low: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]))


def volumes(text: Column) -> Column:
    """Quantities with their units, by pattern, then by place."""
    t = F.coalesce(text, F.lit(""))

    def one(p: str) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(1)).alias("q"), F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(2)).alias("u"))
        return F.transform(pairs, lambda x: F.struct(F.replace(x["q"], F.lit(","), F.lit("")).try_cast("double").alias("quantity"), x["u"].alias("unit")))

    return F.filter(F.concat(*[one(p) for p in VOLUMES]), lambda x: x["quantity"].isNotNull())


def min_years(text: Column) -> Column:
    return first_match(text, ["(?i)" + p for p in EXPERIENCE]).cast("int")


def project_experience(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)experience in ([^.;]+)"), F.lit(1)), lambda x: F.trim(x))


def requirements(text: Column) -> Column:
    """Licences, certificates, statuses, places and packaging that a text asks for."""
    low = _low(text)
    return F.struct(
        min_years(text).alias("min_years"), project_experience(text).alias("project_types"), keywords_in(low, LICENCES).alias("licences"),
        keywords_in(low, CERTIFICATES).alias("certificates"), keywords_in(low, SPECIAL).alias("special_status"),
        F.array_compact(F.array(F.when(has_any(low, ["canadian"]), "Canada"), F.when(has_any(low, ["trade agreement"]), "trade-agreement partners"))).alias("jurisdictions"),
        F.when(has_any(low, ["small business"]), "SMALL_ONLY").alias("business_size"),
        F.array_compact(F.array(F.when(has_any(low, ["pallet"]), "special pallet requirements"), F.when(has_any(low, ["styrofoam", "biodegradable"]), "eco packaging"))).alias("packaging"),
        first_match(text, LEAD_DAYS).cast("int").alias("lead_days"),
    )


def _numbered(text: Column, patterns: list[str]) -> Column:
    """The first match of a pattern if it holds a digit, else that of the next pattern."""
    found = [F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + p, 1) for p in patterns]
    return F.coalesce(*[F.when(f.rlike(r"\d"), F.trim(f)) for f in found])


def identifiers(text: Column) -> Column:
    """Solicitation and reference numbers, and the numbers of the notice's kinds."""
    return F.struct(
        _numbered(text, SOLICITATION).alias("solicitation"), _numbered(text, REFERENCE).alias("reference"), first_match(text, RFB).alias("rfb"),
        first_match(text, TENDER_NUMBER).alias("tender"), first_match(text, RFX).alias("rfx"),
    )


def buyer_contact(text: Column) -> Column:
    return F.struct(first_match(text, BUYER_EMAIL).alias("email"), first_match(text, BUYER_PERSON).alias("name"), first_match(text, BUYER_PHONE).alias("phone"))


def mandatory_flags(text: Column) -> Column:
    low = _low(text)
    has = lambda *w: has_any(low, list(w))
    bids = F.transform(F.regexp_extract_all(low, F.lit(MAX_BIDS), F.lit(1)), lambda n: n.cast("int"))
    return F.struct(
        has("form of offer", "form 1").alias("form_of_offer"), (has("jurisdiction") & has("attestation")).alias("jurisdiction_attestation"),
        has("manufacturer letter", "letter from manufacturer").alias("manufacturer_letter"), has("saami").alias("saami_compliance"),
        has("mds", "material data sheet", "material safety data sheet", "msds").alias("mds_required"),
        (has("specification") & has("upload", "submit")).alias("specs_upload"), F.array_max(bids).alias("max_bids"),
    )


def evaluation(text: Column) -> Column:
    """Stages that are named, weights of technique and price if both are given, days for samples."""
    low = _low(text)
    stages = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(n).alias("number"), F.initcap(F.trim(F.replace(F.regexp_extract(low, p, 0), F.lit("\n"), F.lit(" ")))).alias("name"), F.lit(f).alias("pass_fail"))) for n, p, f in STAGES]))
    technical, price = (first_match(low, [w + r"[:\s]*(\d+)\s*%"]).cast("double") / 100 for w in ("technical", "price"))
    both = technical.isNotNull() & price.isNotNull()
    days = first_match(low, SAMPLE_DAYS)
    return F.struct(stages.alias("stages"), F.when(both, technical).alias("technical"), F.when(both, price).alias("price"), days.cast("int").alias("sample_days"))


def contract_terms(text: Column) -> Column:
    low = _low(text)
    has = lambda *w: has_any(low, list(w))
    term = F.when(low.rlike(TERM_AND_EXTENSION), first_match(low, [TERM_AND_EXTENSION])).otherwise(first_match(low, TERM))
    extension = F.coalesce(first_match(low, [TERM_AND_EXTENSION], 2), first_match(low, EXTENSION))
    return F.struct(
        first_match(text, START_DATE).alias("start_date"), term.cast("int").alias("term_years"),
        extension.cast("int").alias("extension_years"), first_match(low, IRREVOCABLE).cast("int").alias("irrevocable_days"),
        has("insurance").alias("insurance"), has("clearance").alias("clearance"), has("wsia", "workplace safety").alias("wsia"), has("tax compliance").alias("tax_compliance"),
    )


def naics_codes(text: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + p), F.lit(1)) for p in NAICS]))


def scope_title(scope: Column) -> Column:
    """The first line that holds anything, 200 characters at most."""
    line = F.get(F.filter(F.transform(F.split(scope, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return F.when(F.length(line) > 200, F.concat(F.left(line, F.lit(197)), F.lit("..."))).otherwise(line)


def buyer_name(text: Column) -> Column:
    tidy = [F.regexp_replace(F.trim(F.regexp_extract(F.left(text, F.lit(2000)), p, 1)), r"\s+", " ") for p in BUYER_NAME]
    return F.coalesce(*[F.when((F.length(t) > 3) & (F.length(t) < 100), t) for t in tidy])


def deadline(text: Column) -> Column:
    start = F.left(text, F.lit(1000))
    date = first_match(start, DEADLINE)
    pattern = r"([A-Za-z]+)\s+(\d{1,2})[a-z]{0,2},?\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(date, pattern, 1)))
    iso = F.concat_ws("-", F.regexp_extract(date, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(date, pattern, 2), 2, "0"))
    return F.when(month > 0, iso).otherwise(F.trim(date))


def place(text: Column) -> Column:
    """Where the work is: a whole country, several countries, several places, or a city with its state."""
    low, t = _low(text), F.coalesce(text, F.lit(""))

    def found(city: Column, state: Column, country: str) -> Column:
        return F.struct(city.alias("city"), state.alias("state_province"), F.lit(country).alias("country"))

    def pair(p: str, check: bool) -> Column:
        city, state = F.regexp_extract(t, "(?i)" + p, 1), F.regexp_extract(t, "(?i)" + p, 2)
        short = reduce(lambda rest, kv: F.when(state == kv[0], kv[1]).otherwise(rest), STATES.items(), state)
        good = (city != "") & (~F.lower(city).isin(NO_CITIES) if check else F.lit(True))
        return F.when(good, found(F.trim(city), F.trim(short), "United States"))

    wide = [F.when(has_any(low, words), found(F.lit(city), F.lit(None).cast("string"), country)) for city, country, words in WIDE_PLACES]
    return F.coalesce(*wide, *[pair(p, check) for p, check in CITY_STATE])


def is_header_footer(line: Column) -> Column:
    """Lines that a page repeats: page numbers, dates alone, copyright."""
    low = F.lower(F.trim(line))
    return low.rlike(r"^(page\s+)?\d+(\s+(of|/)\s+\d+)?$") | low.rlike(r"^(©|copyright\b|confidential\b)")


def is_heading_line(line: Column) -> Column:
    """Short lines that are numbered or in capitals and do not end a sentence."""
    t = F.trim(line)
    return (F.length(t).between(3, 120)) & (t.rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]") | (t.rlike("[A-Z]") & (t == F.upper(t)))) & ~t.rlike(r"[.;,]$")


def context(parts: Column, each: int = 1000, most: int = 3500) -> Column:
    """Texts cut to a length each, joined, cut to a length in all."""
    return F.left(F.array_join(F.transform(parts, lambda p: F.left(p, F.lit(each))), "\n\n"), F.lit(most))
