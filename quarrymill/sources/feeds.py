"""Readers of feeds: CSV files with their headers, JSON payloads, and the plain columns that operators use.

CSV is read with an explicit schema of strings (no inference pass); `ord` numbers the rows by file and place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import city_province, clean, external_id, iso_date, naics_list, null_token, path_parts, postal_code, split_present, date_part

# Headers of the feeds, and the plain names they get.
CONTRACTS = {
    "legal_name": "supplierLegalName-nomLegalFournisseur-eng", "standardized_name": "supplierStandardizedName-nomNormaliseFournisseur-eng",
    "address": "supplierAddressLine-ligneAdresseFournisseur-eng", "city": "supplierAddressCity-fournisseurAdresseVille-eng",
    "state": "supplierAddressProvince-fournisseurAdresseProvince-eng", "postal_code": "supplierAddressPostalCode-fournisseurAdresseCodePostal",
    "employee_count_range": "supplierEmployeeCount-fournisseurNombreEmployes-eng", "gsin": "gsin-nibs", "unspsc": "unspsc",
    "contract_number": "contractNumber-numeroContrat", "value": "totalContractValue-valeurTotaleContrat", "date": "contractAwardDate-dateAttributionContrat",
    "description": "tenderDescription-descriptionAppelOffres-eng", "category": "procurementCategory-categorieApprovisionnement",
    "contact_name": "contactInfoName-informationsContactNom", "contact_email": "contactInfoEmail-informationsContactCourriel", "contact_phone": "contactInfoPhone-contactInfoTelephone",
}
AWARDS = CONTRACTS | {
    "country": "supplierAddressCountry-fournisseurAdressePays-eng", "amount": "contractAmount-montantContrat", "end_date": "contractEndDate-dateFinContrat",
    "reference": "referenceNumber-numeroReference", "method": "procurementMethod-methodeApprovisionnement-eng", "agreements": "tradeAgreements-accordsCommerciaux-eng", "status": "awardStatus-attributionStatut-eng",
}
STANDING_OFFERS = {
    "legal_name": "supplier-legal-name", "standardized_name": "supplier-standardized-name", "operating_name": "supplier-operating-name", "commodity": "commodity",
    "agreement_number": "agreement-number", "agreement_type": "agreement-type_en", "award_date": "award-date", "expiry_date": "expiry-date",
    "delivery_point": "delivery-point_en", "end_user": "end-user-entity_en", "description": "sosa-description_en", "commodity_description": "commodity-description_en",
}
PAYMENTS = {"vendor_name": "Vendor-name_Nom-du-fournisseur", "procurement_id": "procurement-id_id-approvisionnement", "project_number": "Project-number_Numéro-de-projet", "payment_date": "Payment-date_Date-de-paiement"}
TENDERS = {
    "reference": "referenceNumber-numeroReference", "title": "title-titre-eng", "gsin": "gsin-nibs", "unspsc": "unspsc", "regions": "regionsOfDelivery-regionsLivraison-eng",
    "posted": "publicationDate-datePublication", "response_deadline": "tenderClosingDate-appelOffresDateCloture", "tender_start": "expectedContractStartDate-dateDebutContratPrevue",
    "tender_end": "expectedContractEndDate-dateFinContratPrevue", "attachments": "attachment-piecesJointes-eng", "notice_url": "noticeURL-URLavis-eng",
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under the file's own header; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    return df.withColumn("ord", F.monotonically_increasing_id())


def _col(df: DataFrame, *names: str) -> Column:
    """The first of these headers that holds something; null if the file has none of them."""
    there = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def plain(df: DataFrame, names: dict[str, str]) -> DataFrame:
    own = lambda n: F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")
    return df.select("ord", *[own(header).alias(name) for name, header in names.items()])


def contracts(spark: SparkSession, path: str) -> DataFrame:
    return plain(read_csv(spark, path), CONTRACTS)


def awards(spark: SparkSession, path: str) -> DataFrame:
    return plain(read_csv(spark, path), AWARDS)


def standing_offers(spark: SparkSession, path: str) -> DataFrame:
    out = plain(read_csv(spark, path), STANDING_OFFERS)
    out = out.select("ord", *[clean(F.col(c)).alias(c) for c in STANDING_OFFERS if not c.endswith("_date")], iso_date(F.col("award_date")).alias("award_date"), iso_date(F.col("expiry_date")).alias("expiry_date"))
    return out.where(F.coalesce("legal_name", F.lit("")) != "").withColumn("external_id", external_id("canada_sosa", F.col("legal_name")))


def payments(spark: SparkSession, path: str) -> DataFrame:
    return plain(read_csv(spark, path), PAYMENTS)


def business_registry(spark: SparkSession, path: str) -> DataFrame:
    """Businesses with a name and a city; `..` is null; up to three industry codes; the first row of an id stays."""
    from ..operators.resolve import first_by_key

    df = read_csv(spark, path)
    c = lambda n: null_token(F.col(f"`{n}`")) if n in df.columns else F.lit(None).cast("string")
    out = df.select(
        "ord", c("business_name").alias("legal_name"), c("alt_business_name").alias("dba_name"), c("city").alias("city"), c("prov_terr").alias("state"), postal_code(c("postal_code")).alias("postal_code"),
        c("full_address").alias("address"), c("business_description").alias("description"), c("total_no_employees").alias("employee_count_range"),
        naics_list(c("derived_NAICS"), c("source_NAICS_primary"), c("source_NAICS_secondary")).alias("naics_codes"), F.lit("canada_odbus").alias("source"),
    ).where("legal_name is not null and city is not null")
    out = out.withColumn("external_id", external_id("canada_odbus", F.col("legal_name"), F.col("postal_code"), F.col("city")))
    return first_by_key(out, F.col("external_id"), "ord")


def sam_export(spark: SparkSession, path: str) -> DataFrame:
    """A registrations export: alternative headers, lists cut at '~', flags as booleans."""
    df = read_csv(spark, path)
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "~"), lambda x: F.trim(x)), lambda x: x != "")
    flag = lambda c: F.coalesce(F.upper(c).isin("Y", "YES", "TRUE", "1"), F.lit(False))
    return df.select(
        "ord", _col(df, "UNIQUE ENTITY ID", "UEI").alias("uei"), _col(df, "LEGAL BUSINESS NAME").alias("legal_name"), _col(df, "DBA NAME").alias("dba_name"), _col(df, "CAGE CODE").alias("cage_code"),
        _col(df, "DUNS NUMBER").alias("duns"), _col(df, "PHYSICAL ADDRESS LINE 1").alias("address"), _col(df, "PHYSICAL ADDRESS CITY").alias("city"),
        _col(df, "PHYSICAL ADDRESS PROVINCE OR STATE", "PHYSICAL ADDRESS STATE").alias("state"), _col(df, "PHYSICAL ADDRESS ZIP/POSTAL CODE", "PHYSICAL ADDRESS ZIP").alias("postal_code"),
        _col(df, "PHYSICAL ADDRESS COUNTRY CODE", "PHYSICAL ADDRESS COUNTRY").alias("country"), listed(_col(df, "BUSINESS TYPES")).alias("business_types"), listed(_col(df, "NAICS CODES")).alias("naics_codes"),
        _col(df, "PRIMARY NAICS").alias("primary_naics"), flag(_col(df, "SMALL BUSINESS")).alias("is_small"), flag(_col(df, "WOMAN OWNED")).alias("is_woman_owned"),
        _col(df, "GOVT BUS POC EMAIL").alias("email"), _col(df, "GOVT BUS POC PHONE", "GOVT BUS POC US PHONE").alias("phone"), F.lit("sam_csv").alias("source"),
    ).where("uei is not null and legal_name is not null")


def importers(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    out = df.select("ord", _col(df, "Importer Name", "Name").alias("name"), _col(df, "City").alias("city"), _col(df, "Province").alias("province"), _col(df, "Postal Code").alias("postal_code"), _col(df, "HS Code").alias("hs_code"), _col(df, "HS Description").alias("hs_description"))
    return out.withColumn("external_id", external_id("cid", F.col("name"), city=F.col("city")))


def capabilities(spark: SparkSession, path: str) -> DataFrame:
    """A capability list as CSV or as a JSON list, told apart by the suffix; codes stand before a '-'."""
    if path.endswith(".json"):
        df = spark.read.option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())
    else:
        df = read_csv(spark, path)
    is_list = "NAICS" in df.columns and df.schema["NAICS"].dataType.simpleString().startswith("array")
    codes = F.col("NAICS") if is_list else F.split(F.coalesce(_col(df, "NAICS"), F.lit("")), ",")
    out = df.select(
        "ord", _col(df, "Company Name", "Name", "legal_name").alias("legal_name"), _col(df, "City").alias("city"), _col(df, "Province").alias("state"), _col(df, "Website").alias("website"), _col(df, "Description").alias("description"),
        _col(df, "Export Markets").alias("export_markets"), F.filter(F.transform(codes, lambda c: F.trim(F.substring_index(c.cast("string"), "-", 1))), lambda c: c != "").alias("naics_codes"), F.lit("ccc").alias("source"),
    )
    return out.where("legal_name is not null").withColumn("external_id", external_id("ccc", F.col("legal_name"), city=F.col("city")))


def open_tenders(spark: SparkSession, path: str) -> DataFrame:
    """Tender metadata: dates cut to days, lists cut at the separator that is there, the place, the attachments."""
    df = plain(read_csv(spark, path), TENDERS)
    day = lambda n: F.nullif(F.left(F.trim(F.col(n)), F.lit(10)), F.lit(""))
    urls = F.concat(split_present(F.col("attachments")), F.array_compact(F.array(F.nullif(F.trim("notice_url"), F.lit("")))))
    return df.select(
        "ord", clean(F.col("reference")).alias("external_id"), clean(F.col("title")).alias("title"), split_present(F.col("gsin")).alias("gsin"), split_present(F.col("unspsc")).alias("unspsc"),
        city_province(F.col("regions")).alias("place"), *[day(d).alias(d) for d in ("posted", "response_deadline", "tender_start", "tender_end")],
        F.array_distinct(F.filter(urls, lambda u: u.startswith("http://") | u.startswith("https://"))).alias("attachments"), F.lit("Canada").alias("country"),
    )


def tender_by_reference(tenders: DataFrame, reference: str) -> DataFrame:
    return tenders.where(F.col("external_id") == reference).orderBy("ord").limit(1)


# JSON payloads: captured answers of services, one file or many


def sam_opportunities(payload: DataFrame) -> DataFrame:
    """Tender metadata of `opportunitiesData`: organisation path, place, set-aside, value, awards."""
    o = payload.select(F.explode("opportunitiesData").alias("o"))
    return o.select(
        F.col("o.solicitationNumber").alias("external_id"), "o.title", "o.description", F.array_compact(F.array("o.naicsCode")).alias("naics"), F.col("o.classificationCode").alias("classification"),
        path_parts(F.coalesce("o.fullParentPathName", "o.organizationName")).alias("buyer_path"), date_part(F.col("o.postedDate")).alias("posted"), date_part(F.col("o.responseDeadLine")).alias("response_deadline"),
        F.col("o.setAsideCode").alias("set_aside"), F.col("o.setAside").alias("set_aside_description"), F.col("o.baseAndAllOptionsValue").cast("double").alias("estimated_value"),
        F.coalesce("o.resourceLinks", F.array().cast("array<string>")).alias("attachments"), F.lit("United States").alias("country"),
    )


def ckan_records(payload: DataFrame) -> DataFrame:
    """Tender metadata of `result.records`; every field whose name ends in _url or _link is an attachment."""
    r = payload.select(F.explode("result.records").alias("r")).select("r.*")
    own = lambda n: F.col(n).cast("string") if n in r.columns else F.lit(None).cast("string")
    comma = (",", ";", "|")
    links = F.filter(F.array(*[F.col(c) for c in r.columns if c.endswith(("_url", "_link"))]).cast("array<string>"), lambda u: u.startswith("http"))
    return r.select(
        own("reference_number").alias("external_id"), own("title_en").alias("title"), split_present(own("naics_code"), comma).alias("naics"), split_present(own("gsin_code"), comma).alias("gsin"),
        F.coalesce(own("delivery_city"), own("city")).alias("city"), own("province_state").alias("state_province"), split_present(own("trade_agreement"), comma).alias("trade_agreements"),
        F.left(own("publication_date"), F.lit(10)).alias("posted"), F.left(own("closing_date"), F.lit(10)).alias("response_deadline"), links.alias("attachments"), F.lit("Canada").alias("country"),
    )


def sam_entities(
    payload: DataFrame, state: str | None = None, limit: int | None = None, naics: list[str] = (), project: tuple[float, float] | None = None,
) -> DataFrame:
    """Vendor rows of `entityData`: flags from business types, the first point of contact that is there. naics: entities whose codes begin with one
    of these. project: latitude and longitude that distances are measured from. A limit keeps the nearest, without a project the first by uei and name."""
    e = payload.select(F.explode("entityData").alias("e"))
    types = F.transform(F.coalesce("e.coreData.businessTypes.businessTypeList", F.array()), lambda t: t["businessTypeDesc"])
    poc = F.coalesce(*[F.col(f"e.entityRegistration.pointsOfContact.{p}") for p in ("governmentBusinessPOC", "electronicBusinessPOC", "pastPerformancePOC")])
    has = lambda word: F.exists(types, lambda t: F.contains(F.lower(t), F.lit(word)))
    out = e.select(
        F.col("e.entityRegistration.ueiSAM").alias("uei"), F.col("e.entityRegistration.cageCode").alias("cage_code"), F.col("e.entityRegistration.legalBusinessName").alias("company_name"),
        F.col("e.coreData.physicalAddress.city").alias("city"), F.col("e.coreData.physicalAddress.stateOrProvinceCode").alias("state"), F.col("e.coreData.entityInformation.entityURL").alias("website"),
        types.alias("business_types"), has("small business").alias("is_small"), has("woman").alias("is_woman_owned"), has("veteran").alias("is_veteran_owned"), has("hubzone").alias("is_hubzone"),
        F.nullif(F.trim(F.concat_ws(" ", poc["firstName"], poc["lastName"])), F.lit("")).alias("contact_name"), poc["email"].alias("email"), F.lit("sam_entity").alias("source"), _codes_of(payload).alias("naics_codes"),
    )
    out = out.where(F.upper("state") == state.upper()) if state else out
    if naics:
        out = out.where(F.exists("naics_codes", lambda c: reduce(lambda a, b: a | b, [c.startswith(n) for n in naics])))
    if project:
        from ..operators.nearest import by_distance

        out = out.withColumn("_key", F.struct("uei", "company_name"))
        out = by_distance(out, *project, key="_key").drop("_key")
        return out.limit(limit) if limit else out
    return out.orderBy("uei", "company_name").limit(limit) if limit else out


def _codes_of(payload: DataFrame) -> Column:
    """Industry codes of an entity; an empty list where the payload has none."""
    path = ["assertions", "goodsAndServices", "naicsList"]
    kind = payload.schema["entityData"].dataType.elementType
    for name in path:
        if not hasattr(kind, "names") or name not in kind.names:
            return F.array().cast("array<string>")
        kind = kind[name].dataType
    return F.transform(F.coalesce("e." + ".".join(path), F.array()), lambda c: c["naicsCode"].cast("string"))




def small_business_companies(payload: DataFrame, certification: str | None = None, naics: list[str] = (), state: str | None = None, cap: int = 100) -> DataFrame:
    """Vendor rows of `results`: certificates as flags; by certificate or by the first three codes, and by state."""
    r = payload.select(F.explode("results").alias("r"))
    names = F.transform(F.concat(F.coalesce("r.certifications", F.array()), F.coalesce("r.self_certifications", F.array())), lambda c: F.lower(c["certification_name"]))
    has = lambda *w: F.exists(names, lambda n: reduce(lambda a, b: a | b, [F.contains(n, F.lit(x)) for x in w]))
    out = r.select(
        "r.uei", "r.cage_code", F.col("r.businessName").alias("company_name"), F.col("r.url").alias("website"), F.col("r.sam_address_city").alias("city"), F.col("r.sam_address_state").alias("state"), "r.email", "r.phone",
        "r.naics_codes", names.alias("certifications"), has("wosb", "women-owned").alias("is_wosb"), has("edwosb", "economically disadvantaged").alias("is_edwosb"), has("hubzone").alias("is_hubzone"),
        has("8(a)").alias("is_8a"), has("vosb", "veteran").alias("is_vosb"), has("sdvosb", "service-disabled").alias("is_sdvosb"), F.lit("sba_dsbs").alias("source"),
    )
    if certification:
        out = out.where(F.exists("certifications", lambda n: F.contains(n, F.lit(certification.lower()))))
    elif naics:
        out = out.where(F.arrays_overlap("naics_codes", F.array(*[F.lit(n) for n in naics[:3]])))
    out = out.where(F.upper("state") == state.upper()) if state else out
    return out.limit(cap)


def company_by_uei(companies: DataFrame, uei: str) -> DataFrame:
    return companies.where(F.upper("uei") == uei.upper()).limit(1)


def search_results(captured: DataFrame) -> DataFrame:
    """Rows of captured answers (query, level, organic): one per result, with its domain and place."""
    from ..functions.names import domain

    r = captured.select("query", "level", F.posexplode("organic").alias("position", "r"))
    return r.select("query", "level", (F.col("position") + 1).alias("position"), "r.title", F.col("r.link").alias("url"), "r.snippet", domain(F.col("r.link")).alias("domain"))


def places(captured: DataFrame) -> DataFrame:
    """Rows of captured place answers."""
    return captured.select("query", "level", F.posexplode("places").alias("position", "p")).select("query", "level", "position", "p.title", "p.address", F.col("p.phoneNumber").alias("phone"), "p.website", F.col("p.cid").cast("string").alias("cid"))


def organisations(captured: DataFrame) -> DataFrame:
    """Contacts of captured organisation answers (vendor key, organization)."""
    o = F.col("organization")
    return captured.select("vendor_key", o["primary_email"].alias("email"), F.get(F.transform(o["phone_numbers"], lambda p: p["phone"]), F.lit(0)).alias("phone"), F.get(o["contacts"], F.lit(0))["name"].alias("contact_name"), o["website_url"].alias("website"))


def demo_vendors(spark: SparkSession, n: int = 5) -> DataFrame:
    """A few fixed rows to try the pipeline on."""
    i = F.col("id").cast("string")
    return spark.range(1, n + 1).select(F.col("id").alias("ord"), F.concat(F.lit("Sample Vendor "), i).alias("company_name"), F.concat(F.lit("https://vendor"), i, F.lit(".example.com")).alias("website"), F.lit("static_directory").alias("source"))


# Which sources fit a tender, and all that fit in one table


def fits(source: str, country: str | None, naics: list[str] = (), gsin: list[str] = (), unspsc: list[str] = (), province: str | None = None) -> bool:
    if source in ("sam_entity", "sba_dsbs"):
        return bool(naics) and country != "Canada"
    if source == "canada_contracts":
        return country != "USA" and (country == "Canada" or bool(gsin or unspsc or province))
    return True


def discover(found: dict[str, DataFrame]) -> DataFrame:
    """All sources in the order of registration: source_rank, then the source's own order."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(found.values())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


READERS = {
    "canada_contracts": contracts, "canada_award_notices": awards, "canada_sosa": standing_offers, "canada_pspc_payments": payments, "canada_odbus": business_registry,
    "sam_csv": sam_export, "cid": importers, "ccc": capabilities, "open_tenders": open_tenders,
}


def route(spark: SparkSession, source: str, path: str | None) -> DataFrame:
    """The reader of a source; an unknown source or a missing path is an error."""
    if source not in READERS:
        raise ValueError(f"no reader for {source}; there are {sorted(READERS)}")
    if not path:
        raise ValueError(f"{source} needs a path")
    return READERS[source](spark, path)
