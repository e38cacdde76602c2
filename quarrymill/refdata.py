"""Fixed reference values: small dimensions and word lists that results depend on."""

from __future__ import annotations

# US states and Canadian provinces with their neighbours.
US_NEIGHBOURS = {
    "AL": ["FL", "GA", "MS", "TN"],
    "AK": [],
    "AZ": ["CA", "NV", "NM", "UT"],
    "AR": ["LA", "MO", "MS", "OK", "TN", "TX"],
    "CA": ["AZ", "NV", "OR"],
    "CO": ["KS", "NE", "NM", "OK", "UT", "WY"],
    "CT": ["MA", "NY", "RI"],
    "DE": ["MD", "NJ", "PA"],
    "FL": ["AL", "GA"],
    "GA": ["AL", "FL", "NC", "SC", "TN"],
    "HI": [],
    "ID": ["MT", "NV", "OR", "UT", "WA", "WY"],
    "IL": ["IN", "IA", "KY", "MO", "WI"],
    "IN": ["IL", "KY", "MI", "OH"],
    "IA": ["IL", "MN", "MO", "NE", "SD", "WI"],
    "KS": ["CO", "MO", "NE", "OK"],
    "KY": ["IL", "IN", "MO", "OH", "TN", "VA", "WV"],
    "LA": ["AR", "MS", "TX"],
    "ME": ["NH"],
    "MD": ["DE", "PA", "VA", "WV"],
    "MA": ["CT", "NH", "NY", "RI", "VT"],
    "MI": ["IN", "OH", "WI"],
    "MN": ["IA", "ND", "SD", "WI"],
    "MS": ["AL", "AR", "LA", "TN"],
    "MO": ["AR", "IL", "IA", "KS", "KY", "NE", "OK", "TN"],
    "MT": ["ID", "ND", "SD", "WY"],
    "NE": ["CO", "IA", "KS", "MO", "SD", "WY"],
    "NV": ["AZ", "CA", "ID", "OR", "UT"],
    "NH": ["ME", "MA", "VT"],
    "NJ": ["DE", "NY", "PA"],
    "NM": ["AZ", "CO", "OK", "TX"],
    "NY": ["CT", "MA", "NJ", "PA", "VT"],
    "NC": ["GA", "SC", "TN", "VA"],
    "ND": ["MN", "MT", "SD"],
    "OH": ["IN", "KY", "MI", "PA", "WV"],
    "OK": ["AR", "CO", "KS", "MO", "NM", "TX"],
    "OR": ["CA", "ID", "NV", "WA"],
    "PA": ["DE", "MD", "NJ", "NY", "OH", "WV"],
    "RI": ["CT", "MA"],
    "SC": ["GA", "NC"],
    "SD": ["IA", "MN", "MT", "NE", "ND", "WY"],
    "TN": ["AL", "AR", "GA", "KY", "MS", "MO", "NC", "VA"],
    "TX": ["AR", "LA", "NM", "OK"],
    "UT": ["AZ", "CO", "ID", "NV", "WY"],
    "VT": ["MA", "NH", "NY"],
    "VA": ["KY", "MD", "NC", "TN", "WV"],
    "WA": ["ID", "OR"],
    "WV": ["KY", "MD", "OH", "PA", "VA"],
    "WI": ["IL", "IA", "MI", "MN"],
    "WY": ["CO", "ID", "MT", "NE", "SD", "UT"],
}
CANADA_NEIGHBOURS = {
    "AB": ["BC", "SK", "NT"],
    "BC": ["AB", "YT", "NT"],
    "MB": ["SK", "ON", "NU"],
    "NB": ["QC", "NS", "PE"],
    "NL": ["QC"],
    "NT": ["YT", "NU", "BC", "AB", "SK"],
    "NS": ["NB", "PE"],
    "NU": ["NT", "MB"],
    "ON": ["MB", "QC"],
    "PE": ["NB", "NS"],
    "QC": ["ON", "NB", "NL"],
    "SK": ["AB", "MB", "NT"],
    "YT": ["BC", "NT"],
}

# Names of provinces and their abbreviations.
PROVINCES = {
    "Ontario": "ON", "Quebec": "QC", "Québec": "QC", "British Columbia": "BC", "Alberta": "AB", "Manitoba": "MB", "Saskatchewan": "SK",
    "Nova Scotia": "NS", "New Brunswick": "NB", "Newfoundland and Labrador": "NL", "Prince Edward Island": "PE",
    "Northwest Territories": "NT", "Yukon": "YT", "Nunavut": "NU",
}

# Business types that a set-aside code accepts.
SET_ASIDES = {
    "SBA": ["8(a)", "Small Business"],
    "8A": ["8(a)"],
    "8AN": ["8(a) Native"],
    "WOSB": ["Women Owned Small Business", "WOSB"],
    "EDWOSB": ["Economically Disadvantaged WOSB", "EDWOSB"],
    "HZC": ["HUBZone"],
    "HUBZONE": ["HUBZone"],
    "SDVOSB": ["Service-Disabled Veteran-Owned", "SDVOSB"],
    "SDVOSBC": ["Service-Disabled Veteran-Owned", "SDVOSB"],
}

# Registry sources, past-performance sources, government sources.
REGISTRY_SOURCES = ["canada_contracts", "canada_odbus", "canada_award_notices", "canada_pspc_payments", "canada_sosa"]
SCORED_SOURCES = ["canada_contracts", "sam_entity"]
BUSINESS_REGISTRY = "canada_odbus"

# E-mail rules.
SPAM_PREFIXES = ["test@", "noreply@", "donotreply@", "no-reply@", "bounce@", "mailer@"]
SPAM_DOMAINS = ["example.com", "example.org", "test.com", "localhost", "domain.com", "email.com", "mail.com"]
TECHNICAL_PREFIXES = ["webmaster@", "abuse@", "postmaster@"]
EMAIL_PRIORITY = [("sales", 10), ("contact", 8), ("admin", 7), ("business", 7), ("inquiries", 7), ("hello", 6), ("info", 5), ("support", 3)]
GOVERNMENT_SUFFIXES = [".gov", ".gc.ca", ".gouv.qc.ca", ".canada.ca", ".mil"]
SNIPPET_BAD_DOMAINS = ["example.com", "test.com", "placeholder.com", "google.com", "facebook.com", "twitter.com", "linkedin.com", "youtube.com", "instagram.com"]
SNIPPET_BAD_PREFIXES = ["noreply@", "no-reply@", "info@example"]

# Patterns of contact details, in the order in which they are tried.
EMAIL_PATTERN = r"(?iU)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERNS = [
    r"\+1[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}",
    r"\d{3}[-.\s]\d{3}[-.\s]\d{4}",
    r"\b\d{3}\.\d{3}\.\d{4}\b",
]
NAME_PATTERNS = [
    r"(?:Contact|Manager|Director|VP|President|CEO|Sales|Business\s+Development)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
    r"([A-Z][a-z]+\s+[A-Z][a-z]+)[\s,]+(?:VP|Director|Manager|President|CEO)",
]

# Legal suffixes of company names, for deduplication in the order in which they are cut.
DEDUP_SUFFIXES = [
    r"\s+inc\.?$", r"\s+llc\.?$", r"\s+ltd\.?$", r"\s+corporation$", r"\s+corp\.?$", r"\s+limited$", r"\s+company$", r"\s+co\.?$",
    r"\s+incorporated$", r"\s+s\.?a\.?$", r"\s+gmbh$", r"\s+pty\.?\s+ltd\.?$", r"\s+l\.?l\.?c\.?$",
]

# Words that widen a search, by sector.
GENERIC_KEYWORDS = {
    "ammunition": ["ammunition", "ammo", "munitions", "ordnance", "ballistic"],
    "vehicle": ["vehicle", "automotive", "transport", "equipment"],
    "uniform": ["uniform", "apparel", "textile", "clothing"],
    "defense": ["defense", "defence", "security", "tactical", "military"],
    "technology": ["technology", "software", "hardware", "IT", "computer"],
    "construction": ["construction", "building", "infrastructure"],
    "medical": ["medical", "health", "healthcare", "pharmaceutical"],
}
FALLBACK_KEYWORDS = [
    (["ammunition", "ammo", "munitions", "tactical", "defense", "defence", "military", "weapon", "ballistic", "caliber", "ordnance"],
     ["ammunition", "ammo", "munitions", "defense", "defence", "security", "tactical", "military", "ordnance"]),
    (["vehicle", "transport", "automotive", "truck", "car"], ["vehicle", "automotive", "transport", "equipment", "truck"]),
    (["uniform", "apparel", "clothing", "textile"], ["uniform", "apparel", "textile", "clothing", "garment"]),
]

# Latitude and longitude of the centres of states, and of towns that are located more closely.
STATE_CENTRES = {
    "AL": (32.806671, -86.79113), "AK": (61.370716, -152.404419), "AZ": (33.729759, -111.431221), "AR": (34.969704, -92.373123),
    "CA": (36.116203, -119.681564), "CO": (39.059811, -105.311104), "CT": (41.597782, -72.755371), "DE": (39.318523, -75.507141),
    "FL": (27.766279, -81.686783), "GA": (33.040619, -83.643074), "HI": (21.094318, -157.498337), "ID": (44.240459, -114.478828),
    "IL": (40.349457, -88.986137), "IN": (39.849426, -86.258278), "IA": (42.011539, -93.210526), "KS": (38.5266, -96.726486),
    "KY": (37.66814, -84.670067), "LA": (31.169546, -91.867805), "ME": (44.693947, -69.381927), "MD": (39.063946, -76.802101),
    "MA": (42.230171, -71.530106), "MI": (43.326618, -84.536095), "MN": (45.694454, -93.900192), "MS": (32.741646, -89.678696),
    "MO": (38.456085, -92.288368), "MT": (46.921925, -110.454353), "NE": (41.12537, -98.268082), "NV": (38.313515, -117.055374),
    "NH": (43.452492, -71.563896), "NJ": (40.298904, -74.521011), "NM": (34.840515, -106.248482), "NY": (42.165726, -74.948051),
    "NC": (35.630066, -79.806419), "ND": (47.528912, -99.784012), "OH": (40.388783, -82.764915), "OK": (35.565342, -96.928917),
    "OR": (44.572021, -122.070938), "PA": (40.590752, -77.209755), "RI": (41.680893, -71.51178), "SC": (33.856892, -80.945007),
    "SD": (44.299782, -99.438828), "TN": (35.747845, -86.692345), "TX": (31.054487, -97.563461), "UT": (40.150032, -111.862434),
    "VT": (44.045876, -72.710686), "VA": (37.769337, -78.169968), "WA": (47.400902, -121.490494), "WV": (38.491226, -80.954456),
    "WI": (44.268543, -89.616508), "WY": (42.755966, -107.30249), "DC": (38.907192, -77.036873), "PR": (18.220833, -66.590149),
}
TOWN_PLACES = {
    ("ALBUQUERQUE", "NM"): (35.0844, -106.6504), ("LAS CRUCES", "NM"): (32.3199, -106.7637), ("HOBBS", "NM"): (32.7026, -103.136),
    ("SANTA FE", "NM"): (35.687, -105.9378), ("RIO RANCHO", "NM"): (35.2334, -106.663), ("ROSWELL", "NM"): (33.3943, -104.523),
    ("FARMINGTON", "NM"): (36.728, -108.2187), ("CLOVIS", "NM"): (34.4048, -103.2052), ("ALAMOGORDO", "NM"): (32.8995, -105.9603),
    ("CARLSBAD", "NM"): (32.4207, -104.2288), ("GALLUP", "NM"): (35.5281, -108.7426), ("LOS ALAMOS", "NM"): (35.8892, -106.3058),
    ("ARTESIA", "NM"): (32.8423, -104.4033), ("PORTALES", "NM"): (34.1862, -103.3338), ("SILVER CITY", "NM"): (32.7701, -108.2803),
}
