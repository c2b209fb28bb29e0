"""Word lists, patterns and codes that results depend on."""

STATES = ("ambiguous", "available", "blocked", "failed", "not_applicable", "not_available")

SOURCE_CLASSES = (
    "official_registry",
    "official_accounts",
    "official_registry_roles",
    "official_registry_locations",
    "verified_company_website",
    "verified_social_page",
    "legal_news_report",
    "legal_filing_report",
)
JSON_SOURCE_CLASSES = SOURCE_CLASSES[:4]

# registry field -> key in the registry record
REGISTRY_FIELDS = {
    "legal_name": "navn",
    "legal_form": "organisasjonsform",
    "registered_address": "forretningsadresse",
    "industry": "naeringskode1",
    "registered_at": "registreringsdatoEnhetsregisteret",
    "business_activity": "aktivitet",
    "bankrupt": "konkurs",
    "in_liquidation": "underAvvikling",
}
EMPLOYEE_FIELD = ("registered_employees", "antallAnsatte", "harRegistrertAntallAnsatte")
EMPLOYEE_DATE_KEY = "registreringsdatoAntallAnsatteEnhetsregisteret"
LATER_STAGE_FIELDS = (
    "website_identity",
    "company_description",
    "social_pages",
    "leadership",
    "locations",
    "financials",
    "jobs",
    "news",
    "legal_cases",
)
REFRESHABLE_FIELDS = LATER_STAGE_FIELDS + ("company_page",)

# metric -> path inside an annual account record
ACCOUNT_METRICS = {
    "revenue": "resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter",
    "sales_revenue": "resultatregnskapResultat.driftsresultat.driftsinntekter.salgsinntekter",
    "operating_result": "resultatregnskapResultat.driftsresultat.driftsresultat",
    "annual_result": "resultatregnskapResultat.aarsresultat",
    "total_assets": "eiendeler.sumEiendeler",
    "total_equity": "egenkapitalGjeld.egenkapital.sumEgenkapital",
    "total_liabilities": "egenkapitalGjeld.gjeldOversikt.sumGjeld",
}
ACCOUNT_TYPES = ("SELSKAP", "KONSERN")

KEY_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)

SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com", "youtube.com")
NEWS_INDEXES = ("news", "nyheter", "blog", "blogg", "aktuelt", "press", "pressemeldinger")
JOB_INDEXES = ("jobs", "careers", "karriere", "jobb", "stillinger", "ledige-stillinger")
LINK_WORDS = (
    "nyheter", "news", "blogg", "blog", "aktuelt", "press", "karriere", "careers", "jobs",
    "kontakt", "contact", "om-oss", "about",
)
UTILITY_TAILS = (
    "about", "om-oss", "contact", "kontakt", "privacy", "personvern", "terms", "vilkar", "search", "sok",
)
ASSET_PATTERN = r"\.(?:css|js|jpe?g|png|gif|svg|webp|ico|pdf|zip)$"
SEARCH_QUERY_PATTERN = r"(?:^|&)(?:q|search|query)=[^&]+"
HOST_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
PRIVATE_SUFFIXES = (".local", ".localhost", ".internal", ".invalid")

LABELLED_NUMBER = (
    r"(?iU)\b(?:organisasjonsnummer|organisasjonsnr|org\.?\s*(?:nr|nummer)\.?)\s*[:.]?\s*"
    r"(\d{3}[ .]?\d{3}[ .]?\d{3})(?!\d)"
)
GROUP_HEADING = r"\b(?:group|holding|konsern|konsernet)\b"
GROUP_PHRASE = r"(?iU)\b(?:group website|our subsidiaries|group companies|våre selskaper|konsernets nettside)\b"
LEGAL_TERM = (
    r"(?iU)\b(?:lawsuit|litigation|sued|court proceedings|court case|legal proceedings|søksmål|rettssak|saksnummer)\b"
)
CASE_REFERENCE = r"(?iU)\b(?:case\s+(?:no\.?|number)|saksnummer)\s*[:#]?\s*([A-Z0-9][A-Z0-9./-]{2,79})"

OWNER_TYPES = ("Organization", "Corporation", "LocalBusiness")
JOB_TYPES = ("JobPosting", "https://schema.org/JobPosting", "http://schema.org/JobPosting")
NEWS_TYPES = ("NewsArticle", "https://schema.org/NewsArticle", "http://schema.org/NewsArticle")
ARTICLE_TYPES = ("NewsArticle", "Article", "https://schema.org/NewsArticle", "https://schema.org/Article")
DATED_TYPES = ARTICLE_TYPES + ("Report",)

LEGAL_FORM_WORDS = ("as", "asa", "da", "sa", "nuf", "ba")
LEGAL_KINDS = {"news": "legal_news_report", "filing": "legal_filing_report"}
STATE_PRIORITY = ("available", "failed", "blocked", "ambiguous", "not_available")

JSON_BODY_LIMIT = 2_000_000
HTML_BODY_LIMIT = 1_000_000
QUERY_PRICE = 0.005
REQUESTS_PER_INPUT = 20

# HTML character references decoded natively; '&amp;' comes last. Any other one goes to Python.
CHARACTER_REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "bull": "•", "euro": "€", "aring": "å", "Aring": "Å", "oslash": "ø", "Oslash": "Ø", "aelig": "æ", "AElig": "Æ", "amp": "&",
}
