"""Typed claims from account, role, sub-unit and page documents.

Page extractors read rows that went through page_features, schema_nodes and prove:
organisation_number, legal_name, page_url, retrieved_at, evidence_id, is_root plus
the parsed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.functions import fixed, urls
from vouchlake.functions.canon import collapse, computed, contains_name, digest, json_text, normal_name, slice_text, utc_date
from .gates import consensus_date, is_active, mention
from .identity import _key_json, _span, _text_at, identity_proof, label_spans, names_entity
from .pages import visible_text
from .registry_facts import node_json, unquoted
from .rollups import drop_conflicts
from .walk import explode_nodes, find_objects, has_type
from .windows import keep_first

CLAIM_COLUMNS = (
    "organisation_number", "claim_id", "field", "subject", "value_json", "evidence_id", "json_pointer", "json_ld_block",
    "text_span", "reporting_period", "effective_date", "extraction_method",
)


def as_claims(df: DataFrame, **columns) -> DataFrame:
    """Rows in the claim layout; columns not given are NULL."""
    types = {"json_ld_block": "int", "text_span": "struct<start:int,end:int>"}
    out = []
    for name in CLAIM_COLUMNS:
        value = columns.get(name, F.col(name) if name in ("organisation_number", "evidence_id") else F.lit(None).cast(types.get(name, "string")))
        out.append((F.lit(value) if isinstance(value, str) else value).alias(name))
    return df.select(*out)


# ---- JSON documents -------------------------------------------------------------------


def _texts(nodes: DataFrame, paths) -> tuple[DataFrame, dict[str, Column]]:
    """The JSON text at each path of ``node``, read once per row instead of once per use."""
    nodes = computed(nodes, _texts=F.array(*[node_json(F.col("node"), f"$.{p}") for p in paths])).drop("node")
    return nodes, {p: F.element_at("_texts", i) for i, p in enumerate(paths, 1)}


def account_statements(responses: DataFrame, body: str = "body") -> DataFrame:
    """Account records under any wrapper, usable ones only, conflicts removed."""
    nodes = find_objects(responses, body, ["organisation_number", "evidence_id"], {"regnskapsperiode": "{", "virksomhet": "{"}, stop=True)
    names = ["regnskapsperiode.fraDato", "regnskapsperiode.tilDato", "virksomhet.organisasjonsnummer", "regnskapstype", "valuta"]
    nodes, text = _texts(nodes, [*names, *fixed.ACCOUNT_METRICS.values()])
    at = lambda path: unquoted(text[path])
    rows = computed(
        nodes,
        period_start=at("regnskapsperiode.fraDato"), period_end=at("regnskapsperiode.tilDato"), owner=at("virksomhet.organisasjonsnummer"),
        report_type=at("regnskapstype"), raw_currency=at("valuta"),
    )
    iso = r"\A\d{4}-\d{2}-\d{2}\z"
    start, end = F.col("period_start"), F.col("period_end")
    rows = rows.filter(
        start.rlike(iso) & end.rlike(iso) & (start.try_cast("date") <= end.try_cast("date")) & F.col("owner").isNotNull()
        & F.col("report_type").isin(*fixed.ACCOUNT_TYPES) & (F.trim("raw_currency") != "") & (F.length("raw_currency") <= 10)
    )
    amount = lambda path: F.when(text[path].rlike(r"\A-?[0-9]"), text[path])
    metrics = F.filter(
        F.array(*[F.struct(F.lit(m).alias("metric"), amount(p).alias("amount_json"), F.lit("/" + p.replace(".", "/")).alias("tail")) for m, p in fixed.ACCOUNT_METRICS.items()]),
        lambda m: m["amount_json"].isNotNull(),
    )
    rows = computed(rows, currency=F.trim("raw_currency"), metrics=metrics).filter(F.size("metrics") > 0)
    print_of = F.sha2(F.to_json(F.struct("period_start", "currency", F.transform("metrics", lambda m: F.struct(m["metric"], m["amount_json"])).alias("m"))), 256)
    rows = computed(rows, _print=print_of)
    keys = ["organisation_number", "evidence_id", "owner", "report_type", "period_end"]
    kept = drop_conflicts(rows.drop("_texts"), keys, "_print", ["ord"], last=True)
    return kept.drop("_print", "raw_currency")


def extract_financials(responses: DataFrame, body: str = "body") -> DataFrame:
    """One claim per reported metric with the exact pointer of its amount."""
    st = account_statements(responses, body).filter(F.col("owner") == F.col("organisation_number"))
    m = st.select("*", F.inline("metrics")).drop("metrics")
    quoted = lambda c: json_text(c)
    value = F.concat(
        F.lit('{"amount":'), "amount_json", F.lit(',"currency":'), quoted("currency"), F.lit(',"metric":"'), "metric", F.lit('","organisation_number":"'), "owner",
        F.lit('","period_end":"'), "period_end", F.lit('","period_start":"'), "period_start", F.lit('","report_type":"'), "report_type", F.lit('"}'),
    )
    subject = F.concat_ws(":", F.lit("financials"), "report_type", "period_end", "metric")
    m = computed(m, value_json=value, subject=subject)
    return as_claims(
        m, claim_id=digest("organisation_number", "subject", "value_json"), field="financials", subject=F.col("subject"), value_json=F.col("value_json"),
        json_pointer=F.concat("pointer", "tail"), reporting_period=F.concat_ws("/", "period_start", "period_end"),
        effective_date=F.col("period_end"), extraction_method="official_accounts_v2",
    )


def extract_financials_v1(responses: DataFrame, body: str = "body") -> DataFrame:
    """Revenue only, last record per end date and type, kept so that old evidence stays checkable."""
    nodes = find_objects(responses, body, ["organisation_number", "evidence_id"], {"regnskapsperiode": "{", "virksomhet": "{"}, stop=True)
    revenue = fixed.ACCOUNT_METRICS["revenue"]
    nodes, text = _texts(nodes, ["regnskapsperiode.tilDato", "regnskapsperiode.fraDato", "virksomhet.organisasjonsnummer", "regnskapstype", "valuta", revenue])
    at = lambda path: unquoted(text[path])
    rows = computed(
        nodes,
        period_end=at("regnskapsperiode.tilDato"), owner=at("virksomhet.organisasjonsnummer"), revenue=text[revenue],
        report_type=F.coalesce(at("regnskapstype"), F.lit("SELSKAP")), start_json=F.coalesce(text["regnskapsperiode.fraDato"], F.lit("null")),
        currency_json=F.coalesce(text["valuta"], F.lit("null")),
    )
    rows = rows.filter(F.col("period_end").isNotNull() & F.col("owner").isNotNull() & F.col("revenue").rlike(r"\A-?[0-9]"))
    # The wrapper is read from its end, so the earliest record in the document is the last one met.
    last = keep_first(rows.drop("_texts"), ["organisation_number", "evidence_id", "period_end", "report_type"], [F.col("ord")])
    last = last.filter(F.col("owner") == F.col("organisation_number"))
    value = F.concat(
        F.lit('{"currency":'), "currency_json", F.lit(',"organisation_number":"'), "owner", F.lit('","period_end":"'), "period_end", F.lit('","period_start":'),
        "start_json", F.lit(',"report_type":"'), "report_type", F.lit('","revenue":'), "revenue", F.lit("}"),
    )
    last = computed(last, value_json=value, subject=F.concat_ws(":", F.lit("financials"), "report_type", "period_end"))
    return as_claims(
        last, claim_id=digest("organisation_number", "subject", "value_json"), field="financials", subject=F.col("subject"), value_json=F.col("value_json"),
        reporting_period=F.col("period_end"), effective_date=F.col("period_end"), extraction_method="official_accounts_v1",
    )


def extract_roles(responses: DataFrame, body: str = "body", version: str = "registry_roles_v2") -> DataFrame:
    """People and their roles; nothing else of the person leaves the record."""
    nodes = find_objects(responses, body, ["organisation_number", "evidence_id"], {"person": "{", "type": "{"})
    node = F.col("node")
    part = lambda k: F.nullif(F.trim(unquoted(node_json(node, f"$.person.navn.{k}"))), F.lit(""))
    rows = computed(nodes, name=F.concat_ws(" ", part("fornavn"), part("mellomnavn"), part("etternavn")), role=F.trim(unquoted(node_json(node, "$.type.beskrivelse"))))
    rows = rows.filter((F.col("name") != "") & (F.col("role") != ""))
    rows = computed(rows, value_json=F.to_json(F.struct("name", "role")))
    first = keep_first(rows.drop("node"), ["organisation_number", "evidence_id", "value_json"], [F.col("ord")])
    subject = F.concat(F.lit("leadership:"), "value_json")
    return as_claims(
        first, claim_id=digest("organisation_number", subject), field="leadership", subject=subject, value_json=F.col("value_json"),
        json_pointer=F.col("pointer") if version.endswith("2") else F.lit(None).cast("string"), extraction_method=version,
    )


def extract_locations(responses: DataFrame, body: str = "body", version: str = "registry_subunits_v2") -> DataFrame:
    """Named sub-units whose parent is exactly the requested entity."""
    nodes = find_objects(responses, body, ["organisation_number", "evidence_id"], {"overordnetEnhet": "", "organisasjonsnummer": "", "navn": ""})
    node = F.col("node")
    filled = lambda k: F.when(~F.coalesce(node_json(node, f"$.{k}"), F.lit("null")).isin("null", '""', "[]", "{}", "0", "false"), node_json(node, f"$.{k}"))
    address = F.coalesce(filled("beliggenhetsadresse"), filled("forretningsadresse"), F.lit("{}"))
    rows = computed(
        nodes, parent=unquoted(node_json(node, "$.overordnetEnhet")), number=unquoted(node_json(node, "$.organisasjonsnummer")), name=unquoted(node_json(node, "$.navn")),
        address_json=F.when(address.startswith("{"), address).otherwise(F.lit("{}")), employees_json=F.coalesce(node_json(node, "$.antallAnsatte"), F.lit("null")),
    )
    rows = rows.filter((F.col("parent") == F.col("organisation_number")) & F.col("number").isNotNull() & (F.trim("name") != ""))
    value = F.concat(
        F.lit('{"address":'), "address_json", F.lit(',"employees":'), "employees_json", F.lit(',"name":'), json_text("name"), F.lit(',"organisation_number":'), json_text("number"), F.lit("}")
    )
    rows = computed(rows, value_json=value, subject=F.concat(F.lit("location:"), "number"))
    first = keep_first(rows.drop("node"), ["organisation_number", "evidence_id", "value_json"], [F.col("ord")])
    return as_claims(
        first, claim_id=digest("organisation_number", "subject", "value_json"), field="locations", subject=F.col("subject"), value_json=F.col("value_json"),
        json_pointer=F.col("pointer") if version.endswith("2") else F.lit(None).cast("string"), extraction_method=version,
    )


# ---- pages ----------------------------------------------------------------------------


def extract_description(pages: DataFrame) -> DataFrame:
    """The one home-page description of an owned root page."""
    owned = pages.filter(F.col("owner_span").isNotNull() & F.col("is_root"))
    values = F.array_distinct(F.filter(F.transform("descriptions", collapse), lambda v: v != ""))
    rows = computed(owned, _all=values).filter(F.size("_all") == 1)
    rows = computed(rows, _value=F.element_at("_all", 1), subject=F.concat(F.lit("company_description:"), "page_url"))
    rows = rows.filter(F.char_length("_value").between(40, 320) & (normal_name("_value") != normal_name("legal_name")))
    return as_claims(
        rows, claim_id=digest("organisation_number", "subject", "_value"), field="company_description", subject=F.col("subject"),
        value_json=json_text("_value"), extraction_method="company_meta_description_v1",
    )


def extract_passages(pages: DataFrame) -> DataFrame:
    """The words around the ownership proof."""
    owned = pages.filter(F.col("owner_span").isNotNull())
    start = F.greatest(F.col("owner_span.start") - 150, F.lit(0))
    end = F.least(F.col("owner_span.end") + 150, F.char_length("text"))
    rows = computed(owned, _s=start, _e=end, _field=F.when(F.col("is_root"), "website_identity").otherwise("company_page"))
    rows = computed(rows, _value=slice_text("text", "_s", "_e"))
    return as_claims(
        rows, claim_id=digest("organisation_number", "_field", "page_url", "_value"), field=F.col("_field"), subject=F.concat_ws(":", "_field", "page_url"),
        value_json=json_text("_value"), text_span=_span(F.col("_s"), F.col("_e")), extraction_method="visible_text_v2",
    )


def extract_social(pages: DataFrame) -> DataFrame:
    """X18"""
    rows = pages.filter(F.col("social_span").isNotNull())
    return as_claims(
        rows, claim_id=digest("organisation_number", F.lit("social_pages"), "page_url"), field="social_pages", subject=F.concat(F.lit("social_pages:"), "page_url"),
        value_json=json_text("page_url"), text_span=F.col("social_span"), extraction_method="social_identity_v1",
    )


def _same_page(df: DataFrame, target: str) -> DataFrame:
    """Add ``same_page``: does a declared URL name this page?"""
    df = urls.normalize_urls(df, target).withColumnRenamed("norm_url", "_target").drop("host", "path", "query", "reject_reason")
    df = urls.normalize_urls(df, "page_url").withColumnRenamed("norm_url", "_self").drop("host", "path", "query", "reject_reason")
    return computed(df, same_page=F.coalesce(F.col("_target") == F.col("_self"), F.lit(False))).drop("_target", "_self")


def _declared_url(node) -> Column:
    return F.when(_key_json(node, "url").isNotNull(), _text_at(node, "url")).otherwise(_text_at(node, "@id"))


def _lone(pages: DataFrame, types, out: str) -> DataFrame:
    """The first node of a type and how many different ones the page has."""
    hits = F.filter("nodes", lambda n: has_type(n["node"], types))
    p = computed(pages, _hits=hits)
    return computed(p, **{out: F.try_element_at("_hits", F.lit(1)), f"{out}_n": F.size(F.array_distinct(F.transform("_hits", lambda n: F.to_json(n["node"]))))}).drop("_hits")


def extract_jobs(pages: DataFrame, version: int = 2) -> DataFrame:
    """Attributed, dated postings. Version 2 wants exactly one on an owned detail page."""
    p = pages
    if version == 2:
        role = urls.url_role("page_url")
        p = _lone(p.filter(F.col("owner_span").isNotNull() & ~role.isin("root", "job_index", "search")), fixed.JOB_TYPES, "_job").filter("_job_n = 1")
        p = computed(p, _t=_declared_url(F.col("_job.node")), _d=visible_text(_text_at(F.col("_job.node"), "description")))
        p = _same_page(p, "_t").filter("same_page")
        p = p.filter((F.char_length("_d") >= 40) & F.contains(normal_name("text"), normal_name("_d")))
    keep = ["organisation_number", "legal_name", "page_url", "retrieved_at", "evidence_id"]
    rows = explode_nodes(p, keep).filter(has_type(F.col("node"), fixed.JOB_TYPES))
    node = F.col("node")
    employer = F.try_variant_get(node, "$.hiringOrganization", "variant")
    name_norm = normal_name("legal_name")
    employed = names_entity(employer, F.col("organisation_number"), name_norm)
    if version == 1:
        employed = (normal_name(_text_at(employer, "name")) == name_norm) & names_entity(
            F.parse_json(F.to_json(F.struct(F.col("legal_name").alias("name"), F.coalesce(_text_at(employer, "taxID"), _text_at(employer, "vatID")).alias("taxID")))),
            F.col("organisation_number"), name_norm,
        )
    rows = computed(rows, title=_text_at(node, "title"), posted=_text_at(node, "datePosted"), _ok=F.coalesce(employed, F.lit(False)))
    rows = rows.filter(
        F.col("_ok") & (F.trim("title") != "") & (F.char_length("title") <= 300)
        & is_active("posted", _text_at(node, "validThrough"), _key_json(node, "validThrough").isNotNull(), "retrieved_at")
    )
    place = F.coalesce(_key_json(node, "jobLocation"), F.lit("null"))
    fallback = F.concat(F.lit('{"datePosted":'), json_text("posted"), F.lit(',"jobLocation":'), place, F.lit(',"title":'), json_text("title"), F.lit("}"))
    rows = computed(rows, subject=F.concat(F.lit("jobs:"), "page_url", F.lit(":"), F.coalesce(_key_json(node, "identifier"), fallback)))
    # Equal postings collapse, different ones under one subject vanish.
    rows = drop_conflicts(rows.drop("node"), ["organisation_number", "evidence_id", "subject"], "node_json", ["ord"])
    return as_claims(
        rows, claim_id=digest("organisation_number", "subject", "node_json"), field="jobs", subject=F.col("subject"), value_json=F.col("node_json"),
        json_ld_block=F.col("block"), json_pointer=F.col("pointer"), effective_date=F.col("posted"), extraction_method=f"json_ld_job_v{version}",
    )


def news_decisions(pages: DataFrame) -> DataFrame:
    """X15 + X16 per page: ``decision`` is structured, visible or none."""
    tail_bad = urls.last_segment(urls.url_path("page_url")).isin("products", "search")
    p = pages.filter(F.col("owner_span").isNotNull() & (F.size("article_texts") == 1))
    p = p.filter(~urls.url_role("page_url").isin("root", "news_index", "search") & ~tail_bad)
    p = _lone(p, fixed.NEWS_TYPES, "_news")
    node = F.col("_news.node")
    p = computed(p, _article=F.element_at("article_texts", 1), _t=_declared_url(node), _posted=utc_date(_text_at(node, "datePublished")), _headline=_text_at(node, "headline"), _name=normal_name("legal_name"))
    p = _same_page(p, "_t")
    p = computed(p, _art=normal_name("_article"), _body=visible_text(_text_at(node, "articleBody")), _labels=label_spans("_article"))
    article, number = F.col("_art"), F.col("organisation_number")
    long_enough = F.char_length("_article") >= 80
    named = contains_name(article, "_name")
    no_url = _key_json(node, "url").isNull() & _key_json(node, "@id").isNull() | (_key_json(node, "url") == "null")
    no_date = F.coalesce(_key_json(node, "datePublished"), F.lit("null")) == "null"
    dates_agree = F.forall("publication_dates", lambda d: F.coalesce(utc_date(d) == F.col("_posted"), F.lit(False)))
    bad_head = ~F.coalesce(F.char_length(F.trim("_headline")).between(15, 300) & F.contains(article, normal_name("_headline")) & long_enough, F.lit(False))
    about = F.try_variant_get(node, "$.about", "variant")
    body_given = F.coalesce(_key_json(node, "articleBody"), F.lit("null")) != "null"
    verdict = (
        F.when(F.col("_news_n") == 0, "fallback").when(F.col("_news_n") > 1, "reject").when(no_url | no_date, "fallback")
        .when(~F.col("same_page") | ~F.coalesce(F.col("_posted") <= utc_date("retrieved_at"), F.lit(False)) | ~dates_agree, "reject")
        .when(bad_head, "fallback").when(F.coalesce(F.to_json(about), F.lit("null")) == "null", "fallback")
        .when(~names_entity(about, number, F.col("_name")) | ~named, "reject")
        .when(body_given & ~F.coalesce(F.contains(article, normal_name("_body")), F.lit(False)), "reject").otherwise("accept")
    )
    p = computed(p, _verdict=verdict)
    head = F.try_element_at("article_headings", F.lit(1))
    when = consensus_date(F.concat("publication_dates", "article_dates"), "retrieved_at")
    numbered = F.exists("_labels", lambda s: s["number"] == number)
    visible = (
        (F.size("article_headings") == 1) & F.char_length(head).between(15, 300) & F.contains(article, normal_name(head)) & long_enough
        & (named | numbered) & (F.size("article_dates") <= 1)
    )
    p = computed(p, _day=when, _head=head, _visible=F.coalesce(visible, F.lit(False)))
    shown = F.col("_visible") & F.col("_day").isNotNull()
    return computed(p, decision=F.when(F.col("_verdict") == "accept", "structured").when((F.col("_verdict") == "fallback") & shown, "visible").otherwise("none"))


def extract_news(pages: DataFrame) -> DataFrame:
    p = news_decisions(pages).filter("decision <> 'none'")
    structured = F.col("decision") == "structured"
    value = F.when(structured, F.to_json("_news.node")).otherwise(
        F.to_json(F.struct(F.col("_article").alias("articleBody"), F.col("_day").alias("datePublished"), F.col("_head").alias("headline")))
    )
    p = computed(p, value_json=value, subject=F.concat(F.lit("news:"), "page_url"))
    return as_claims(
        p, claim_id=digest("organisation_number", "subject", "value_json"), field="news", subject=F.col("subject"), value_json=F.col("value_json"),
        json_ld_block=F.when(structured, F.col("_news.block")), json_pointer=F.when(structured, F.col("_news.pointer")),
        effective_date=F.when(structured, _text_at(F.col("_news.node"), "datePublished")).otherwise(F.col("_day")),
        extraction_method=F.when(structured, "json_ld_news_v1").otherwise("visible_html_news_v1"),
    )


def extract_legal(pages: DataFrame, version: int = 2) -> DataFrame:
    """A dated mention of a case near the identity proof; the outcome is never inferred. Needs ``kind``."""
    declared = F.transform(
        F.filter("nodes", lambda n: has_type(n["node"], fixed.DATED_TYPES) & _key_json(n["node"], "datePublished").isNotNull()),
        lambda n: F.coalesce(_text_at(n["node"], "datePublished"), F.lit("")),
    )
    p = pages.filter(F.col("identity_span").isNotNull() & F.col("kind").isin(*fixed.LEGAL_KINDS))
    p = computed(p, published=consensus_date(F.concat("publication_dates", declared), "retrieved_at"), _news=(F.col("kind") == "news") & F.lit(version == 2))
    p = _lone(p.filter(F.col("published").isNotNull()), fixed.ARTICLE_TYPES, "_art")
    node = F.col("_art.node")
    p = computed(p, _t=_declared_url(node), _article=F.when(F.col("_news"), F.try_element_at("article_texts", F.lit(1))))
    p = _same_page(p, "_t")
    p = computed(p, _at=F.instr("text", F.col("_article")) - 1, _local=identity_proof(F.col("_article"), label_spans("_article"), F.col("organisation_number"), normal_name("legal_name")), _head=_text_at(node, "headline"))
    fits = (
        (F.size("article_texts") == 1) & F.col("_local").isNotNull() & (F.col("_art_n") == 1) & F.col("same_page")
        & (F.date_format(utc_date(_text_at(node, "datePublished")), "yyyy-MM-dd") == F.col("published"))
        & (F.char_length(F.trim("_head")) >= 15) & F.contains("_article", F.col("_head")) & (F.col("_at") >= 0)
    )
    p = p.filter(~F.col("_news") | F.coalesce(fits, F.lit(False)))
    lo = F.when(F.col("_news"), F.col("_at")).otherwise(F.lit(0))
    hi = F.when(F.col("_news"), F.col("_at") + F.char_length("_article")).otherwise(F.char_length("text"))
    ps = F.when(F.col("_news"), F.col("_at") + F.col("_local.start")).otherwise(F.col("identity_span.start"))
    pe = F.when(F.col("_news"), F.col("_at") + F.col("_local.end")).otherwise(F.col("identity_span.end"))
    p = computed(p, _s=F.greatest(lo, ps - 450), _e=F.least(hi, pe + 450))
    p = computed(p, _passage=slice_text("text", "_s", "_e"))
    p = computed(p, _m=mention("_passage")).filter("_m.hit")
    value = F.to_json(
        F.struct(F.col("_m.case_reference").alias("case_reference"), F.lit(None).cast("string").alias("court_outcome"), F.lit("source_report_only").alias("interpretation"),
                 F.col("published").alias("published_at"), F.col("_passage").alias("reported_text"), F.col("kind").alias("source_kind")),
        {"ignoreNullFields": "false"},
    )
    p = computed(p, value_json=value, subject=F.concat(F.lit("legal_cases:"), "page_url"))
    return as_claims(
        p, claim_id=digest("organisation_number", "subject", "value_json"), field="legal_cases", subject=F.col("subject"), value_json=F.col("value_json"),
        text_span=_span(F.col("_s"), F.col("_e")), effective_date=F.col("published"), extraction_method=f"legal_report_v{version}",
    )


#: Locators that travel to one body at once.
LOCATED = 1_000


def claim_excerpts(claims: DataFrame, evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """What the stored source says at each claim's locator, whole or at most ``limit`` characters.

    ``evidence``: evidence_id, body, is_json, text (of pages), json_ld. The locators of a body travel to it
    as one array; the body is parsed once and never repeated, nor shuffled where it is bucketed by evidence_id.
    """
    from vouchlake.sinks.bodies import in_parts

    locator = F.struct("organisation_number", "claim_id", "json_pointer", "json_ld_block", "text_span", "value_json")
    located = in_parts(claims, "evidence_id", "claim_id", LOCATED).groupBy("evidence_id", "_part").agg(F.collect_list(locator).alias("_at")).drop("_part")
    j = evidence.join(located, "evidence_id")
    j = computed(j, _root=F.when(F.col("is_json"), F.try_parse_json("body")), _blocks=F.transform("json_ld", lambda b: F.try_parse_json(b)))

    def step(node, token):
        key = F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        by_name = F.try_element_at(F.try_variant_get(node, "$", "map<string,variant>"), key)
        by_index = F.try_element_at(F.try_variant_get(node, "$", "array<variant>"), key.try_cast("int") + 1)
        return F.coalesce(by_name, by_index)

    def excerpt(at):
        pointer = F.regexp_replace(F.coalesce(at["json_pointer"], F.lit("")), r"\A/", "")
        tokens = F.when(pointer == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(pointer, "/"))
        root = F.when(F.col("is_json"), F.col("_root")).otherwise(F.try_element_at("_blocks", at["json_ld_block"] + 1))
        s, e = at["text_span"]["start"], at["text_span"]["end"]
        in_text = F.when((s >= 0) & (s < e) & (e <= F.char_length("text")), slice_text("text", s, e))
        literal = unquoted(at["value_json"])
        use_pointer = (F.col("is_json") & at["json_pointer"].isNotNull()) | at["json_ld_block"].isNotNull()
        found = F.when(use_pointer, F.to_json(F.aggregate(tokens, root, step))).when(at["text_span"].isNotNull() & in_text.isNotNull(), in_text)
        found = F.coalesce(found.when(F.contains("body", literal), literal), at["value_json"])
        return F.struct(
            at["organisation_number"].alias("organisation_number"), at["claim_id"].alias("claim_id"),
            (F.substring(found, 1, limit) if limit else found).alias("excerpt"),
        )

    rows = j.select("evidence_id", F.inline(F.transform("_at", excerpt)))
    return rows.select("organisation_number", "claim_id", "evidence_id", "excerpt")
