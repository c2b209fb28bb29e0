"""Domain rules on literal documents: exact match, wrong entity, conflicts, missing and zero."""

import json

import pytest
from pyspark.sql import functions as F

from vouchlake.functions.canon import computed
from vouchlake.operators import extract as X, identity, pages as P, registry_facts as R, walk
from vouchlake.operators.gates import filter_robots

ORG, NAME = "923609016", "Nordlys Verft AS"


def docs(spark, *bodies):
    rows = [(ORG, f"e{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "organisation_number string, evidence_id string, body string")


def page(spark, *htmls, url="https://nordlys.no/", kind=None, root=True):
    """Parsed and proven pages; ``case`` is the position of the page in the arguments."""
    df = spark.createDataFrame(
        [(i, ORG, NAME, url, root, "2024-01-16T00:00:00+00:00", html, kind) for i, html in enumerate(htmls)],
        "case int, organisation_number string, legal_name string, page_url string, is_root boolean, retrieved_at string, html string, kind string",
    )
    return identity.prove(walk.schema_nodes(P.page_features(computed(df, evidence_id=F.sha2("html", 256)))))


def test_registry_zero_and_false_are_facts(spark):
    rec = {"organisasjonsnummer": ORG, "navn": NAME, "konkurs": False, "aktivitet": [], "harRegistrertAntallAnsatte": True, "antallAnsatte": 0}
    facts = {r.field: r for r in R.registry_facts(docs(spark, rec)).collect()}
    assert facts["bankrupt"].value_json == "false" and facts["registered_employees"].value_json == "0"
    assert facts["business_activity"].reason == "absent_in_registry_response" and facts["in_liquidation"].state == "not_available"


def test_employee_gate(spark):
    cases = [(True, -1, "failed"), (True, "4", "failed"), (False, -1, "available"), ("true", 5, "available")]
    recs = docs(spark, *[{"organisasjonsnummer": ORG, "navn": NAME, "harRegistrertAntallAnsatte": f, "antallAnsatte": n} for f, n, _ in cases])
    states = [r.state for r in R.gate_confirmed(R.gate_registry(recs)).orderBy("evidence_id").collect()]
    assert states == [c[2] for c in cases]
    assert R.unpivot_claims(recs).filter("field = 'registered_employees'").count() == 0


def statement(**over):
    rec = {
        "virksomhet": {"organisasjonsnummer": ORG}, "regnskapsperiode": {"fraDato": "2023-01-01", "tilDato": "2023-12-31"}, "regnskapstype": "SELSKAP", "valuta": "NOK",
        "resultatregnskapResultat": {"driftsresultat": {"driftsinntekter": {"sumDriftsinntekter": 0}}, "aarsresultat": -5.5}, "eiendeler": {"sumEiendeler": True},
    }
    rec.update(over)
    return rec


def test_accounts_pointer_zero_and_boolean(spark):
    got = {json.loads(r.value_json)["metric"]: r for r in X.extract_financials(docs(spark, {"a/b": [{"~x": statement()}]})).collect()}
    assert set(got) == {"revenue", "annual_result"}
    assert got["revenue"].json_pointer == "/a~1b/0/~0x/resultatregnskapResultat/driftsresultat/driftsinntekter/sumDriftsinntekter"
    assert json.loads(got["annual_result"].value_json)["amount"] == -5.5


BAD_STATEMENTS = [
        {"virksomhet": {"organisasjonsnummer": "999999999"}}, {"virksomhet": {"organisasjonsnummer": 923609016}}, {"valuta": " "}, {"valuta": "X" * 11}, {"regnskapstype": "ANNET"},
        {"regnskapsperiode": {"fraDato": "2024-01-01", "tilDato": "2023-12-31"}}, {"regnskapsperiode": {"fraDato": "2023-01-01"}}, {"regnskapsperiode": {"fraDato": "2023-13-01", "tilDato": "2023-12-31"}},
    ]


def test_accounts_rejects(spark):
    assert X.extract_financials(docs(spark, *[[statement(**bad)] for bad in BAD_STATEMENTS])).count() == 0


def test_accounts_conflicts_vanish_and_copies_collapse(spark):
    other = statement(resultatregnskapResultat={"aarsresultat": 1})
    assert X.extract_financials(docs(spark, [statement(), statement()])).count() == 2
    assert X.extract_financials(docs(spark, [statement(), other])).count() == 0


def test_roles_keep_only_name_and_role(spark):
    role = lambda n, t: {"type": {"beskrivelse": t}, "person": {"fodselsnummer": "010101", "navn": n}}
    body = {"g": [role({"fornavn": " Kari ", "mellomnavn": None, "etternavn": "Vik"}, "Leder "), role({"fornavn": "Kari", "etternavn": "Vik"}, "Leder"), role({"fornavn": " "}, "Leder"), role("x", "y")]}
    rows = X.extract_roles(docs(spark, body)).collect()
    assert [(r.value_json, r.json_pointer) for r in rows] == [('{"name":"Kari Vik","role":"Leder"}', "/g/0")]


def test_locations_need_the_exact_parent(spark):
    unit = {"organisasjonsnummer": "1", "overordnetEnhet": ORG, "navn": "Avd", "antallAnsatte": 0}
    rows = X.extract_locations(docs(spark, [unit, dict(unit, overordnetEnhet="2"), dict(unit, navn=" "), dict(unit)])).collect()
    assert [json.loads(r.value_json) for r in rows] == [{"address": {}, "employees": 0, "name": "Avd", "organisation_number": "1"}]


def test_walk_fails_rather_than_cutting(spark):
    deep = "[" * 20 + "]" * 20
    with pytest.raises(Exception, match="json_nested_too_deep"):
        walk.walk_json(docs(spark, deep), "body", ["evidence_id"], depth=5, only_objects=False).collect()


def test_walks_reach_every_depth(spark):
    rows = lambda n: [(n, '[{"@type":"T","@graph":' * n + '{"@type":"Last"}' + "}]" * n)]
    df = spark.createDataFrame([*rows(1), *rows(4), *rows(5), *rows(20), *rows(100)], "n int, ld string")
    nodes = walk.explode_nodes(walk.schema_nodes(df.select("n", F.array("ld").alias("json_ld"))), ["n"])
    found = {r.n: (r.c, r.p) for r in nodes.groupBy("n").agg(F.count("*").alias("c"), F.max_by("pointer", F.length("pointer")).alias("p")).collect()}
    assert found == {n: (n + 1, "/0/@graph" * n) for n in (1, 4, 5, 20, 100)}
    walked = walk.walk_json(df, "ld", ["n"]).groupBy("n").agg(F.count("*").alias("c"), F.max_by("pointer", F.length("pointer")).alias("p")).collect()
    assert {r.n: (r.c, r.p) for r in walked} == found


def test_page_features_details(spark):
    html = (
        "<title>A &amp; B</title><script type='application/ld+json'>{\"@type\":\"X\"}</script><SCRIPT type=application/ld+json>{bad</SCRIPT><noscript><a href=/no>n</a></noscript>"
        "<article><h1>One</h1><article>in<time datetime='2024-01-01'></time></article>out &Oslash;&#229;&eacute;</article><article>Two</article><article>never closed"
        "<a title='1 > 0' href=\"/x?a=1&amp;b=2\">l</a><!-- <a href='/c'> --><style>p{}</style>a<b>b</b>"
    )
    row = page(spark, html).first()
    assert row.headings == ["A & B", "One"] and row.article_texts == ["One in out Øåé", "Two"]
    assert row.article_headings == ["One"] and row.article_dates == ["2024-01-01"] and row.links == ["/x?a=1&b=2"]
    assert row.json_ld == ['{"@type":"X"}', None]
    assert row.text == "A & B One in out Øåé Two never closed l a b"


def test_identity_offsets_are_code_points(spark):
    row = page(spark, f"<p>😀 {NAME} Org.nr: 923 609 016</p>").first()
    text = row.text
    assert text[row.identity_span.start:row.identity_span.end] == "Org.nr: 923 609 016"


GATES = [
        (f"<h1>{NAME}</h1>", False, True, True), (f"<h1>{NAME}</h1> org nr 974760673", False, False, False), (f"<h1>{NAME} Holding</h1><p>{NAME}", False, False, False),
        (f"<p>{NAME} is one of our subsidiaries", False, False, False), (f"<p>Xnordlys verft asx", False, False, False), (f"<p>nordlys   VERFT as", False, True, False),
        (f"<script>org nr 974760673</script><p>{NAME} org nr {ORG}", True, True, True),
        (f'<script type="application/ld+json">{{"@type":"WebSite","publisher":{{"name":"Morselskap AS"}}}}</script><p>{NAME} org nr {ORG}', True, False, True),
        (f'<script type="application/ld+json">{{"@type":"schema:LocalBusiness","name":"x","legalName":"{NAME}","vatID":null}}</script><p>{NAME}', False, True, False),
        (f'<script type="application/ld+json">{{"taxID":"{ORG}","name":"{NAME}","legalName":null}}</script><p>{NAME}', False, False, False),
    ]


def test_identity_gates(spark):
    rows = page(spark, *[c[0] for c in GATES]).select("case", "identity_span", "owner_span", "social_span").collect()
    got = {r.case: (r.identity_span is not None, r.owner_span is not None, r.social_span is not None) for r in rows}
    assert got == {i: c[1:] for i, c in enumerate(GATES)}


JOB = {
    "@type": "JobPosting", "url": "https://nordlys.no/jobb/1", "title": "Sveiser", "description": "Du sveiser skrog til store skip i en kald havn.", "datePosted": "2024-01-02",
    "hiringOrganization": {"name": "x", "legalName": NAME}, "identifier": {"value": "77"},
}


JOBS = [
        ({}, 1), ({"validThrough": None}, 0), ({"validThrough": "2024-01-16"}, 1), ({"validThrough": "2024-01-15"}, 0), ({"datePosted": "2024-01-17"}, 0), ({"datePosted": "2024-01-02T10:00"}, 0),
        ({"hiringOrganization": {"name": NAME}}, 1), ({"hiringOrganization": {"name": NAME, "taxID": "1"}}, 0), ({"title": "x" * 301}, 0), ({"url": "https://other.no/"}, 0), ({"description": "kort"}, 0), ({"@type": ["JobPosting"]}, 1),
    ]


def test_jobs(spark):
    html = lambda job: f'<script type="application/ld+json">{json.dumps(job)}</script><p>{NAME} org nr {ORG}<p>{JOB["description"]}'
    pages = page(spark, *[html({**JOB, **c}) for c, _ in JOBS], url="https://nordlys.no/jobb/1", root=False)
    ids = {r.evidence_id: r.case for r in pages.select("evidence_id", "case").collect()}
    rows = X.extract_jobs(pages).collect()
    assert sorted(ids[r.evidence_id] for r in rows) == [i for i, (_, n) in enumerate(JOBS) if n]
    assert {r.subject for r in rows} == {'jobs:https://nordlys.no/jobb/1:{"value":"77"}'}


def test_old_job_rules_drop_an_ambiguous_identifier(spark):
    two = [JOB, {**JOB, "title": "Maler"}, {**JOB, "identifier": "b"}]
    old = [{**j, "hiringOrganization": {"name": NAME}} for j in two]
    html = f'<script type="application/ld+json">{json.dumps(old)}</script>'
    rows = X.extract_jobs(page(spark, html), version=1).collect()
    assert [r.subject for r in rows] == ['jobs:https://nordlys.no/:"b"']


def test_conflicting_dates_stop_news_and_reports(spark):
    body = f"<article><h1>Ny kran på kaien i nord</h1><p>{NAME} org nr {ORG} ble saksøkt, en lawsuit om kranen som er større enn kirken.</p></article>"
    meta = lambda *days: "".join(f'<meta property="article:published_time" content="{d}">' for d in days)
    pages = page(spark, meta("2024-01-05") + body, meta("2024-01-05", "2024-01-06") + body, body, meta("2024-02-05") + body, url="https://nordlys.no/sak/1", kind="filing")
    ids = {r.evidence_id: r.case for r in pages.select("evidence_id", "case").collect()}
    assert [ids[r.evidence_id] for r in X.extract_news(pages).collect()] == [0]
    filings = X.extract_legal(pages).collect()
    assert [ids[r.evidence_id] for r in filings] == [0]
    value = json.loads(filings[0].value_json)
    assert value["court_outcome"] is None and value["case_reference"] is None
    assert X.extract_legal(pages.withColumn("kind", F.lit("news"))).count() == 0


def test_robots_first_match(spark):
    frontier = spark.createDataFrame([("a.no", "/x/1"), ("a.no", "/x/ok/1"), ("a.no", "/y")], "host string, path string")
    robots = spark.createDataFrame([("a.no", 200, "User-agent: *\nDisallow: /x\nAllow: /x/ok\n")], "host string, http_status int, body string")
    got = {r.path: r.allowed for r in filter_robots(frontier, robots, "bot").collect()}
    assert got == {"/x/1": False, "/x/ok/1": False, "/y": True}
