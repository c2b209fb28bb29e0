"""Proofs that a page speaks about, or belongs to, one exact entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.functions import fixed
from vouchlake.functions.canon import collapse, computed, contains_name, digits, normal_name, slice_text

SPAN = "struct<start:int,end:int>"


def label_spans(text) -> Column:
    """ARRAY<STRUCT<start, end, number>> of labelled organisation numbers, offsets in code points."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = F.lit(fixed.LABELLED_NUMBER)
    found, numbers = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1))
    gaps = F.split(text, fixed.LABELLED_NUMBER, -1)
    parts = F.arrays_zip(found.alias("hit"), numbers.alias("number"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int,number:string>>))")

    def step(acc, p):
        begin = acc["at"] + F.char_length(p["gap"])
        end = begin + F.char_length(p["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), digits(p["number"]).alias("number"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(parts, start, step)["spans"]).otherwise(
        F.expr("cast(array() as array<struct<start:int,end:int,number:string>>)")
    )


def _span(start, end) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def identity_proof(text: Column, labels: Column, number: Column, name_norm: Column) -> Column:
    """A label span whose surroundings hold the legal name; every label must agree."""
    agree = (F.size(labels) > 0) & F.forall(labels, lambda s: s["number"] == number)
    near = F.filter(
        labels,
        lambda s: contains_name(normal_name(slice_text(text, F.greatest(s["start"] - 400, F.lit(0)), s["end"] + 400)), name_norm),
    )
    first = F.try_element_at(near, F.lit(1))
    return F.when(agree & first.isNotNull(), _span(first["start"], first["end"]))


def _heading_proof(text: Column, headings: Column, name_norm: Column) -> Column:
    heading = F.try_element_at(F.filter(headings, lambda h: normal_name(h) == name_norm), F.lit(1))
    at = F.instr(text, heading)
    return F.when(at > 0, _span(at - 1, at - 1 + F.char_length(heading)))


def _name_proof(text: Column, legal_name: Column) -> Column:
    name = collapse(legal_name)
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_])"))
    pieces = F.split(text, pattern, 2)
    start = F.char_length(F.element_at(pieces, 1))
    return F.when((F.size(pieces) == 2) & (name != ""), _span(start, start + F.char_length(name)))


def _key_json(node, key: str) -> Column:
    return F.to_json(F.try_variant_get(node, f"$['{key}']", "variant"))


def _text_at(node, key: str) -> Column:
    value = F.try_variant_get(node, f"$['{key}']", "variant")
    return F.when(F.to_json(value).startswith('"'), F.try_variant_get(value, "$", "string"))


def names_entity(node, number: Column, name_norm: Column, strict_name: bool = False) -> Column:
    """legalName (else name) equals the legal name; taxID (else vatID), when given, equals the number."""
    name = F.when(_key_json(node, "legalName").isNotNull(), _text_at(node, "legalName")).otherwise(_text_at(node, "name"))
    given = F.coalesce(_key_json(node, "taxID"), _key_json(node, "vatID"), F.lit("null"))
    tax = F.when(_key_json(node, "taxID").isNotNull(), _text_at(node, "taxID")).otherwise(_text_at(node, "vatID"))
    tax_ok = (given == "null") | F.coalesce(digits(tax) == number, F.lit(False))
    return F.coalesce(normal_name(name) == name_norm, F.lit(False)) & tax_ok


def owner_verdict(nodes: Column, number: Column, name_norm: Column) -> Column:
    """'none' without declared owners, 'match' when all of them are the entity, else 'conflict'."""
    from .walk import node_types

    short = lambda n: F.transform(node_types(n["node"]), lambda t: F.regexp_replace(t, r"\A.*[/:]", ""))
    known = F.array(*[F.lit(t) for t in fixed.OWNER_TYPES])
    owns = lambda n: F.arrays_overlap(short(n), known) | _key_json(n["node"], "taxID").isNotNull() | _key_json(n["node"], "vatID").isNotNull()
    publishes = lambda n: F.array_contains(short(n), "WebSite") & _key_json(n["node"], "publisher").isNotNull()

    def publisher_ok(n):
        pub = F.try_variant_get(n["node"], "$.publisher", "variant")
        only_ref = F.to_json(pub).rlike(r'\A\{"@id":"(?:[^"\\]|\\.)*"\}\z')
        target = F.try_element_at(F.filter(nodes, lambda m: _text_at(m["node"], "@id") == _text_at(pub, "@id")), F.lit(-1))
        node = F.when(only_ref, target["node"]).otherwise(pub)
        return F.coalesce(names_entity(node, number, name_norm), F.lit(False))

    direct = F.transform(F.filter(nodes, owns), lambda n: names_entity(n["node"], number, name_norm))
    via = F.transform(F.filter(nodes, publishes), publisher_ok)
    votes = F.concat(direct, via)
    return F.when(F.size(votes) == 0, "none").when(F.forall(votes, lambda v: v), "match").otherwise("conflict")


def prove(pages: DataFrame, number: str = "organisation_number", legal_name: str = "legal_name", strict: str | None = None) -> DataFrame:
    """Add identity_span (P12), owner_span (P13) and social_span (P14) to parsed pages with ``nodes``."""
    num, name, text = F.col(number), F.col("_name"), F.col("text")
    p = computed(pages, _labels=label_spans("text"), _name=normal_name(legal_name))
    agree = F.forall("_labels", lambda s: s["number"] == num)
    labelled = F.size("_labels") > 0
    first = F.try_element_at("_labels", F.lit(1))
    p = computed(
        p,
        identity_span=identity_proof(text, F.col("_labels"), num, name),
        _heading=_heading_proof(text, F.col("headings"), name),
        _label=F.when(labelled & agree, _span(first["start"], first["end"])),
        _agree=agree,
        _labelled=labelled,
        _owners=owner_verdict(F.col("nodes"), num, name),
    )
    group = F.exists(F.filter("headings", lambda h: F.trim(h) != ""), lambda h: normal_name(h).rlike(fixed.GROUP_HEADING)) | text.rlike(fixed.GROUP_PHRASE)
    # The text search for the name runs only where no cheaper proof exists.
    named = F.when(F.col("identity_span").isNull() & F.col("_heading").isNull(), _name_proof(text, F.col(legal_name)))
    proof = F.coalesce("identity_span", "_heading", named, "_label")
    strict_col = F.col(strict) if strict else F.lit(False)
    unproven = strict_col & ~(F.col("_labelled") & F.col("_agree")) & (F.col("_owners") != "match")
    refused = ~F.col("_agree") | (F.col("_owners") == "conflict") | ((F.col("_owners") == "none") & group) | unproven
    p = computed(
        p,
        owner_span=F.when(~refused, proof),
        social_span=F.when(F.col("_labelled"), F.col("_label")).otherwise(F.col("_heading")),
        owner_verdict=F.col("_owners"),
    )
    return p.drop("_labels", "_name", "_heading", "_label", "_agree", "_labelled", "_owners")
