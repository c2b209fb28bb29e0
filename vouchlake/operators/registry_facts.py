"""Registry records to gated claims, availability, candidates and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.functions import fixed
from vouchlake.functions.canon import computed, digest, is_missing_json
from vouchlake.functions.keys import is_valid_key


def node_json(variant: Column, path: str) -> Column:
    """Canonical JSON text at a path of a VARIANT; NULL when absent."""
    return F.to_json(F.try_variant_get(variant, path, "variant"))


def unquoted(json_col: Column) -> Column:
    """The text of a JSON string; NULL for any other JSON type."""
    return F.when(json_col.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json_col, F.lit("}")), "$.v"))


def is_object(variant: Column) -> Column:
    return F.schema_of_variant(variant).startswith("OBJECT")


def gate_registry(df: DataFrame, body: str = "body") -> DataFrame:
    """A record is used only when it is an object that names the requested key."""
    v = F.col("_v")
    parsed = computed(df, _v=F.try_parse_json(F.col(body).cast("string")))
    parsed = computed(parsed, _number=node_json(v, "$.organisasjonsnummer"), _name=unquoted(node_json(v, "$.navn")))
    name = F.col("_name")
    named = F.col("_number") == F.concat(F.lit('"'), F.col("organisation_number"), F.lit('"'))
    error = (
        F.when(~is_valid_key("organisation_number"), F.lit("invalid_organisation_number"))
        .when(v.isNull(), F.lit("JSONDecodeError"))
        .when(~is_object(v), F.lit("ValueError"))
        .when(~F.coalesce(named, F.lit(False)), F.lit("registry_identity_mismatch"))
        .when(F.coalesce(F.trim(name) == "", F.lit(True)), F.lit("ValueError"))
    )
    gated = computed(parsed, error=error)
    gated = computed(
        gated,
        state=F.when(F.col("error").isNull(), "available")
        .when(F.col("error") == "registry_identity_mismatch", "ambiguous")
        .otherwise("failed"),
        legal_name=F.when(F.col("error").isNull(), name),
        record=v,
    )
    return gated.drop("_v", "_number", "_name")


def gate_confirmed(df: DataFrame) -> DataFrame:
    """An employee count needs an exact true flag; an impossible count fails the row."""
    _, count_key, flag_key = fixed.EMPLOYEE_FIELD
    df = computed(
        df,
        count_confirmed=F.coalesce(node_json(F.col("record"), f"$.{flag_key}") == "true", F.lit(False)),
        _count=node_json(F.col("record"), f"$.{count_key}"),
    )
    count = F.col("_count")
    broken = F.col("count_confirmed") & ~is_missing_json(count) & ~count.rlike(r"\A[0-9]+\z") & (F.col("state") == "available")
    return computed(
        df,
        error=F.when(broken, F.lit("ValueError")).otherwise(F.col("error")),
        state=F.when(broken, F.lit("failed")).otherwise(F.col("state")),
    ).drop("_count")


def registry_facts(df: DataFrame) -> DataFrame:
    """X1 + P3: one row per registry field of each available record.

    Claims are the rows in state 'available'; the others are availability rows.
    """
    field, count_key, _ = fixed.EMPLOYEE_FIELD
    gated = gate_confirmed(gate_registry(df)).filter(F.col("state") == "available")
    record = F.col("record")
    cells = [
        F.struct(
            F.lit(name).alias("field"),
            F.lit(key).alias("key"),
            node_json(record, f"$.{key}").alias("value_json"),
            F.lit(True).alias("confirmed"),
        )
        for name, key in fixed.REGISTRY_FIELDS.items()
    ]
    cells.append(
        F.struct(
            F.lit(field).alias("field"),
            F.lit(count_key).alias("key"),
            node_json(record, f"$.{count_key}").alias("value_json"),
            F.col("count_confirmed").alias("confirmed"),
        )
    )
    evidence_id = F.sha2(F.col("body"), 256)
    rows = computed(gated, evidence_id=evidence_id, effective=unquoted(node_json(record, f"$.{fixed.EMPLOYEE_DATE_KEY}")))
    rows = rows.select("organisation_number", "legal_name", "evidence_id", "effective", F.explode(F.array(*cells)).alias("c"))
    missing = is_missing_json("c.value_json")
    ok = F.col("c.confirmed") & ~missing
    return rows.select(
        "organisation_number",
        "legal_name",
        F.col("c.field").alias("field"),
        F.col("c.field").alias("subject"),
        F.when(ok, F.col("c.value_json")).alias("value_json"),
        F.when(ok, F.lit("available")).otherwise(F.lit("not_available")).alias("state"),
        F.when(~F.col("c.confirmed"), F.lit("registry_does_not_confirm_employee_count"))
        .when(missing, F.lit("absent_in_registry_response"))
        .alias("reason"),
        "evidence_id",
        F.concat(F.lit("/"), F.col("c.key")).alias("json_pointer"),
        F.when(
            ok, digest(F.col("organisation_number"), F.lit(":"), F.col("c.field"), F.lit(":"), F.col("c.value_json"))
        ).alias("claim_id"),
        F.when(F.col("c.field") == field, F.col("effective")).alias("effective_date"),
        F.lit("registry_json_pointer").alias("extraction_method"),
    )


def unpivot_claims(df: DataFrame) -> DataFrame:
    return registry_facts(df).filter(F.col("state") == "available").drop("state", "reason")


def registry_candidates(df: DataFrame) -> DataFrame:
    """The registered homepage is a lead, never a fact."""
    gated = gate_confirmed(gate_registry(df)).filter(F.col("state") == "available")
    home = unquoted(node_json(F.col("record"), "$.hjemmeside"))
    return (
        computed(gated, value=home)
        .filter(F.trim("value") != "")
        .select(
            "organisation_number",
            F.lit(0).alias("ord"),
            F.lit("website").alias("kind"),
            "value",
            F.lit("unverified").alias("status"),
            F.sha2("body", 256).alias("evidence_id"),
            F.lit("/hjemmeside").alias("json_pointer"),
        )
    )


def baseline_availability(df: DataFrame | None, facts: DataFrame | None = None) -> DataFrame:
    """Registry availability plus the fields that only later stages can fill; stored ``registry_facts`` spare a second parse."""
    facts = registry_facts(df) if facts is None else facts
    own = F.struct("field", "state", "reason")
    later = [
        F.struct(F.lit(f).alias("field"), F.lit("not_available").alias("state"), F.lit("not_researched_in_registry_baseline").alias("reason"))
        for f in fixed.LATER_STAGE_FIELDS
    ]
    # Every available record has exactly one legal_name row; it carries the later fields along.
    rows = F.when(F.col("field") == "legal_name", F.array(own, *later)).otherwise(F.array(own))
    return facts.select("organisation_number", F.inline(rows))


def left_outcomes(inputs: DataFrame, records: DataFrame, missing_reason: str) -> DataFrame:
    """One terminal row per input, duplicates and invalid inputs included."""
    gated = gate_confirmed(gate_registry(records)).select(
        "organisation_number", "legal_name", F.col("state").alias("_state"), F.col("error").alias("_error")
    )
    joined = inputs.join(gated, "organisation_number", "left")
    valid = is_valid_key("organisation_number")
    return joined.select(
        "input_index",
        "organisation_number",
        "legal_name",
        F.when(~valid, F.lit("failed")).otherwise(F.coalesce("_state", F.lit("not_available"))).alias("state"),
        F.when(~valid, F.lit("invalid_organisation_number"))
        .when(F.col("_state").isNull(), F.lit(missing_reason))
        .otherwise(F.col("_error"))
        .alias("error"),
    )


def build_evidence(df: DataFrame, source_class: str, extractor_version: str, synthetic: bool = False) -> DataFrame:
    """One evidence row per accepted body, named by its content hash."""
    suffix = ".json" if source_class in fixed.JSON_SOURCE_CLASSES else ".html"
    key = F.sha2(F.col("body").cast("binary"), 256)
    return df.select(
        "organisation_number",
        key.alias("id"),
        key.alias("content_sha256"),
        F.concat(F.lit("snapshots/"), key, F.lit(suffix)).alias("snapshot_path"),
        F.lit(source_class).alias("source_class"),
        F.lit(extractor_version).alias("extractor_version"),
        "source_url",
        "retrieved_at",
        F.lit(synthetic).alias("synthetic"),
    )
