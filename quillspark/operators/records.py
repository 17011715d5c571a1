"""JSON documents of differing shapes as tables: mentions, pages, context, entities, predictions.

Every function takes a frame with a key column and a JSON text column. Broken JSON and missing parts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import as_list, first_present
from ..functions.text import lexical_surface, stable_id

# Alternative names of a field, in the order of preference, and what is known by name.
NAMES = ["raw_medication_text", "medicine", "medicine_name"]
CONTEXT = {
    "chief_complaints": ["chief_complaint", "complaints_or_diagnosis"],
    "diagnoses": ["diagnosis", "clinical_impression"],
    "clinical_history": ["clinical_history", "history"],
    "clinical_findings": ["clinical_findings", "clinical_examination", "examination_findings"],
    "investigations": ["investigations", "investigations_advised"],
    "lab_observations": ["lab_observations", "laboratory_results"],
    "procedures": ["procedures"],
    "advice": ["advice", "recommendation"],
    "follow_up": ["follow_up"],
}
NOT_CONTEXT = ["medications", "prescription", "clinical_notes", "plan_of_care"]
ENTITY_LISTS = ["complaints_or_diagnosis", "observations", "procedures", "advice", "allergy_mentions", "other_notes"]
EMPTY_WORDS = ["", "null", "none", "[]", "{}"]
SOURCE_TYPES = {"opd_prescription": "prescription", "diagnostic_reports": "diagnostic_report"}
VERIFIED = ["VERIFIED_EXACT_METADATA", "VERIFIED_VISUAL_HIGH", "VERIFIED_VISUAL_MEDIUM"]
CATEGORIES = ["procedure", "advice", "observation"]
RAW_TEXTS = ["complaints_or_diagnosis", "observations", "medications", "advice"]


def get(json: Column, *names: str) -> Column:
    """The first of the names whose value isn't null or empty, as text."""
    return F.coalesce(*(F.nullif(F.get_json_object(json, f"$.{n}"), F.lit("")) for n in names))


def items(json: Column) -> Column:
    """A JSON list as an array of JSON texts; nothing for null and for what is no list."""
    listed = F.when(F.trim(json).startswith("["), F.from_json(json, "array<string>"))
    return F.coalesce(listed, F.array().cast("array<string>"))


def is_object(item: Column) -> Column:
    return F.coalesce(F.trim(item).startswith("{"), F.lit(False))


def has(json: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), name), F.lit(False))


def blank(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(EMPTY_WORDS), F.lit(True))


def mentions(df: DataFrame, key: str, json: str) -> DataFrame:
    """Mentions of documents that are a list of them, have "mentions", have "raw_entities", or are one themselves.

    Returns key, position, mention_id, document_uid, text, strength, dosage; mentions without a name are left out.
    """
    body = F.col(json)
    listed = (
        F.when(F.trim(body).startswith("["), items(body))
        .when(has(body, "mentions"), items(F.get_json_object(body, "$.mentions")))
        .when(has(body, "raw_entities"), items(F.get_json_object(body, "$.raw_entities.medications")))
        .when(get(body, "raw_medication_text").isNotNull(), F.array(body))
        .otherwise(F.array().cast("array<string>"))
    )
    own = F.when(~F.trim(body).startswith("["), get(body, "document_uid"))
    rows = df.select(key, F.coalesce(own, stable_id("DOC", F.col(key).cast("string"))).alias("own"), F.posexplode(listed).alias("position", "item"))
    name, uid = get(F.col("item"), *NAMES), F.coalesce(get(F.col("item"), "document_uid"), F.col("own"))
    rows = rows.select(key, "position", get(F.col("item"), "mention_id").alias("given"), uid.alias("document_uid"), name.alias("text"), F.coalesce(get(F.col("item"), "raw_strength_text"), F.lit("")).alias("strength"), F.coalesce(get(F.col("item"), "raw_dosage_text"), F.lit("")).alias("dosage"))
    made = stable_id("MENTION", F.col("document_uid"), F.col("text"), F.col("position"))
    return rows.where("text is not null").select(key, "position", F.coalesce("given", made).alias("mention_id"), "document_uid", "text", "strength", "dosage")


def document_records(df: DataFrame, key: str, json: str, collected: Column) -> DataFrame:
    """One record for each document: ids, pages (a number or null), language as lower-case codes, source type."""
    meta = F.get_json_object(json, "$.document_metadata")
    own = F.coalesce(get(meta, "document_id"), F.col(key).cast("string"))
    language = F.transform(as_list(F.get_json_object(meta, "$.language")), lambda x: F.lower(F.trim(x)))
    return df.select(
        key,
        stable_id("DOC", collected.cast("string"), own, F.sha2(json, 256)).alias("document_uid"),
        own.alias("source_document_id"),
        F.get_json_object(meta, "$.total_pages").try_cast("int").alias("total_pages"),
        language.alias("language"),
        F.get_json_object(meta, "$.source_type").alias("source_type"),
        F.sha2(json, 256).alias("source_sha256"),
    )


def page_records(df: DataFrame, document: str, page: Column, images: list[str], status: str) -> DataFrame:
    """Pages with their ids: of the document, the page's number (1 where none is given, null where it is no number), and
    the first image digest that there is. Only verified lineage is eligible."""
    number = F.when(page.isNull(), F.lit(1)).otherwise(page.cast("string").try_cast("int"))
    image = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in images))
    return df.select(document, number.alias("page_number"), stable_id("PAGE", F.col(document), number, image).alias("page_uid"), image.alias("image"), F.col(status).alias("lineage_status"), F.coalesce(F.col(status).isin(VERIFIED), F.lit(False)).alias("eligible"))


def mention_records(found: DataFrame, document: str, place: str, position: str, item: str, fields: dict[str, list[str]]) -> DataFrame:
    """Discovered objects as records: an id from document, place and position, and of each field the first name that is
    present (a null that is present wins). fields["text"] names the mention; objects without it are left out."""
    values = {k: first_present(F.col(item), names) for k, names in fields.items()}
    rows = found.select(document, place, position, stable_id("MENTION", F.col(document), F.col(place), F.col(position)).alias("mention_id"), *(v.alias(k) for k, v in values.items()))
    return rows.where("text is not null").withColumn("surface", lexical_surface(F.col("text")))


def context(df: DataFrame, key: str, json: str) -> DataFrame:
    """The context of documents: lists under the first of their names that holds something, and what else there is."""
    refs = items(F.get_json_object(json, "$.reference_annotations"))
    raw, other = F.get_json_object(json, "$.raw_entities"), F.get_json_object(F.try_element_at(refs, F.lit(1)), "$.raw_entities")
    merged = F.when(is_object(raw) & (F.size(F.json_object_keys(raw)) > 0), raw).when(is_object(other), other).otherwise("{}")
    rows = df.select(key, merged.alias("merged"))
    known = [n for names in CONTEXT.values() for n in names] + NOT_CONTEXT
    something = lambda n: F.when(~F.coalesce(F.get_json_object("merged", f"$.{n}").isin("", "[]", "{}", "0", "false"), F.lit(True)), F.get_json_object("merged", f"$.{n}"))
    lists = [as_list(F.coalesce(*(something(n) for n in names))).alias(k) for k, names in CONTEXT.items()]
    rest = F.filter(F.json_object_keys("merged"), lambda k: ~k.isin(known))
    return rows.select(key, *lists, rest.alias("other_context"))


def entities(df: DataFrame, key: str, json: str) -> DataFrame:
    """The entity lists of documents (key, list, position, text, evidence, page, warning): texts become entities, an
    empty text is filled from its evidence, and what stays empty is pruned; warnings say so, and pruned rows have no
    text."""
    lists = F.array(*(F.struct(F.lit(n).alias("list"), items(F.get_json_object(json, f"$.{n}")).alias("items")) for n in ENTITY_LISTS))
    rows = df.select(key, F.explode(lists).alias("l")).select(key, "l.list", F.posexplode("l.items").alias("position", "item"))
    item = F.col("item")
    text, evidence, whole = get(item, "raw_text"), get(item, "evidence_text"), is_object(item)
    warning = F.when(~whole, "converted").when(~blank(text), None).when(~blank(evidence), "populated").otherwise("pruned")
    value = F.when(~whole, item).when(~blank(text), text).when(~blank(evidence), evidence)
    rows = rows.where(whole | ~blank(item))
    page = F.coalesce(F.get_json_object(item, "$.page_number").try_cast("int"), F.lit(1))
    return rows.select(key, "list", "position", value.alias("text"), F.when(whole, F.coalesce(evidence, text)).otherwise(item).alias("evidence"), F.when(whole, page).otherwise(1).alias("page"), warning.alias("warning"))


def ground_truth_medications(df: DataFrame, key: str, json: str) -> DataFrame:
    """Medications of annotated documents: parts under either of their names, and the line, written anew from its parts
    where it is missing. A route that the name holds already isn't repeated."""
    rows = df.select(key, F.posexplode(items(F.get_json_object(json, "$.raw_entities.medications"))).alias("position", "item"))
    item = F.col("item")
    parts = {"name": get(item, "raw_medication_text", "raw_name")} | {p: get(item, f"raw_{p}_text", f"raw_{p}") for p in ("dosage", "route", "frequency", "duration", "instruction", "timing")}
    rows = rows.select(key, "position", "item", *(F.when(is_object(item), v).alias(k) for k, v in parts.items()))
    route = F.when(~F.coalesce(F.contains(F.coalesce("name", F.lit("")), F.col("route")), F.lit(False)), F.col("route"))
    rebuilt = F.concat_ws(" ", "name", "dosage", route, "frequency", "duration", "instruction", "timing")
    line = F.when(is_object(item), F.coalesce(get(item, "raw_line_text"), rebuilt)).otherwise(item)
    return rows.select(key, "position", line.alias("line"), F.when(is_object(item), F.col("name")).otherwise(item).alias("name"), "dosage", "route", "frequency", "duration", "instruction", "timing")


def source_type(value: Column) -> Column:
    """A source type in lower case, under its present name."""
    text = F.lower(F.trim(value))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair]), text), text)


def predictions(df: DataFrame, key: str, json: str) -> DataFrame:
    """Items of predictions by their stated category (key, position, category, text, evidence, dosage, frequency,
    duration, instruction); without one of the known categories an item is a medication."""
    rows = df.select(key, F.posexplode(items(F.get_json_object(json, "$.items"))).alias("position", "item"))
    item = F.col("item")
    clean = lambda *names: F.nullif(F.trim(get(item, *names)), F.lit(""))
    stated = F.get_json_object(item, "$.category")
    category = F.when(stated.isin(CATEGORIES), stated).otherwise("medication")
    other = F.coalesce(get(item, "medicine_name", "raw_text", "name"), F.lit(""))
    medication = F.coalesce(clean("raw_text"), clean("medicine_name", "name"))
    text = F.when(category == "medication", medication).otherwise(other)
    evidence = F.when(category == "medication", medication).otherwise(F.coalesce(get(item, "evidence_text"), other))
    return rows.select(key, "position", category.alias("category"), text.alias("text"), evidence.alias("evidence"), *(F.when(category == "medication", clean(n)).alias(a) for a, n in (("dosage", "dosage"), ("frequency", "frequency"), ("duration", "duration"), ("instruction", "instructions"))))


def raw_texts(df: DataFrame, key: str, json: str) -> DataFrame:
    """Entities of documents as texts, objects as JSON, in the order of RAW_TEXTS; then the follow-up. Blanks go."""
    groups = [F.transform(items(F.get_json_object(json, f"$.{n}")), lambda x: x) for n in RAW_TEXTS]
    follow = F.get_json_object(json, "$.follow_up")
    texts = F.concat(*groups, F.when(follow.isNotNull(), F.array(follow)).otherwise(F.array().cast("array<string>")))
    return df.select(key, F.posexplode(texts).alias("position", "text")).where("trim(text) <> ''")
