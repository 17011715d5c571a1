"""Tri-state evidence and the decisions that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEVELS = {"BRAND_PRODUCT": "EXACT_LOCAL_PRODUCT", "BRAND_FAMILY": "LOCAL_BRAND_FAMILY", "CLINICAL_FORMULATION": "CLINICAL_FORMULATION", "INGREDIENT": "INGREDIENT_ONLY", "RXNORM_CONCEPT": "TERMINOLOGY_ONLY"}
PROMOTION_LEVELS = ["L1", "L2", "L3"]


def tri_state(seen: Column, known: Column) -> Column:
    """MATCH or CONFLICT where both sides say something, else NOT_COMPARABLE."""
    empty = lambda c: c.isNull() | (c.cast("string") == "")
    return F.when(empty(seen) | empty(known), "NOT_COMPARABLE").when(seen == known, "MATCH").otherwise("CONFLICT")


def tri_state_any(seen: Column, known: Column) -> Column:
    """As tri_state, against an array whose empty values don't count."""
    options = F.filter(known, lambda k: k.isNotNull() & (k != ""))
    return F.when(seen.isNull() | (seen == "") | known.isNull() | (F.size(options) == 0), "NOT_COMPARABLE").when(F.array_contains(options, seen), "MATCH").otherwise("CONFLICT")


def lexical_status(a: Column, b: Column, similarity: Column, best_rank: Column, threshold: float = 0.9) -> Column:
    return F.when((a == b) | (similarity >= threshold) | (best_rank <= 3), "MATCH").otherwise("NOT_COMPARABLE")


def codes(*conditions: tuple[Column, str]) -> Column:
    """The sorted distinct codes of the conditions that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(k)) for c, k in conditions)))))


def formulation(seen: str, facts: str) -> dict[str, Column]:
    """Comparisons of an observed formulation (strength, form, component_count, release_modifier, combination) with
    candidate facts (strengths, form, component_count, release_modifier), and their conflicts and gaps."""
    s, f = (lambda n: F.col(f"{seen}.{n}")), (lambda n: F.col(f"{facts}.{n}"))
    strength, form = tri_state_any(s("strength"), f("strengths")), tri_state(s("form"), f("form"))
    count, release = tri_state(s("component_count"), f("component_count")), tri_state(s("release_modifier"), f("release_modifier"))
    several = F.when(s("combination") & f("component_count").isNotNull() & (f("component_count") > 0), F.when(f("component_count") > 1, "MATCH").otherwise("CONFLICT")).otherwise("NOT_COMPARABLE")
    hard = codes((strength == "CONFLICT", "STRENGTH_CONFLICT"), (form == "CONFLICT", "DOSAGE_FORM_CONFLICT"), (count == "CONFLICT", "COMPONENT_COUNT_CONFLICT"), (release == "CONFLICT", "RELEASE_FORM_CONFLICT"), (several == "CONFLICT", "FDC_STRUCTURE_CONFLICT"))
    none = lambda c: c == "NOT_COMPARABLE"
    unseen = s("strength").isNull() | (s("strength") == "")
    missing = codes((none(strength) & unseen, "observed_strength_missing"), (none(strength) & ~unseen, "candidate_strength_missing"), (none(form), "dosage_form_missing"), (none(count), "component_count_missing"), (none(release), "release_modifier_missing"))
    return {"strength_status": strength, "form_status": form, "count_status": count, "release_status": release, "structure_status": several, "hard": hard, "missing": missing}


def provenance_status(states: Column, entity_type: Column) -> Column:
    return F.when(F.exists(states, lambda s: s.contains("AUTHORITATIVE")) | (entity_type == "RXNORM_CONCEPT"), "MATCH").when(F.size(states) > 0, "NOT_COMPARABLE").otherwise("UNKNOWN")


def quarantine_only(states: Column) -> Column:
    return (F.size(states) > 0) & F.forall(states, lambda s: s == "CANDIDATE_QUARANTINE")


def acceptance() -> Column:
    """SUPPORTED, or the first reason against. Reads resolution_level, hard, lexical_status, semantic_status,
    entity_type, states."""
    alone = quarantine_only(F.col("states"))
    return (
        F.when(F.col("resolution_level") == "OFFICIAL_EVIDENCE_ONLY", "OFFICIAL_SOURCE_RECORD_EVIDENCE_ONLY")
        .when(F.size("hard") > 0, "HARD_FORMULATION_CONFLICT")
        .when((F.col("lexical_status") != "MATCH") & (F.col("semantic_status") != "MATCH"), "WEAK_IDENTITY_EVIDENCE")
        .when((F.col("entity_type") == "BRAND_PRODUCT") & alone, "QUARANTINE_ONLY_PRODUCT")
        .when((F.col("entity_type") == "BRAND_FAMILY") & alone, "INSUFFICIENT_SOURCE_SUPPORT")
        .otherwise("SUPPORTED")
    )


def review_reasons() -> Column:
    """Sorted reason codes of a candidate that needs review. Reads hard, missing, entity_type, states."""
    has = lambda c, v: F.array_contains(F.col(c), v)
    kind, alone = F.col("entity_type"), quarantine_only(F.col("states"))
    found = codes(
        (has("hard", "STRENGTH_CONFLICT"), "STRENGTH_CONFLICT"),
        (has("hard", "DOSAGE_FORM_CONFLICT"), "DOSAGE_FORM_CONFLICT"),
        (has("hard", "COMPONENT_COUNT_CONFLICT") | has("hard", "FDC_STRUCTURE_CONFLICT"), "FDC_CONFLICT"),
        ((kind == "BRAND_PRODUCT") & alone, "QUARANTINE_ONLY_PRODUCT"),
        (((kind == "BRAND_FAMILY") & alone) | (kind == "OFFICIAL_SOURCE_RECORD"), "INSUFFICIENT_SOURCE_SUPPORT"),
        (has("missing", "candidate_strength_missing") | has("missing", "observed_strength_missing"), "MISSING_FORMULATION_EVIDENCE"),
        (kind == "RXNORM_CONCEPT", "TERMINOLOGY_CROSSWALK_UNCERTAIN"),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("MULTIPLE_PLAUSIBLE_CANDIDATES")))


def resolution(entity_type: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, entity_type), F.lit("NO_SUPPORTED_RESOLUTION"))


def decide(evidence: DataFrame) -> DataFrame:
    """For each mention the first acceptable candidate (ACCEPT), else the first that is more than an official record
    (HUMAN_REVIEW), else NIL. evidence: mention_id, final_rank, candidate_id, official boolean, acceptable boolean.

    One aggregation: a scan with a break is the minimum rank among the rows that pass.
    """
    first = lambda c: F.min_by(F.when(c, F.col("candidate_id")), F.when(c, F.col("final_rank")))
    rows = evidence.groupBy("mention_id").agg(first(F.col("acceptable")).alias("accepted"), first(~F.col("official")).alias("reviewed"))
    decision = F.when(F.col("accepted").isNotNull(), "ACCEPT").when(F.col("reviewed").isNotNull(), "HUMAN_REVIEW").otherwise("NIL")
    return rows.select("mention_id", decision.alias("decision"), F.coalesce("accepted", "reviewed").alias("candidate_id"))


def semantic_evidence(candidates: DataFrame, trace: DataFrame, branch: str) -> DataFrame:
    """candidates (mention_id, candidate_id, ...) with what a branch says of them: MATCH with the best rank, its score and
    alias where it returned the candidate, else NOT_COMPARABLE. trace: mention_id, candidate_id, branch, rank, score, alias."""
    best = F.min(F.struct("rank", (-F.col("score")).alias("minus"), "alias")).alias("best")
    found = trace.where(F.col("branch") == branch).groupBy("mention_id", "candidate_id").agg(best)
    rows = candidates.join(found, ["mention_id", "candidate_id"], "left")
    status = F.when(F.col("best").isNotNull(), "MATCH").otherwise("NOT_COMPARABLE")
    return rows.select(*candidates.columns, status.alias("semantic_status"), F.col("best.rank").alias("semantic_rank"), (-F.col("best.minus")).alias("semantic_score"), F.col("best.alias").alias("semantic_alias"))


def layer_b(selected: DataFrame) -> DataFrame:
    """What is published of a decision. selected: mention_id, decision, candidate_id, entity_type, facts (a struct of
    family_id, family_name, product_id, product_name, components, form, release_modifier, rxnorm, atc arrays); facts and
    candidate are null where nothing was selected.

    Official records are evidence and never a result; products are published only if they were accepted as such.
    """
    none = lambda c: F.coalesce(c, F.lit(""))
    chosen, official = F.col("candidate_id").isNotNull(), F.coalesce(F.col("entity_type") == "OFFICIAL_SOURCE_RECORD", F.lit(False))
    level = F.when(~chosen | official | (F.col("decision") == "NIL"), "NO_SUPPORTED_RESOLUTION").otherwise(resolution(F.col("entity_type")))
    exact = (F.col("decision") == "ACCEPT") & (level == "EXACT_LOCAL_PRODUCT")
    own, product = (lambda n: F.when(~official, none(F.col(f"facts.{n}"))).otherwise("")), (lambda n: F.when(exact, none(F.col(f"facts.{n}"))).otherwise(""))
    codes_of = F.array_sort(F.array_distinct(F.filter(F.coalesce("facts.atc", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    return selected.select(
        "mention_id",
        "decision",
        level.alias("resolution_level"),
        F.when(official, "").otherwise(none(F.col("candidate_id"))).alias("primary_candidate_id"),
        own("family_id").alias("family_id"),
        own("family_name").alias("family_name"),
        product("product_id").alias("product_id"),
        product("product_name").alias("product_name"),
        F.when(official, F.array().cast("array<string>")).otherwise(F.coalesce("facts.components", F.array().cast("array<string>"))).alias("components"),
        none(F.col("facts.form")).alias("dosage_form"),
        none(F.col("facts.release_modifier")).alias("release_modifier"),
        none(F.try_element_at("facts.rxnorm", F.lit(1))).alias("rxnorm"),
        codes_of.alias("atc_codes"),
    )


def decide_online(evidence: DataFrame, supported: DataFrame) -> DataFrame:
    """Decisions candidate by candidate, each tried as it is and then as its supported family, before the next one.

    evidence: mention_id, final_rank, candidate_id, entity_type, family, lexical_status, hard, official boolean,
    acceptable boolean, reasons; supported: family. It can differ from decide and then family_fallback, which looks at
    families only after all candidates. Reasons are those of the candidate that would have been reviewed, and stay when a
    later one is accepted as it is; a family has none.
    """
    rows = evidence.join(supported.distinct().withColumn("known", F.lit(True)), "family", "left")
    family = F.coalesce(F.col("known") & (F.col("lexical_status") == "MATCH") & (F.size("hard") == 0) & (F.col("family") != ""), F.lit(False))
    one = F.struct("final_rank", F.when(F.col("acceptable"), F.col("candidate_id").cast("string")).otherwise(F.concat(F.lit("FAMILY:"), "family")).alias("id"), F.col("acceptable").alias("as_it_is"))
    reviewed = F.struct("final_rank", F.col("candidate_id").cast("string").alias("id"), "reasons")
    best = rows.groupBy("mention_id").agg(F.min(F.when(F.col("acceptable") | family, one)).alias("a"), F.min(F.when(~F.col("official") & ~F.col("acceptable") & ~family, reviewed)).alias("r"))
    before = F.col("r").isNotNull() & (F.col("a").isNull() | (F.col("r.final_rank") < F.col("a.final_rank")))
    decision = F.when(F.col("a").isNotNull(), "ACCEPT").when(F.col("r").isNotNull(), "HUMAN_REVIEW").otherwise("NIL")
    reasons = F.when(before & (F.col("a").isNull() | F.col("a.as_it_is")), F.col("r.reasons")).when(decision == "NIL", F.array(F.lit("NO_DEFENSIBLE_CANDIDATE"))).otherwise(F.array().cast("array<string>"))
    return best.select("mention_id", decision.alias("decision"), F.coalesce("a.id", "r.id").alias("candidate_id"), reasons.alias("reasons"))


def top_candidates(ranked: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """For each mention its first n candidates as a JSON list, in the order of their ranks."""
    first = ranked.where(F.col("final_rank") <= n)
    return first.groupBy("mention_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))).alias("candidates"))


def family_fallback(decisions: DataFrame, evidence: DataFrame, supported: DataFrame) -> DataFrame:
    """Decisions with a supported family in place of none, or of an ingredient or a term alone.

    decisions: mention_id, decision, candidate_id, resolution_level; evidence: mention_id, final_rank, candidate_id,
    entity_type, family, lexical_status, hard; supported: family.
    """
    able = evidence.where("entity_type in ('BRAND_PRODUCT', 'BRAND_FAMILY') and lexical_status = 'MATCH' and size(hard) = 0").join(supported.distinct(), "family", "left_semi")
    best = able.groupBy("mention_id").agg(F.min_by("family", "final_rank").alias("fallback"))
    weak = (F.col("decision") != "ACCEPT") | F.col("resolution_level").isin("INGREDIENT_ONLY", "TERMINOLOGY_ONLY")
    use = weak & F.col("fallback").isNotNull()
    out = decisions.join(best, "mention_id", "left")
    return out.select("mention_id", F.when(use, "ACCEPT").otherwise(F.col("decision")).alias("decision"), F.when(use, F.col("fallback")).otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(use, "LOCAL_BRAND_FAMILY").otherwise(F.col("resolution_level")).alias("resolution_level"), use.alias("fallback_used"))


def promotable(levels: Column, official: Column, authenticated: Column) -> Column:
    return official & authenticated & (F.size(F.array_except(F.array(*map(F.lit, PROMOTION_LEVELS)), levels)) == 0)


def name_hallucinated(found: Column, truth: Column) -> Column:
    """Whether a name was found where the truth has none; the likeness to its address only says why."""
    return (F.coalesce(found, F.lit("")) != "") & (F.coalesce(truth, F.lit("")) == "")


def name_rationale(address_similarity: Column) -> Column:
    return F.when(address_similarity >= 70, "address taken for a name").otherwise("name without a truth")


def false_positive_kind(similarity: Column) -> Column:
    return F.when(similarity >= 80, "gap").when(similarity < 60, "hallucination").otherwise("review")


def quote_found(needle: Column, haystack: Column, words, share: float = 0.7) -> Column:
    """A quote counts if either text holds the other, or share of its distinct words occur."""
    a, b = F.array_distinct(words(needle)), F.array_distinct(words(haystack))
    return (needle != "") & (haystack.contains(needle) | needle.contains(haystack) | F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a) >= share).otherwise(False))


def violations(**checks: DataFrame) -> DataFrame:
    """The number of rows that break each invariant."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("invariant"), "violations")
        out = one if out is None else out.union(one)
    return out


def supported_families(products: DataFrame, validated: DataFrame, families: DataFrame, names: DataFrame) -> DataFrame:
    """Families of products (source_id, family) that were validated (source_id), and families (family, name) whose name an
    index has (name), once each."""
    by_product = products.join(validated.select("source_id"), "source_id", "left_semi").select("family")
    by_name = families.join(names.select("name"), "name", "left_semi").select("family")
    return by_product.union(by_name).where("family is not null and family <> ''").distinct()


def family_of(entity_type: Column, entity_id: Column, family: Column) -> Column:
    """The family that a candidate stands for: itself, or the one that its facts name."""
    return F.when(entity_type == "BRAND_FAMILY", entity_id).otherwise(F.coalesce(family, F.lit("")))


def facts_for(candidates: DataFrame, sources: dict[str, tuple[DataFrame, str, dict[str, str]]], columns: list[str]) -> DataFrame:
    """candidates (entity_type, entity_id text, ...) with facts from the source of their type: its frame, its key, and the
    column that each fact has there. Facts that a type doesn't have are null, and so are all of an unknown type."""
    out, found = candidates, {c: [] for c in columns}
    for i, (kind, (df, key, named)) in enumerate(sources.items()):
        side = df.select(F.col(key).cast("string").alias(f"_key{i}"), F.lit(kind).alias(f"_kind{i}"), *(F.col(v).cast("string").alias(f"_{c}{i}") for c, v in named.items()))
        out = out.join(side, (F.col("entity_type") == F.col(f"_kind{i}")) & (F.col("entity_id") == F.col(f"_key{i}")), "left")
        for c in named:
            found[c].append(F.col(f"_{c}{i}"))
    return out.select(*candidates.columns, *((F.coalesce(*cs) if cs else F.lit(None).cast("string")).alias(c) for c, cs in found.items()))
