"""Feature extraction and the choice of experts for a chunk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import Scratch

IDS = [e[0] for e in V.EXPERTS if e[1] != "reserved"]
LAYER = {name: [e[0] for e in V.EXPERTS if e[1] == name] for name in ("base", "analysis", "verification", "graph")}
#: Named threshold profiles (analysis, verification, graph).
PROFILES = {"config": (0.3, 0.3, 0.5), "published": (0.6, 0.7, 0.8)}


def _claims(text: Column, patterns: list[str]) -> Column:
    hits = reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))
    return F.least(hits / F.lit(2.0), F.lit(1.0))


def features_15(text: Column, compat: bool = False) -> Column:
    """15 features. compat: upper-case terms of the density vocabulary are looked for in lower-cased text, so they never
    occur, though they count in the divisor; by default case doesn't count."""
    text = T.filled(text)
    f = {name: T.presence(text, words, full) for name, (words, full) in V.SELECTOR.items()}
    words, full = V.SELECTOR["esg_keyword_density"]
    f["esg_keyword_density"] = T.presence(F.lower(text), [w for w in words if not compat or w == w.lower()], full, fold=not compat)
    return F.struct(
        F.length(text).cast("double").alias("length"),
        F.size(F.filter(F.split(text, f"[{V.SPACE}]+"), lambda w: w != "")).cast("double").alias("word_count"),
        F.least(F.size(T.numbers(text)) / F.lit(10.0), F.lit(1.0)).alias("has_numbers"),
        f["has_entities"].alias("has_entities"),
        f["has_question_keywords"].alias("has_question_keywords"),
        f["has_structured_data"].alias("has_structured_data"),
        f["esg_keyword_density"].alias("esg_keyword_density"),
        f["comparative_keywords"].alias("comparative_keywords"),
        f["temporal_keywords"].alias("temporal_keywords"),
        F.least(T.year_mentions(text) / F.lit(3.0), F.lit(1.0)).alias("year_mentions"),
        f["industry_keywords"].alias("industry_keywords"),
        f["vague_commitments"].alias("vague_commitments"),
        f["standard_keywords"].alias("standard_keywords"),
        _claims(text, V.CLAIMS).alias("verifiable_claims"),
        f["performance_keywords"].alias("performance_keywords"),
    )


def features_14(text: Column) -> Column:
    """14 bilingual features."""
    text = T.filled(text)
    low = F.lower(text)
    folded = [T.presence(low, words, full, fold=True).alias(name) for name, (words, full) in V.BILINGUAL.items()]
    return F.struct(
        F.least(F.length(text) / F.lit(2000.0), F.lit(1.0)).alias("length"),
        F.least(F.size(T.numbers(text, "decimal")) / F.lit(10.0), F.lit(1.0)).alias("numerical_density"),
        F.least(T.year_mentions(text) / F.lit(3.0), F.lit(1.0)).alias("year_mentions"),
        *folded,
        T.presence(text, *V.BILINGUAL_MARKS).alias("structured_data"),
        T.presence(text, *V.BILINGUAL_ENTITIES).alias("entity_density"),
        _claims(text, V.CLAIMS_BILINGUAL).alias("verifiable_claims"),
    )


def with_features(df: DataFrame, features: Column, out: str = "f") -> DataFrame:
    return T.once(df, out, features)


def scores_15(f: Column) -> dict[str, Column]:
    half = F.lit(0.5)
    return {
        "qa_expert": f["has_question_keywords"] * half + f["esg_keyword_density"] * half,
        "summary_expert": F.when(f["length"] > 300, 1.0).otherwise(f["length"] / 300) * half + f["has_structured_data"] * half,
        "extraction_expert": f["has_structured_data"] * 0.4 + f["has_numbers"] * 0.3 + f["has_entities"] * 0.3,
        "classification_expert": f["esg_keyword_density"] * 0.7 + f["has_entities"] * 0.3,
        "analysis_expert": f["comparative_keywords"] * 0.6 + f["has_entities"] * 0.4,
        "temporal_analysis_expert": f["temporal_keywords"] * half + f["year_mentions"] * half,
        "benchmark_comparison_expert": f["industry_keywords"] * 0.6 + f["comparative_keywords"] * 0.4,
        "greenwashing_detection_expert": f["vague_commitments"] * 0.6 + f["verifiable_claims"] * 0.4,
        "standard_alignment_expert": f["standard_keywords"] * 0.7 + f["has_structured_data"] * 0.3,
        "knowledge_graph_expert": f["has_entities"] * 0.6 + f["has_structured_data"] * 0.4,
        "consistency_verification_expert": f["has_numbers"] * 0.6 + f["comparative_keywords"] * 0.4,
    }


def scores_14(f: Column) -> dict[str, Column]:
    return {
        "qa_expert": f["carbon_keywords"] * 0.5 + f["numerical_density"] * 0.3 + f["length"] * 0.2,
        "summary_expert": f["length"] * 0.5 + f["structured_data"] * 0.3 + f["carbon_keywords"] * 0.2,
        "extraction_expert": f["structured_data"] * 0.4 + f["numerical_density"] * 0.3 + f["entity_density"] * 0.3,
        "classification_expert": (f["carbon_keywords"] + f["social_keywords"] + f["governance_keywords"]) / 3 * 0.7 + f["entity_density"] * 0.3,
        "analysis_expert": f["comparative_language"] * 0.6 + f["entity_density"] * 0.4,
        "temporal_analysis_expert": f["temporal_markers"] * 0.5 + f["year_mentions"] * 0.5,
        "benchmark_comparison_expert": f["industry_keywords"] * 0.6 + f["comparative_language"] * 0.4,
        "greenwashing_detection_expert": f["vague_commitments"] * 0.6 + f["verifiable_claims"] * 0.4,
        "standard_alignment_expert": f["standards_language"] * 0.7 + f["structured_data"] * 0.3,
        "knowledge_graph_expert": f["entity_density"] * 0.6 + f["structured_data"] * 0.4,
        "consistency_verification_expert": f["numerical_density"] * 0.6 + f["comparative_language"] * 0.4,
    }


def _ranked(scores: dict[str, Column], names: list[str]) -> Column:
    """The experts by falling score; of equal ones the earlier in the catalogue first."""
    rows = [F.struct((-scores[n]).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("id")) for k, n in enumerate(names)]
    return F.sort_array(F.array(*rows))


def by_rule(f: Column, least: int = 1, most: int = 3, threshold: float = 0.3) -> Column:
    """Experts above the threshold by falling score, filled up from the ranking to `least`."""
    ranked = _ranked(scores_15(f), IDS)
    over = F.transform(F.slice(F.filter(ranked, lambda x: -x["s"] > threshold), 1, most), lambda x: x["id"])
    return F.when(F.size(over) >= least, over).otherwise(F.transform(F.slice(ranked, 1, least), lambda x: x["id"]))


def by_layer(f: Column, least: int = 1, most: int = 3, thresholds: tuple[float, float, float] = PROFILES["config"]) -> Column:
    """The best base expert; up to two of the analysis layer; one of the verification layer; the graph expert; cut to
    `most` and filled up from the base layer, in its order, to `least`."""
    analysis, verification, graph = thresholds
    none = F.array().cast("array<string>")
    one = lambda name, ok: F.when(ok, F.array(F.lit(name))).otherwise(none)
    base = F.array(_ranked(scores_15(f), LAYER["base"])[0]["id"])
    middle = F.concat(one("temporal_analysis_expert", f["temporal_keywords"] > analysis), one("benchmark_comparison_expert", f["industry_keywords"] > analysis), one("greenwashing_detection_expert", f["vague_commitments"] > analysis))
    check = F.when(f["has_numbers"] > verification, F.array(F.lit("consistency_verification_expert"))).otherwise(one("standard_alignment_expert", f["standard_keywords"] > verification))
    last = one("knowledge_graph_expert", (f["has_entities"] > graph) & (f["has_structured_data"] > 0.3))
    chosen = F.slice(F.concat(base, F.slice(middle, 1, 2), check, last), 1, most)
    spare = F.array_except(F.array(*(F.lit(x) for x in LAYER["base"])), chosen)
    return F.concat(chosen, F.slice(spare, F.lit(1), F.greatest(F.lit(0), least - F.size(chosen))))


def by_appendix(f: Column, threshold: float = 0.5, most: int = 3) -> Column:
    """The best base expert, then every expert of the other layers at or above the threshold, in layer order, to `most`."""
    s = scores_14(f)
    base = F.array(_ranked(s, LAYER["base"])[0]["id"])
    rest = [*LAYER["analysis"], "consistency_verification_expert", "standard_alignment_expert", *LAYER["graph"]]
    over = F.filter(F.array(*(F.when(s[n] >= threshold, F.lit(n)) for n in rest)), lambda x: x.isNotNull())
    return F.slice(F.concat(base, over), 1, most)


def route(chunks: DataFrame, strategy: str = "layered", text: str = "text", **options) -> DataFrame:
    """chunks with `experts` and `selection_reasons` (method, features, number)."""
    pick = {"layered": by_layer, "rule": by_rule, "appendix": by_appendix}[strategy]
    df = with_features(chunks, (features_14 if strategy == "appendix" else features_15)(F.col(text)))
    df = df.withColumn("experts", pick(F.col("f"), **options))
    return df.withColumn("selection_reasons", F.struct(F.lit(strategy).alias("method"), F.col("f").alias("features"), F.size("experts").alias("selected_count"))).drop("f")


def best_profile(rows: DataFrame, stored: str = "experts", text: str = "text") -> DataFrame:
    """(profile, match_rate), best first: the share of rows whose stored choice each profile of thresholds repeats."""
    df = Scratch(rows.sparkSession, "profiles").keep(with_features(rows, features_15(F.col(text))).select(stored, "f"))
    same = df.select(*(by_layer(F.col("f"), thresholds=t).eqNullSafe(F.col(stored)).cast("double").alias(n) for n, t in PROFILES.items()))
    rates = same.agg(*(F.avg(n).alias(n) for n in PROFILES))
    return rates.unpivot([], list(PROFILES), "profile", "match_rate").orderBy(F.desc("match_rate"), "profile")


def differences(rows: DataFrame, key: str, stored: str = "experts", text: str = "text", strategy: str = "layered", **options) -> DataFrame:
    """(key, same, missing, extra) of stored choices against recomputed ones: experts that only the stored choice has,
    and that only the new one has. A stored null has nothing."""
    df = route(rows.select(key, F.coalesce(F.col(stored), F.array().cast("array<string>")).alias("_stored"), F.col(text).alias("_text")), strategy, "_text", **options)
    return df.select(key, (F.col("_stored") == F.col("experts")).alias("same"), F.array_except("_stored", "experts").alias("missing"), F.array_except("experts", "_stored").alias("extra"))
