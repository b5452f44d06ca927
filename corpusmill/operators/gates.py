"""Quality gates and predicates. A gate gives the first reason that applies, or its word for a good text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

#: What the filters of training candidates look for.
QA_WORDS = ["环境", "社会", "治理", "ESG", "CSR", "可持续发展", "碳排放", "员工", "培训", "供应链", "合规"]
EXTRACTION_MARKS = ["：", "、", "；", "1.", "2."]
#: How the reasons of gate_after begin, by the name of their counter.
REASONS = {
    "valid_text": "Valid text",
    "too_short": "Text too short",
    "private_use": "Contains private-use",
    "replacement": "Contains replacement",
    "ext_b": "Ext-B",
    "invalid_characters": "Valid character ratio",
    "uncommon_characters": "Uncommon character ratio",
    "neither_language": "Neither",
}


def too_short(text: Column, least: int) -> Column:
    return F.length(T.strip(T.filled(text))) < least


def _percent(part: Column, of: Column) -> Column:
    """The share in percent as C's printf("%.2f%%") has it: the double's exact value is rounded, ties to even.
    format_string rounds the shortest decimal that stands for the double, ties up."""
    return F.concat(F.format_number(F.lit(100.0) * part / F.greatest(of, F.lit(1)), 2), F.lit("%"))


def gate_before(text: Column, least: int = 80, valid: float = 0.70, uncommon: float = 0.20, ext_b: float = 0.01, ext_b_count: int = 10, chinese_only: bool = False, chinese: float = 0.60) -> Column:
    """The gate of whole documents and fresh chunks: 'OK' or the first reason."""

    def rule(p: Column) -> Column:
        share = {k: p[k] / F.greatest(p["n"], F.lit(1)) for k in ("valid", "odd", "cjk", "latin", "ext_b")}
        first = (
            F.when((p["ext_b"] >= ext_b_count) | (share["ext_b"] > ext_b), "Too many extended-B characters")
            .when(share["valid"] < valid, F.concat(F.lit("Valid character ratio too low ("), _percent(p["valid"], p["n"]), F.lit(")")))
            .when(share["odd"] > uncommon, F.concat(F.lit("Uncommon character ratio too high ("), _percent(p["odd"], p["n"]), F.lit(")")))
        )
        if chinese_only:
            first = first.when(share["cjk"] < chinese, F.concat(F.lit("Chinese ratio too low ("), _percent(p["cjk"], p["n"]), F.lit(f"), required ≥{chinese:.2%}")))
        else:
            first = first.when((share["cjk"] < 0.10) & (share["latin"] < 0.10), "Neither predominantly Chinese nor predominantly English")
        return first.otherwise("OK")

    text = T.filled(text)
    early = F.when(too_short(text, least), "Text too short or empty").when(F.contains(text, F.lit("\ufffd")), "Contains replacement character")
    return early.otherwise(T.let(T.profile(text), rule))


def gate_after(text: Column) -> Column:
    """The gate of the quality check on finished chunks: 'Valid text' or the first reason."""

    def rule(p: Column) -> Column:
        share = {k: p[k] / F.greatest(p["n"], F.lit(1)) for k in ("valid", "odd", "cjk", "latin", "ext_b")}
        return (
            F.when((p["ext_b"] >= 6) | (share["ext_b"] > 0.01), "Ext-B character ratio too high (possible garbled text)")
            .when(share["valid"] < 0.70, F.concat(F.lit("Valid character ratio too low ("), _percent(p["valid"], p["n"]), F.lit(")")))
            .when(share["odd"] > 0.15, F.concat(F.lit("Uncommon character ratio too high ("), _percent(p["odd"], p["n"]), F.lit(")")))
            .when((share["cjk"] < 0.15) & (share["latin"] < 0.15), "Neither predominantly Chinese nor English")
            .otherwise("Valid text")
        )

    text = T.filled(text)
    early = (
        F.when(too_short(text, 10), "Text too short or empty")
        .when(text.rlike(f"[{V.PRIVATE}]"), "Contains private-use chars (possible encoding/font issue)")
        .when(F.contains(text, F.lit("\ufffd")), "Contains replacement char \\uFFFD (possible encoding issue)")
    )
    return early.otherwise(T.let(T.profile(text), rule))


def quality_check(chunks: DataFrame, mode: str = "clean") -> DataFrame:
    """chunks (text) with `status` (valid, salvaged or invalid) and `reason`; in mode 'clean' an invalid text that is
    valid after sanitising, and was changed by it, is salvaged and replaced."""
    df = chunks.withColumn("reason", gate_after(F.col("text")))
    ok = F.col("reason") == "Valid text"
    if mode == "strict":
        return df.withColumn("status", F.when(ok, "valid").otherwise("invalid"))
    df = df.withColumn("_clean", T.sanitize(F.col("text")))
    saved = (gate_after(F.col("_clean")) == "Valid text") & (F.col("_clean") != T.filled(F.col("text")))
    df = df.withColumn("status", F.when(ok, "valid").when(saved, "salvaged").otherwise("invalid"))
    return df.withColumn("text", F.when(F.col("status") == "salvaged", F.col("_clean")).otherwise(F.col("text"))).drop("_clean")


def counted(checked: DataFrame, observation: Observation | str = "quality") -> DataFrame:
    """Rows with `status` and `reason`, whose counters the pass that writes them observes: n, how many are valid,
    salvaged and invalid, and how many had each of REASONS. Of a batch an Observation gives them once the rows are
    written, of a stream its progress does, so that nothing is scanned twice."""
    statuses = [F.count_if(F.col("status") == s).alias(s) for s in ("valid", "salvaged", "invalid")]
    return checked.observe(observation, F.count("*").alias("n"), *statuses, *(F.count_if(F.startswith("reason", F.lit(r))).alias(name) for name, r in REASONS.items()))


def structural_noise(text: Column) -> Column:
    """Tables of contents, notices and repeated page frames."""
    text = T.filled(text)
    rows = T.lines(text)
    n = F.size(rows)
    short = F.size(F.filter(rows, lambda x: F.length(T.strip(x)) < 30)) / n
    contents = (n > 20) & text.rlike(rf"(?m)^[{V.SPACE}]*[0-9a-z.\-]+[{V.SPACE}]+") & (short > 0.7)
    notice = (T.hits(F.lower(text), V.NOISE) > 0) & (F.length(text) < 500)
    first = T.strip(rows[0])
    frame = (n > 5) & (first != "") & (n - F.size(F.array_remove(rows, first)) >= n * 0.3)
    return contents | notice | frame


def candidates(chunks: DataFrame, kind: str) -> DataFrame:
    """Chunks that suit a kind of benchmark question: qa, extraction, classification or summary."""
    text = F.col("text")
    if kind == "qa":
        return chunks.where(F.length(text).between(200, 800) & (T.hits(text, QA_WORDS) > 0))
    if kind == "extraction":
        return chunks.where(text.rlike("[0-9]") & (T.hits(text, EXTRACTION_MARKS) > 0))
    if kind == "classification":
        return chunks.withColumn("label_primary", F.lit("")).withColumn("label_secondary", F.lit(""))
    if kind == "summary":
        return chunks.select("doc_id").distinct()
    raise ValueError(f"no such kind: {kind}")


def alpaca_reason(instruction: Column, output: Column) -> Column:
    """Null for a record that can be trained on."""
    return F.when(T.strip(T.filled(instruction)) == "", "empty_instruction").when(T.strip(T.filled(output)) == "", "empty_output")


def layer_of(name: Column, renamed: dict[str, str] | None = None) -> Column:
    """What stands before the first underscore, by its new name where it has one."""
    prefix = F.split_part(name, F.lit("_"), F.lit(1))
    if not renamed:
        return prefix
    table = F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))
    return F.coalesce(F.element_at(table, prefix), prefix)


#: Layers by their older names, and sections by what a document's name holds, the first that fits.
LAYERS = {"第一层": "Layer1", "第二层": "Layer2", "第三层": "Layer3", "第四层": "Layer4"}
SECTIONS = ((("治理",), "Governance Structure"), (("员工", "社会"), "Social Responsibility"), (("环境",), "Environmental Management"))


def known_layer(name: Column) -> Column:
    """Layer1 to Layer4 by what stands before the first underscore, by its older name too; else 'unknown'."""
    prefix = F.split_part(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(1))
    return F.when(prefix.isin(list(LAYERS.values())), prefix).otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair)), prefix), F.lit("unknown")))


def layer_within(path: Column) -> Column:
    """The first of Layer1 to Layer4, by number, that occurs in a path, or null."""
    return F.coalesce(*(F.when(F.contains(path, F.lit(x)), F.lit(x)) for x in LAYERS.values()))


def section_of(name: Column) -> Column:
    """The section that a document's name tells, or null."""
    return F.coalesce(*(F.when(T.hits(name, list(words)) > 0, F.lit(section)) for words, section in SECTIONS))


def rename(text: Column, renamed: dict[str, str]) -> Column:
    for old, new in renamed.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def task_type(expert: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in V.TASK_TYPES.items() for x in pair))
    return F.coalesce(F.element_at(table, expert), F.lit("unknown"))
