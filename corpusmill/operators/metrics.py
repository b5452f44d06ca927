"""Quality and overlap metrics of instruction-response pairs."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

#: Weights of the composite score.
WEIGHTS = {"fidelity": 0.25, "relevance": 0.25, "grounding": 0.20, "structure": 0.15, "diversity": 0.15}


def collaboration_quality(instruction: Column, response: Column, chunk: Column) -> Column:
    """0 for trivial pairs; else 0.3, up to 0.4 for the share of the chunk's first 3-grams in the response, and 0.3 for
    its length."""
    instruction, response, head = T.filled(instruction), T.filled(response), F.substring(T.filled(chunk), 1, 200)
    grams = F.array_distinct(T.grams(head, 3))
    share = T.count_with(grams, response, lambda g, r: F.contains(r, g)) / F.size(grams)
    first = F.substring(head, 1, 50)
    chars = T.grams(first, 1)
    few = T.count_with(chars, response, lambda c, r: F.contains(r, c)) / F.lit(50)
    overlap = F.when(F.size(grams) > 0, F.least(share * 0.4, F.lit(0.4))).otherwise(F.least(few * 0.4, F.lit(0.4)))
    length = F.when(F.length(response) > 50, 0.2).otherwise(0.0), F.when(F.length(response) > 100, 0.1).otherwise(0.0)
    good = (F.length(instruction) > 10) & (F.length(response) > 20)
    return F.when(good, F.least(F.lit(0.3) + overlap + length[0] + length[1], F.lit(1.0))).otherwise(0.0)


def relevance(output: Column, source: Column, words: list[str] | None = None) -> Column:
    """Share of the source's domain terms that the output has too; 1 if the source has none."""
    words = sorted({w.lower() for w in words or V.QUALITY})
    out, src = F.lower(T.filled(output)), F.lower(T.filled(source))
    in_source = T.hits(src, words)
    in_both = F.lit(0)
    for w in words:
        in_both = in_both + (F.contains(src, F.lit(w)) & F.contains(out, F.lit(w))).cast("int")
    return F.when(in_source == 0, 1.0).otherwise(in_both / in_source)


def structure(output: Column, least: int = 50, trivial: int = 20) -> Column:
    n = F.length(T.strip(T.filled(output)))
    return F.when(n <= trivial, 0.0).otherwise(F.least(F.lit(1.0), n / F.lit(float(least))))


def grounding(output: Column, source: Column) -> Column:
    """Share of the output's numbers, each time they occur, that the source has; half the structure if it has none."""
    own, theirs = T.numbers(output, "decimal"), T.numbers(source, "decimal")
    found = T.count_with(own, theirs, lambda n, t: F.array_contains(t, n))
    return F.when(F.size(own) == 0, structure(output) * 0.5).otherwise(found / F.size(own))


def _distinct(tokens: Column, n: int) -> Column:
    size = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat_ws("\x00", *(F.get(tokens, i + k) for k in range(n))))
    return F.when(size > 0, F.size(F.array_distinct(grams)) / size).otherwise(0.0)


def diversity(tokens: Column) -> Column:
    """Mean of distinct-2 and distinct-3 over mixed tokens."""
    return (_distinct(tokens, 2) + _distinct(tokens, 3)) / 2.0


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word for many rows of the table."""
    if not a or not b:
        return 0
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & place.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(candidate: Column | str, reference: Column | str) -> Column:
    """F1 of the longest common subsequence of two arrays of tokens; 0 if either is empty."""

    @F.pandas_udf("double")
    def run(candidate: pd.Series, reference: pd.Series) -> pd.Series:
        out = []
        for c, r in zip(candidate, reference, strict=True):
            n = lcs(list(c), list(r)) if c is not None and r is not None else 0
            p, q = (n / len(c), n / len(r)) if n else (0.0, 0.0)
            out.append(2 * p * q / (p + q) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return run(candidate, reference)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter stem of a lower-case word."""
    if len(word) <= 2:
        return word

    def shape(w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    measure = lambda w: len(re.findall("v+c+", shape(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"
    short = lambda w: shape(w).endswith("cvc") and w[-1] not in "wxy"

    def swapped(w: str, table: list[tuple[str, str]], least: int) -> str:
        for end, new in table:
            if w.endswith(end):
                head = w[: len(w) - len(end)]
                return head + new if measure(head) >= least else w
        return w

    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = swapped(w, STEPS[0], 1)
    w = swapped(w, STEPS[1], 1)
    for end in STEPS[2]:
        if w.endswith(end):
            head = w[: -len(end)]
            if measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


#: Suffixes of the published stemming algorithm, steps 2 to 4.
STEPS = (
    [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")],
    [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")],
    ["ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"],
)


def stemmed(tokens: Column | str) -> Column:
    """Tokens of more than three characters by their stems."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [stem(w) if len(w) > 3 else w for w in x] for x in lists])

    return run(tokens)


#: Weights of the reviewer's rubric, and the score below which a record goes through another round.
RUBRIC, AGAIN = {"correctness": 0.4, "completeness": 0.3, "relevance": 0.2, "structure": 0.1}, 0.6


def rubric(scores: DataFrame, threshold: float = AGAIN) -> DataFrame:
    """scores (correctness, completeness, relevance, structure, each 0 to 1) with `overall`, their weighted sum (to nine
    places, so that sums that are equal tie), and
    `feedback`, whether it is below the threshold. A missing score leaves both null."""
    overall = sum((F.col(k) * w for k, w in RUBRIC.items()), F.lit(0.0))
    return scores.withColumn("overall", F.round(overall, 9)).withColumn("feedback", F.col("overall") < threshold)


def best_round(rounds: DataFrame, key: str, number: str = "round", most: int = 2, threshold: float = AGAIN) -> DataFrame:
    """Of the rounds 0 to `most` of a record the best one, the earlier of equal ones; records that stay below the
    threshold go."""
    scored = rubric(rounds.where(F.col(number) <= most), threshold)
    best = scored.groupBy(key).agg(F.max_by(F.struct(*(c for c in scored.columns if c != key)), F.struct("overall", -F.col(number))).alias("x"))
    return best.select(key, "x.*").where(F.col("overall") >= threshold)


def model_scores(pairs: DataFrame) -> DataFrame:
    """pairs with the metrics that need a model, null: no model is at hand, and 0 would count in means."""
    return pairs.withColumn("bertscore", F.lit(None).cast("double")).withColumn("bleurt", F.lit(None).cast("double"))


def composite(pairs: DataFrame, output: str = "response", source: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """pairs with fidelity, relevance, grounding, structure, diversity and quality, their weighted sum."""
    w = weights or WEIGHTS
    if abs(sum(w.values()) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    df = T.once(T.once(pairs, "_c", T.mixed_tokens(F.col(output))), "_r", T.mixed_tokens(F.col(source)))
    df = df.withColumn("fidelity", rouge_l("_c", "_r")).withColumn("relevance", relevance(F.col(output), F.col(source)))
    df = df.withColumn("grounding", grounding(F.col(output), F.col(source))).withColumn("structure", structure(F.col(output))).withColumn("diversity", diversity(F.col("_c")))
    total = sum((F.col(name) * weight for name, weight in w.items()), F.lit(0.0))
    return df.withColumn("quality", total).drop("_c", "_r")


def filter_by_quality(pairs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    return composite(pairs, **options).where(F.col("quality") >= least)


def domain_relevance(text: Column, words: list[str] | None = None, compat: bool = False) -> Column:
    """min(2 hits / vocabulary, 1). compat: upper-case terms are looked for in lower-cased text and never occur."""
    words = words or V.INTRINSIC
    hit = T.hits(F.lower(T.filled(text)), [w for w in words if not compat or w == w.lower()], fold=not compat)
    return F.least(hit / F.lit(float(len(words))) * 2, F.lit(1.0))


def domain_hits(text: Column, words: list[str] | None = None, full: float = 3.0) -> Column:
    return T.presence(T.filled(text), words or V.EVALUATOR, full)


def factcheck_numbers(candidate: Column, source: Column, kind: str = "integer") -> Column:
    """Share of the candidate's distinct numbers that the source has; 1 if it has none."""
    own = F.array_distinct(T.numbers(candidate, kind))
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, T.numbers(source, kind))) / F.size(own))


def factcheck_tokens(candidate: Column, source: Column) -> Column:
    """Half the overlap of numbers, half that of words of three characters or more; an empty side counts 0."""
    words = lambda x: F.array_distinct(F.filter(F.split(T.filled(x), f"[{V.SPACE}]+"), lambda w: F.length(w) > 2))
    half = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)) * 0.5
    return half(F.array_distinct(T.numbers(candidate)), F.array_distinct(T.numbers(source))) + half(words(candidate), words(source))


def _bleu_counts(c: str, r: str) -> list[tuple[int, int]]:
    out = []
    for n in range(1, 5):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (c, r))
        out.append((sum(min(v, b[g]) for g, v in a.items()), max(sum(a.values()), 0)))
    return out


def bleu4_chars(candidate: Column | str, reference: Column | str) -> Column:
    """Character BLEU-4 without smoothing: 0 for texts under 4 characters or a precision of 0."""

    @F.pandas_udf("double")
    def run(candidate: pd.Series, reference: pd.Series) -> pd.Series:
        out = []
        for c, r in zip(candidate.fillna(""), reference.fillna(""), strict=True):
            value, counts = 0.0, _bleu_counts(c, r)
            if len(c) >= 4 and len(r) >= 4 and all(n for n, _ in counts):
                value = min(1.0, float(np.exp(1 - len(r) / len(c)))) * float(np.prod([n / t for n, t in counts])) ** 0.25
            out.append(value)
        return pd.Series(out, dtype="float64")

    return run(candidate, reference)


def bleu_words(candidate: Column | str, reference: Column | str) -> Column:
    """Sentence BLEU over white-space words; a precision without hits counts 0.1 hits."""

    @F.pandas_udf("double")
    def run(candidate: pd.Series, reference: pd.Series) -> pd.Series:
        out = []
        for c, r in zip(candidate, reference, strict=True):
            c, r = (c or "").split(), (r or "").split()
            logs, ok = [], bool(c and r)
            for n in range(1, 5):
                a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r))
                hit, total = sum(min(v, b[g]) for g, v in a.items()), max(sum(a.values()), 1)
                ok &= not (n == 1 and hit == 0)
                logs.append(np.log((hit or 0.1) / total))
            out.append(min(1.0, float(np.exp(1 - len(r) / len(c)))) * float(np.exp(np.mean(logs))) if ok else 0.0)
        return pd.Series(out, dtype="float64")

    return run(candidate, reference)


def corpus_bleu4(pairs: DataFrame, candidate: str, reference: str, by: list[str], epsilon: float = 0.1) -> DataFrame:
    """Character BLEU-4 over groups, from n-gram counts pooled over their rows. An order without hits counts `epsilon`
    hits; a row too short for an order counts one n-gram without a hit; no hit of single characters gives 0."""

    @F.pandas_udf("array<long>")
    def counts(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[v for hit, total in _bleu_counts(x or "", y or "") for v in (hit, max(total, 1))] + [len(x or ""), len(y or "")] for x, y in zip(c, r, strict=True)])

    df = pairs.withColumn("_n", counts(candidate, reference))
    df = df.groupBy(*by).agg(*(F.sum(F.col("_n")[i]).alias(f"n{i}") for i in range(10)))
    hit = lambda n: F.when(F.col(f"n{2 * n}") == 0, F.lit(epsilon)).otherwise(F.col(f"n{2 * n}"))
    logs = sum((F.log(hit(n) / F.col(f"n{2 * n + 1}")) for n in range(4)), F.lit(0.0)) / 4
    brevity = F.when(F.col("n8") > F.col("n9"), 1.0).otherwise(F.exp(1 - F.col("n9") / F.col("n8")))
    return df.select(*by, F.when((F.col("n8") > 0) & (F.col("n0") > 0), brevity * F.exp(logs)).otherwise(0.0).alias("bleu4"))


def _n_grams(df: DataFrame, text: str, n: int, by: list[str], unit: str) -> DataFrame:
    """(by ..., g): a row for each n-gram of each text."""
    if unit == "char":
        grams = T.grams(T.filled(F.col(text)), n)
    else:
        words = F.filter(F.split(T.filled(F.col(text)), f"[{V.SPACE}]+"), lambda w: w != "")
        df = T.once(df, "_w", words)
        size = F.size("_w") - n + 1
        grams = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat_ws(" ", *(F.get("_w", i + k) for k in range(n)))))
    return df.select(*by, F.explode(grams).alias("g"))


def distinct_n(df: DataFrame, text: str, n: int, by: list[str], unit: str = "char") -> DataFrame:
    """Distinct n-grams over all n-grams of each group's texts."""
    each = _n_grams(df, text, n, by, unit).groupBy(*by, "g").agg(F.count("*").alias("c"))
    return each.groupBy(*by).agg((F.count("*") / F.sum("c")).alias(f"distinct_{n}"))


#: The logarithm of the registers of a sketch: 1.04 / sqrt(2^14), a relative standard error of 0.8 %, in 16 KB at most.
SKETCH = 14


def distinct_sketches(df: DataFrame, text: str, n: int, by: list[str], unit: str = "char", size: int = SKETCH) -> DataFrame:
    """(by ..., sketch, grams): what distinct_of needs of each group's texts. N-grams are taken up where they are made and
    sketches are shuffled in their place. Kept per label and part of a growing collection, parts are never read again."""
    each = _n_grams(df, text, n, by, unit)
    return each.groupBy(*by).agg(F.hll_sketch_agg("g", size).alias("sketch"), F.count("*").alias("grams"))


def distinct_of(sketches: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by ..., distinct_n) of the union of all sketches of a group, at most 1, with the relative error of SKETCH; groups
    may be coarser than those of the sketches."""
    own = sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("d"), F.sum("grams").alias("c"))
    return own.select(*by, F.least(F.lit(1.0), F.col("d") / F.col("c")).alias(f"distinct_{n}"))


def evaluate(pairs: DataFrame, by: list[str], instruction: str = "instruction", response: str = "response", source: str = "source", quality: str | None = None) -> DataFrame:
    """Means of the row metrics of each group; rows without a source don't count in those that need one. Over whole
    groups: distinct_1 and distinct_2 of the responses' characters, and the metrics that need a model, null."""
    has = T.filled(F.col(source)) != ""
    only = lambda c: F.when(has, c)
    df = pairs.withColumn("_r", T.ascii_tokens(F.col(source))).withColumn("_c", T.ascii_tokens(F.col(response)))
    df = df.withColumn("_rouge", rouge_l("_c", "_r")).withColumn("_bleu", bleu4_chars(response, source))
    aggs = [
        F.count("*").alias("n"),
        F.avg(only(F.col("_rouge"))).alias("rouge_l"),
        F.avg(only(F.col("_bleu"))).alias("bleu4"),
        F.avg(domain_relevance(F.col(response))).alias("domain_relevance"),
        F.avg(only(factcheck_numbers(F.col(response), F.col(source)))).alias("factcheck"),
        F.avg(T.completeness(F.col(instruction), F.col(response))).alias("structural"),
    ]
    if quality:
        mean = F.avg(quality)
        aggs.append(F.when(F.max(quality) > 0, mean).alias("mean_quality"))
    out = df.groupBy(*by).agg(*aggs)
    for n in (1, 2):
        out = out.join(distinct_n(pairs, response, n, by), by, "left")
    return model_scores(out)
