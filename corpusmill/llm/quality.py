"""Quality rules with cross-document line frequency, in DataFrame functions only.

Repeated word windows are found inside each row: window hashes come from three doubling steps over the word hashes,
and only a text in which a hash occurs twice pays for the sort that measures what the windows cover. Lines are counted
over distinct texts of a host; lines above the limit are removed, and a document that keeps too little is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, text_of, with_groups

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: A line of more distinct texts of one host than this is removed; a document needs this share of its words after that.
LINE_LIMIT, LEAST_LEFT = 20, 0.3


def _doubled(a: Column, by: Column, size: Column) -> Column:
    """Hashes of the pairs (a[i], a[i + by])."""
    n = size - by
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, by + 1, n), lambda x, y: F.xxhash64(x, y)))


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that stand in an 8-word window found twice or more in the array `words`."""
    h = F.col
    df = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_h2", _doubled(h("_h1"), F.lit(1), F.size("_h1")))
    df = df.withColumn("_h4", _doubled(h("_h2"), F.lit(2), F.size("_h2")))
    df = df.withColumn("_h8", _doubled(h("_h4"), F.lit(4), F.size("_h4")))
    df = df.withColumn("_twice", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.col("_h8")))
    df = df.withColumn("_sorted", F.sort_array(F.transform("_twice", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    n = F.size("_sorted") - 1
    pair = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    zipped = F.zip_with(F.slice("_sorted", F.lit(1), n), F.slice("_sorted", F.lit(2), n), pair)
    df = df.withColumn("_at", F.when(h("_twice").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(zipped, lambda x: x.isNotNull()))))))
    m = F.size("_at") - 1
    steps = F.zip_with(F.slice("_at", F.lit(1), m), F.slice("_at", F.lit(2), m), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.size("_at") > 0, F.aggregate(steps, F.lit(WINDOW), lambda x, y: x + y)).otherwise(F.lit(0))
    return df.withColumn(out, covered.cast("long")).drop("_h1", "_h2", "_h4", "_h8", "_twice", "_sorted", "_at")


def normal_line(line: Column) -> Column:
    """Case, kinds and runs of white space, outer white space and digits don't tell lines apart."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]", "0")


def measured(docs: DataFrame, host: str = "source", keep_text: bool = False) -> DataFrame:
    """A row per document with the base counts, the hash of the text, and (hash, words) of each line with a word."""
    df = docs.select(F.col("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_of().alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = repeated_words(df, "words", "n_repeat_words").drop("words")
    df = df.withColumn("own", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0))
    line = lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(F.filter(F.split(x, SPACE), lambda w: w != "")).alias("n"))
    return df.select(
        "doc_id",
        "host",
        "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.xxhash64("text").alias("same"),
        F.transform("own", line).alias("lines"),
        *([F.col("text")] if keep_text else []),
    )


def quality_rules(spark: SparkSession, docs: DataFrame, host: str = "source", line_limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT, keep_text: bool = False) -> DataFrame:
    """Base counts and verdict of docs (doc_id, text, and the host column; other columns are ignored).

    Returns a row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_left_words (words outside removed lines) and, with keep_text, `text` without the removed lines. kept is false
    where base_failed, or where fewer than 20 words or less than the share least_left of the words are left. A null
    text counts as empty, a null host as a host of its own; whole texts are read, however long; equal texts count once
    for a line, so that copies alone make no line frequent. Repeated rows each get a row. An empty table gives an empty
    result.
    """
    scratch = Scratch(spark, "quality")
    own = scratch.keep(measured(docs, host, keep_text).withColumn("row", F.monotonically_increasing_id()), "measured")
    each = own.select("host", "same", F.explode(F.array_distinct("lines.h")).alias("h"))
    gone = own.select("row", "host", "same", F.explode("lines").alias("x")).select("row", "host", "same", "x.h", "x.n")
    # a line of all documents of a host is joined in parts
    gone = with_groups(gone, ["host", "h"], "same", F.count("*").alias("texts"), where=f"texts > {int(line_limit)}", over=each.distinct())
    gone = gone.groupBy("row").agg(F.sum("n").alias("n_gone"), F.collect_set("h").alias("gone"))
    out = own.join(gone, "row", "left").withColumn("n_left_words", F.col("n_words") - F.coalesce("n_gone", F.lit(0)))
    enough = (F.col("n_left_words") >= LEAST_WORDS) & (F.col("n_left_words") >= least_left * F.col("n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & enough)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words"]
    if keep_text:
        left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), F.xxhash64(normal_line(x))))
        out = out.withColumn("text", F.array_join(left, "\n"))
        names.append("text")
    return out.select(*names)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {
    "op6_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own FROM d
), win AS (
  SELECT row, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), hit AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT row, count(DISTINCT i + k) AS n FROM hit, range(0, 8) r(k) GROUP BY row
), lines AS (
  SELECT row, host, text, unnest(own) AS line FROM w
), norm AS (
  SELECT row, host, text, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
    regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g') AS l FROM lines
), often AS (
  SELECT host, l FROM norm GROUP BY host, l HAVING count(DISTINCT text) > 20
), gone AS (
  SELECT row, sum(n) AS n FROM norm JOIN often USING (host, l) GROUP BY row
), base AS (
  SELECT w.row, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(own) - len(list_distinct(own)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(words) - coalesce(gone.n, 0) AS BIGINT) AS n_left_words
  FROM w LEFT JOIN cov ON cov.row = w.row LEFT JOIN gone ON gone.row = w.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_left_words >= 20 AND n_left_words >= 0.3 * n_words AS kept,
  n_left_words
FROM base""",
}
