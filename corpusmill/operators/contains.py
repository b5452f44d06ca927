"""Which of very many words stand in which texts, by joins on rare character n-grams.

A text holds a word only if it holds all n-grams of the word; of these the one that fewest texts hold is the word's sign.
Texts meet words by their signs alone, and what meets is verified. So neither does each text go through all words, nor
does one task or the driver hold all of them: the list may be a knowledge base of millions.

Where no word has a space, none reaches across one: texts are cut at spaces, and each distinct piece meets the words once,
however many texts it stands in. Texts themselves are neither shuffled nor searched then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import Scratch
from .groups import join_unique

#: Words of a sign that come together in an array.
TOGETHER = 256


def contains_join(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word", n: int | None = None) -> DataFrame:
    """(key, word): a row for each row of docs and each distinct word that stands anywhere in its text, as it is written.

    n: characters of a sign; without it those of the shortest word, from 3 to 7. Words shorter than n are signs of their
    own. Null texts and null or empty words hold and are held by nothing; repeated rows of docs each count, repeated words
    once; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "contains")
    words = scratch.keep(words.select(F.col(word).cast("string").alias("word")).where("word <> ''").distinct(), "words")
    shortest, spaced = words.agg(F.coalesce(F.min(F.length("word")), F.lit(0)), F.count_if(F.contains("word", F.lit(" ")))).first()
    n = n or max(3, min(shortest, 7))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text <> ''")
    if spaced:
        own = scratch.keep(own, "docs")
        return own.join(_held(scratch, own, words, n), "row").select(F.col("key").alias(key), F.explode("words").alias("word"))
    pieces = F.array_distinct(F.filter(F.split("text", " "), lambda x: F.length(x) >= max(shortest, 1)))
    pieces = scratch.keep(own.select("row", "key", F.explode(pieces).alias("piece")), "pieces")
    each = scratch.keep(pieces.select(F.col("piece").alias("text")).distinct().withColumn("row", F.monotonically_increasing_id()), "each")
    held = each.join(_held(scratch, each, words, n), "row").select(F.col("text").alias("piece"), "words")
    found = join_unique(pieces, scratch.keep(held, "found"), ["piece"], "row")
    # a word may stand in several pieces of a text
    return found.select("row", "key", F.explode("words").alias("word")).distinct().select(F.col("key").alias(key), "word")


def _held(scratch: Scratch, own: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(row, words): the words that stand in the text of each row (row, text) that holds any."""
    sizes = sorted(r[0] for r in words.select(F.least(F.length("word"), F.lit(n)).alias("n")).distinct().collect())  # n at most
    of_text = F.array_distinct(F.concat(*(T.grams(F.col("text"), k) for k in sizes)) if sizes else F.array().cast("array<string>"))
    of_word = F.when(F.length("word") < n, F.array("word")).otherwise(T.grams(F.col("word"), n))
    parts = words.select("word", F.explode(F.array_distinct(of_word)).alias("g"))
    # n-grams of texts that no word has go before anything is shuffled, where those of words are few enough to be sent
    wanted = scratch.keep(parts.select("g").distinct(), "wanted")
    held = scratch.keep(own.select("row", F.explode(of_text).alias("g")).join(wanted, "g", "left_semi"), "held")
    counts = held.groupBy("g").agg(F.count("*").alias("n"))
    signs = parts.join(counts, "g", "left").groupBy("word").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all")
    signs = scratch.keep(signs.select("g", "word"), "signs")
    each = signs.groupBy("g").agg(F.ceil(F.count("*") / TOGETHER).alias("chunks"))
    signs = join_unique(signs, each, ["g"], "word").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")))
    lists = signs.groupBy("g", "chunk").agg(F.collect_list("word").alias("words"))
    met = join_unique(held, each, ["g"], "row").select("row", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    met = join_unique(met, lists, ["g", "chunk"], "row").groupBy("row").agg(F.flatten(F.collect_list("words")).alias("words"))
    return own.join(met, "row").select("row", F.filter("words", lambda w: F.contains("text", w)).alias("words")).where(F.size("words") > 0)
