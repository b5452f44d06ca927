"""Keyword tagging, knowledge retrieval and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

ITEM = "array<struct<type:string,content:string,source:string>>"
MOST = 5


def keywords(text: Column, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """'dimension:keyword' of the keywords that occur, in the order of the vocabulary; case doesn't count."""
    return T.chosen(F.lower(T.filled(text)), {f"{d}:{w}": w.lower() for d, words in (vocabulary or V.KNOWLEDGE).items() for w in words})


def topics(text: Column, words: list[str] | None = None, most: int = MOST, default: list[str] | None = None) -> Column:
    found = F.slice(T.found_words(T.filled(text), words or V.TOPICS), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*(F.lit(x) for x in default or V.TOPICS_DEFAULT)))


def _item(kind: str, content: Column, source: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(source).alias("source"))


def retrieve(chunks: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None, key: str = "chunk_id", text: str = "text", vocabulary: dict[str, list[str]] | None = None, most: int = MOST, order: str | None = None, compat: bool = False) -> DataFrame:
    """chunks with `knowledge`: entities and relations of the knowledge base that hold one of the chunk's keywords, then
    keyword items, then the standard item; at most `most`.

    The vocabulary, not the chunks, meets the knowledge base: each entry is tagged with the keywords it holds, and tags
    are joined by equality. Entries come in the order of the column `order`, without one in that of their files. Of each
    keyword's entries only the first `most` in order can come into a list that is cut there, so no popular keyword
    gathers more. compat: keywords are looked for in lower-cased entries as they are, so upper-case ones never occur.
    """
    vocabulary = vocabulary or V.KNOWLEDGE
    words = sorted({w if compat else w.lower() for ws in vocabulary.values() for w in ws})
    df = chunks.withColumn("_k", keywords(F.col(text), vocabulary))
    bare = lambda k: (lambda w: w if compat else F.lower(w))(F.element_at(F.split(k, ":"), -1))
    parts = []
    for rank, (base, kind) in enumerate(((entities, "entity"), (relations, "relation"))):
        if base is None:
            continue
        body, content = ("text", F.concat(F.lit("Entity: "), T.filled(F.col("name")), F.lit(" - "), T.filled(F.col("description")))) if kind == "entity" else ("raw", F.concat(F.lit("Relation: "), F.col("raw")))
        tagged = base.select((F.col(order) if order else F.monotonically_increasing_id()).alias("at"), content.alias("content"), F.lower(T.filled(F.col(body))).alias("_t"))
        tagged = tagged.select("at", "content", F.explode(T.chosen(F.col("_t"), {w: w for w in words})).alias("word"))
        # the first of a keyword come from the first of its parts, so that no task ranks all entries of a popular one
        first = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("at", "content"))).where(F.col("_r") <= most).drop("_r")
        few = first(first(tagged.withColumn("_p", F.pmod(F.xxhash64("content"), F.lit(64))), "word", "_p").drop("_p"), "word")
        parts.append(few.select("word", F.lit(rank).alias("rank"), F.lit(kind).alias("type"), "at", "content"))
    low = F.lower(T.filled(F.col(text)))
    plain = F.transform(F.slice("_k", 1, most), lambda k: _item("keyword", F.concat(F.lit("ESG keyword: "), F.element_at(F.split(k, ":"), 2), F.lit(" (dimension: "), F.element_at(F.split(k, ":"), 1), F.lit(")")), "builtin"))
    gri = F.when(F.contains(low, F.lit("gri")) | F.contains(low, F.lit("实质性")), F.array(_item("standard", F.lit("GRI: Global Reporting Initiative sustainability reporting standards"), "builtin"))).otherwise(F.array().cast(ITEM))
    own = F.array().cast(ITEM)
    if parts:
        base = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        each = df.select(key, F.explode(F.array_distinct(F.transform("_k", bare))).alias("word")).join(base, "word").select(key, "rank", "type", "at", "content").distinct()
        # at most `most` entries for each word of the vocabulary come together here
        listed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "at", "content", "type"))).alias("_b"))
        df = df.join(listed, key, "left")
        own = F.coalesce(F.transform("_b", lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"), F.lit("knowledge_base").alias("source"))), own)
    df = df.withColumn("knowledge", F.slice(F.concat(own, plain, gri), 1, most))
    return df.select(*chunks.columns, "knowledge")


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["content"], F.lit("\n"))), "")


def inject(prompt: Column, items: Column) -> Column:
    head, tail = "\n\nRelevant ESG domain knowledge:\n", "\n\nGenerate high-quality instruction-answer pairs based on the above ESG domain knowledge."
    return F.when(F.size(items) == 0, prompt).otherwise(F.concat(prompt, F.lit(head), _numbered(items), F.lit(tail)))


def summary(items: Column) -> Column:
    rows = F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x["type"], F.lit(": "), F.substring(x["content"], 1, 50), F.lit("...\n"))), "")
    return F.when(F.size(items) == 0, "No relevant domain knowledge").otherwise(F.concat(F.lit("Retrieved "), F.size(items).cast("string"), F.lit(" knowledge items:\n"), rows))


def default_instruction(expert: Column) -> Column:
    table = F.create_map(*(F.lit(x) for e in V.EXPERTS for x in (e[0], e[3])))
    return F.coalesce(F.element_at(table, expert), F.lit(V.DEFAULT_INSTRUCTION))


#: Templates of training prompts, without and with an input, by language.
ALPACA = {
    "en": (
        "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Response:\n",
        "Below is an instruction that describes a task, paired with further context. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n",
    ),
    "zh": (
        "以下是一个描述任务的指令。请编写一个适当完成请求的回复。\n\n### 指令：\n{instruction}\n\n### 回复：\n",
        "以下是一个描述任务的指令，并附有进一步的上下文信息。请编写一个适当完成请求的回复。\n\n### 指令：\n{instruction}\n\n### 输入：\n{input}\n\n### 回复：\n",
    ),
}


def alpaca_prompt(instruction: Column, source: Column, language: str = "en", output: Column | None = None) -> Column:
    """The training prompt of a record, with its output where one is given; a blank input takes the template without."""

    def filled(template: str) -> Column:
        parts = [F.lit(x) if i % 2 == 0 else {"instruction": T.filled(instruction), "input": T.filled(source)}[x] for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
        return F.concat(*parts, *([T.filled(output)] if output is not None else []))

    plain, with_input = ALPACA[language]
    return F.when(T.strip(T.filled(source)) == "", filled(plain)).otherwise(filled(with_input))


def alpaca_text(instruction: str, source: str, language: str = "en") -> str:
    """The same as `alpaca_prompt`, of plain texts."""
    plain, with_input = ALPACA[language]
    return (with_input if source.strip(V.SPACES) else plain).format(instruction=instruction, input=source)
