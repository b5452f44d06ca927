"""Reading: document folders, JSON lines, knowledge bases, labelled result files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.gates import gate_before

#: Character sets that are tried in order.
CHARSETS = ("utf-8", "gbk", "gb2312", "gb18030", "big5", "latin1")


def list_files(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("pdf", "docx", "txt")) -> DataFrame:
    """(path, doc_id, suffix, content) of the files of these kinds under root. In no order: contents aren't sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(root)
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return files.select("path", T.doc_id(relative).alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("suffix"), "content")


def listing(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("pdf", "docx", "txt")) -> DataFrame:
    """(path, doc_id, suffix) by path; no content is read."""
    return list_files(spark, root, kinds).drop("content").orderBy("path")


def decoded_text(content: bytes | None, chinese: bool = True) -> str:
    """The text of bytes in an unknown character set: the first decoding that scores above 0.8, else the best. chinese:
    CJK characters are expected and make two fifths of the score."""
    best = (0.0, "")
    for charset in CHARSETS:
        text = (content or b"").decode(charset, "replace")
        n = len(text)
        if not n:
            return ""
        cjk = len(re.findall(r"[一-龥]", text))
        plain = cjk + len(re.findall(r"[a-zA-Z0-9\s，。！？、；：\"'（）【】《》·—,.!?;:()\[\]<>/\\\-]", text))
        valid = plain / n
        score = valid * 0.6 + cjk / n * 0.4 if chinese else valid
        score *= 0.3 if text.count("�") / n > 0.10 else 1.0
        score *= 0.5 if len(re.findall(r"[\ue000-\uf8ff]", text)) / n > 0.05 else 1.0
        score *= 0.2 if valid < 0.3 else 1.0
        if score > 0.8:
            return text
        if score > best[0]:
            best = (score, text)
    return best[1] if best[0] > 0.1 else (content or b"").decode("utf-8", "replace")


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, then table rows with cells joined by a space."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    rows = [words(p) for p in body.findall(f"{w}p")]
    rows += [" ".join(words(c).strip() for c in r.findall(f"{w}tc")) for t in body.iter(f"{w}tbl") for r in t.findall(f"{w}tr")]
    return "\n".join(x for x in rows if x.strip())


def pdf_pages(content: bytes) -> list[str]:
    """Page texts, by an optional library; an unreadable page is empty."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("reading PDF files needs the optional package pypdf") from error
    out = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # a broken page doesn't lose the file
            out.append("")
    return out


def parse_files(files: DataFrame, page_least: int = 80) -> DataFrame:
    """(doc_id, text, error): by suffix; pages of PDF files are repaired, cleaned and gated one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, suffix, content in zip(b["doc_id"], b["suffix"], b["content"], strict=True):
                try:
                    parts = {"txt": lambda c: [decoded_text(c)], "docx": lambda c: [docx_text(c)], "pdf": pdf_pages}[suffix](content)
                    rows += [(doc_id, suffix, k, p, None) for k, p in enumerate(parts)]
                except KeyError:
                    rows.append((doc_id, suffix, 0, "", f"unsupported file type: {suffix}"))
                except Exception as error:  # a file's failure is data
                    rows.append((doc_id, suffix, 0, "", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["doc_id", "suffix", "page", "text", "error"])

    pages = files.select("doc_id", "suffix", "content").mapInPandas(run, "doc_id string, suffix string, page int, text string, error string")
    fixed = T.sanitize(T.clean_text(T.fix_encoding(F.col("text"))))
    pages = pages.withColumn("text", F.when(F.col("suffix") == "pdf", fixed).otherwise(F.col("text")))
    good = (F.col("suffix") != "pdf") | (gate_before(F.col("text"), page_least) == "OK")
    pages = pages.withColumn("text", F.when(good, F.col("text")).otherwise(""))
    ordered = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("page", "text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), F.max("error").alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines): blank lines count as neither."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record"), parsed.where("r._corrupt_record is not null").select(F.col("value").alias("line"))


def knowledge_base(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): relations stay raw lines, since their fields are free."""
    entities = spark.read.schema("name string, description string, text string").json(f"{root}/esg_entities.jsonl")
    return entities, spark.read.text(f"{root}/esg_relations.jsonl").where(F.trim("value") != "").select(F.col("value").alias("raw"))


def labelled(spark: SparkSession, glob: str, pattern: str, schema: str) -> DataFrame:
    """Result files with `label`, the part of their path that the pattern's group takes."""
    return spark.read.schema(schema).json(glob).withColumn("label", F.regexp_extract(F.input_file_name(), pattern, 1))


def tolerant(raw: Column) -> Column:
    """One shape for records of several generators, from their JSON text: aliases fall through where they are empty."""
    get = lambda *paths: T.first_filled(*(F.get_json_object(raw, p) for p in paths))
    lists = F.coalesce(*(F.from_json(F.get_json_object(raw, p), "array<string>") for p in ("$.metadata.selected_experts", "$.metadata.experts", "$.metadata.expert_ids", "$.selected_experts")), F.array().cast("array<string>"))
    return F.struct(
        get("$.question", "$.instruction").alias("instruction"),
        get("$.answer", "$.output", "$.response").alias("response"),
        get("$.chunk", "$.text", "$.input", "$.metadata.chunk", "$.metadata.chunk_text", "$.metadata.text").alias("source"),
        get("$.chunk_id", "$.source_chunk_id", "$.metadata.chunk_id").alias("chunk_id"),
        get("$.doc_id", "$.source_doc_id", "$.metadata.doc_id").alias("doc_id"),
        F.coalesce(F.get_json_object(raw, "$.metadata.quality_score").try_cast("double"), F.get_json_object(raw, "$.quality_score").try_cast("double")).alias("quality_score"),
        lists.alias("experts"),
    )


@dataclass(frozen=True)
class Config:
    """Settings of a run, from a YAML file of nested mappings of plain values."""

    raw: str = "data/raw"
    processed: str = "data/processed"
    chunk_size: int = 512
    chunk_overlap: int = 50
    chunk_least: int = 100
    experts_least: int = 1
    experts_most: int = 3
    thresholds: tuple[float, float, float] = (0.3, 0.3, 0.5)


#: Where a file keeps each setting.
PLACES = {"raw": "data.raw_corpus_path", "processed": "data.processed_corpus_path", "chunk_size": "data.chunk_size", "chunk_overlap": "data.chunk_overlap", "chunk_least": "data.min_chunk_length", "experts_least": "coe.min_experts", "experts_most": "coe.max_experts"}
LEVELS = tuple(f"coe.layered_selection.{x}_layer_threshold" for x in ("analysis", "verification", "graph"))


def plain_yaml(text: str) -> dict:
    """Nested mappings, lists of plain values, and plain values of a YAML text; comments go. What else YAML can say is
    an error."""

    def value(x: str):
        x = x.strip()
        if x.startswith("[") and x.endswith("]"):
            return [value(v) for v in x[1:-1].split(",") if v.strip()]
        if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
            return x[1:-1]
        if x.lower() in ("true", "false", "null", "~", ""):
            return {"true": True, "false": False}.get(x.lower())
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                continue
        return x

    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for number, line in enumerate(text.split("\n"), 1):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip():
            continue
        depth, x = len(bare) - len(bare.lstrip()), bare.strip()
        if x.startswith("- "):
            if last is None or not isinstance(last[0][last[1]], list | None):
                raise ValueError(f"line {number} isn't understood: {line}")
            last[0][last[1]] = [*(last[0][last[1]] or []), value(x[2:])]
            continue
        name, colon, rest = x.partition(":")
        if not colon or (rest and not rest.startswith(" ")):
            raise ValueError(f"line {number} isn't understood: {line}")
        while depth <= open_[-1][0]:
            open_.pop()
        at, name = open_[-1][1], value(name)
        at[name] = value(rest)
        last = (at, name)
        if not rest.strip():
            open_.append((depth, _Later(at, name)))
    return root


class _Later(dict):
    """A mapping that takes its place in another one when it gets its first entry."""

    def __init__(self, outer: dict, name):
        super().__init__()
        self.outer, self.name = outer, name

    def __setitem__(self, key, value):
        super().__setitem__(key, value)
        self.outer[self.name] = self


def load_config(text: str) -> Config:
    """The settings that a YAML text states; others keep their defaults."""
    found = plain_yaml(text)

    def at(place: str):
        here = found
        for part in place.split("."):
            here = here.get(part) if isinstance(here, dict) else None
        return here

    stated = {name: v for name, place in PLACES.items() if (v := at(place)) is not None}
    levels = tuple(at(place) for place in LEVELS)
    return Config(**stated, **({"thresholds": tuple(map(float, levels))} if None not in levels else {}))
