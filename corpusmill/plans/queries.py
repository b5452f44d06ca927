"""Queries over the driver's tables, one for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import chunking, dedup, gates, generation, knowledge, metrics, routing, sampling, stats
from ..session import Scratch, table
from ..streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Parts of the SQL, made from the same fixed values as the operators.
S = r"[ \t\n\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = lambda x: f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"
CNT = lambda x, body: f"len(regexp_extract_all({x}, '[{body}]'))"
EXT_S, PRIVATE_S = r"\x{20000}-\x{2A6DF}", r"\x{E000}-\x{F8FF}"
CJK_S = "一-龥"
PUNCT_S = r"，。！？、；：\"''（）【】《》·—,.!?;:()\[\]<>/\\\-" + r" \t\n\r\f\x0b\x{a0}\x{3000}"
ODD_S = r"^\x00-\x7F一-龥，。！？、；：（）【】《》·—" + r"\x{a0}\x{3000}"


quoted = lambda x: "'" + x.replace("'", "''") + "'"

#: Rows with Chinese text and with characters that only broken texts have: the vocabularies and the gates' rules are
#: about these, and the tables hold Latin texts. They are added to the documents, on both sides of a comparison.
_REPORT = "公司致力于减少碳排放，2023年排放量降低了15%，2022年为20%，与行业平均水平相比低于基准。员工培训、环保治理和合规管理：1. 计划 2. 目标；预计明年实现30%的增长（趋势）。"
EXTRA = [
    (-1, _REPORT),
    (-2, "本公司依据GRI、TCFD、SASB和ISO标准披露环境、社会与治理信息，" * 4),
    (-3, "什么是碳中和？如何实现？为什么重要？对比去年，今年的成效和成果达成了目标，完成率提高了12%。" * 3),
    (-4, "环境报告" + chr(0xFFFD) + "正文内容" * 30),
    (-5, "附录说明" * 20 + chr(0x20000) * 12 + "结束"),
    (-6, "私有区字符" * 20 + chr(0xE000) + "末尾"),
    (-7, "Привет мир " * 20),
    (-8, "®©™§¶" * 30 + "text"),
    (-9, "　\n 短 　"),
    (-10, "第 3 页 / 共 12 页\n" + _REPORT + "\n[图片]\n[图12] Page 3 of 9\n\n\n\n12\n" + _REPORT),
    (-11, "免责声明：本报告仅供参考。" + "公司" * 20),
    (-12, "The company is committed to lower carbon emission, reduced by 15 since 2020 and 2021; ranked higher than the industry average. GRI, ISO; energy, safety, audit. " * 3),
    (-13, "统计 1,234.5 与 67.8% 以及 3.14.15；" * 6 + chr(0x1F600) * 3),
    (-14, _REPORT + chr(1) + chr(0xE123) + "  　" + "\n\n\n" + _REPORT),
]
D_S = "d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in EXTRA) + ") v(doc_id, text))"


def sql_hits(x: str, words: list[str], fold: bool = False) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {quoted(w.lower() if fold else w)}) AS INTEGER)" for w in words) + ")"


def sql_presence(x: str, words: list[str], full: float, fold: bool = False) -> str:
    return f"least({sql_hits(x, words, fold)} / {full}, 1.0)"


def sql_clean(x: str) -> str:
    for pattern in (r"(?m)^[0-9]+$", rf"第{S}*[0-9]+{S}*页{S}*[/\\]{S}*共{S}*[0-9]+{S}*页", rf"(?i)Page{S}+[0-9]+{S}+of{S}+[0-9]+", rf"(?i)\[图片\]|\[图[0-9]+\]|\[Image\]|\[Figure{S}+[0-9]+\]"):
        x = f"regexp_replace({x}, {quoted(pattern)}, '', 'g')"
    x = f"regexp_replace({x}, '{S}{{3,}}', ' ', 'g')"
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {STRIP('l')}), chr(10))"
    return STRIP(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_sanitize(x: str) -> str:
    x = rf"regexp_replace({x}, '[{PRIVATE_S}\x{{FFFD}}\x00-\x08\x0B-\x1F\x7F]', '', 'g')"
    x = rf"regexp_replace({x}, '[ \x{{3000}}]+', ' ', 'g')"
    return STRIP(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_gate(x: str, after: bool = False) -> str:
    """The reason of a gate on a text, as one expression."""
    n, extb, cjk, latin = f"greatest(length({x}), 1)", CNT(x, EXT_S), CNT(x, CJK_S), CNT(x, "a-zA-Z")
    valid, odd = f"({cjk} + {latin} + {CNT(x, '0-9')} + {CNT(x, PUNCT_S)})", CNT(x, ODD_S)
    ratios = f"WHEN {valid} / {n} < 0.70 THEN printf('Valid character ratio too low (%.2f%%)', 100.0 * {valid} / {n}) WHEN {odd} / {n} > {0.15 if after else 0.20} THEN printf('Uncommon character ratio too high (%.2f%%)', 100.0 * {odd} / {n})"
    if after:
        return f"CASE WHEN length({STRIP(x)}) < 10 THEN 'Text too short or empty' WHEN regexp_matches({x}, '[{PRIVATE_S}]') THEN 'Contains private-use chars (possible encoding/font issue)' WHEN contains({x}, chr(65533)) THEN 'Contains replacement char \\uFFFD (possible encoding issue)' WHEN {extb} >= 6 OR {extb} / {n} > 0.01 THEN 'Ext-B character ratio too high (possible garbled text)' {ratios} WHEN {cjk} / {n} < 0.15 AND {latin} / {n} < 0.15 THEN 'Neither predominantly Chinese nor English' ELSE 'Valid text' END"
    return f"CASE WHEN length({STRIP(x)}) < 80 THEN 'Text too short or empty' WHEN contains({x}, chr(65533)) THEN 'Contains replacement character' WHEN {extb} >= 10 OR {extb} / {n} > 0.01 THEN 'Too many extended-B characters' {ratios} WHEN {cjk} / {n} < 0.10 AND {latin} / {n} < 0.10 THEN 'Neither predominantly Chinese nor predominantly English' ELSE 'OK' END"


def sql_chunks(source: str, out: str = "chunks") -> str:
    """CTEs that cut the texts of a relation (doc_id, text) into chunks: (doc_id, chunk_index, chunk_id, text)."""
    closed = "CASE WHEN length(a.cur) >= 100 THEN list_append(a.out, a.cur) ELSE a.out END"
    step = f"""CASE WHEN x.k = 'f' THEN {{'out': {closed}, 'cur': ''}}
    WHEN length(a.cur) + length(x.t) + 1 <= 512 THEN {{'out': a.out, 'cur': CASE WHEN x.k = 's' THEN a.cur || x.t WHEN a.cur = '' THEN x.t ELSE a.cur || chr(10) || x.t END}}
    ELSE {{'out': {closed}, 'cur': CASE WHEN x.k = 's' THEN right(a.cur, 50) || x.t WHEN a.cur = '' THEN x.t ELSE right(a.cur, 50) || chr(10) || x.t END}} END"""
    return rf"""{out}_p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{S}*\n'), lambda p: {STRIP("p")}), lambda p: p <> '') AS ps FROM {source}),
{out}_s AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) > 512 THEN list_concat([{{'k': 'f', 't': ''}}], list_transform(list_filter(list_transform(regexp_split_to_array(p, '[。！？\n]'), lambda s: {STRIP("s")}), lambda s: s <> ''), lambda s: {{'k': 's', 't': s}})) ELSE [{{'k': 'p', 't': p}}] END)) AS st FROM {out}_p),
{out}_f AS (SELECT doc_id, list_reduce(st, lambda a, x: {step}, {{'out': CAST([] AS VARCHAR[]), 'cur': ''}}) AS a FROM {out}_s),
{out}_o AS (SELECT doc_id, {closed} AS o FROM {out}_f),
{out} AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, doc_id || '_chunk_' || (i - 1) AS chunk_id, o[i] AS text FROM (SELECT doc_id, o, unnest(range(1, len(o) + 1)) AS i FROM {out}_o))"""


def _more(spark: SparkSession, d: str) -> DataFrame:
    """The documents and EXTRA, as (doc_id, text)."""
    extra = spark.createDataFrame(EXTRA, "doc_id long, text string")
    return _docs(spark, d).select("doc_id", "text").unionByName(extra)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", deal=True)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(_docs(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = turns.withColumn("response", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    df = df.where("role = 'user' and next_role = 'assistant'")
    return df.select("conv_id", "turn", F.col("text").alias("instruction"), "response", F.col("text").alias("source"))


PAIRS_S = """p AS (SELECT conv_id, turn, text AS instruction, response, text AS source FROM (
  SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
) WHERE role = 'user' AND next_role = 'assistant')"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as records: topics as the chosen items, a quality between 0 and 1 from the length."""
    df = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return df.select("doc_id", "lang", "source", knowledge.topics(F.lower("text"), V.LATIN_TOPICS, 3, ["none"]).alias("experts"), (F.pmod(F.length("text"), F.lit(101)) / 100.0).alias("quality"), F.substring("text", 1, 60).alias("instruction"), F.col("text").alias("output"))


LATIN_ARRAY = "[" + ", ".join(quoted(w) for w in V.LATIN_TOPICS) + "]"
RECORDS_S = f"""r AS (SELECT doc_id, lang, source, quality, instruction, output, CASE WHEN len(e) = 0 THEN ['none'] ELSE e END AS experts FROM (
  SELECT doc_id, lang, source, list_filter({LATIN_ARRAY}, lambda k: contains(lower(text), k))[1:3] AS e, (length(text) % 101) / 100.0 AS quality, left(text, 60) AS instruction, text AS output
  FROM documents JOIN labels USING (doc_id)))"""


@query(f"WITH {D_S} SELECT doc_id, {sql_sanitize(sql_clean('text'))} AS text FROM d")
def clean_text_docs(spark, d):
    """F1, F2."""
    return _more(spark, d).select("doc_id", T.sanitize(T.clean_text(F.col("text"))).alias("text"))


@query(rf"""
WITH {D_S}, c AS (SELECT doc_id, text, length(text) AS n, {CNT("text", CJK_S)} AS cjk, {CNT("text", "a-zA-Z")} AS latin, {CNT("text", "0-9")} AS digit, {CNT("text", PUNCT_S)} AS punct FROM d)
SELECT doc_id, CAST(n AS INTEGER) AS chars, CAST(cjk AS INTEGER) AS cjk, CAST(latin AS INTEGER) AS latin, CAST(digit AS INTEGER) AS digits, CAST(cjk + latin + digit + punct AS INTEGER) AS valid FROM c""")
def char_profile(spark, d):
    """F4."""
    x = F.col("text")
    return _more(spark, d).select("doc_id", F.length(x).alias("chars"), T.count(x, V.CJK).alias("cjk"), T.count(x, V.LATIN).alias("latin"), T.count(x, "0-9").alias("digits"), T.valid_count(x).alias("valid"))


@query(f"WITH {D_S} SELECT doc_id, {sql_gate('text')} AS reason FROM d")
def quality_gate_pre(spark, d):
    """P1, P2."""
    return _more(spark, d).select("doc_id", gates.gate_before(F.col("text")).alias("reason"))


@query(f"WITH {D_S} SELECT doc_id, {sql_gate('text', True)} AS reason FROM d")
def quality_gate_post(spark, d):
    """P3."""
    return _more(spark, d).select("doc_id", gates.gate_after(F.col("text")).alias("reason"))


@query(f"""WITH {D_S}, c AS (SELECT text, {sql_sanitize('text')} AS clean FROM d), g AS (SELECT text, clean, {sql_gate('text', True)} AS reason, {sql_gate('clean', True)} AS again FROM c)
SELECT CASE WHEN reason = 'Valid text' THEN 'valid' WHEN again = 'Valid text' AND clean <> text THEN 'salvaged' ELSE 'invalid' END AS status, reason, count(*) AS n FROM g GROUP BY ALL""")
def qc_salvage_counts(spark, d):
    """P4 with its counters."""
    return gates.quality_check(_more(spark, d)).groupBy("status", "reason").agg(F.count("*").alias("n"))


@query(rf"""
WITH {D_S}, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM d), m AS (SELECT *, {STRIP("x[1]")} AS f FROM l)
SELECT doc_id, (len(x) > 20 AND regexp_matches(text, '(?m)^{S}*[0-9a-z.\-]+{S}+') AND len(list_filter(x, lambda y: length({STRIP("y")}) < 30)) / len(x) > 0.7)
  OR ({sql_hits("lower(text)", V.NOISE)} > 0 AND length(text) < 500)
  OR (len(x) > 5 AND f <> '' AND len(list_filter(x, lambda y: y = f)) >= len(x) * 0.3) AS noise FROM m""")
def structural_noise(spark, d):
    """P5."""
    return _more(spark, d).select("doc_id", gates.structural_noise(F.col("text")).alias("noise"))


LAYER_NAMES = {f"src{i}": f"Layer{i % 4 + 1}" for i in range(20)}
RENAMED = {"en_": "english_", "_src1": "_Layer2"}


@query(f"""
SELECT doc_id, CASE WHEN {STRIP('i')} = '' THEN 'empty_instruction' WHEN {STRIP('o')} = '' THEN 'empty_output' END AS reason, coalesce(CASE {" ".join(f"WHEN source = '{a}' THEN '{b}'" for a, b in LAYER_NAMES.items())} END, source) AS layer, {"replace(" * len(RENAMED)}lang || '_' || source || '_' || doc_id{"".join(f", '{a}', '{b}')" for a, b in RENAMED.items())} AS name
FROM (SELECT doc_id, lang, source, CASE WHEN length(text) % 7 = 0 THEN chr(12288) || ' ' ELSE text END AS o, CASE WHEN length(text) % 5 = 0 THEN '' WHEN length(text) % 5 = 1 THEN NULL ELSE lang END AS i FROM documents)""".replace(STRIP('i'), STRIP("coalesce(i, '')")))
def alpaca_validation(spark, d):
    """Validation reasons; layers by prefix and new name; names with their layers renamed."""
    n = F.length("text")
    df = _docs(spark, d).withColumn("o", F.when(F.pmod(n, F.lit(7)) == 0, "\u3000 ").otherwise(F.col("text"))).withColumn("i", F.when(F.pmod(n, F.lit(5)) == 0, "").when(F.pmod(n, F.lit(5)) != 1, F.col("lang")))
    layer = gates.layer_of(F.concat_ws("_", "source", "lang"), LAYER_NAMES)
    return df.select("doc_id", gates.alpaca_reason(F.col("i"), F.col("o")).alias("reason"), layer.alias("layer"), gates.rename(F.concat_ws("_", "lang", "source", "doc_id"), RENAMED).alias("name"))


@query(f"""
SELECT 'qa' AS kind, count(*) AS n FROM documents WHERE length(text) BETWEEN 200 AND 800 AND {sql_hits("text", gates.QA_WORDS)} > 0
UNION ALL SELECT 'extraction', count(*) FROM documents WHERE regexp_matches(text, '[0-9]') AND {sql_hits("text", gates.EXTRACTION_MARKS)} > 0
UNION ALL SELECT 'classification', count(*) FROM documents UNION ALL SELECT 'summary', count(DISTINCT doc_id) FROM documents""")
def candidate_counts(spark, d):
    """P8."""
    docs, out = _docs(spark, d), None
    for kind in ("qa", "extraction", "classification", "summary"):
        own = gates.candidates(docs, kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT *, {STRIP("line")} = '' OR row_number() OVER (PARTITION BY doc_id, {STRIP("line")} ORDER BY i) = 1 AS kept FROM l)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept)) AS hash, CAST(count(*) FILTER (WHERE NOT kept) AS INTEGER) AS line_dedup_removed FROM k GROUP BY doc_id""")
def line_dedup(spark, d):
    """D1, W1."""
    return dedup.dedup_lines(_docs(spark, d)).select("doc_id", F.md5("text").alias("hash"), "line_dedup_removed")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents")
def exact_dup_docs(spark, d):
    """D6."""
    return dedup.exact_duplicates(_docs(spark, d)).select("doc_id", "kept")


@query()
def simhash_near_dups(spark, d):
    """The greedy scan over whole documents."""
    return dedup.near_duplicates(_docs(spark, d))


@query(r"""
WITH o AS (SELECT min(doc_id) AS id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '') AS w FROM documents GROUP BY text),
e AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS h FROM o WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM e GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM e x JOIN e y USING (h) WHERE x.id < y.id GROUP BY ALL)
SELECT a, b, s / (m.n + n.n - s) AS jaccard FROM c JOIN n m ON m.id = a JOIN n ON n.id = b WHERE s / (m.n + n.n - s) > 0.85""")
def jaccard_near_dups(spark, d):
    """D4."""
    return dedup.jaccard_pairs(_docs(spark, d))


@query(f"WITH {D_S}, {sql_chunks('d')} SELECT doc_id, chunk_index, chunk_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS hash FROM chunks")
def chunk_docs(spark, d):
    """C1, F6, W6."""
    return chunking.chunk(_more(spark, d)).select("doc_id", "chunk_index", "chunk_id", F.length("text").alias("chars"), F.md5("text").alias("hash"))


@query(f"""WITH {sql_chunks('documents')}, b AS (SELECT CASE WHEN n < 200 THEN 0 WHEN n < 400 THEN 1 WHEN n < 512 THEN 2 WHEN n < 800 THEN 3 WHEN n < 1200 THEN 4 ELSE 5 END AS bin FROM (SELECT length(text) AS n FROM chunks))
SELECT k AS bin, l AS label, count(b.bin) AS n FROM (VALUES (0, '0-200'), (1, '200-400'), (2, '400-512'), (3, '512-800'), (4, '800-1200'), (5, '1200+')) v(k, l) LEFT JOIN b ON b.bin = k GROUP BY ALL""")
def chunk_length_hist(spark, d):
    """A9."""
    return stats.histogram(_chunks(spark, d), F.length("text"), stats.CHAR_RANGES)


@query("""
SELECT k AS bin, l AS label, count(doc_id) AS n FROM (VALUES (0, '0-256'), (1, '256-512'), (2, '512-1024'), (3, '1024-2048'), (4, '2048+')) v(k, l)
LEFT JOIN (SELECT doc_id, CASE WHEN t < 256 THEN 0 WHEN t < 512 THEN 1 WHEN t < 1024 THEN 2 WHEN t < 2048 THEN 3 ELSE 4 END AS b FROM (SELECT doc_id, floor(length(text) * 1.5) AS t FROM documents)) ON b = k GROUP BY ALL""")
def token_length_hist(spark, d):
    """A9 over estimated tokens."""
    return stats.histogram(_docs(spark, d), T.token_estimate(F.col("text")), stats.TOKEN_RANGES)


@query("""
SELECT round(quantile_cont(t, 0.0), 6) AS p0, round(quantile_cont(t, 0.25), 6) AS p25, round(quantile_cont(t, 0.5), 6) AS p50, round(quantile_cont(t, 0.75), 6) AS p75, round(quantile_cont(t, 0.9), 6) AS p90, round(quantile_cont(t, 0.95), 6) AS p95, round(quantile_cont(t, 0.99), 6) AS p99, round(quantile_cont(t, 1.0), 6) AS p100, round(avg(t), 6) AS mean
FROM (SELECT CAST(floor(length(text) * 1.5) AS DOUBLE) AS t FROM documents)""")
def token_estimate_stats(spark, d):
    """A8, F9."""
    p = stats.percentiles(_docs(spark, d).select(T.token_estimate(F.col("text")).alias("t")), "t")
    return p.select(*(F.round(c, 6).alias(c) for c in p.columns))


@query(r"""
WITH t AS (SELECT doc_id, text, floor(length(text) * 1.5) > 2048 AS cut FROM documents), b AS (
  SELECT *, list_max(list_filter(range(1166, 1366), lambda i: i < length(text) AND contains('。！？.!?' || chr(10), substring(text, CAST(i + 1 AS BIGINT), 1)))) AS back,
    list_min(list_filter(range(1365, 1565), lambda i: i < length(text) AND contains('。！？.!?' || chr(10), substring(text, CAST(i + 1 AS BIGINT), 1)))) AS ahead FROM t)
SELECT doc_id, cut, CAST(CASE WHEN NOT cut THEN length(text) ELSE least(length(text), coalesce(back + 1, ahead + 1, 1365)) END AS INTEGER) AS chars FROM b""")
def oversize_truncate(spark, d):
    """F10, F11."""
    return chunking.fit_tokens(_docs(spark, d)).select("doc_id", "cut", F.length("text").alias("chars"))


def _f15_sql(source: str = "d") -> str:
    x, pres = "text", {n: sql_presence("text", w, f) for n, (w, f) in V.SELECTOR.items()}
    pres["esg_keyword_density"] = sql_presence("lower(text)", V.SELECTOR["esg_keyword_density"][0], 9.0, fold=True)
    claims = " + ".join(f"CAST(regexp_matches({x}, {quoted(p)}) AS INTEGER)" for p in V.CLAIMS)
    return f"""f AS (SELECT *, CAST(length(text) AS DOUBLE) AS length, CAST(len(list_filter(regexp_split_to_array(text, '{S}+'), lambda w: w <> '')) AS DOUBLE) AS word_count,
  least(len(regexp_extract_all(text, '[0-9]+')) / 10.0, 1.0) AS has_numbers, {", ".join(f"{p} AS {n}" for n, p in pres.items())},
  least(len(list_distinct(regexp_extract_all(text, '20[0-9]{{2}}'))) / 3.0, 1.0) AS year_mentions, least(({claims}) / 2.0, 1.0) AS verifiable_claims FROM {source})"""


F15 = ["length", "word_count", "has_numbers", "has_entities", "has_question_keywords", "has_structured_data", "esg_keyword_density", "comparative_keywords", "temporal_keywords", "year_mentions", "industry_keywords", "vague_commitments", "standard_keywords", "verifiable_claims", "performance_keywords"]


@query(f"WITH {D_S}, {_f15_sql()} SELECT doc_id, {', '.join(F15)} FROM f")
def features_15(spark, d):
    """E1, F12-F14."""
    return routing.with_features(_more(spark, d), routing.features_15(F.col("text"))).select("doc_id", "f.*")


def _f14_sql() -> str:
    folded = ", ".join(f"{sql_presence('lower(text)', w, f, fold=True)} AS {n}" for n, (w, f) in V.BILINGUAL.items())
    claims = " + ".join(f"CAST(regexp_matches(text, {quoted(p)}) AS INTEGER)" for p in V.CLAIMS_BILINGUAL)
    return f"""f AS (SELECT *, least(length(text) / 2000.0, 1.0) AS length, least(len(regexp_extract_all(text, '[0-9]+\\.?[0-9]*%?')) / 10.0, 1.0) AS numerical_density,
  least(len(list_distinct(regexp_extract_all(text, '20[0-9]{{2}}'))) / 3.0, 1.0) AS year_mentions, {folded}, {sql_presence("text", *V.BILINGUAL_MARKS)} AS structured_data, {sql_presence("text", *V.BILINGUAL_ENTITIES)} AS entity_density, least(({claims}) / 2.0, 1.0) AS verifiable_claims FROM d)"""


F14 = ["length", "numerical_density", "year_mentions", *V.BILINGUAL, "structured_data", "entity_density", "verifiable_claims"]


@query(f"WITH {D_S}, {_f14_sql()} SELECT doc_id, {', '.join(F14)} FROM f")
def features_14(spark, d):
    """E2."""
    return routing.with_features(_more(spark, d), routing.features_14(F.col("text"))).select("doc_id", "f.*")


SCORES_15 = {
    "qa_expert": "has_question_keywords * 0.5::DOUBLE + esg_keyword_density * 0.5::DOUBLE",
    "summary_expert": "(CASE WHEN length > 300 THEN 1.0 ELSE length / 300 END)::DOUBLE * 0.5::DOUBLE + has_structured_data * 0.5::DOUBLE",
    "extraction_expert": "has_structured_data * 0.4::DOUBLE + has_numbers * 0.3::DOUBLE + has_entities * 0.3::DOUBLE",
    "classification_expert": "esg_keyword_density * 0.7::DOUBLE + has_entities * 0.3::DOUBLE",
    "analysis_expert": "comparative_keywords * 0.6::DOUBLE + has_entities * 0.4::DOUBLE",
    "temporal_analysis_expert": "temporal_keywords * 0.5::DOUBLE + year_mentions * 0.5::DOUBLE",
    "benchmark_comparison_expert": "industry_keywords * 0.6::DOUBLE + comparative_keywords * 0.4::DOUBLE",
    "greenwashing_detection_expert": "vague_commitments * 0.6::DOUBLE + verifiable_claims * 0.4::DOUBLE",
    "standard_alignment_expert": "standard_keywords * 0.7::DOUBLE + has_structured_data * 0.3::DOUBLE",
    "knowledge_graph_expert": "has_entities * 0.6::DOUBLE + has_structured_data * 0.4::DOUBLE",
    "consistency_verification_expert": "has_numbers * 0.6::DOUBLE + comparative_keywords * 0.4::DOUBLE",
}
SCORES_14 = {
    "qa_expert": "carbon_keywords * 0.5::DOUBLE + numerical_density * 0.3::DOUBLE + length * 0.2::DOUBLE",
    "summary_expert": "length * 0.5::DOUBLE + structured_data * 0.3::DOUBLE + carbon_keywords * 0.2::DOUBLE",
    "extraction_expert": "structured_data * 0.4::DOUBLE + numerical_density * 0.3::DOUBLE + entity_density * 0.3::DOUBLE",
    "classification_expert": "(carbon_keywords + social_keywords + governance_keywords) / 3 * 0.7::DOUBLE + entity_density * 0.3::DOUBLE",
    "analysis_expert": "comparative_language * 0.6::DOUBLE + entity_density * 0.4::DOUBLE",
    "temporal_analysis_expert": "temporal_markers * 0.5::DOUBLE + year_mentions * 0.5::DOUBLE",
    "benchmark_comparison_expert": "industry_keywords * 0.6::DOUBLE + comparative_language * 0.4::DOUBLE",
    "greenwashing_detection_expert": "vague_commitments * 0.6::DOUBLE + verifiable_claims * 0.4::DOUBLE",
    "consistency_verification_expert": "numerical_density * 0.6::DOUBLE + comparative_language * 0.4::DOUBLE",
    "standard_alignment_expert": "standards_language * 0.7::DOUBLE + structured_data * 0.3::DOUBLE",
    "knowledge_graph_expert": "entity_density * 0.6::DOUBLE + structured_data * 0.4::DOUBLE",
}


def _ranked_sql(scores: dict[str, str], names: list[str]) -> str:
    return "list_sort([" + ", ".join(f"{{'s': -({scores[n]}), 'k': {k}, 'id': '{n}'}}" for k, n in enumerate(names)) + "])"


@query(f"""WITH {D_S}, {_f15_sql()}, r AS (SELECT doc_id, {_ranked_sql(SCORES_15, routing.IDS)} AS r FROM f), o AS (SELECT doc_id, r, list_transform(list_filter(r, lambda x: -x.s > 0.3)[1:3], lambda x: x.id) AS o FROM r)
SELECT doc_id, array_to_string(CASE WHEN len(o) >= 1 THEN o ELSE [r[1].id] END, ',') AS experts FROM o""")
def route_rule(spark, d):
    """E3, E4, O1."""
    return routing.route(_more(spark, d), "rule").select("doc_id", F.array_join("experts", ",").alias("experts"))


def sql_layered(thresholds: tuple[float, float, float] = (0.3, 0.3, 0.5)) -> str:
    """The layered choice over the features of relation f, as a list."""
    a, v, g = thresholds
    middle = f"list_filter([CASE WHEN temporal_keywords > {a} THEN 'temporal_analysis_expert' END, CASE WHEN industry_keywords > {a} THEN 'benchmark_comparison_expert' END, CASE WHEN vague_commitments > {a} THEN 'greenwashing_detection_expert' END], lambda x: x IS NOT NULL)[1:2]"
    last = f"list_filter([CASE WHEN has_numbers > {v} THEN 'consistency_verification_expert' WHEN standard_keywords > {v} THEN 'standard_alignment_expert' END, CASE WHEN has_entities > {g} AND has_structured_data > 0.3 THEN 'knowledge_graph_expert' END], lambda x: x IS NOT NULL)"
    return f"list_concat(list_concat([{_ranked_sql(SCORES_15, routing.LAYER['base'])}[1].id], {middle}), {last})[1:3]"


@query(f"WITH {D_S}, {_f15_sql()} SELECT doc_id, array_to_string({sql_layered()}, ',') AS experts FROM f")
def route_layered(spark, d):
    """E5, E7."""
    return routing.route(_more(spark, d)).select("doc_id", F.array_join("experts", ",").alias("experts"))


@query(f"""WITH {D_S}, {_f14_sql()}, r AS (SELECT doc_id, [{_ranked_sql(SCORES_14, routing.LAYER["base"])}[1].id] AS b, list_filter([{", ".join(f"CASE WHEN {SCORES_14[n]} >= 0.5 THEN '{n}' END" for n in [*routing.LAYER["analysis"], "consistency_verification_expert", "standard_alignment_expert", "knowledge_graph_expert"])}], lambda x: x IS NOT NULL) AS v FROM f)
SELECT doc_id, array_to_string(list_concat(b, v)[1:3], ',') AS experts FROM r""")
def route_appendix(spark, d):
    """E6."""
    return routing.route(_more(spark, d), "appendix").select("doc_id", F.array_join("experts", ",").alias("experts"))


_BOTH = f"p AS (SELECT doc_id, {sql_layered()} AS config, {sql_layered((0.6, 0.7, 0.8))} AS published FROM f), q AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN config ELSE published END AS stored FROM p)"


def _stored(spark, d) -> DataFrame:
    """Stored choices: those of one profile for a third of the documents, of another one for the rest."""
    df = routing.with_features(_more(spark, d), routing.features_15(F.col("text")))
    pick = F.when(F.col("doc_id") % 3 == 0, routing.by_layer(F.col("f"))).otherwise(routing.by_layer(F.col("f"), thresholds=routing.PROFILES["published"]))
    return Scratch(spark, "routed").keep(df.select("doc_id", "text", pick.alias("experts")))


@query(f"WITH {D_S}, {_f15_sql()}, {_BOTH} SELECT 'config' AS profile, avg(CAST(config = stored AS DOUBLE)) AS match_rate FROM q UNION ALL SELECT 'published', avg(CAST(published = stored AS DOUBLE)) FROM q")
def profile_match_rate(spark, d):
    """Which profile of thresholds repeats the stored choice."""
    return routing.best_profile(_stored(spark, d))


@query(f"WITH {D_S}, {_f15_sql()}, {_BOTH} SELECT doc_id, stored = config AS same, array_to_string(list_filter(stored, lambda x: NOT list_contains(config, x)), ',') AS missing, array_to_string(list_filter(config, lambda x: NOT list_contains(stored, x)), ',') AS extra FROM q")
def route_differences(spark, d):
    """Recomputed against stored choices, differences both ways."""
    out = routing.differences(_stored(spark, d), "doc_id")
    return out.select("doc_id", "same", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def accepted_chunks(spark, d) -> DataFrame:
    docs = T.once(_more(spark, d), "text", T.sanitize(T.clean_text(F.col("text"))))
    return chunking.chunk(docs.where(gates.gate_before(F.col("text")) == "OK"))


_ACCEPTED = f"{D_S}, c AS (SELECT doc_id, {sql_sanitize(sql_clean('text'))} AS text FROM d), k AS (SELECT doc_id, text FROM c WHERE {sql_gate('text')} = 'OK'), {sql_chunks('k')}"
_NAMES = "CASE item " + " ".join(f"WHEN '{e[0]}' THEN '{e[2]}'" for e in V.EXPERTS) + " END"


@query(f"""WITH {_ACCEPTED}, {_f15_sql('chunks')}, r AS (SELECT chunk_id, {sql_layered()} AS e FROM f)
SELECT item, {_NAMES} AS name, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS share FROM (SELECT unnest(e) AS item FROM r) GROUP BY item""")
def expert_frequency(spark, d):
    """The flagship: clean, gate, chunk, route, count experts."""
    routed = routing.route(accepted_chunks(spark, d))
    names = F.create_map(*(F.lit(x) for e in V.EXPERTS for x in (e[0], e[2])))
    return stats.frequency(routed, "experts", "chunk_id").select("item", F.element_at(names, F.col("item")).alias("name"), "n", "share")


@query(f"WITH {RECORDS_S} SELECT item, count(*) AS uses, round(avg(quality), 9) AS avg_quality, round(avg(CAST(quality >= 0.7 AS DOUBLE)), 9) AS pass_rate FROM (SELECT unnest(experts) AS item, quality FROM r) GROUP BY item")
def expert_quality(spark, d):
    """A5."""
    q = stats.quality_by(_records(spark, d), "experts", "quality")
    return q.select("item", "uses", F.round("avg_quality", 9).alias("avg_quality"), F.round("pass_rate", 9).alias("pass_rate"))


@query(f"""WITH {RECORDS_S}, l AS (SELECT * FROM r WHERE quality < 0.5)
SELECT item, count(*) AS n, (SELECT count(*) FROM l) AS low, (SELECT count(*) FROM l) / (SELECT count(*) FROM r) AS low_share FROM (SELECT doc_id, unnest(experts) AS item FROM l) GROUP BY item ORDER BY n DESC, min(doc_id), item LIMIT 5""")
def low_quality_experts(spark, d):
    """A6, O2."""
    return stats.low_quality(_records(spark, d), "quality", "experts", "doc_id")


@query(f"""WITH {RECORDS_S} SELECT item, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS share FROM (SELECT doc_id, unnest(experts) AS item FROM r) GROUP BY item ORDER BY n DESC, min(doc_id), item LIMIT 30""")
def topics_top(spark, d):
    """F19, A4."""
    return stats.frequency(_records(spark, d), "experts", "doc_id", 30).select("item", "n", "share")


@query(f"""WITH {RECORDS_S} SELECT count(*) AS n, round(avg(CAST(len(experts) > 1 AS DOUBLE)), 9) AS multi_expert_ratio, round(avg(quality), 9) AS avg_quality, round(stddev_pop(quality), 9) AS std_quality, round(avg(length(instruction)), 9) AS avg_instruction, round(avg(length(output)), 9) AS avg_output,
  (SELECT count(DISTINCT e) FROM (SELECT unnest(experts) AS e FROM r)) AS expert_types FROM r""")
def qa_stats(spark, d):
    """A2, A16."""
    q = stats.qa_stats(_records(spark, d))
    return q.select("n", *(F.round(c, 9).alias(c) for c in q.columns if c not in ("n", "expert_types")), "expert_types")


@query(f"""WITH {RECORDS_S}, b AS (SELECT CASE WHEN quality < 0.5 THEN 0 WHEN quality < 0.6 THEN 1 WHEN quality < 0.7 THEN 2 WHEN quality < 0.8 THEN 3 WHEN quality < 0.9 THEN 4 WHEN quality < 0.95 THEN 5 ELSE 6 END AS bin FROM r)
SELECT k AS bin, l AS label, count(b.bin) AS n FROM (VALUES (0, '0-0.5'), (1, '0.5-0.6'), (2, '0.6-0.7'), (3, '0.7-0.8'), (4, '0.8-0.9'), (5, '0.9-0.95'), (6, '0.95+')) v(k, l) LEFT JOIN b ON b.bin = k GROUP BY ALL""")
def quality_bins(spark, d):
    """A7."""
    return stats.histogram(_records(spark, d), F.col("quality"), stats.QUALITY_7)


@query(f"WITH {RECORDS_S} SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality >= 0.7) AS ge_70, count(*) FILTER (WHERE quality >= 0.8) AS ge_80, count(*) FILTER (WHERE quality >= 0.9) AS ge_90 FROM r GROUP BY lang")
def quality_cumulative(spark, d):
    """A7."""
    return stats.cumulative_quality(_records(spark, d), "quality", ["lang"])


_SUMMARY = "CASE WHEN len(i) = 0 THEN 'No relevant domain knowledge' ELSE 'Retrieved ' || len(i) || ' knowledge items:' || chr(10) || array_to_string(list_transform(i, lambda x: '  - ' || x.t || ': ' || left(x.c, 50) || '...' || chr(10)), '') END"


@query(f"""WITH {D_S}, b AS (SELECT item_id, 'Entity: item ' || item_id || ' - ' || left(text, 40) AS c, list_filter({LATIN_ARRAY}, lambda k: contains(lower(text), k)) AS ks FROM benchmark),
e AS (SELECT doc_id, text, list_filter({LATIN_ARRAY}, lambda k: contains(lower(text), k)) AS ks FROM d),
h AS (SELECT doc_id, list({{'t': 'entity', 'c': c}} ORDER BY item_id)[1:5] AS own FROM e JOIN b ON list_has_any(e.ks, b.ks) GROUP BY doc_id),
i AS (SELECT doc_id, list_concat(list_concat(coalesce(own, []), list_transform(ks[1:5], lambda k: {{'t': 'keyword', 'c': 'ESG keyword: ' || k || ' (dimension: word)'}})), CASE WHEN contains(lower(text), 'gri') OR contains(lower(text), '实质性') THEN [{{'t': 'standard', 'c': 'GRI: Global Reporting Initiative sustainability reporting standards'}}] ELSE [] END)[1:5] AS i FROM e LEFT JOIN h USING (doc_id))
SELECT doc_id, CAST(len(i) AS INTEGER) AS n, array_to_string(list_transform(i, lambda x: x.t), ',') AS types, md5({_SUMMARY}) AS summary FROM i""")
def knowledge_items(spark, d):
    """Benchmark items as the knowledge base, a Latin vocabulary as the keywords."""
    base = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.substring("text", 1, 40).alias("description"), "text")
    found = knowledge.retrieve(_more(spark, d), base, None, "doc_id", vocabulary={"word": V.LATIN_TOPICS}, order="item_id")
    return found.select("doc_id", F.size("knowledge").alias("n"), F.array_join("knowledge.type", ",").alias("types"), F.md5(knowledge.summary(F.col("knowledge"))).alias("summary"))


@query(f"""SELECT doc_id, array_to_string(CASE WHEN len(x) = 0 THEN ['ESG', 'sustainability'] ELSE x END, ',') AS topics FROM (
  SELECT doc_id, list_filter({LATIN_ARRAY}, lambda k: contains(lower(text), k))[1:5] AS x FROM documents)""")
def core_topics(spark, d):
    """F19."""
    return _docs(spark, d).select("doc_id", F.array_join(knowledge.topics(F.col("text"), V.LATIN_TOPICS), ",").alias("topics"))


@query(f"WITH {PAIRS_S} SELECT conv_id, turn, md5(instruction) AS instruction, md5(response) AS response FROM p")
def pair_turns(spark, d):
    """W7."""
    return _pairs(spark, d).select("conv_id", "turn", F.md5("instruction").alias("instruction"), F.md5("response").alias("response"))


@query(f"""WITH {PAIRS_S}, g AS (SELECT *, list_distinct(list_transform(range(1, length(left(source, 200)) - 1), lambda i: substring(source, CAST(i AS BIGINT), 3))) AS g FROM p)
SELECT conv_id, turn, CASE WHEN length(instruction) > 10 AND length(response) > 20 THEN least(0.3::DOUBLE + CASE WHEN len(g) > 0 THEN least(len(list_filter(g, lambda x: contains(response, x))) / len(g) * 0.4::DOUBLE, 0.4::DOUBLE)
  ELSE least(len(list_filter(string_split(left(source, 50), ''), lambda c: contains(response, c))) / 50 * 0.4::DOUBLE, 0.4::DOUBLE) END + CASE WHEN length(response) > 50 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(response) > 100 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) ELSE 0.0 END AS quality FROM g""")
def quality_collab(spark, d):
    """Q1, F16."""
    return _pairs(spark, d).select("conv_id", "turn", metrics.collaboration_quality(F.col("instruction"), F.col("response"), F.col("source")).alias("quality"))


QUALITY_WORDS = sorted({w.lower() for w in [*V.QUALITY, *V.LATIN_TOPICS]})


@query(f"""WITH {PAIRS_S}, h AS (SELECT conv_id, turn, {sql_hits("lower(source)", QUALITY_WORDS)} AS s, {" + ".join(f"CAST(contains(lower(source), {quoted(w)}) AND contains(lower(response), {quoted(w)}) AS INTEGER)" for w in QUALITY_WORDS)} AS b FROM p)
SELECT conv_id, turn, CASE WHEN s = 0 THEN 1.0 ELSE b / s END AS relevance FROM h""")
def relevance(spark, d):
    """Q4, U3."""
    return _pairs(spark, d).select("conv_id", "turn", metrics.relevance(F.col("response"), F.col("source"), QUALITY_WORDS).alias("relevance"))


NUM = r"'[0-9]+\.?[0-9]*%?'"
STRUCTURE_S = f"CASE WHEN length({STRIP('response')}) <= 20 THEN 0.0 ELSE least(1.0, length({STRIP('response')}) / 50.0) END"


@query(f"WITH {PAIRS_S} SELECT conv_id, turn, CAST({STRUCTURE_S} AS DOUBLE) AS structure, CASE WHEN length({STRIP('instruction')}) >= 10 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN length({STRIP('response')}) >= 20 THEN 0.5::DOUBLE ELSE 0 END AS completeness FROM p")
def structure(spark, d):
    """Q6, M9, F25."""
    return _pairs(spark, d).select("conv_id", "turn", metrics.structure(F.col("response")).alias("structure"), T.completeness(F.col("instruction"), F.col("response")).alias("completeness"))


@query(f"""WITH {PAIRS_S}, n AS (SELECT *, regexp_extract_all(response, {NUM}) AS o, regexp_extract_all(source, {NUM}) AS s FROM p)
SELECT conv_id, turn, CASE WHEN len(o) = 0 THEN 0.5::DOUBLE * {STRUCTURE_S} ELSE len(list_filter(o, lambda x: list_contains(s, x))) / len(o) END AS grounding FROM n""")
def grounding(spark, d):
    """Q5, F15."""
    return _pairs(spark, d).select("conv_id", "turn", metrics.grounding(F.col("response"), F.col("source")).alias("grounding"))


def sql_lcs(a: str, b: str) -> str:
    """The length of the longest common subsequence of two lists, by the whole table, a row of it at a time."""
    at = lambda x, i: f"CASE WHEN {i} > 0 THEN {x}[{i}] ELSE 0 END"
    cell = f"list_append(acc, greatest({at('acc', 'j - 1')}, CASE WHEN {b}[j] = c THEN {at('line', 'j - 1')} + 1 ELSE line[j] END))"
    line = f"list_reduce(range(1, len({b}) + 1), lambda acc, j: {cell}, CAST([] AS BIGINT[]))"
    return f"coalesce(list_last(list_reduce({a}, lambda line, c: {line}, list_transform(range(0, len({b})), lambda k: CAST(0 AS BIGINT)))), 0)"


def sql_f1(n: str, a: str, b: str) -> str:
    return f"CASE WHEN {n} > 0 THEN 2 * ({n} / len({a})) * ({n} / len({b})) / ({n} / len({a}) + {n} / len({b})) ELSE 0.0::DOUBLE END"


TOKENS_S = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
MIXED_S = lambda x: rf"regexp_extract_all(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'), '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+[^A-Za-z0-9\x{{4e00}}-\x{{9fff}}]?|.')"
_GRAMS = lambda n: f"CASE WHEN len(c) >= {n} THEN len(list_distinct(list_transform(range(1, len(c) - {n} + 2), lambda i: c[i:i+{n}-1]))) / (len(c) - {n} + 1) ELSE 0.0::DOUBLE END"
_QUALITY = sorted({w.lower() for w in V.QUALITY})
COMPOSITE_S = f"""{PAIRS_S}, m AS (SELECT *, {MIXED_S("response")} AS c, {MIXED_S("source")} AS r, regexp_extract_all(response, {NUM}) AS o, regexp_extract_all(source, {NUM}) AS s,
  {sql_hits("lower(source)", _QUALITY)} AS hs, {" + ".join(f"CAST(contains(lower(source), {quoted(w)}) AND contains(lower(response), {quoted(w)}) AS INTEGER)" for w in _QUALITY)} AS hb FROM p),
l AS (SELECT *, {sql_lcs("c", "r")} AS lcs FROM m),
k AS (SELECT conv_id, turn, {sql_f1("lcs", "c", "r")} AS fidelity, CASE WHEN hs = 0 THEN 1.0 ELSE hb / hs END AS relevance, CASE WHEN len(o) = 0 THEN 0.5::DOUBLE * {STRUCTURE_S} ELSE len(list_filter(o, lambda x: list_contains(s, x))) / len(o) END AS grounding,
  CAST({STRUCTURE_S} AS DOUBLE) AS structure, ({_GRAMS(2)} + {_GRAMS(3)}) / 2.0::DOUBLE AS diversity, instruction, response FROM l),
q AS (SELECT *, 0.25::DOUBLE * fidelity + 0.25::DOUBLE * relevance + 0.2::DOUBLE * grounding + 0.15::DOUBLE * structure + 0.15::DOUBLE * diversity AS quality FROM k)"""
_PARTS = ("fidelity", "relevance", "grounding", "structure", "diversity", "quality")


@query(f"WITH {COMPOSITE_S} SELECT conv_id, turn, {', '.join(f'round({c}, 9) AS {c}' for c in _PARTS)} FROM q")
def composite_quality(spark, d):
    """Q2, Q3, Q7, F17."""
    return metrics.composite(_pairs(spark, d)).select("conv_id", "turn", *(F.round(c, 9).alias(c) for c in _PARTS))


@query(f"WITH {COMPOSITE_S} SELECT conv_id, turn, round(quality, 9) AS quality FROM q WHERE quality >= 0.5")
def release_filter(spark, d):
    """P10."""
    return metrics.filter_by_quality(_pairs(spark, d), 0.5).select("conv_id", "turn", F.round("quality", 9).alias("quality"))


@query(f"WITH {PAIRS_S}, t AS (SELECT conv_id, turn, {TOKENS_S('response')} AS c, {TOKENS_S('source')} AS r FROM p), l AS (SELECT *, {sql_lcs('c', 'r')} AS n FROM t) SELECT conv_id, turn, {sql_f1('n', 'c', 'r')} AS rouge_l FROM l")
def rouge_l(spark, d):
    """M1."""
    p = _pairs(spark, d).withColumn("c", T.ascii_tokens(F.col("response"))).withColumn("r", T.ascii_tokens(F.col("source")))
    return p.select("conv_id", "turn", metrics.rouge_l("c", "r").alias("rouge_l"))


def _bleu_parts() -> tuple[str, str, str]:
    """CTEs of n-gram hits and totals over p, their joins, and the character BLEU-4 of a row."""
    parts = []
    for n in range(1, 5):
        grams = lambda c, n=n: f"list_transform(range(1, length({c}) - {n} + 2), lambda i: substring({c}, CAST(i AS BIGINT), {n}))"
        parts.append(f"""g{n} AS (SELECT conv_id, turn, sum(least(a, coalesce(b, 0))) AS hit, sum(a) AS total FROM
  (SELECT conv_id, turn, g, count(*) AS a FROM (SELECT conv_id, turn, unnest({grams("response")}) AS g FROM p) GROUP BY ALL) x
  LEFT JOIN (SELECT conv_id, turn, g, count(*) AS b FROM (SELECT conv_id, turn, unnest({grams("source")}) AS g FROM p) GROUP BY ALL) y USING (conv_id, turn, g) GROUP BY ALL)""")
    joins = " ".join(f"LEFT JOIN g{n} USING (conv_id, turn)" for n in range(1, 5))
    product = " * ".join(f"(g{n}.hit / g{n}.total)" for n in range(1, 5))
    zero = " OR ".join(f"g{n}.hit = 0" for n in range(1, 5))
    return ", ".join(parts), joins, f"CASE WHEN length(response) < 4 OR length(source) < 4 OR {zero} THEN 0.0 ELSE least(1.0, exp(1 - length(source) / length(response))) * ({product}) ** 0.25 END"


def _bleu_sql() -> str:
    parts, joins, bleu = _bleu_parts()
    return f"WITH {PAIRS_S}, {parts} SELECT p.conv_id, p.turn, round({bleu}, 9) AS bleu4 FROM p {joins}"


@query(_bleu_sql())
def bleu4_char(spark, d):
    """M3."""
    return _pairs(spark, d).select("conv_id", "turn", F.round(metrics.bleu4_chars("response", "source"), 9).alias("bleu4"))


def _word_bleu_sql() -> str:
    parts = []
    for n in range(1, 5):
        grams = lambda c, n=n: f"list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i+{n}-1], ' '))"
        parts.append(f"""g{n} AS (SELECT conv_id, turn, sum(least(a, coalesce(b, 0))) AS hit, sum(a) AS total FROM
  (SELECT conv_id, turn, g, count(*) AS a FROM (SELECT conv_id, turn, unnest({grams("c")}) AS g FROM w) GROUP BY ALL) x
  LEFT JOIN (SELECT conv_id, turn, g, count(*) AS b FROM (SELECT conv_id, turn, unnest({grams("r")}) AS g FROM w) GROUP BY ALL) y USING (conv_id, turn, g) GROUP BY ALL)""")
    joins = " ".join(f"LEFT JOIN g{n} USING (conv_id, turn)" for n in range(1, 5))
    logs = " + ".join(f"ln((CASE WHEN coalesce(g{n}.hit, 0) = 0 THEN 0.1::DOUBLE ELSE g{n}.hit END) / coalesce(g{n}.total, 1))" for n in range(1, 5))
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '{S}+'), lambda w: w <> '')"
    return f"""WITH {PAIRS_S}, w AS (SELECT conv_id, turn, {split("response")} AS c, {split("source")} AS r FROM p), {", ".join(parts)}
SELECT w.conv_id, w.turn, round(CASE WHEN len(c) = 0 OR len(r) = 0 OR coalesce(g1.hit, 0) = 0 THEN 0.0 ELSE least(1.0, exp(1 - len(r) / len(c))) * exp(({logs}) / 4) END, 9) AS bleu FROM w {joins}"""


@query(_word_bleu_sql())
def bleu_word(spark, d):
    """M2."""
    return _pairs(spark, d).select("conv_id", "turn", F.round(metrics.bleu_words("response", "source"), 9).alias("bleu"))


def _corpus_bleu_sql() -> str:
    parts = []
    for n in range(1, 5):
        grams = lambda c, n=n: f"list_transform(range(1, length({c}) - {n} + 2), lambda i: substring({c}, CAST(i AS BIGINT), {n}))"
        parts.append(f"""g{n} AS (SELECT g, sum(hit) AS hit, sum(greatest(total, 1)) AS total FROM (SELECT conv_id, turn, sum(least(a, coalesce(b, 0))) AS hit, sum(a) AS total FROM
  (SELECT conv_id, turn, s, count(*) AS a FROM (SELECT conv_id, turn, unnest({grams("response")}) AS s FROM p) GROUP BY ALL) x
  LEFT JOIN (SELECT conv_id, turn, s, count(*) AS b FROM (SELECT conv_id, turn, unnest({grams("source")}) AS s FROM p) GROUP BY ALL) y USING (conv_id, turn, s) GROUP BY ALL) RIGHT JOIN z USING (conv_id, turn) GROUP BY g)""")
    logs = " + ".join(f"ln((CASE WHEN coalesce(g{n}.hit, 0) = 0 THEN 0.1::DOUBLE ELSE g{n}.hit END) / g{n}.total)" for n in range(1, 5))
    joins = " ".join(f"JOIN g{n} USING (g)" for n in range(1, 5))
    return f"""WITH {PAIRS_S}, z AS (SELECT conv_id, turn, conv_id % 4 AS g, length(response) AS c, length(source) AS r FROM p), {", ".join(parts)}, t AS (SELECT g, sum(c) AS c, sum(r) AS r FROM z GROUP BY g)
SELECT CAST(g AS BIGINT) AS g, round(CASE WHEN c = 0 OR g1.hit = 0 THEN 0.0 ELSE (CASE WHEN c > r THEN 1.0::DOUBLE ELSE exp(1 - r / c) END) * exp(({logs}) / 4) END, 9) AS bleu4 FROM t {joins}"""


@query(_corpus_bleu_sql())
def corpus_bleu4(spark, d):
    """M4."""
    return metrics.corpus_bleu4(_pairs(spark, d).withColumn("g", F.pmod("conv_id", F.lit(4))), "response", "source", ["g"]).select("g", F.round("bleu4", 9).alias("bleu4"))


@query("""SELECT lang, count(DISTINCT g) / count(*) AS distinct_2 FROM (SELECT lang, unnest(list_transform(range(1, length(text)), lambda i: substring(text, CAST(i AS BIGINT), 2))) AS g FROM documents) GROUP BY lang""")
def distinct_n_by_lang(spark, d):
    """M5."""
    return metrics.distinct_n(_docs(spark, d), "text", 2, ["lang"])


MIXED_WORDS = [*V.INTRINSIC, *V.LATIN_TOPICS]


@query(f"SELECT doc_id, least({sql_hits('lower(text)', MIXED_WORDS, fold=True)} / {float(len(MIXED_WORDS))} * 2, 1.0) AS relevance, {sql_presence('text', [*V.EVALUATOR, *V.LATIN_TOPICS], 3.0)} AS hits FROM documents")
def domain_relevance(spark, d):
    """M6."""
    return _docs(spark, d).select("doc_id", metrics.domain_relevance(F.col("text"), MIXED_WORDS).alias("relevance"), metrics.domain_hits(F.col("text"), [*V.EVALUATOR, *V.LATIN_TOPICS]).alias("hits"))


@query(f"""WITH {PAIRS_S}, n AS (SELECT *, list_distinct(regexp_extract_all(response, '[0-9]+')) AS o, list_distinct(regexp_extract_all(source, '[0-9]+')) AS s,
  list_distinct(list_filter(regexp_split_to_array(response, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: length(w) > 2)) AS ow, list_distinct(list_filter(regexp_split_to_array(source, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: length(w) > 2)) AS sw FROM p)
SELECT conv_id, turn, CASE WHEN len(o) = 0 THEN 1.0 ELSE len(list_intersect(o, s)) / len(o) END AS numbers, len(list_intersect(o, s)) / greatest(len(o), 1) * 0.5::DOUBLE + len(list_intersect(ow, sw)) / greatest(len(ow), 1) * 0.5::DOUBLE AS tokens FROM n""")
def factcheck(spark, d):
    """M7, M8."""
    return _pairs(spark, d).select("conv_id", "turn", metrics.factcheck_numbers(F.col("response"), F.col("source")).alias("numbers"), metrics.factcheck_tokens(F.col("response"), F.col("source")).alias("tokens"))


def _eval_sql() -> str:
    parts, joins, bleu = _bleu_parts()
    words = [w.lower() for w in V.INTRINSIC]
    part = lambda n: f"d{n} AS (SELECT label, count(DISTINCT s) / count(*) AS distinct_{n} FROM (SELECT 'set' || (conv_id % 3) AS label, unnest(list_transform(range(1, length(response) - {n} + 2), lambda i: substring(response, CAST(i AS BIGINT), {n}))) AS s FROM p) GROUP BY label)"
    half = lambda x, n: f"CASE WHEN length({STRIP(x)}) >= {n} THEN 0.5::DOUBLE ELSE 0 END"
    return f"""WITH {PAIRS_S}, {parts}, {part(1)}, {part(2)},
t AS (SELECT 'set' || (p.conv_id % 3) AS label, response, source, instruction, {bleu} AS bleu, {TOKENS_S("response")} AS c, {TOKENS_S("source")} AS r, list_distinct(regexp_extract_all(response, '[0-9]+')) AS o, list_distinct(regexp_extract_all(source, '[0-9]+')) AS s FROM p {joins}),
l AS (SELECT *, {sql_lcs("c", "r")} AS n FROM t),
e AS (SELECT label, {sql_f1("n", "c", "r")} AS rouge, bleu, least({sql_hits("lower(response)", words)} / {float(len(words))} * 2, 1.0) AS domain, CASE WHEN len(o) = 0 THEN 1.0 ELSE len(list_intersect(o, s)) / len(o) END AS fact, {half("instruction", 10)} + {half("response", 20)} AS structural FROM l)
SELECT label, count(*) AS n, round(avg(rouge), 9) AS rouge_l, round(avg(bleu), 9) AS bleu4, round(avg(domain), 9) AS domain_relevance, round(avg(fact), 9) AS factcheck, round(avg(structural), 9) AS structural, round(any_value(distinct_1), 9) AS distinct_1, round(any_value(distinct_2), 9) AS distinct_2, CAST(NULL AS DOUBLE) AS bertscore, CAST(NULL AS DOUBLE) AS bleurt
FROM e JOIN d1 USING (label) JOIN d2 USING (label) GROUP BY label"""


@query(_eval_sql())
def dataset_eval_by_label(spark, d):
    """A13."""
    out = metrics.evaluate(_pairs(spark, d).withColumn("label", F.concat(F.lit("set"), F.pmod("conv_id", F.lit(3)).cast("string"))), ["label"])
    return out.select(*(c if c in ("label", "n") else F.round(c, 9).alias(c) for c in out.columns))


@query(f"WITH {sql_chunks('documents')}, n AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id) SELECT source, count(*) AS documents, CAST(coalesce(sum(c), 0) AS BIGINT) AS chunks FROM documents LEFT JOIN n USING (doc_id) GROUP BY ROLLUP (source)")
def corpus_stats_rollup(spark, d):
    """A1."""
    docs = _docs(spark, d)
    return stats.corpus_stats(docs, chunking.chunk(docs).select("doc_id"), "source").select("source", "documents", F.col("chunks").cast("long").alias("chunks"))


@query("SELECT source, year, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_transform(regexp_extract_all(name, '20[12][0-9]'), lambda y: CAST(y AS INTEGER)))) AS year FROM (SELECT o_orderpriority AS source, 'doc_' || strftime(o_orderdate, '%Y_%m') || '_' || (2010 + o_orderkey % 20) AS name FROM orders)) WHERE year BETWEEN 2015 AND 2026 GROUP BY ALL")
def year_histogram(spark, d):
    """Years in names."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("doc_"), F.date_format("o_orderdate", "yyyy_MM"), F.lit("_"), (F.lit(2010) + F.pmod("o_orderkey", F.lit(20))).cast("int").cast("string"))
    return stats.year_histogram(o.select(F.col("o_orderpriority").alias("source"), name.alias("chunk_id")), "source")


YEARS = list(range(1992, 1999))


@query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE year(o_orderdate) = {y}) AS \"{y}\"" for y in YEARS) + " FROM orders GROUP BY o_orderpriority")
def layer_year_matrix(spark, d):
    """A10."""
    return stats.matrix(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "o_orderpriority", "y", YEARS)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def audit_counts(spark, d):
    """A11."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS files, count(*) FILTER (WHERE n_chars = 0) AS empty, count(*) FILTER (WHERE n_chars < 50) AS short FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def processing_verification(spark, d):
    """A12."""
    return stats.verification(_docs(spark, d), "lang", "source", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_anti(spark, d):
    """J1, U2."""
    return sampling.unprocessed(_docs(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT source, count(*) AS expected, count(*) FILTER (WHERE l IS NULL) AS missing, 100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE l IS NULL)) / count(*) AS coverage FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON l = doc_id GROUP BY source")
def coverage_missing(spark, d):
    """J2."""
    return sampling.missing(_docs(spark, d), table(spark, d, "labels"), "doc_id", "source")


@query("SELECT o_orderkey FROM orders ORDER BY year(o_orderdate) DESC, o_orderkey LIMIT 500")
def year_first_take(spark, d):
    """W5."""
    return sampling.newest_first(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "y", 500, "o_orderkey").select("o_orderkey")


MD5 = lambda k: f"md5({k} || '|42')"
WEIGHTS = {1998: 0.40, 1997: 0.30, 1996: 0.20, 1995: 0.10}


@query(f"""SELECT o_orderkey, y FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY {MD5("o_orderkey")}, o_orderkey) AS r FROM orders)
WHERE r <= CASE y WHEN 1998 THEN 200 WHEN 1997 THEN 150 WHEN 1996 THEN 100 WHEN 1995 THEN 50 ELSE 0 END""")
def year_weighted_sample(spark, d):
    """O8."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return sampling.by_year(o, "y", 500, "o_orderkey", WEIGHTS).select("o_orderkey", "y")


@query(f"SELECT o_orderkey FROM orders ORDER BY {MD5('o_orderkey')}, o_orderkey LIMIT 300")
def hash_sample(spark, d):
    """O4, O5, O6."""
    return sampling.sample(table(spark, d, "orders"), 300, "o_orderkey").select("o_orderkey")


@query(f"""SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {MD5("doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= floor(n * 0.25)""")
def layer_ratio_sample(spark, d):
    """O9."""
    return sampling.by_layer(_docs(spark, d), "source", 0.25, "doc_id").select("doc_id")


@query(f"""SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.05)) THEN 'eval' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {MD5("doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def stratified_split(spark, d):
    """O10."""
    return sampling.split(_docs(spark, d), "doc_id", 0.05, "lang").select("doc_id", "split")


@query(f"""WITH {RECORDS_S}, e AS (SELECT doc_id, unnest(experts) AS item FROM r), f AS (SELECT DISTINCT min(doc_id) AS id FROM e GROUP BY item)
SELECT doc_id FROM r LEFT JOIN f ON f.id = doc_id ORDER BY (f.id IS NULL), {MD5("doc_id")}, doc_id LIMIT 50""")
def coverage_sample(spark, d):
    """O7."""
    return sampling.coverage(_records(spark, d), "experts", [*V.LATIN_TOPICS, "none"], 50, "doc_id", "doc_id")[0].select("doc_id")


@query("""WITH l AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS r, row_number() OVER (ORDER BY value, event_id) AS s, count(*) OVER () AS n FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500))
SELECT max(n) AS n, max(value) FILTER (WHERE s = floor(n / 2) + 1) AS upper_median, avg(value) FILTER (WHERE r <= floor(n / 2)) AS first_half, avg(value) FILTER (WHERE r > floor(n / 2)) AS second_half,
  avg(value) FILTER (WHERE r > floor(n / 2)) - avg(value) FILTER (WHERE r <= floor(n / 2)) AS trend FROM l""")
def latest_trend(spark, d):
    """W2."""
    return sampling.latest(table(spark, d, "events"), 500, "event_id", "value")


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM events")
def running_quality(spark, d):
    """W3."""
    return sampling.running_mean(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "user_id", F.round("running_mean", 9).alias("running_mean"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def batch_slice(spark, d):
    """W4."""
    return sampling.batch(_docs(spark, d), 2, 100, "doc_id", table(spark, d, "labels")).select("doc_id")


SCORES = "SELECT l_returnflag AS model, 'tax' AS metric, l_orderkey * 10 + l_linenumber AS id, l_tax AS v FROM lineitem"


def _scores(spark, d) -> DataFrame:
    """Two models' scores of orders on two metrics: the mean tax and discount of lines of two flags."""
    li = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')")
    g = li.groupBy("l_orderkey", "l_returnflag").agg(F.round(F.avg("l_tax"), 9).alias("tax"), F.round(F.avg("l_discount"), 9).alias("discount"))
    long = g.unpivot(["l_orderkey", "l_returnflag"], ["tax", "discount"], "metric", "value")
    both = long.groupBy("l_orderkey", "metric").agg(F.count("*").alias("c")).where("c = 2").select("l_orderkey", "metric")
    return long.join(both, ["l_orderkey", "metric"]).select(F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("model"), "metric", "value")


SCORES_S = """g AS (SELECT l_orderkey AS sample, l_returnflag AS model, round(avg(l_tax), 9) AS tax, round(avg(l_discount), 9) AS discount FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
q AS (SELECT a.sample, m.metric, CASE m.metric WHEN 'tax' THEN a.tax ELSE a.discount END AS va, CASE m.metric WHEN 'tax' THEN b.tax ELSE b.discount END AS vb FROM g a JOIN g b USING (sample), (VALUES ('tax'), ('discount')) m(metric) WHERE a.model = 'A' AND b.model = 'R')"""


@query(f"WITH {SCORES_S} SELECT metric, sample, round(va, 9) AS va, round(vb, 9) AS vb FROM q")
def paired_scores(spark, d):
    """J7, J3."""
    return stats.paired(_scores(spark, d), "sample", "model", "metric", "value", "A", "R").select("metric", "sample", F.round("va", 9).alias("va"), F.round("vb", 9).alias("vb"))


#: The two-sided p of a normal deviate, by Simpson's rule over its density.
_P = "least(1.0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(abs(z) * k / 2000, 2) / 2))) * abs(z) / 2000 / 3 / sqrt(2 * pi()))"


@query(f"""WITH {SCORES_S}, x AS (SELECT metric, va, vb, va - vb AS d, abs(va - vb) AS m FROM q), e AS (SELECT metric, m, count(*) AS c, count(*) FILTER (WHERE d > 0) AS up FROM x WHERE d <> 0 GROUP BY metric, m),
r AS (SELECT *, sum(c) OVER (PARTITION BY metric ORDER BY m ROWS UNBOUNDED PRECEDING) - (c - 1) / 2 AS rank FROM e), s AS (SELECT metric, sum(rank * up) AS w, CAST(sum(c) AS DOUBLE) AS n, CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM r GROUP BY metric),
v AS (SELECT metric, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s), a AS (SELECT metric, avg(va) AS mean_a, avg(vb) AS mean_b FROM x GROUP BY metric)
SELECT metric, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(mean_a - mean_b, 9) AS diff, w AS w_plus, round(z, 6) AS z, round({_P}, 6) AS p, {_P} < 0.05 AS significant FROM v JOIN a USING (metric)""")
def wilcoxon_pairs(spark, d):
    """V3, V4."""
    out = stats.wilcoxon(stats.paired(_scores(spark, d), "sample", "model", "metric", "value", "A", "R"), "metric")
    return out.select("metric", *(F.round(c, 9).alias(c) for c in ("mean_a", "mean_b", "diff")), "w_plus", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"), "significant")


@query()
def bootstrap_ci(spark, d):
    """V1: seen against the normal interval in the tests, since draws are random."""
    p = stats.paired(_scores(spark, d), "sample", "model", "metric", "value", "A", "R")
    return stats.bootstrap_ci(p.select("metric", "sample", (F.col("va") - F.col("vb")).alias("diff")), "metric", "diff", "sample", draws=200)


@query()
def paired_bootstrap(spark, d):
    """V2."""
    return stats.paired_bootstrap(stats.paired(_scores(spark, d), "sample", "model", "metric", "value", "A", "R"), "metric", "sample", draws=200)


@query("""WITH g AS (SELECT o_orderpriority AS c, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY ALL), b AS (SELECT n AS bn, m AS bm, s AS bs FROM g WHERE c = '1-URGENT')
SELECT c AS o_orderpriority, n, round(m, 4) AS mean, round(s, 4) AS sd, round(m - 1.96 * s / sqrt(n), 4) AS low, round(m + 1.96 * s / sqrt(n), 4) AS high, CASE WHEN c <> '1-URGENT' THEN round((m - bm) / sqrt(s * s / n + bs * bs / bn), 6) END AS t,
  CASE WHEN c <> '1-URGENT' THEN round((s*s/n + bs*bs/bn) * (s*s/n + bs*bs/bn) / ((s*s/n) * (s*s/n) / (n - 1) + (bs*bs/bn) * (bs*bs/bn) / (bn - 1)), 4) END AS df FROM g, b""")
def welch_vs_baseline(spark, d):
    """V5."""
    w = stats.welch(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "1-URGENT")
    return w.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "low", "high")), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


LONG_S = "l AS (SELECT l_returnflag AS method, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([avg(l_quantity), avg(l_discount), avg(l_tax)]) AS value FROM lineitem GROUP BY l_returnflag)"


def _long(spark, d) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return g.unpivot("method", ["quantity", "discount", "tax"], "metric", "value")


@query(f"WITH {LONG_S} SELECT method, metric, round(value, 9) AS value, round(value / max(value) OVER (PARTITION BY metric), 9) AS normalized, value = max(value) OVER (PARTITION BY metric) AS best FROM l")
def best_per_metric(spark, d):
    """A14, K6."""
    return stats.best_per_metric(_long(spark, d)).select("method", "metric", F.round("value", 9).alias("value"), F.round("normalized", 9).alias("normalized"), "best")


@query(f"WITH {LONG_S} SELECT metric, round(max(value) FILTER (WHERE method = 'A'), 9) AS ours, round(max(value) FILTER (WHERE method <> 'A'), 9) AS best_other, round(max(value) FILTER (WHERE method = 'A') / max(value) FILTER (WHERE method <> 'A'), 9) AS ratio FROM l GROUP BY metric")
def relative_gain(spark, d):
    """V6."""
    return stats.relative_gain(_long(spark, d), "A").select("metric", *(F.round(c, 9).alias(c) for c in ("ours", "best_other", "ratio")))


@query("SELECT o_orderpriority AS experiment, o_orderstatus AS value, max(o_custkey) AS n_items, round(sum(o_totalprice), 2) AS seconds, round(max(o_custkey) * 60 / sum(o_totalprice), 9) AS per_minute FROM orders GROUP BY ALL")
def stage_throughput(spark, d):
    """A15."""
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("experiment"), F.col("o_orderstatus").alias("value"), F.col("o_custkey").alias("n_items"), F.col("o_totalprice").alias("wall_seconds"))
    return stats.throughput(s).select("experiment", "value", "n_items", F.round("seconds", 2).alias("seconds"), F.round("per_minute", 9).alias("per_minute"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Tumbling windows, as a table."""
    return streams.event_windows(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    """Session windows over events."""
    return streams.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def generate_pairs(spark, d):
    """The whole way from chunk to record with the extractive generator."""
    out = generation.pairs(accepted_chunks(spark, d))
    return out.select("chunk_id", F.array_join("experts", ",").alias("experts"), "expert", gates.task_type(F.col("expert")).alias("task_type"), "quality_score", "status", F.md5("response").alias("response"))


@query()
def preprocess_audit(spark, d):
    """Audit actions of the whole preprocessing."""
    return chunking.preprocess(_docs(spark, d))[1].groupBy("action").agg(F.count("*").alias("n"))
