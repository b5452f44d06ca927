"""Further queries: text functions, readers of replies, samples, tables of runs, and generation, with the same in SQL
where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contains, dedup, gates, generation, metrics, replies, sampling, stats
from ..session import Scratch, table
from ..sources import corpus_files, files, sinks
from ..streaming import monitor, streams
from .queries import QUERIES, SQL, CNT, D_S, MD5, PAIRS_S, PUNCT_S, RECORDS_S, STRIP, _chunks, _docs, _more, _pairs, _records, accepted_chunks, query, quoted, sql_chunks, sql_gate, sql_sanitize

__all__ = ["QUERIES", "SQL"]

S_ENC = PUNCT_S.replace("''", "")  # the encoding repair's punctuation has no apostrophe


def _valid(x: str) -> str:
    return f"(({CNT(x, '一-龥')} + {CNT(x, 'a-zA-Z')} + {CNT(x, '0-9')} + {CNT(x, S_ENC)}) / greatest(length({x}), 1))"


def _line(x: str) -> str:
    latin = f"regexp_extract_all({x}, '[a-zA-Z]+')"
    found = f"array_to_string(list_concat(list_concat(regexp_extract_all({x}, '[一-龥]+'), {latin}), regexp_extract_all({x}, '[0-9]+')), ' ')"
    useful = f"({CNT(x, '一-龥')} > 0 OR length(array_to_string({latin}, ' ')) > 20) AND length({found}) > 5"
    return rf"CASE WHEN length({x}) > 10 AND {_valid(x)} < 0.30 THEN CASE WHEN {useful} THEN {found} END ELSE regexp_replace({x}, '[\x{{E000}}-\x{{F8FF}}\x{{FFFD}}\x00-\x08\x0B-\x1F\x7F]', '', 'g') END"


@query(f"""WITH {D_S}, l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_line('x')}), lambda x: x IS NOT NULL), chr(10)) AS t FROM d)
SELECT doc_id, md5(array_to_string(list_filter(string_split(t, chr(10) || chr(10)), lambda p: {STRIP('p')} = '' OR {_valid('p')} >= 0.50 OR (length(p) < 20 AND ({CNT('p', '一-龥')} > 0 OR {CNT('p', 'a-zA-Z')} > 5))), chr(10) || chr(10))) AS hash FROM l""")
def repaired_texts(spark, d):
    """F3."""
    return _more(spark, d).select("doc_id", F.md5(T.fix_encoding(F.col("text"))).alias("hash"))


#: A few traditional characters, for the test of the conversion; the whole table is a parameter.
SIMPLER = {"減": "减", "業": "业", "環": "环", "員": "员", "e": "e"}


@query(f"WITH {D_S} SELECT doc_id, md5(translate(replace(text, '企', '業'), '{''.join(SIMPLER)}', '{''.join(SIMPLER.values())}')) AS hash FROM d")
def simplified_texts(spark, d):
    """F5."""
    return _more(spark, d).select("doc_id", F.md5(T.to_simplified(F.replace("text", F.lit("企"), F.lit("業")), SIMPLER)).alias("hash"))


_PATHS = "CASE doc_id % 5 WHEN 0 THEN source || '/' || lang || '/d_' || (1990 + doc_id % 130) || '_x.pdf' WHEN 1 THEN 'a\\b' || (2000 + doc_id % 40) || '年报.docx' WHEN 2 THEN 'r (' || (1995 + doc_id % 40) || ').txt' WHEN 3 THEN 'x_1850_' || (2005 + doc_id % 30) || '.v2.txt' ELSE 'none' END"
_YEAR = lambda x, p, a, b: rf"CASE WHEN try_cast(regexp_extract({x}, '{p}', 1) AS INTEGER) BETWEEN {a} AND {b} THEN CAST(regexp_extract({x}, '{p}', 1) AS INTEGER) END"
_PLACES = (r"_([0-9]{4})_", r"([0-9]{4})年", r"\(([0-9]{4})\)", r"_([0-9]{4})\.")


@query(rf"""WITH p AS (SELECT doc_id, {_PATHS} AS p FROM documents), n AS (SELECT doc_id, p, regexp_replace(regexp_replace(p, '[/\\]', '_', 'g'), '\.[^._]*$', '') AS n FROM p)
SELECT doc_id, n AS name, coalesce({", ".join(_YEAR("p", x, 1900, 2100) for x in _PLACES[:2])}, 0) AS year, coalesce({", ".join(_YEAR("p", x, 2000, 2024) for x in _PLACES)}) AS chunk_year FROM n""")
def names_and_years(spark, d):
    """Document names from paths, years in names by both rules."""
    k = F.col("doc_id")
    path = F.when(k % 5 == 0, F.concat_ws("/", "source", "lang", F.concat(F.lit("d_"), (F.lit(1990) + k % 130).cast("string"), F.lit("_x.pdf")))).when(k % 5 == 1, F.concat(F.lit("a\\b"), (F.lit(2000) + k % 40).cast("string"), F.lit("年报.docx")))
    path = path.when(k % 5 == 2, F.concat(F.lit("r ("), (F.lit(1995) + k % 40).cast("string"), F.lit(").txt"))).when(k % 5 == 3, F.concat(F.lit("x_1850_"), (F.lit(2005) + k % 30).cast("string"), F.lit(".v2.txt"))).otherwise("none")
    df = _docs(spark, d).select("doc_id", path.alias("p"))
    return df.select("doc_id", T.doc_id(F.col("p")).alias("name"), T.year_of_id(F.col("p")).alias("year"), T.year_of_chunk(F.col("p")).alias("chunk_year"))


@query(f"""WITH {PAIRS_S}, x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '工作指令：  ' WHEN 1 THEN 'WORK Instruction: ' ELSE '' END || instruction AS i, response FROM p)
SELECT conv_id, turn, regexp_replace(regexp_replace(i, '^工作指令[:：][ \\t\\n\\r]*', ''), '(?i)^work instruction[:：][ \\t\\n\\r]*', '') AS instruction, CASE WHEN length(response) > 40 THEN left(response, 37) || '...' ELSE response END AS shown FROM x""")
def shown_pairs(spark, d):
    """F21, P14."""
    head = F.when(F.col("turn") % 3 == 0, "工作指令：  ").when(F.col("turn") % 3 == 1, "WORK Instruction: ").otherwise("")
    return _pairs(spark, d).select("conv_id", "turn", T.strip_prefix(F.concat(head, F.col("instruction"))).alias("instruction"), T.shorten(F.col("response"), 40).alias("shown"))


_JSON = """CASE doc_id % 4 WHEN 0 THEN json_object('question', left(text, 20), 'answer', lang, 'metadata', json_object('chunk_id', source, 'quality_score', 0.5, 'experts', json_array(lang, source)))
  WHEN 1 THEN json_object('instruction', left(text, 20), 'question', '', 'output', lang, 'input', source, 'quality_score', 'no number', 'selected_experts', json_array('x'))
  WHEN 2 THEN json_object('response', lang, 'text', source, 'source_chunk_id', 'c', 'source_doc_id', 'd', 'quality_score', 0.25) ELSE json_object('other', 1) END"""
_GET = lambda *paths: "coalesce(" + ", ".join(f"nullif(json_extract_string(r, '{p}'), '')" for p in paths) + ", '')"


@query(f"""WITH j AS (SELECT doc_id, {_JSON} AS r FROM documents)
SELECT doc_id, {_GET("$.question", "$.instruction")} AS instruction, {_GET("$.answer", "$.output", "$.response")} AS response, {_GET("$.chunk", "$.text", "$.input", "$.metadata.chunk", "$.metadata.chunk_text", "$.metadata.text")} AS source,
  {_GET("$.chunk_id", "$.source_chunk_id", "$.metadata.chunk_id")} AS chunk_id, {_GET("$.doc_id", "$.source_doc_id", "$.metadata.doc_id")} AS record_doc, coalesce(try_cast(json_extract_string(r, '$.metadata.quality_score') AS DOUBLE), try_cast(json_extract_string(r, '$.quality_score') AS DOUBLE)) AS quality_score,
  array_to_string(coalesce(CAST(json_extract(r, '$.metadata.selected_experts') AS VARCHAR[]), CAST(json_extract(r, '$.metadata.experts') AS VARCHAR[]), CAST(json_extract(r, '$.metadata.expert_ids') AS VARCHAR[]), CAST(json_extract(r, '$.selected_experts') AS VARCHAR[]), []), ',') AS experts FROM j""")
def tolerant_records(spark, d):
    """Records of four shapes in one."""
    k, head = F.col("doc_id") % 4, F.substring("text", 1, 20)
    shapes = [
        F.to_json(F.struct(head.alias("question"), F.col("lang").alias("answer"), F.struct(F.col("source").alias("chunk_id"), F.lit(0.5).alias("quality_score"), F.array("lang", "source").alias("experts")).alias("metadata"))),
        F.to_json(F.struct(head.alias("instruction"), F.lit("").alias("question"), F.col("lang").alias("output"), F.col("source").alias("input"), F.lit("no number").alias("quality_score"), F.array(F.lit("x")).alias("selected_experts"))),
        F.to_json(F.struct(F.col("lang").alias("response"), F.col("source").alias("text"), F.lit("c").alias("source_chunk_id"), F.lit("d").alias("source_doc_id"), F.lit(0.25).alias("quality_score"))),
        F.lit('{"other": 1}'),
    ]
    raw = F.when(k == 0, shapes[0]).when(k == 1, shapes[1]).when(k == 2, shapes[2]).otherwise(shapes[3])
    r = _docs(spark, d).select("doc_id", files.tolerant(raw).alias("r"))
    return r.select("doc_id", *(f"r.{c}" for c in ("instruction", "response", "source", "chunk_id")), F.col("r.doc_id").alias("record_doc"), "r.quality_score", F.array_join("r.experts", ",").alias("experts"))


#: Replies of several kinds, with labels in both languages, twice, lacking, and with colons inside.
SAID = [
    "Question: What is it?\nAnswer: This: and that", "问题：甲\n答案：乙:丙", "question: a\nQuestion: b\nAnswer: c\nANSWER: d", "no label at all", "first block\n\nsecond: block\n\nthird", "",
    "Instruction: Do it\nSummary: Short: one\nmore", "指令：做\n摘要：短", "Instruction:\nSummary:", "指令: 提取\n提取结果：甲", "Instruction: x\nThe classification result: E", "分类结果：S\n指令：分类", "Instruction: a\nAnalysis result: good\nanalysis RESULT: better", "指令：答\n回答：好", " instruction: padded\n  answer: padded too", "Answer: only", "Instruction: only",
    "Instruction: do\nAnswer: one long line\nand more of it", "Answer: short", "指令：总结以下内容\n回答：这是一个足够长的答复内容", "1. 指令: 分析全文内容\n2. 回答: 第一部分内容足够长的一句话",
]
#: Replies made of the turns of all conversations, with the labels of five kinds of reply around them.
_TURNS = "SELECT 1000 + conv_id * 100 + turn AS i, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Question: ' || t || {nl} || 'Answer: ' || role || ' ' || t WHEN 1 THEN '指令：' || t || {nl} || '回答：' || t WHEN 2 THEN 'Instruction: as the ' || role || {nl} || 'Summary: ' || t WHEN 3 THEN t ELSE t || {nl} || {nl} || 'Analysis result: ' || t END AS reply FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"
SAID_S = "s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(SAID)) + ") v(i, reply) UNION ALL " + _TURNS.format(nl="chr(10)") + "), e AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}')" for e in replies.READERS) + ") v(expert))"


def _said(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.sql(_TURNS.format(nl="chr(10)").replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, d, "conversations"))
    return spark.createDataFrame(list(enumerate(SAID)), "i int, reply string").unionByName(turns.select(F.col("i").cast("int").alias("i"), "reply"))


def _after_sql(x: str) -> str:
    return STRIP(f"regexp_replace(regexp_replace({x}, '(?s)^[^：]*：', ''), '(?s)^[^:]*:', '')")


def _reader_sql() -> str:
    ask, tell, default = [], [], []
    plain = lambda p: quoted(re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", p))
    for kind, form in replies.FORMS.items():
        of = ", ".join(f"'{e}'" for e, (k, _) in replies.READERS.items() if k == kind)
        last = lambda test: f"CASE WHEN len(list_filter(l, lambda x: {test})) > 0 THEN {_after_sql(f'list_last(list_filter(l, lambda x: {test}))')} END"
        asked = f"regexp_matches(x, {plain(form.asks)})"
        ask.append(f"WHEN expert IN ({of}) THEN {last(asked)}")
        tell.append(f"WHEN expert IN ({of}) THEN {last(f'NOT {asked} AND regexp_matches(x, {plain(form.tells)})')}")
    default = " ".join(f"WHEN '{e}' THEN {quoted(t)}" for e, (_, t) in replies.READERS.items())
    block = lambda k, label: STRIP(f"regexp_replace({STRIP(f'''regexp_replace(b[{k}], '{label}[：:]', '', 'g')''')}, '(?s)^[^:]*:', '')")
    return f"""WITH {SAID_S}, l AS (SELECT i, expert, reply, string_split({STRIP("reply")}, chr(10)) AS l, string_split(reply, chr(10) || chr(10)) AS b FROM s, e),
p AS (SELECT *, CASE {" ".join(ask)} END AS a, CASE {" ".join(tell)} END AS t FROM l), q AS (SELECT *, expert = 'qa_expert' AND (coalesce(a, '') = '' OR coalesce(t, '') = '') AND len(b) >= 2 AS blocks FROM p),
r AS (SELECT i, expert, reply, CASE WHEN blocks THEN {block(1, "问题")} ELSE a END AS a, CASE WHEN blocks THEN {block(2, "答案")} ELSE t END AS t FROM q)
SELECT CAST(i AS INTEGER) AS i, expert, coalesce(CASE WHEN expert = 'qa_expert' THEN nullif(a, '') ELSE a END, CASE expert {default} END) AS instruction, coalesce(nullif(t, ''), CASE WHEN expert = 'qa_expert' THEN reply ELSE {STRIP("reply")} END) AS response FROM r"""


@query(_reader_sql())
def expert_replies(spark, d):
    """the replies of all twelve kinds of experts."""
    names = spark.createDataFrame([(e,) for e in replies.READERS], "expert string")
    each = _said(spark, d).join(F.broadcast(names))  # a dozen kinds
    return each.select("i", "expert", replies.read_any(F.col("expert"), F.col("reply")).alias("p")).select("i", "expert", "p.*")


_ASK, _TELL = "^(Instruction|指令|Question|问题)[:：]", "^(Answer|Response|回答|答案)[:：]"


@query(f"""WITH {SAID_S}, l AS (SELECT i, reply, list_transform(string_split({STRIP("reply")}, chr(10)), lambda x: {STRIP("x")}) AS l FROM s),
f AS (SELECT i, reply, list_reduce(l, lambda a, x: CASE WHEN regexp_matches(x, '{_TELL}') THEN {{'q': a.q, 'a': [{STRIP(f"regexp_replace(x, '{_TELL}', '')")}], 'o': true}} WHEN regexp_matches(x, '{_ASK}') THEN {{'q': {STRIP(f"regexp_replace(x, '{_ASK}', '')")}, 'a': a.a, 'o': false}}
  ELSE {{'q': a.q, 'a': CASE WHEN a.o THEN list_append(a.a, x) ELSE a.a END, 'o': a.o}} END, {{'q': '', 'a': CAST([] AS VARCHAR[]), 'o': false}}) AS f FROM l)
SELECT CAST(i AS INTEGER) AS i, CASE WHEN f.q = '' THEN 'Analyze the following ESG-related content.' ELSE f.q END AS instruction, CASE WHEN length({STRIP("array_to_string(f.a, chr(10))")}) < 10 THEN {STRIP("reply")} ELSE {STRIP("array_to_string(f.a, chr(10))")} END AS response FROM f""")
def baseline_replies(spark, d):
    """F23."""
    return _said(spark, d).select("i", generation.parse_multiline(F.col("reply")).alias("p")).select("i", "p.*")


@query()
def marked_replies(spark, d):
    """against a plain version in the tests."""
    return _said(spark, d).select("i", replies.read_marks(F.col("reply")).alias("p")).select("i", "p.*")


@query(f"WITH {RECORDS_S} SELECT source, round(avg(CASE WHEN quality > 0 THEN quality END), 9) AS mean, count(*) AS n FROM r GROUP BY source")
def positive_quality(spark, d):
    """A18."""
    return stats.positive_mean(_records(spark, d), "quality", ["source"]).select("source", F.round("mean", 9).alias("mean"), "n")


@query(f"WITH {RECORDS_S} SELECT count(DISTINCT e) AS distinct_items FROM (SELECT unnest(experts) AS e FROM r)")
def distinct_topics(spark, d):
    """A4: the number of distinct topics."""
    return stats.distinct_items(_records(spark, d), "experts")


@query(f"WITH {RECORDS_S}, t AS (SELECT *, CAST(floor(length(output) * 1.5) AS INTEGER) AS t FROM r) SELECT count(*) AS n, avg(length(instruction)) AS avg_instruction, avg(length(output)) AS avg_output, CAST(max(length(instruction)) AS INTEGER) AS max_instruction, CAST(max(length(output)) AS INTEGER) AS max_output, avg(t) AS avg_tokens, max(t) AS max_tokens, count(*) FILTER (WHERE t > 2048) AS exceeding FROM t")
def dataset_stats(spark, d):
    """A16."""
    return stats.dataset_stats(_records(spark, d), tokens=T.token_estimate(F.col("output")))


@query(f"WITH {sql_chunks('documents')} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS unique_docs, count(*) FILTER (WHERE trim(text) = '') AS empty_chunks, count(*) FILTER (WHERE length(trim(text)) BETWEEN 1 AND 49) AS short_chunks, (SELECT count(*) FROM documents) AS files, 100.0::DOUBLE * count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS coverage FROM chunks")
def processing_coverage(spark, d):
    """What processing left of the files."""
    return stats.coverage(_docs(spark, d), _chunks(spark, d))


@query(f"WITH {RECORDS_S} SELECT doc_id FROM (SELECT doc_id, quality FROM r ORDER BY doc_id LIMIT 300) WHERE quality >= 0.6 ORDER BY {MD5('doc_id')}, doc_id LIMIT 40")
def good_sample(spark, d):
    """O6."""
    return sampling.good_sample(_records(spark, d), 40, "doc_id", "quality", 0.6, 300).select("doc_id")


@query("SELECT p_partkey, p_brand, CAST(row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END, p_retailprice, p_partkey) AS INTEGER) AS place FROM part WHERE p_brand IN ('Brand#3', 'Brand#1', 'Brand#2')")
def plan_order(spark, d):
    """By rank of a tier, then by size."""
    return sampling.plan(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), ["Brand#3", "Brand#1", "Brand#2"], "p_brand", "p_retailprice").select("p_partkey", "p_brand", "place")


_LAYERED = "CASE doc_id % 6 WHEN 0 THEN 'Layer2_治理_' WHEN 1 THEN '第三层_员工治理_' WHEN 2 THEN '第四层_社会_' WHEN 3 THEN 'Layer1_环境_' WHEN 4 THEN '' ELSE 'other_Layer4_' END || source"


@query(f"""WITH n AS (SELECT doc_id, {_LAYERED} AS n FROM documents)
SELECT doc_id, CASE split_part(n, '_', 1) WHEN 'Layer1' THEN 'Layer1' WHEN 'Layer2' THEN 'Layer2' WHEN 'Layer3' THEN 'Layer3' WHEN 'Layer4' THEN 'Layer4' WHEN '第一层' THEN 'Layer1' WHEN '第二层' THEN 'Layer2' WHEN '第三层' THEN 'Layer3' WHEN '第四层' THEN 'Layer4' ELSE 'unknown' END AS layer,
  CASE WHEN contains(n, 'Layer1') THEN 'Layer1' WHEN contains(n, 'Layer2') THEN 'Layer2' WHEN contains(n, 'Layer3') THEN 'Layer3' WHEN contains(n, 'Layer4') THEN 'Layer4' END AS within,
  CASE WHEN contains(n, '治理') THEN 'Governance Structure' WHEN contains(n, '员工') OR contains(n, '社会') THEN 'Social Responsibility' WHEN contains(n, '环境') THEN 'Environmental Management' END AS section FROM n""")
def layers_and_sections(spark, d):
    """P11."""
    k = F.col("doc_id") % 6
    head = F.when(k == 0, "Layer2_治理_").when(k == 1, "第三层_员工治理_").when(k == 2, "第四层_社会_").when(k == 3, "Layer1_环境_").when(k == 4, "").otherwise("other_Layer4_")
    n = F.concat(head, F.col("source"))
    return _docs(spark, d).select("doc_id", gates.known_layer(n).alias("layer"), gates.layer_within(n).alias("within"), gates.section_of(n).alias("section"))


@query("""WITH g AS (SELECT o_orderpriority AS c, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY ALL), b AS (SELECT n AS bn, m AS bm, s AS bs FROM g WHERE c = '1-URGENT'),
t AS (SELECT c, CASE WHEN c <> '1-URGENT' THEN (m - bm) / sqrt(s * s / n + bs * bs / bn) END AS t, (s*s/n + bs*bs/bn) * (s*s/n + bs*bs/bn) / ((s*s/n) * (s*s/n) / (n - 1) + (bs*bs/bn) * (bs*bs/bn) / (bn - 1)) AS df FROM g, b),
z AS (SELECT c, t, (8 * df + 1) / (8 * df + 3) * sqrt(df * ln(1 + t * t / df)) AS z FROM t)
SELECT c AS o_orderpriority, CASE WHEN z > 3.290527 THEN '***' WHEN z > 2.575829 THEN '**' WHEN z > 1.959964 THEN '*' WHEN t IS NOT NULL THEN '' END AS stars FROM z""")
def welch_stars(spark, d):
    """V5: marks of significance."""
    w = stats.welch(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "1-URGENT")
    return w.select("o_orderpriority", stats.stars(F.col("t"), F.col("df")).alias("stars"))


@query("SELECT l_returnflag AS method, max(l_discount) FILTER (WHERE l_returnflag <> 'N') AS discount, max(l_quantity) AS quantity, max(l_tax) FILTER (WHERE l_returnflag = 'A') AS tax FROM lineitem GROUP BY l_returnflag")
def metric_columns(spark, d):
    """K5: long rows as columns for the union of their keys."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"))
    long = g.unpivot("method", ["quantity", "discount", "tax"], "metric", "value").where("metric = 'quantity' or (metric = 'discount' and method <> 'N') or (metric = 'tax' and method = 'A')")
    return sinks.union_of_keys(long, "metric", "value", ["method"])


_RUBRIC = "round(0.4::DOUBLE * (l_orderkey % 11 / 10) + 0.3::DOUBLE * (l_partkey % 11 / 10) + 0.2::DOUBLE * (l_suppkey % 11 / 10) + 0.1::DOUBLE * (l_linenumber % 11 / 10), 9)"


@query(f"WITH o AS (SELECT l_orderkey, l_linenumber, {_RUBRIC} AS overall FROM lineitem) SELECT l_orderkey, CAST(arg_max(l_linenumber, overall * 1000 - l_linenumber * 0.0001) AS INTEGER) AS round, max(overall) AS overall FROM o WHERE l_linenumber <= 2 GROUP BY l_orderkey HAVING max(overall) >= 0.6")
def best_rounds(spark, d):
    """The reviewer's rubric and the best of several rounds."""
    part = lambda c: (F.pmod(F.col(c), F.lit(11)) / 10.0)
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("round"), part("l_orderkey").alias("correctness"), part("l_partkey").alias("completeness"), part("l_suppkey").alias("relevance"), part("l_linenumber").alias("structure"))
    return metrics.best_round(li, "l_orderkey", threshold=0.6).select("l_orderkey", "round", F.round("overall", 9).alias("overall"))


@query(f"WITH {PAIRS_S} SELECT conv_id, turn, CAST(NULL AS DOUBLE) AS bertscore, CAST(NULL AS DOUBLE) AS bleurt FROM p")
def model_scores(spark, d):
    """Null where no model is at hand."""
    return metrics.model_scores(_pairs(spark, d)).select("conv_id", "turn", "bertscore", "bleurt")


@query()
def stemmed_rouge_l(spark, d):
    """M1 with stems."""
    p = _pairs(spark, d).withColumn("c", metrics.stemmed(T.ascii_tokens(F.col("response")))).withColumn("r", metrics.stemmed(T.ascii_tokens(F.col("source"))))
    return p.select("conv_id", "turn", metrics.rouge_l("c", "r").alias("rouge_l"))


@query()
def paragraph_dedup(spark, d):
    """Each document beside itself with one word more, as two paragraphs."""
    two = F.concat("text", F.lit("\n\n"), "text", F.lit(" end\n\nshort"))
    return dedup.dedup_paragraphs(_docs(spark, d).select("doc_id", two.alias("text"))).select("doc_id", F.md5("text").alias("hash"), "para_dedup_removed")


@query(r"""
WITH o AS (SELECT min(doc_id) AS id, length(text) AS n, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '') AS w FROM documents GROUP BY text),
e AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS h FROM o WHERE len(w) >= 5),
s AS (SELECT id, count(*) AS s FROM e GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM e x JOIN e y USING (h) WHERE x.id < y.id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN s m ON m.id = a JOIN s t ON t.id = b WHERE k / (m.s + t.s - k) > 0.85),
r AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS r FROM o),
q AS (SELECT greatest(x.r, y.r) AS r, list(least(x.r, y.r)) AS before FROM p JOIN r x ON x.id = a JOIN r y ON y.id = b GROUP BY 1),
l AS (SELECT list({'r': r, 'before': before} ORDER BY r) AS l FROM q),
g AS (SELECT coalesce(list_reduce(l, lambda gone, x: CASE WHEN len(list_filter(x.before, lambda y: NOT list_contains(gone, y))) > 0 THEN list_append(gone, x.r) ELSE gone END, CAST([] AS BIGINT[])), []) AS gone FROM l)
SELECT doc_id, id IS NOT NULL AND NOT list_contains(gone, r) AS kept FROM documents LEFT JOIN r ON id = doc_id, g""")
def fuller_versions(spark, d):
    """Of near copies the fuller one stays."""
    return dedup.keep_fuller(_docs(spark, d))


@query()
def sequential_pairs(spark, d):
    """Experts answer in turn, each seeing the answer before."""
    out = generation.pairs(_chunks(spark, d), mode="sequential", most=2)
    return out.select("chunk_id", "expert", "quality_score", "status", F.md5("response").alias("response"))


@query()
def baseline_records(spark, d):
    """The records of the five baselines."""
    out = generation.baselines(_chunks(spark, d).select("chunk_id", "text"))
    return out.select("chunk_id", "method", F.md5("instruction").alias("instruction"), F.md5("output").alias("output"), "seed_instruction", "evolution_rounds")


@query()
def ablation_grid(spark, d):
    """One condition of each dimension, over accepted chunks."""
    grid = [g for g in generation.GRID if g[1] in ("K=2", "sequential", "R=0", "off")]
    out = generation.ablation(accepted_chunks(spark, d), grid=grid)
    return out.groupBy("dimension", "condition").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("quality"))




@query(f"WITH {PAIRS_S} SELECT 'set' || (conv_id % 3) AS label, count(*) AS n, CAST(sum(length(response)) AS BIGINT) AS chars FROM p GROUP BY 1")
def labelled_files(spark, d):
    """Result files written by label, and read again with the label from their path."""
    at = Scratch(spark, "labelled").at
    _pairs(spark, d).withColumn("label", F.concat(F.lit("set"), (F.col("conv_id") % 3).cast("string"))).select("label", "instruction", "response").write.partitionBy("label").json(at)
    rows = files.labelled(spark, f"{at}/*/*.json", "label=([^/]+)/", "instruction string, response string")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("response")).cast("long").alias("chars"))


@query("SELECT count(*) FILTER (WHERE doc_id % 7 <> 0) AS good, count(*) FILTER (WHERE doc_id % 7 = 0) AS bad, CAST(sum(length(text)) FILTER (WHERE doc_id % 7 <> 0) AS BIGINT) AS chars FROM documents")
def lines_with_bad_ones(spark, d):
    """JSON lines of which every seventh is cut off."""
    at = Scratch(spark, "lines").at
    line = F.to_json(F.struct("doc_id", "text"))
    _docs(spark, d).select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(at)
    good, bad = files.read_jsonl(spark, at, "doc_id long, text string")
    return good.agg(F.count("*").alias("good"), F.sum(F.length("text")).cast("long").alias("chars")).crossJoin(bad.agg(F.count("*").alias("bad"))).select("good", "bad", "chars")  # one row each


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def appended_rows(spark, d):
    """K3: two appends, of which the second brings what the first did not."""
    at, rows = Scratch(spark, "appended").at, _docs(spark, d).select("doc_id", "lang", "source")
    sinks.append_new(rows.where("doc_id % 2 = 0"), at, "doc_id")
    sinks.append_new(rows.where("doc_id % 2 = 0 or doc_id % 3 = 0"), at, "doc_id")
    return spark.read.parquet(at)


@query("""WITH e AS (SELECT event_type, event_id, value, CAST(ts AS TIMESTAMP) AS ts, count(*) OVER (PARTITION BY event_type) AS total,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC, CAST(ts AS TIMESTAMP) DESC, value DESC) AS back FROM events WHERE event_type IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL
), l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY back DESC) AS r, row_number() OVER (PARTITION BY event_type ORDER BY value) AS s, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE back <= 200
), a AS (SELECT event_type, any_value(total) AS total, any_value(n) AS n, max(value) FILTER (WHERE s = n // 2 + 1) AS upper_median, avg(value) FILTER (WHERE r <= n // 2) AS first_half, avg(value) FILTER (WHERE r > n // 2) AS second_half,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM l GROUP BY event_type
), b AS (SELECT *, CASE WHEN span > 0 THEN (n - 1) / span END AS rate FROM a)
SELECT event_type, total, CAST(n AS INTEGER) AS n, upper_median, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, round(second_half - first_half, 6) AS trend, round(rate, 9) AS rate, round(greatest(100000 - total, 0) / rate, 3) AS seconds_left FROM b""")
def live_latest(spark, d):
    """The live figures of each kind of event, over the table."""
    out = monitor.latest_by(table(spark, d, "events"), "event_type", "event_id", "value", "ts", 200, 100_000)
    six = lambda c: F.round(c, 6).alias(c)
    return out.select("event_type", "total", "n", "upper_median", six("first_half"), six("second_half"), six("trend"), F.round("rate", 9).alias("rate"), F.round("seconds_left", 3).alias("seconds_left"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def committed_appends(spark, d):
    """K2, K3: two overlapping runs and a repeated one are appended; each key is there once."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ledger = sinks.Ledger(spark, Scratch(spark, "ledger").at)
    ledger.append(orders.where("o_orderkey % 3 < 2"), "o_orderkey", "first")
    ledger.append(orders.where("o_orderkey % 3 > 0"), "o_orderkey", "second")
    ledger.append(orders, "o_orderkey", "second")
    ledger.append(orders.where("o_orderkey % 3 = 2 or o_orderkey % 5 = 0"), "o_orderkey", "third")
    return ledger.read()


@query(r"""WITH m AS (SELECT l_returnflag || l_linestatus AS mode, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS quantity, CAST(nullif(count(*) FILTER (WHERE l_linenumber > 3 AND l_linestatus = 'F'), 0) AS DOUBLE) AS late FROM lineitem GROUP BY 1
), c AS (SELECT mode, [n, quantity, late] AS v, [max(n) OVER (), max(quantity) OVER (), max(late) OVER ()] AS best FROM m
), r AS (SELECT mode || ' & ' || array_to_string(list_transform([1, 2, 3], lambda i: CASE WHEN v[i] IS NULL THEN '--' WHEN v[i] = best[i] THEN '\textbf{' || printf('%.2f', v[i]) || '}' ELSE printf('%.2f', v[i]) END), ' & ') || ' \\' AS line FROM c
), t AS (SELECT row_number() OVER (ORDER BY line) AS place, line, count(*) OVER () AS n FROM r)
SELECT place, line FROM t UNION ALL SELECT * FROM (VALUES (-3, '\begin{tabular}{lrrr}'), (-2, '\toprule'), (-1, 'mode & n & quantity & late \\'), (0, '\midrule')) UNION ALL SELECT any_value(n) + 1, '\bottomrule' FROM t UNION ALL SELECT any_value(n) + 2, '\end{tabular}' FROM t""")
def latex_of_metrics(spark, d):
    """K6: a table as lines, the best of a column in bold."""
    rows = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("mode")).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("quantity"),
        F.nullif(F.count_if((F.col("l_linenumber") > 3) & (F.col("l_linestatus") == "F")), F.lit(0)).cast("double").alias("late"),
    )
    return sinks.latex_lines(rows, "mode", ["n", "quantity", "late"], 2)


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark)
SELECT doc_id, count(word) AS n, min(word) AS first_word, max(word) AS last_word FROM (SELECT doc_id, text FROM documents WHERE text <> '') d JOIN (SELECT word FROM w WHERE length(word) > 6) v ON contains(d.text, v.word) GROUP BY doc_id""")
def words_in_texts(spark, d):
    """J4 for many words: which long words of the benchmark stand anywhere in which documents."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where(F.length("word") > 6)
    found = contains.contains_join(table(spark, d, "documents", deal=True).select("doc_id", "text"), words)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents")
def files_in_ranges(spark, d):
    """Documents as files of JSON lines, read back by tasks of equal size in ranges of whole lines."""
    folder = Scratch(spark, "files").at
    table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).write.json(folder)
    ranges = corpus_files.corpus_files(spark, folder, kinds="json", range_bytes=1 << 20)
    lines = ranges.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", "doc_id long, text string").alias("r")).select("r.doc_id", F.md5("r.text").alias("hash"))


def _streamed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The documents and odd rows as files of JSON lines, and a folder for what streams make of them."""
    at = Scratch(spark, "stream").at
    rows = _more(spark, d).select("doc_id", "text")
    rows.where("doc_id % 2 = 0").write.json(f"{at}/in")
    return rows.where("doc_id % 2 <> 0"), at


_STATUS_S = f"WITH {D_S}, c AS (SELECT doc_id, text, {sql_sanitize('text')} AS clean FROM d), g AS (SELECT doc_id, text, clean, {sql_gate('text', True)} AS reason, {sql_gate('clean', True)} AS again FROM c), q AS (SELECT doc_id, reason, CASE WHEN reason = 'Valid text' THEN 'valid' WHEN again = 'Valid text' AND clean <> text THEN 'salvaged' ELSE 'invalid' END AS status FROM g)"


@query(f"{_STATUS_S} SELECT status, reason, count(*) AS n FROM q GROUP BY ALL")
def streamed_check(spark, d):
    """The quality check as a stream that stops and goes on from its checkpoint when more files have come."""
    later, at = _streamed(spark, d)
    for _ in range(2):
        stream = streams.read_stream(spark, f"{at}/in", "doc_id long, text string", files=4)
        streams.run_available(streams.checked(stream), f"{at}/out", f"{at}/mark").awaitTermination()
        if later is not None:
            later.write.mode("append").json(f"{at}/in")
            later = None
    return spark.read.parquet(f"{at}/out").groupBy("status", "reason").agg(F.count("*").alias("n"))


@query(f"{_STATUS_S} SELECT doc_id, status = 'invalid' AS failed FROM q")
def failure_log(spark, d):
    """What passed and what failed, each in a table of its own, from one stream."""
    later, at = _streamed(spark, d)
    later.write.mode("append").json(f"{at}/in")
    stream = streams.checked(streams.read_stream(spark, f"{at}/in", "doc_id long, text string", files=4))
    streams.with_failure_log(stream, f"{at}/good", f"{at}/bad", f"{at}/mark").awaitTermination()
    good, bad = (spark.read.parquet(f"{at}/{name}").select("doc_id", F.lit(failed).alias("failed")) for name, failed in (("good", False), ("bad", True)))
    return good.unionByName(bad)


@query("SELECT kind, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM (SELECT 'entity' AS kind, coalesce(text, '') AS body FROM benchmark UNION ALL SELECT 'relation', replace(url, ' ', '') || ' has ' || page_id FROM pages) GROUP BY kind")
def knowledge_files(spark, d):
    """Entities and relations written and loaded as a knowledge base."""
    at = Scratch(spark, "knowledge").at
    items = table(spark, d, "benchmark")
    items.select(F.col("item_id").cast("string").alias("name"), F.lit("item").alias("description"), F.coalesce("text", F.lit("")).alias("text")).write.json(f"{at}/esg_entities.jsonl")
    table(spark, d, "pages").select(F.concat(F.replace("url", F.lit(" "), F.lit("")), F.lit(" has "), F.col("page_id").cast("string"))).write.text(f"{at}/esg_relations.jsonl")
    entities, relations = files.knowledge_base(spark, at)
    each = entities.select(F.lit("entity").alias("kind"), F.col("text").alias("body")).unionByName(relations.select(F.lit("relation").alias("kind"), F.col("raw").alias("body")))
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("body")).cast("long").alias("chars"))


@query("SELECT lang, n, shown FROM (SELECT coalesce(lang, '') AS lang, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), '|') AS shown FROM documents GROUP BY lang)")
def csv_lists(spark, d):
    """K7: a table with lists written as CSV and read back."""
    at = Scratch(spark, "csv").at
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("shown"))
    sinks.write_csv(rows, at)
    back = spark.read.option("header", True).schema("lang string, n long, shown string").csv(at)
    return back.select(F.coalesce("lang", F.lit("")).alias("lang"), "n", F.coalesce("shown", F.lit("")).alias("shown"))
