"""Generation of pairs: a pluggable generator, reply parsers, collaboration of experts, baselines and ablations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import Scratch
from . import knowledge, metrics, replies, routing

#: A generator takes a prompt and the source text and returns the reply; it runs in Python workers.
Generator = Callable[[str, str], str]

#: Seed instructions of the self-instruct baseline.
SEEDS = [
    "Summarise what the text commits to.",
    "Which figures does the text report?",
    "Explain the main risk in the text.",
    "List the measures that the text names.",
    "Compare the statements of the text.",
    "What does the text leave open?",
]


_SHOWN = re.compile(r"\n([^\n:]+): \[[^\n]*\]\n([^\n:]+): \[[^\n]*\]\s*$")


@lru_cache(maxsize=64)
def _opening(text: str) -> str:
    """The first sentences of a text. Several prompts about a text come one after the other: it is cut once for them."""
    return " ".join([s.strip() for s in re.split(r"(?<=[.!?。！？])\s+|\n", text) if s.strip()][:3])


def extractive(prompt: str, text: str) -> str:
    """The default generator, without any network: the task as the question and the first sentences as the answer, under
    the labels that the prompt asks for."""
    opening = _opening(text or "")
    shown = _SHOWN.search(prompt)
    ask, tell = shown.groups() if shown else ("Question", "Answer")
    return f"{ask}: {prompt.split(chr(10), 1)[0]}\n{tell}: {opening}" if opening else ""


def parse_multiline(reply: Column) -> Column:
    """(instruction, response): the answer runs on over the lines after its label; one of fewer than ten characters
    gives way to the whole reply."""
    ask, tell = r"^(Instruction|指令|Question|问题)[:：]", r"^(Answer|Response|回答|答案)[:：]"
    state = F.struct(F.lit("").alias("q"), F.array().cast("array<string>").alias("a"), F.lit(False).alias("on"))

    def step(st, line):
        x = T.strip(line)
        rest = lambda p: T.strip(F.regexp_replace(x, p, ""))
        asked = F.struct(rest(ask).alias("q"), st["a"].alias("a"), F.lit(False).alias("on"))
        told = F.struct(st["q"].alias("q"), F.array(rest(tell)).alias("a"), F.lit(True).alias("on"))
        more = F.struct(st["q"].alias("q"), F.when(st["on"], F.array_append(st["a"], x)).otherwise(st["a"]).alias("a"), st["on"].alias("on"))
        return F.when(x.rlike(tell), told).when(x.rlike(ask), asked).otherwise(more)

    done = F.aggregate(T.lines(T.strip(reply)), state, step)
    answer = T.strip(F.array_join(done["a"], "\n"))
    return F.struct(F.coalesce(F.nullif(done["q"], F.lit("")), F.lit("Analyze the following ESG-related content.")).alias("instruction"), F.when(F.length(answer) < 10, T.strip(reply)).otherwise(answer).alias("response"))


def generate(df: DataFrame, generator: Generator = extractive, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """df with `reply` and `error`: a generator that fails or says nothing gives an empty reply, never a lost row."""

    @F.pandas_udf("reply string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, texts in batches:
            rows = []
            for p, t in zip(prompts, texts, strict=True):
                try:
                    rows.append((generator(p or "", t or "") or "", None))
                except Exception as error:  # a row's failure is data
                    rows.append(("", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["reply", "error"])

    df = df.withColumn("_g", run(prompt, text))
    return df.withColumn("reply", F.col("_g.reply")).withColumn("error", F.col("_g.error")).drop("_g")


def expert_prompt(expert: Column, text: Column, known: Column, dynamic: Column | None = None) -> Column:
    """The prompt of each expert; the task is the dynamic instruction where there is one, else the expert's default."""
    task = knowledge.default_instruction(expert)
    task = task if dynamic is None else F.coalesce(F.nullif(T.strip_prefix(dynamic), F.lit("")), task)
    out = replies.prompt_for("qa_expert", task, known, text)
    for name in replies.READERS:
        out = F.when(expert == name, replies.prompt_for(name, task, known, text)).otherwise(out)
    return out


def instruction_prompt(expert: Column, text: Column, topics: Column, experts: Column, section: Column | None = None, knowledge_: Column | None = None) -> Column:
    """What a meta expert is asked for a dynamic instruction: role, section, topics, the experts that work on the same
    chunk, and at most three lines of knowledge."""
    others = F.array_join(F.array_remove(experts, expert), ", ")
    place = F.lit("the report") if section is None else F.coalesce(F.concat(F.lit("section "), section), F.lit("the report"))
    known = F.lit("") if knowledge_ is None else F.array_join(F.transform(F.slice(knowledge_, 1, 3), lambda k: F.concat(F.lit("- "), k["content"], F.lit("\n"))), "")
    return F.concat(F.lit("Write one work instruction, in one sentence, for the expert "), expert, F.lit(".\nThe text is from "), place, F.lit("; its topics: "), F.array_join(topics, ", "), F.lit(".\nOther experts on the same text, whose work it mustn't repeat: "), F.when(others == "", "none").otherwise(others), F.lit(".\n"), known, F.lit("Text:\n"), F.substring(T.filled(text), 1, 1500))


def instructions(df: DataFrame, generator: Generator | None = None, expert: str = "expert", default: bool = True) -> DataFrame:
    """df (expert, prompt, text) with `instruction`: the meta expert's reply without its prefix; without a generator, or
    where it fails or says nothing, the expert's default."""
    if generator is None:
        return df.withColumn("instruction", knowledge.default_instruction(F.col(expert)))
    made = generate(df, generator).withColumn("instruction", F.coalesce(F.nullif(T.strip(T.strip_prefix(T.strip(F.col("reply")))), F.lit("")), knowledge.default_instruction(F.col(expert))))
    return made.drop("reply", "error")


def run_batches(chunks: DataFrame, out: str, failures: str, generator: Generator = extractive, key: str = "chunk_id", batches: int = 10, **options) -> DataFrame:
    """Records of all chunks whose key isn't in `out` yet, in batches by hash of the key, each appended whole: a run that
    was stopped goes on after its last batch. Successes go to `out`, other keys with their status and error to
    `failures`; chunks without text are skipped with a status of their own. Returns (status, n) over both tables."""
    spark = chunks.sparkSession

    def there(path: str) -> DataFrame | None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None

    done = there(out)
    todo = chunks if done is None else chunks.join(done.select(key), key, "left_anti")
    todo = todo.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)))
    for k in range(batches):
        own = todo.where(F.col("_batch") == k).drop("_batch")
        blank = T.strip(T.filled(F.col("text"))) == ""
        made = Scratch(spark, "batch").keep(pairs(own.where(~blank), generator, key, least=1, **options))
        empty = own.where(blank).select(key, F.lit("skipped_empty_chunk").alias("status"), F.lit(None).cast("string").alias("error"))
        made.where("status <> 'success'").select(key, "status", "error").unionByName(empty).withColumn("batch", F.lit(k)).write.mode("append").parquet(failures)
        made.where("status = 'success'").write.mode("append").parquet(out)
    lost = spark.read.parquet(failures).join(spark.read.parquet(out).select(key), key, "left_anti").select(key, "status").distinct()
    return spark.read.parquet(out).select("status").unionByName(lost.select("status")).groupBy("status").agg(F.count("*").alias("n"))


ANSWER = "struct<expert:string,instruction:string,response:string,quality_score:double,error:string>"


def _asker(text: str, names: list[str], tasks: list[str], generator: Generator, readers: dict):
    """ask(k, before, turn): the k-th expert's answer on a text (expert, instruction, response, score, error), after the
    answer before. What was asked in the same turn isn't asked again."""

    @cache
    def ask(k: int, before: str, turn: int) -> tuple:
        try:
            reply, failed = generator(tasks[k] + (f"\n\nEarlier answer:\n{before}" if before else ""), text) or "", None
        except Exception as error:  # a call's failure is data
            reply, failed = "", f"{type(error).__name__}: {error}"
        asked, told = replies.read_text(reply, names[k], readers)
        return names[k], asked, told, _score(asked, told, text), failed

    return ask


def _best_of(ask, experts: int) -> tuple:
    """The best answer; of equal ones that of the expert chosen first."""
    return max((ask(k, "", 0) for k in range(experts)), key=lambda a: a[3], default=(None, "", "", 0.0, None))


def _best_in_turn(ask, experts: int, passes: int, good: float) -> tuple:
    """The best answer of experts in turn, each seeing the answer before, until one is good."""
    best, before, failed = (None, "", "", 0.0), "", None
    for turn in range(passes * experts):
        *answer, error = ask(turn % experts, before, turn)
        failed, before = error or failed, answer[2] or before
        if best[0] is None or answer[3] > best[3]:
            best = tuple(answer)
        if answer[3] >= good:
            break
    return (*best, failed if not best[2] else None)


def _asked(df: DataFrame, conditions: list[tuple[int | None, str, int, bool]], generator: Generator, good: float) -> DataFrame:
    """df (text, experts, knowledge) with `best`: the best answer under each condition (experts at most, mode, passes,
    knowledge), in an array. All conditions of a text are met in its row, by the same answers."""
    # one row holds all that is asked about it: nothing is shuffled or joined back
    df = T.once(df, "_e", F.struct("experts", "knowledge"))
    prompts = lambda items: F.transform(F.col("_e.experts"), lambda e: expert_prompt(e, F.col("text"), items))
    apart = len({c[3] for c in conditions}) > 1
    df = df.withColumn("_tasks", prompts(F.col("_e.knowledge") if any(c[3] for c in conditions) else F.array().cast(knowledge.ITEM)))
    bare = prompts(F.array().cast(knowledge.ITEM)) if apart else F.lit(None).cast("array<string>")
    df = df.withColumn("_bare", F.when(F.size("_e.knowledge") > 0, bare))  # without knowledge prompts are the same
    readers = dict(replies.READERS)

    @F.pandas_udf(f"array<{ANSWER}>")
    def run(texts: pd.Series, experts: pd.Series, tasks: pd.Series, bares: pd.Series) -> pd.Series:
        out = []
        for text, names, own, bare in zip(texts, experts, tasks, bares, strict=True):
            knowing = _asker(text or "", list(names), own, generator, readers)
            plain = knowing if bare is None else _asker(text or "", list(names), bare, generator, readers)
            best = []
            for most, mode, passes, known in conditions:
                ask, n = knowing if known else plain, len(names[: 1 if mode == "single" else most])
                best.append(_best_in_turn(ask, n, passes, good) if mode == "sequential" else _best_of(ask, n))
            out.append([dict(zip(("expert", "instruction", "response", "quality_score", "error"), b, strict=True)) for b in best])
        return pd.Series(out)

    # filters on the array would call the experts once more
    return T.once(df, "best", run("text", "_e.experts", "_tasks", "_bare")).drop("_tasks", "_bare", "_e")


def pairs(chunks: DataFrame, generator: Generator = extractive, key: str = "chunk_id", mode: str = "parallel", least: int = 50, passes: int = 2, good: float = 0.7, with_knowledge: bool = True, **routing_options) -> DataFrame:
    """A record per chunk of at least `least` characters: topics, routing, knowledge, generation, score and status.

    parallel: every chosen expert answers, the best answer wins, of equal ones the expert chosen first. sequential:
    experts answer in turn, at most `passes` times round, each seeing the answer before, until one is good. single:
    the first expert only.
    """
    df = _prepared(chunks, key, least, with_knowledge, **routing_options)
    df = _asked(df, [(None, mode, passes, with_knowledge)], generator, good)
    return _records(df.withColumn("best", F.get("best", F.lit(0))), chunks.columns)


def _prepared(chunks: DataFrame, key: str, least: int, known: bool, **routing_options) -> DataFrame:
    """Chunks of at least `least` characters with core_topics, experts and their reasons, and knowledge."""
    df = chunks.where(F.length("text") >= least).withColumn("core_topics", knowledge.topics(F.col("text")))
    df = routing.route(df, **routing_options)
    return knowledge.retrieve(df, key=key) if known else df.withColumn("knowledge", F.array().cast(knowledge.ITEM))


def _records(df: DataFrame, columns: list[str]) -> DataFrame:
    """The record of each row by its `best` answer, with its status."""
    df = df.select(*columns, "core_topics", "experts", "selection_reasons", F.size("knowledge").alias("knowledge_items_count"), F.col("best.expert").alias("expert"), F.col("best.instruction").alias("instruction"), F.col("best.response").alias("response"), F.col("best.quality_score").alias("quality_score"), F.col("best.error").alias("error"))
    empty = (T.filled(F.col("instruction")) == "") | (T.filled(F.col("response")) == "")
    return df.withColumn("status", F.when(F.col("error").isNotNull(), "exception").when(empty, "empty_or_parse_failed").otherwise("success"))


def _score(instruction: str, response: str, text: str) -> float:
    if len(instruction) <= 10 or len(response) <= 20:
        return 0.0
    head = text[:200]
    grams = {head[i : i + 3] for i in range(len(head) - 2)}
    share = sum(g in response for g in grams) / len(grams) if grams else sum(c in response for c in head[:50]) / 50
    return min(0.3 + min(share * 0.4, 0.4) + 0.2 * (len(response) > 50) + 0.1 * (len(response) > 100), 1.0)


#: The baselines, each with what it asks first; self_instruct asks one of SEEDS.
METHODS = {
    "direct": "Write an instruction and its answer for the text.",
    "self_instruct": None,
    "evol": "Write an instruction for the text.",
    "alpaca": "Write one instruction for the text, and nothing else.",
    "api_direct": "Write an instruction and its answer for the text.",
}


def _exchange(method: str, task: str, text: str, rounds: int, generator: Generator) -> tuple[str | None, str]:
    """(instruction, reply) of a baseline on one text, by all the calls that it takes. The instruction is null where the
    reply holds both. A call that fails gives an empty reply."""

    def call(prompt: str) -> str:
        try:
            return generator(prompt, text) or ""
        except Exception:  # a call's failure is data
            return ""

    about = lambda head: f"{head}\n\nText:\n{text}"
    said = call(about(task))
    if method == "evol":
        for _ in range(rounds):
            said = call(about(f"Make this instruction harder: {said.strip(T.V.SPACES)}"))
        return said, call(f"Instruction: {said.strip(T.V.SPACES)}\n\nInput: {text}\n\nGenerate the response.")
    if method == "alpaca":
        return said, call(knowledge.alpaca_text(said.strip(T.V.SPACES), text))
    return None, said


def baselines(chunks: DataFrame, methods: Sequence[str] = tuple(METHODS), generator: Generator = extractive, key: str = "chunk_id", rounds: int = 2) -> DataFrame:
    """Records of baselines, one for each chunk and method; chunks are worked out once for all of them. direct: one
    prompt; self_instruct: a seed instruction by hash; evol: an instruction, made harder `rounds` times, then answered;
    alpaca: an instruction, then its answer under the Alpaca template; api_direct: one prompt, read by labels that begin a
    line."""
    seed = F.element_at(F.array(*(F.lit(s) for s in SEEDS)), F.pmod(F.xxhash64(key), F.lit(len(SEEDS))).cast("int") + 1)
    heads = F.create_map(*(F.lit(x) for m, head in METHODS.items() if head for x in (m, head)))

    @F.pandas_udf("asked string, reply string")
    def run(names: pd.Series, tasks: pd.Series, texts: pd.Series) -> pd.DataFrame:
        said = [_exchange(m, task, text or "", rounds, generator) for m, task, text in zip(names, tasks, texts, strict=True)]
        return pd.DataFrame(said, columns=["asked", "reply"])

    df = chunks.withColumn("method", F.explode(F.array(*(F.lit(m) for m in methods))))
    df = df.withColumn("seed_instruction", F.when(F.col("method") == "self_instruct", seed).otherwise(F.element_at(heads, F.col("method"))))
    df = df.withColumn("_g", run("method", "seed_instruction", "text"))
    asked, reply = F.col("_g.asked"), F.col("_g.reply")
    made = F.when(asked.isNotNull(), F.struct(T.strip(asked).alias("instruction"), T.strip(reply).alias("response")))
    made = made.when(F.col("method") == "api_direct", replies.read_form(reply, "answer", F.lit("Answer the following question."))).otherwise(parse_multiline(reply))
    df = T.once(df, "p", made)
    evolved = F.when(F.col("method") == "evol", F.lit(rounds)).cast("int")
    return df.select(*chunks.columns, F.col("p.instruction").alias("instruction"), F.col("p.response").alias("output"), "method", "seed_instruction", evolved.alias("evolution_rounds"))


def baseline(chunks: DataFrame, method: str, generator: Generator = extractive, key: str = "chunk_id", rounds: int = 2) -> DataFrame:
    """Records of one baseline."""
    return baselines(chunks, [method], generator, key, rounds)


#: The grid of ablations, as (dimension, condition, experts, mode, passes, knowledge).
GRID = [("experts", f"K={k}", k, "parallel", 2, True) for k in (1, 2, 3, 5)] + [("mode", m, 3, m, 2, True) for m in ("none", "sequential", "parallel")] + [("feedback", f"R={r}", 3, "sequential", r + 1, True) for r in (0, 1, 2)] + [("knowledge", "off", 3, "parallel", 2, False), ("knowledge", "on", 3, "parallel", 2, True)]


def ablation(chunks: DataFrame, generator: Generator = extractive, grid: list | None = None, key: str = "chunk_id", least: int = 50, good: float = 0.7) -> DataFrame:
    """Records of every condition of the grid, with `dimension` and `condition`: those of `pairs` with its settings.

    Features, routes and knowledge of a chunk are worked out once for all conditions: fewer experts are the first ones of
    more. So are answers: an expert is asked once in a turn after the same answer before, with knowledge and, where there
    is any, without. Conditions that don't ask in turn choose among the answers of the first turn.
    """
    grid = grid or GRID
    df = _prepared(chunks, key, least, any(g[5] for g in grid), most=max(g[2] for g in grid))
    df = _asked(df, [(most, "single" if mode == "none" else mode, passes, known) for _, _, most, mode, passes, known in grid], generator, good)
    df = df.select(*(c for c in df.columns if c != "best"), F.posexplode("best").alias("_at", "best"))
    conditions = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("condition"), F.lit(most).alias("most"), F.lit(known).alias("known")) for d, c, most, _, _, known in grid))
    df = df.withColumn("_c", F.get(conditions, F.col("_at"))).withColumn("dimension", F.col("_c.dimension")).withColumn("condition", F.col("_c.condition"))
    df = df.withColumn("knowledge", F.when(F.col("_c.known"), F.col("knowledge")).otherwise(F.array().cast(knowledge.ITEM)))
    df = df.withColumn("experts", F.slice("experts", F.lit(1), F.col("_c.most")))
    df = df.withColumn("selection_reasons", F.col("selection_reasons").withField("selected_count", F.size("experts")))
    return _records(df, [*chunks.columns, "dimension", "condition"]).select(*chunks.columns, *RECORD, "dimension", "condition")


#: The columns of a record beside those of its chunk.
RECORD = ["core_topics", "experts", "selection_reasons", "knowledge_items_count", "expert", "instruction", "response", "quality_score", "error", "status"]
