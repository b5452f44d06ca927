"""Experts: what each is asked for, in which form, and how its replies are read. Each reader is stated twice, as a column
and as a plain function for use inside Python workers; a test holds both to the same answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


@dataclass(frozen=True)
class Form:
    """The labels of a reply: those that begin a line (`asks`, `tells`; English ones with a colon, case aside), and for
    the answer also words that may stand anywhere in its line."""

    asks: str
    tells: str
    shown: tuple[str, str]  # the labels that the prompt asks for


#: Label patterns of the kinds of replies, and the instruction where a reply names none.
#: White space before a label, in words that both regular expression dialects have.
_GAP = r"[\x09-\x0D\x20\u00A0\u3000]*"
_TASK = r"^(?:指令[：:]|" + _GAP + r"(?i:instruction:))"
FORMS = {
    "qa": Form(r"^(?:问题[：:]|" + _GAP + r"(?i:question:))", r"^(?:答案[：:]|" + _GAP + r"(?i:answer:))", ("Question", "Answer")),
    "summary": Form(_TASK, r"^(?:摘要[：:]|" + _GAP + r"(?i:summary:))", ("Instruction", "Summary")),
    "extraction": Form(_TASK, r"提取结果|^" + _GAP + r"(?i:extraction result:)", ("Instruction", "Extraction result")),
    "classification": Form(_TASK, r"分类结果|(?i:classification result)", ("Instruction", "Classification result")),
    "analysis": Form(_TASK, r"分析结果|(?i:analysis result)", ("Instruction", "Analysis result")),
    "answer": Form(_TASK, r"^(?:回答[：:]|" + _GAP + r"(?i:answer:))", ("Instruction", "Answer")),
}
READERS = {
    "qa_expert": ("qa", "Answer the following question."),
    "summary_expert": ("summary", "Summarize the main content of the following text."),
    "extraction_expert": ("extraction", "Extract ESG-related metrics from the following text."),
    "classification_expert": ("classification", "Classify the following text by ESG dimension (environment/social/governance)."),
    "analysis_expert": ("analysis", "Analyze the ESG-related content in the following text."),
    "temporal_analysis_expert": ("answer", "Analyze temporal features and cross-year trends in the following text."),
    "benchmark_comparison_expert": ("answer", "Compare the carbon commitments in the text with industry average."),
    "greenwashing_detection_expert": ("answer", "Detect greenwashing risk in the following text."),
    "standard_alignment_expert": ("answer", "Identify ESG standards followed in the text and assess compliance."),
    "knowledge_graph_expert": ("answer", "Extract ESG entities and relations from the text and build a knowledge graph."),
    "consistency_verification_expert": ("answer", "Verify data consistency in the following text."),
    "promise_performance_verification_expert": ("answer", "Identify verifiable claims in the text and generate tool-call instructions for verification."),
}
#: What the answer of each expert has to hold, for its prompt.
WANTED = {
    "qa_expert": "a specific question on one dimension of the text and an answer that the text supports",
    "summary_expert": "a summary of 100 to 200 words that covers the core statements",
    "extraction_expert": "the figures and facts of the text in a structured form, or that there are none",
    "classification_expert": "the dimensions that the text belongs to, each with its reason",
    "analysis_expert": "an analysis that connects several statements of the text",
    "temporal_analysis_expert": "how figures and commitments change over the years that the text names",
    "benchmark_comparison_expert": "how the text's commitments stand against its industry",
    "greenwashing_detection_expert": "claims without evidence, vague terms and what is left out",
    "standard_alignment_expert": "the standards that the text follows and where it falls short",
    "knowledge_graph_expert": "entities and relations as triples",
    "consistency_verification_expert": "figures that contradict each other, and gaps",
    "promise_performance_verification_expert": "claims that can be checked, and the call that checks each",
}


def _after(line: Column) -> Column:
    """What follows the first full-width colon, and of that what follows the first plain one."""
    wide = F.regexp_replace(line, "(?s)^[^：]*：", "")
    return T.strip(F.regexp_replace(wide, "(?s)^[^:]*:", ""))


def _last(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, _after(F.element_at(rows, -1)))


def _form(reply: Column, name: str) -> Column:
    """(ask, tell) of a reply, null where no line has the label: the last line with a label counts, and a line with
    both counts as the instruction."""
    form = FORMS[name]
    asked = lambda x: x.rlike(form.asks)
    found = lambda rows: F.struct(_last(F.filter(rows, asked)).alias("ask"), _last(F.filter(rows, lambda x: ~asked(x) & x.rlike(form.tells))).alias("tell"))
    return T.let(T.lines(T.strip(reply)), found)


def _block(reply: Column, number: int, label: str) -> Column:
    """A block of a reply between blank lines, without its label; null where there are fewer than two."""
    blocks = F.split(reply, "\n\n")
    bare = T.strip(F.regexp_replace(F.get(blocks, F.lit(number)), f"{label}[：:]", ""))
    return F.when(F.size(blocks) >= 2, T.strip(F.regexp_replace(bare, "(?s)^[^:]*:", "")))


def read(reply: Column, expert: str = "qa_expert") -> Column:
    """(instruction, response) of one expert's replies. Questions and answers that lack either label are read from the
    first two blocks; without an answer the whole reply is one. Null counts as empty."""
    kind, default = READERS[expert]
    reply = T.filled(reply)
    if kind != "qa":
        return read_form(reply, kind, F.lit(default))

    def choose(p: Column) -> Column:
        lacks = (T.filled(p["ask"]) == "") | (T.filled(p["tell"]) == "")
        ask = F.when(lacks, F.coalesce(_block(reply, 0, "问题"), p["ask"])).otherwise(p["ask"])
        tell = F.when(lacks, F.coalesce(_block(reply, 1, "答案"), p["tell"])).otherwise(p["tell"])
        return F.struct(F.coalesce(F.nullif(ask, F.lit("")), F.lit(default)).alias("instruction"), F.coalesce(F.nullif(tell, F.lit("")), reply).alias("response"))

    return T.let(_form(reply, kind), choose)


def read_form(reply: Column, kind: str, default: Column) -> Column:
    """(instruction, response) of replies with labels; without an answer the whole reply is one."""
    reply = T.filled(reply)
    pick = lambda p: F.struct(F.coalesce(p["ask"], default).alias("instruction"), F.coalesce(F.nullif(p["tell"], F.lit("")), T.strip(reply)).alias("response"))
    return T.let(_form(reply, kind), pick)


def read_any(expert: Column, reply: Column) -> Column:
    """(instruction, response) where the expert is a column; unknown experts are read as questions and answers."""
    out = read(reply, "qa_expert")
    for kind in dict.fromkeys(k for k, _ in READERS.values() if k != "qa"):
        own = [e for e, (k, _) in READERS.items() if k == kind]
        defaults = F.element_at(F.create_map(*(F.lit(x) for e in own for x in (e, READERS[e][1]))), expert)
        out = F.when(expert.isin(own), read_form(reply, kind, defaults)).otherwise(out)
    return out


def _strip(x: str) -> str:
    return x.strip(V.SPACES)


def _after_text(line: str) -> str:
    return _strip(line.split("：", 1)[-1].split(":", 1)[-1])


def read_text(reply: str | None, expert: str, readers: dict | None = None) -> tuple[str, str]:
    """The same as `read`, of a plain text. readers: the driver's READERS, where Python workers call this; theirs hold no
    registered experts."""
    reply, readers = reply or "", readers or READERS
    kind, default = readers.get(expert, readers["qa_expert"])
    form, ask, tell = FORMS[kind], None, None
    for line in _strip(reply).split("\n"):
        if re.search(form.asks, line):
            ask = _after_text(line)
        elif re.search(form.tells, line):
            tell = _after_text(line)
    if kind != "qa":
        return default if ask is None else ask, tell or _strip(reply)
    blocks = reply.split("\n\n")
    if (not ask or not tell) and len(blocks) >= 2:
        ask, tell = (_strip(_strip(re.sub(f"{w}[：:]", "", b)).split(":", 1)[-1]) for w, b in (("问题", blocks[0]), ("答案", blocks[1])))
    return ask or default, tell or reply


def read_marks(reply: Column) -> Column:
    """(instruction, response) by the words 指令 and 回答 wherever they stand: what lies between the last 指令 before the
    first 回答 and that, each after its last colon; else line by line. An instruction of fewer than five characters and
    an answer of fewer than ten give way to the default and to the whole reply."""
    reply = T.filled(reply)
    tail = lambda x: F.regexp_replace(F.regexp_replace(x, "(?s)^.*：", ""), "(?s)^.*:", "")
    after = lambda x, sign: F.regexp_replace(x, f"(?s)^.*{sign}", "")
    both = F.contains(reply, F.lit("指令")) & F.contains(reply, F.lit("回答"))
    parts = F.split(reply, "回答")
    head = F.get(parts, F.lit(0))
    ask = F.when(both & F.contains(head, F.lit("指令")), T.strip(F.replace(T.strip(tail(after(head, "指令"))), F.lit("\n"), F.lit(" "))))
    tell = F.when(both, T.strip(tail(F.get(parts, F.lit(1)))))
    rows = F.split(reply, "\n")
    # a line counts as the instruction if it has the word and none before had; the first other line with 回答 ends it
    asks = F.transform(rows, lambda x: F.contains(x, F.lit("指令")))
    first = F.array_position(asks, F.lit(True))
    ends = F.array_position(F.transform(rows, lambda x, i: F.contains(x, F.lit("回答")) & ((first == 0) | (i + 1 != first))), F.lit(True))
    seen = (first > 0) & ((ends == 0) | (first < ends))
    ask2 = F.when(seen, T.strip(tail(after(F.element_at(rows, first.cast("int")), "指令"))))
    rest = F.array_join(F.slice(rows, (ends + 1).cast("int"), F.size(rows)), "\n")
    tell2 = F.when(ends > 0, T.strip(tail(T.strip(rest))))
    lacks = (T.filled(ask) == "") | (T.filled(tell) == "")
    ask = F.when(lacks & (T.filled(ask) == ""), T.filled(ask2)).otherwise(T.filled(ask))
    tell = F.when(lacks & (T.filled(tell) == ""), T.filled(tell2)).otherwise(T.filled(tell))
    return F.struct(F.when(F.length(ask) < 5, "Analyze the following ESG-related content").otherwise(ask).alias("instruction"), F.when(F.length(tell) < 10, T.strip(reply)).otherwise(tell).alias("response"))


def prompt_for(expert: str, task: Column, knowledge: Column, text: Column) -> Column:
    """What an expert is asked: its role, the task, what the answer has to hold, at most three lines of knowledge, the
    text, and the labels of the reply."""
    name = {e[0]: e[2] for e in V.EXPERTS}.get(expert, expert)
    ask, tell = FORMS[READERS.get(expert, READERS["qa_expert"])[0]].shown
    lines = F.array_join(F.transform(F.slice(knowledge, 1, 3), lambda k: F.concat(F.lit("- "), T.filled(k["content"]), F.lit("\n"))), "")
    known = F.when(F.size(knowledge) > 0, F.concat(F.lit("\nDomain knowledge:\n"), lines)).otherwise("")
    head = F.concat(task, F.lit(f"\n\nYou act as: {name}. The reply holds {WANTED.get(expert, WANTED['qa_expert'])}.\n"))
    return F.concat(head, known, F.lit("\nText:\n"), T.filled(text), F.lit(f"\n\nReply in this form only:\n{ask}: [{ask.lower()}]\n{tell}: [{tell.lower()}]"))


#: Prompts by expert; a registered expert adds its own to these tables.
def register(expert: str, layer: str, name: str, task: str, form: str = "answer", wanted: str = "an answer that the text supports", default: str | None = None) -> None:
    """Adds an expert to the catalogue: it can be chosen, prompted and read like the others. Replaces one of its id."""
    if form not in FORMS:
        raise ValueError(f"no such form of replies: {form}")
    V.EXPERTS[:] = [e for e in V.EXPERTS if e[0] != expert] + [(expert, layer, name, task)]
    READERS[expert], WANTED[expert] = (form, default or task), wanted
