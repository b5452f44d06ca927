"""Text functions from columns to columns. All of them but the conversion by phrases run in the JVM; null counts as an
empty text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row, however often later steps use it: filters aren't pushed below an
    exploded array, and projections aren't merged across it. The value stands in a projection of its own, where what
    its parts have in common is worked out once too."""
    return df.withColumn("_once", value).withColumn(name, F.explode(F.array("_once"))).drop("_once")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_with(items: Column, other: Column, test) -> Column:
    """How many items pass test(item, other). A lambda works out what it captures for each item; here `other` is worked
    out once and handed along."""
    passed = F.zip_with(items, F.array_repeat(other, F.size(items)), test)
    return F.size(F.filter(passed, lambda x: x))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Outer white space of any kind goes."""
    return F.btrim(text, F.lit(V.SPACES))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def clean_text(text: Column) -> Column:
    """Page numbers, page marks and figure marks go; runs of three white-space characters become one space."""
    x = F.regexp_replace(filled(text), r"(?m)^[0-9]+$", "")
    # most texts hold none of these marks: a plain search is cheaper than the pattern
    marked = lambda x, sign, p: let(x, lambda y: F.when(F.contains(y, F.lit(sign)), F.regexp_replace(y, p, "")).otherwise(y))
    x = marked(x, "页", rf"第[{V.SPACE}]*[0-9]+[{V.SPACE}]*页[{V.SPACE}]*[/\\][{V.SPACE}]*共[{V.SPACE}]*[0-9]+[{V.SPACE}]*页")
    x = F.regexp_replace(x, rf"(?i)Page[{V.SPACE}]+[0-9]+[{V.SPACE}]+of[{V.SPACE}]+[0-9]+", "")
    x = marked(x, "[", rf"(?i)\[图片\]|\[图[0-9]+\]|\[Image\]|\[Figure[{V.SPACE}]+[0-9]+\]")
    x = F.regexp_replace(x, f"[{V.SPACE}]{{3,}}", " ")
    x = F.array_join(F.transform(lines(x), strip), "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def sanitize(text: Column) -> Column:
    """Private-use, replacement and control characters go; runs of spaces and of line ends shrink."""
    x = F.regexp_replace(filled(text), rf"[{V.PRIVATE}\x{{FFFD}}{V.CONTROL}]", "")
    x = F.regexp_replace(x, r"[ \x{3000}]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def count(text: Column, body: str) -> Column:
    """Characters of a class: what its runs leave is counted, since a run is one match and a character would be many."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{body}]++", ""))


def profile(text: Column) -> Column:
    """(n, latin, cjk, valid, odd, ext_b): characters, Latin and CJK letters, valid ones (letters, digits, punctuation,
    white space), uncommon ones (neither ASCII nor valid) and of these the extended-B ideographs. Each class is taken
    out of what the one before left, so that only the first pass reads the whole text."""
    without = lambda x, body: F.regexp_replace(x, f"[{body}]++", "")

    def named(t, a, b, c, d):
        size = F.length
        return F.struct(size(t).alias("n"), (size(t) - size(a)).alias("latin"), (size(a) - size(b)).alias("cjk"), (size(t) - size(c)).alias("valid"), size(d).alias("odd"), (size(d) - size(without(d, V.EXT_B))).alias("ext_b"))

    return let(without(text, V.LATIN), lambda a: let(without(a, V.CJK), lambda b: let(without(b, "0-9" + V.PUNCT), lambda c: let(without(c, r"\x00-\x7F"), lambda d: named(text, a, b, c, d)))))


def valid_count(text: Column, punct: str = V.PUNCT) -> Column:
    return count(text, V.CJK + V.LATIN + "0-9" + punct)


def fix_encoding(text: Column) -> Column:
    """Lines that are mostly garbled are cut down to their plain runs or dropped, other lines lose bad characters;
    then paragraphs that are mostly garbled go."""

    def line(x: Column) -> Column:
        runs = lambda body: F.regexp_extract_all(x, F.lit(f"([{body}]+)"), F.lit(1))
        latin = runs(V.LATIN)
        found = F.array_join(F.concat(runs(V.CJK), latin, runs("0-9")), " ")
        useful = (count(x, V.CJK) > 0) | (F.length(F.array_join(latin, " ")) > 20)
        garbled = (F.length(x) > 10) & (valid_count(x, V.PUNCT_ENCODING) / F.greatest(F.length(x), F.lit(1)) < 0.30)
        return F.when(garbled, F.when(useful & (F.length(found) > 5), found)).otherwise(F.regexp_replace(x, rf"[{V.PRIVATE}\x{{FFFD}}{V.CONTROL}]", ""))

    fixed = F.array_join(F.filter(F.transform(lines(filled(text)), line), lambda x: x.isNotNull()), "\n")
    good = lambda p: (strip(p) == "") | (valid_count(p, V.PUNCT_ENCODING) / F.greatest(F.length(p), F.lit(1)) >= 0.50) | ((F.length(p) < 20) & ((count(p, V.CJK) > 0) | (count(p, V.LATIN) > 5)))
    return F.array_join(F.filter(F.split(fixed, "\n\n"), good), "\n\n")


def paragraphs(text: Column) -> Column:
    """Split at blank lines, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(filled(text), rf"\n[{V.SPACE}]*\n"), strip), lambda p: p != "")


def doc_id(relative_path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(relative_path, r"[/\\]", "_"), r"\.[^._]*$", "")


def year_of_id(name: Column) -> Column:
    """_YYYY_ or YYYY年 from 1900 to 2100, else 0."""
    found = [F.regexp_extract(name, p, 1) for p in (r"_([0-9]{4})_", r"([0-9]{4})年")]
    return F.coalesce(*(F.when(x.try_cast("int").between(1900, 2100), x.try_cast("int")) for x in found), F.lit(0))


def year_of_chunk(name: Column) -> Column:
    """_YYYY_, YYYY年, (YYYY) or _YYYY. from 2000 to 2024; a year out of range falls to the next pattern; else null."""
    found = [F.regexp_extract(name, p, 1) for p in (r"_([0-9]{4})_", r"([0-9]{4})年", r"\(([0-9]{4})\)", r"_([0-9]{4})\.")]
    return F.coalesce(*(F.when(x.try_cast("int").between(2000, 2024), x.try_cast("int")) for x in found))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(filled(text)) * 1.5).cast("int")


def sentence_boundary(text: Column, most: int, reach: int = 200) -> Column:
    """Just after the last sentence end at most `reach` characters before `most`, else after the first one after it,
    else `most`."""
    ends = "。！？.!?\n"
    back = F.reverse(F.substring(text, F.lit(most - reach + 2), F.lit(reach)))
    ahead = F.substring(text, F.lit(most + 1), F.lit(reach))
    held = F.length(F.substring(text, F.lit(most - reach + 2), F.lit(reach)))
    at_back = F.regexp_instr(back, F.lit(f"[{ends}]"))
    at_ahead = F.regexp_instr(ahead, F.lit(f"[{ends}]"))
    return F.when(at_back > 0, most - reach + 1 + held - at_back + 1).when(at_ahead > 0, most + at_ahead).otherwise(F.lit(most)).cast("int")


def truncated(text: Column, most_tokens: int = 2048) -> Column:
    """A text of more estimated tokens is cut at a sentence boundary near the number of characters that fits."""
    near = int(most_tokens / 1.5)
    return F.when(token_estimate(text) > most_tokens, F.substring(text, F.lit(1), sentence_boundary(text, near))).otherwise(text)


def hits(text: Column, words: list[str], fold: bool = False) -> Column:
    """How many of the words occur. fold: case doesn't count. A sum of plain `contains`, which code generation covers."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w.lower() if fold else w)).cast("int")
    return total


def presence(text: Column, words: list[str], full: float, fold: bool = False) -> Column:
    return F.least(hits(text, words, fold) / F.lit(full), F.lit(1.0))


def found_words(text: Column, words: list[str]) -> Column:
    """The words that occur, in the order of the vocabulary; case doesn't count."""
    return chosen(F.lower(text), {w: w.lower() for w in words})


def chosen(text: Column, signs: dict[str, str]) -> Column:
    """The names of the signs that occur in the text, in their order. A joined text that is split again is covered by
    code generation, a filtered array isn't."""
    bar = "\x1f"
    names = F.concat_ws(bar, *(F.when(F.contains(text, F.lit(s)), F.lit(n)) for n, s in signs.items()))
    return F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, bar))


def numbers(text: Column, kind: str = "integer") -> Column:
    """integer: digit runs; decimal: with at most one point and a per-cent sign; loose: points anywhere after a digit."""
    pattern = {"integer": r"[0-9]+", "decimal": r"[0-9]+\.?[0-9]*%?", "loose": r"[0-9]+[\.0-9]*%?"}[kind]
    return F.regexp_extract_all(filled(text), F.lit(f"({pattern})"), F.lit(1))


def year_mentions(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(filled(text), F.lit("(20[0-9]{2})"), F.lit(1))))


def grams(text: Column, n: int) -> Column:
    """All character n-grams in order, in one pass: each match looks n characters ahead and takes one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def mixed_tokens(text: Column) -> Column:
    """A CJK character is a token; other letters and digits join a token of plain ASCII ones, whatever stood between."""
    kept = F.regexp_replace(filled(text), r"[^\p{L}\p{N}]", "")
    return F.regexp_extract_all(kept, F.lit(r"([\x{4e00}-\x{9fff}]|[A-Za-z0-9]+[^A-Za-z0-9\x{4e00}-\x{9fff}]?|.)"), F.lit(1))


def ascii_tokens(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 separates."""
    return F.filter(F.split(F.lower(filled(text)), "[^a-z0-9]+"), lambda w: w != "")


def completeness(instruction: Column, response: Column, least_instruction: int = 10, least_response: int = 20) -> Column:
    half = lambda x, n: F.when(F.length(strip(filled(x))) >= n, 0.5).otherwise(0.0)
    return half(instruction, least_instruction) + half(response, least_response)


def strip_prefix(instruction: Column) -> Column:
    x = F.regexp_replace(instruction, rf"^工作指令[:：][{V.SPACE}]*", "")
    return F.regexp_replace(x, rf"(?i)^work instruction[:：][{V.SPACE}]*", "")


def shorten(text: Column, n: int) -> Column:
    x = filled(text)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def to_simplified(text: Column, pairs: dict[str, str] | None = None) -> Column:
    """Traditional to simplified characters by a table of single characters; without a table the text stays."""
    return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text


def to_simplified_phrases(text: Column, phrases: dict[str, str], pairs: dict[str, str] | None = None) -> Column:
    """Traditional to simplified text by the longest phrase at each place, where none begins by single characters: one
    character has several simple forms, which its phrase tells apart. Null stays null. A place costs a look-up for each
    length that phrases of its first character have; both tables are parameters and go along with the function."""
    table = {k: v for k, v in ((pairs or {}) | phrases).items() if k}
    lengths: dict[str, list[int]] = {}
    for n, first in sorted({(len(k), k[0]) for k in table}, reverse=True):
        lengths.setdefault(first, []).append(n)
    starts = re.compile("[" + "".join(map(re.escape, lengths)) + "]") if lengths else None

    def one(t: str) -> str:
        out, at = [], 0
        while m := starts.search(t, at):
            i = m.start()
            out.append(t[at:i])
            n = next((n for n in lengths[t[i]] if t[i : i + n] in table), 1)
            out.append(table.get(t[i : i + n], t[i : i + n]))
            at = i + n
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t) if t is not None and starts else t)

    return run(text)
