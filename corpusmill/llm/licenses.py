"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences, sentences are normalised and mapped to the identifiers of known licence sentences, and
the sequence of identifiers of a document is matched against ordered rules, each of which takes what it matches out of
the sequence. Texts without any word that licence sentences have never get that far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Known sentences, as (identifier, pattern of the whole normalised sentence or a part of it).
SENTENCES = (
    ("apache2", r"apache license,? (version |v)?2(\.0)?\b"),
    ("agpl3", r"(gnu affero general public license|\bagpl)(,? v(ersion )?|-)? ?3"),
    ("lgpl", r"(gnu (lesser|library) general public license|\blgpl)"),
    ("gpl3", r"(gnu general public license|\bgpl)(,? v(ersion )?|-)? ?3"),
    ("gpl2", r"(gnu general public license|\bgpl)(,? v(ersion )?|-)? ?2"),
    ("gplany", r"(gnu general public license|\bgpl)\b"),
    ("laterversion", r"\b(or \(?at your option\)? any later version|any later version)\b"),
    ("mpl2", r"mozilla public license,? (version |v)?2"),
    ("ccbyncsa", r"(cc by-nc-sa|creative commons attribution-noncommercial-sharealike)"),
    ("ccbyncnd", r"(cc by-nc-nd|creative commons attribution-noncommercial-noderivatives)"),
    ("ccbync", r"(cc by-nc|creative commons attribution-noncommercial)"),
    ("ccbysa", r"(cc by-sa|creative commons attribution-sharealike)"),
    ("ccbynd", r"(cc by-nd|creative commons attribution-noderivatives)"),
    ("ccby", r"(cc by\b|creative commons attribution)"),
    ("cc0", r"(\bcc0\b|creative commons zero)"),
    ("mitname", r"\b(the )?mit license\b"),
    ("mitgrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mitnotice", r"the above copyright notice and this permission notice shall be included"),
    ("asis", r"the software is provided \"?as is\"?"),
    ("iscgrant", r"permission to use, copy, modify, and/?(or)? distribute this software for any purpose"),
    ("bsdname3", r"\b(bsd-3-clause|3-clause bsd|bsd 3-clause)\b"),
    ("bsdname2", r"\b(bsd-2-clause|2-clause bsd|bsd 2-clause)\b"),
    ("bsdname", r"\bbsd license\b"),
    ("bsdgrant", r"redistribution and use in source and binary forms"),
    ("bsdsource", r"redistributions of source code must retain"),
    ("bsdbinary", r"redistributions in binary form must reproduce"),
    ("bsdadvert", r"all advertising materials mentioning features or use of this software"),
    ("bsdendorse", r"may (not )?be used to endorse or promote products"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("notpublicdomain", r"\b(not|never|nor) [a-z ]{0,30}public domain\b"),
    ("publicdomain", r"\bpublic domain\b"),
    ("allrights", r"\ball rights reserved\b"),
    ("copyright", r"\bcopyright\b"),
)
#: Ordered rules over identifier sequences, as (licence, pattern). A sequence is written <a><b><c>; ~ is
#: where identifiers that stand in many licences, NOISE, may come between.
NOISE = "(<copyright>|<allrights>)*"
RULES = (
    ("MIT", r"<mitgrant>~(<mitnotice>~)?(<asis>)?"),
    ("BSD-4-Clause", r"<bsdgrant>~<bsdsource>~<bsdbinary>~<bsdadvert>~<bsdendorse>~(<asis>)?"),
    ("BSD-3-Clause", r"<bsdgrant>~<bsdsource>~<bsdbinary>~<bsdendorse>~(<asis>)?"),
    ("BSD-2-Clause", r"<bsdgrant>~<bsdsource>~<bsdbinary>~(<asis>)?"),
    ("ISC", r"<iscgrant>~(<asis>)?"),
    ("AGPL-3.0-or-later", r"<agpl3>~<laterversion>"),
    ("GPL-3.0-or-later", r"<gpl3>~<laterversion>"),
    ("GPL-2.0-or-later", r"<gpl2>~<laterversion>"),
    ("Apache-2.0", r"<apache2>"),
    ("AGPL-3.0", r"<agpl3>"),
    ("LGPL", r"<lgpl>"),
    ("GPL-3.0", r"<gpl3>"),
    ("GPL-2.0", r"<gpl2>"),
    ("GPL", r"<gplany>"),
    ("MPL-2.0", r"<mpl2>"),
    ("CC-BY-NC-SA", r"<ccbyncsa>"),
    ("CC-BY-NC-ND", r"<ccbyncnd>"),
    ("CC-BY-NC", r"<ccbync>"),
    ("CC-BY-SA", r"<ccbysa>"),
    ("CC-BY-ND", r"<ccbynd>"),
    ("CC-BY", r"<ccby>"),
    ("CC0-1.0", r"<cc0>"),
    ("MIT", r"<mitname>"),
    ("BSD-3-Clause", r"<bsdname3>"),
    ("BSD-2-Clause", r"<bsdname2>"),
    ("BSD", r"<bsdname>|<bsdgrant>"),
    ("Unlicense", r"<unlicense>"),
    ("public-domain", r"<publicdomain>"),
    ("proprietary", r"(<copyright>)?<allrights>"),
)
#: Counts only where no other rule found anything: rights are reserved in open licences too.
ALONE = "proprietary"
#: The name of a column that is held for a while.
SEQ = "__licence_seq"
#: Every known sentence holds one of these; a text without them has no licence sentence.
HINT = r"(?i)licen[sc]e|copyright|permission|redistribut|public domain|all rights|provided|gpl|cc by|cc0|creative commons|endorse|bsd|any later version"


#: Further forms of known sentences, tried before the others.
_FSF = r" as published by the free software foundation,? (either )?version "
MORE = (
    ("agpl3", f"gnu affero general public license{_FSF}3"),
    ("gpl3", f"gnu general public license{_FSF}3"),
    ("gpl2", f"gnu general public license{_FSF}2"),
)
#: SPDX identifiers in a tag, as (identifiers of sentences, pattern of the lower-case tag value).
SPDX = (
    ("agpl3,laterversion", r"agpl-3\.0(-or-later|\+)"),
    ("agpl3", r"agpl-3\.0(-only)?"),
    ("lgpl", r"lgpl-[0-9.]+(-or-later|-only|\+)?"),
    ("gpl3,laterversion", r"gpl-3\.0(-or-later|\+)"),
    ("gpl3", r"gpl-3\.0(-only)?"),
    ("gpl2,laterversion", r"gpl-2\.0(-or-later|\+)"),
    ("gpl2", r"gpl-2\.0(-only)?"),
    ("apache2", r"apache-2\.0"),
    ("mpl2", r"mpl-2\.0"),
    ("ccbyncsa", r"cc-by-nc-sa-[0-9.]+"),
    ("ccbyncnd", r"cc-by-nc-nd-[0-9.]+"),
    ("ccbync", r"cc-by-nc-[0-9.]+"),
    ("ccbysa", r"cc-by-sa-[0-9.]+"),
    ("ccbynd", r"cc-by-nd-[0-9.]+"),
    ("ccby", r"cc-by-[0-9.]+"),
    ("cc0", r"cc0-1\.0"),
    ("bsdname3", r"bsd-3-clause"),
    ("bsdname2", r"bsd-2-clause"),
    ("unlicense", r"unlicense"),
    ("mitname", r"mit"),
    ("iscgrant", r"isc"),
)
TAG = r"spdx-license-identifier:"


def _sentences(text: Column) -> Column:
    """Sentences end at blank lines, and where white space follows a full stop, question or exclamation mark. Lines
    that are wrapped inside a sentence are joined, without the marks of a comment; a line with an SPDX tag is one."""
    bare = F.regexp_replace(text, r"(?m)^[\x20\t*#/;%!-]+|\r", "")
    tags = F.regexp_replace(bare, rf"(?im)^.*{TAG}.*$", "\n\n$0\n\n")
    ends = F.regexp_replace(tags, r"([.!?])[\x20\t\n]+", "$1\n\n")
    return F.split(ends, r"\n[\x20\t]*\n\s*")


def _normal(sentence: Column) -> Column:
    s = F.regexp_replace(F.lower(sentence), "licence", "license")
    return F.trim(F.regexp_replace(s, r"[^a-z0-9.,()/\"-]+", " "))


def _found(x: Column, known: tuple[tuple[str, str], ...]) -> Column:
    """The identifiers of all places of x that a known pattern fits, in order; at a place the first one counts."""
    name = lambda m: F.coalesce(*(F.when(m.rlike(f"^(?:{p})$"), n) for n, p in known))
    return F.transform(F.regexp_extract_all(x, F.lit(_either(known)), F.lit(0)), name)


def _either(known: tuple[tuple[str, str], ...]) -> str:
    return "|".join(f"(?:{p})" for _, p in known)


def _identifiers(sentence: Column) -> Column:
    """All identifiers of a sentence in order. A mention of copyright counts where nothing else is known."""
    tag = F.lower(F.regexp_extract(sentence, rf"(?i){TAG}(.*)", 1))
    ids = _found(_normal(sentence), MORE + SENTENCES)
    some = F.filter(ids, lambda x: x != "copyright")
    plain = F.when(F.size(some) > 0, some).otherwise(F.slice(ids, 1, 1))
    # the tag's value is a list of identifiers and words between; what isn't a known identifier as a whole gives none
    names = F.split(tag, r"[^a-z0-9.+-]+")
    known = F.transform(names, lambda m: F.coalesce(*(F.when(m.rlike(f"^(?:{p})$"), n) for n, p in SPDX)))
    spdx = F.flatten(F.transform(F.filter(known, lambda x: x.isNotNull()), lambda x: F.split(x, ",")))
    return F.when(sentence.rlike(f"(?i){TAG}"), spdx).otherwise(plain)


def scan(docs: DataFrame) -> DataFrame:
    """docs (text; all other columns stay) with `sentence_ids` (identifiers of the known sentences of the whole text,
    in order), `licenses` (what the rules found, in rule order) and `unmatched` (identifiers that no rule took).

    A null or empty text has none. Columns of these names are replaced. Repeated rows each get a row; an empty table
    gives an empty result. A sentence gives all identifiers that it holds, in their order.
    """
    docs = docs.drop("sentence_ids", "licenses", "unmatched")
    hint = F.when(text_of().rlike(HINT), F.col("text"))
    lines = F.filter(_sentences(hint), lambda x: x.rlike(HINT))
    ids = F.filter(F.flatten(F.transform(lines, _identifiers)), lambda x: x.isNotNull())
    out = docs.withColumn("sentence_ids", F.coalesce(ids, F.array().cast("array<string>")))
    out = out.withColumn(SEQ, F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    found = F.array().cast("array<string>")
    for k, (name, rule) in enumerate(RULES):
        alone = F.size(found) == 0 if name == ALONE else F.lit(True)
        # what a rule takes leaves a bar, so that its neighbours don't become neighbours of each other
        rule = rule.replace("~", NOISE)
        out = out.withColumn(f"{SEQ}_{k}", F.col(SEQ).rlike(rule) & alone).withColumn(SEQ, F.regexp_replace(SEQ, rule, "|"))
        found = F.concat(found, F.when(F.col(f"{SEQ}_{k}"), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("licenses", F.array_distinct(found))
    out = out.withColumn("unmatched", F.filter(F.split(SEQ, "[<>|]+"), lambda x: x != ""))
    return out.drop(SEQ, *(f"{SEQ}_{k}" for k in range(len(RULES))))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, licenses, sentence_ids and unmatched (each comma-joined), n_sentences."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("licenses", "sentence_ids", "unmatched")), F.size("sentence_ids").alias("n_sentences"))


def _sql() -> str:
    """The scan in SQL, made from the same fixed values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = MORE + SENTENCES
    name = " ".join(f"WHEN regexp_full_match(m, {quoted(p)}) THEN {quoted(n)}" for n, p in known)
    tag = " ".join(f"WHEN regexp_full_match(m, {quoted(p)}) THEN {quoted(n)}" for n, p in SPDX)
    some = "lambda x: x IS NOT NULL"
    steps, before = [], "s"
    for k, (licence, rule) in enumerate(RULES):
        rule = quoted(rule.replace("~", NOISE))
        alone = " AND len(found) = 0" if licence == ALONE else ""
        hit = f"CASE WHEN regexp_matches(seq, {rule}){alone} THEN list_append(found, {quoted(licence)}) ELSE found END"
        steps.append(f"r{k} AS (SELECT row, ids, {hit} AS found, regexp_replace(seq, {rule}, '|', 'g') AS seq FROM {before})")
        before = f"r{k}"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, text FROM documents
), t AS (
  SELECT row, regexp_replace(regexp_replace(text, '(?m)^[ \t*#/;%!-]+|\r', '', 'g'), '(?im)^.*{TAG}.*$', chr(10) || chr(10) || '\0' || chr(10) || chr(10), 'g') AS text
  FROM d WHERE regexp_matches(text, {quoted(HINT)})
), p AS (
  SELECT row, regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n]+', '\1' || chr(10) || chr(10), 'g'), '\n[ \t]*\n\s*') AS x FROM t
), l AS (
  SELECT row, k, x[k] AS x FROM (SELECT row, x, unnest(range(1, len(x) + 1)) AS k FROM p) WHERE regexp_matches(x[k], {quoted(HINT)})
), n AS (
  SELECT row, k, regexp_matches(x, '(?i){TAG}') AS tagged, regexp_split_to_array(lower(regexp_extract(x, '(?i){TAG}(.*)', 1)), '[^a-z0-9.+-]+') AS names,
    trim(regexp_replace(regexp_replace(lower(x), 'licence', 'license', 'g'), '[^a-z0-9.,()/"-]+', ' ', 'g'), ' ') AS x FROM l
), f AS (
  SELECT row, k, tagged, list_filter(list_transform(names, lambda m: CASE {tag} END), {some}) AS tags, list_transform(regexp_extract_all(x, {quoted(_either(known))}), lambda m: CASE {name} END) AS ids FROM n
), g AS (
  SELECT row, k, CASE WHEN tagged THEN string_split(array_to_string(tags, ','), ',') WHEN len(list_filter(ids, lambda x: x <> 'copyright')) > 0 THEN list_filter(ids, lambda x: x <> 'copyright') ELSE ids[1:1] END AS ids FROM f
), i AS (
  SELECT row, list_filter(flatten(list(ids ORDER BY k)), lambda x: x IS NOT NULL AND x <> '') AS ids FROM g GROUP BY row
), s AS (
  SELECT row, coalesce(ids, []) AS ids, CAST([] AS VARCHAR[]) AS found, array_to_string(list_transform(coalesce(ids, []), lambda x: '<' || x || '>'), '') AS seq FROM d LEFT JOIN i USING (row)
), {", ".join(steps)}
SELECT doc_id, array_to_string(list_filter(found, lambda x, k: list_position(found, x) = k), ',') AS licenses, array_to_string(ids, ',') AS sentence_ids,
  trim(regexp_replace(seq, '[<>|]+', ',', 'g'), ',') AS unmatched, CAST(len(ids) AS INTEGER) AS n_sentences
FROM {before} JOIN d USING (row)"""


QUERIES = {"op5_license_scan": op5_license_scan}
SQL = {"op5_license_scan": _sql()}
