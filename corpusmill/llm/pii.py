"""Personal data by patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans (e-mail and IP addresses, card and phone numbers) name the protected entities. What else reveals them is
estimated from the corpus: for an entity e and a term t, PMI(e; t) / IC(e) is the share of the information in e that t
discloses, with probabilities over distinct texts. Among the words around an entity one text with both is enough: what
stands with one owner only discloses most. A term anywhere else in the text counts too, if that isn't chance: texts of
one entity whose surroundings of it are alike (copies with edits elsewhere) count once there, and one occurrence
together is taken off. Terms at or above a threshold are generalised to their first letters or, if they disclose nearly
all, removed, wherever they occur. What was seen once beside an address may be chance, though, and says little of texts without
the address. With `support` 2 a term goes from such texts only where two surroundings of the entity or more hold it, and
with `z` by a share with the lower confidence bound of P(e | t); from the texts of the entity it goes by the share itself.
The query and the pipeline take SURE, the values for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.groups import join_unique, with_groups
from .common import Scratch, few, table, text_of

#: The base patterns, in the order of their kinds. Each is written so that Java's matcher needs no deep
#: stack and no second look at a run; a match can only begin where its run begins or where the last match ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"

#: Characters around an entity whose words count as its surroundings.
CONTEXT = 60
#: Share of the entity's information: generalised from the first on, removed from the second on.
GENERALISE, REMOVE, STEM = 0.8, 0.95, 3
#: For texts that don't hold the entity: two surroundings, and a one-sided confidence bound of 95 %.
SURE = {"support": 2, "z": 1.645}
#: Bits of the table of terms that rows are tested with before anything is shuffled, at two places for each term: a
#: table of fixed size (256 KB) however many terms there are. What it lets through is decided by a join.
BITS, PROBES = 1 << 21, (0, 1)

#: Names of columns that are held for a while.
ROW, SPOTS, TERMS, SAME = "__pii_row", "__pii_spots", "__pii_terms", "__pii_same"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(_digits(number))
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {"email": F.lit(True), "ip": x.rlike(IP_VALID), "card": n.between(12, 19) & luhn(x), "phone": n.between(9, 15)}[kind]


def places(text: Column, pattern: Column) -> Column:
    """array of (start, found) of the leftmost non-overlapping matches, in code points: what lies between matches and
    the matches themselves, laid end to end."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["b"])).cast("int").alias("start"), x["m"].alias("found"))).alias("out"))
    zipped = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _spans(text: Column, kind: str, pattern: Column) -> Column:
    valid = F.filter(places(text, pattern), lambda x: _valid(kind, x["found"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["found"])).cast("int").alias("end"), x["found"].alias("found")))


BASE = "array<struct<start:int,rank:int,kind:string,end:int,found:string>>"


def base_spans(df: DataFrame, out: str = "base") -> DataFrame:
    """Adds the base spans of the column text, sorted by start and then kind."""
    text, none = F.col("text"), F.array().cast(BASE)
    can = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9](?:[\\x20-]?[0-9]){11}"), "phone": F.contains(text, F.lit("+"))}
    each = [F.when(can[k], _spans(text, k, F.lit(PATTERNS[k]))).otherwise(none) for k in KINDS]
    return df.withColumn(out, F.sort_array(F.concat(*each)))


def _words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))


def _bit(w: tuple[Column, ...], probe: int) -> Column:
    return F.pmod(F.xxhash64(*w, F.lit(probe)), F.lit(BITS))


def _test(terms: DataFrame, *by: str):
    """A function of columns that is true for every row of the table (its term, or the columns `by`), and for few other
    values; None for an empty table."""
    key = tuple(F.col(c) for c in by or ("term",))
    each = terms.select(F.explode(F.array(*(_bit(key, k) for k in PROBES))).alias("bit"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    rows = each.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("i")).agg(F.bit_or(word).alias("b")).collect()
    if not rows:
        return None
    longs = [0] * (BITS // 64)
    for r in rows:
        longs[r.i] = r.b
    table_ = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")  # folded to one literal

    def test(*w: Column) -> Column:
        held = [F.call_function("shiftright", F.get(table_, F.floor(_bit(w, k) / 64).cast("int")), (_bit(w, k) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for k in PROBES]
        return held[0] & held[1]

    return test


def _share(both: Column, texts_e: Column, texts_t: Column, texts: Column) -> Column:
    """PMI(e; t) / IC(e)."""
    return F.log(both * texts / (texts_e * texts_t)) / F.log(texts / texts_e)


def _lower_share(both: Column, texts_e: Column, texts_t: Column, texts: Column, z: float) -> Column:
    """The share with the lower bound of P(e | t) = both / texts_t (Wilson's score interval)."""
    p, zz = both / texts_t, z * z / texts_t
    bound = (p + zz / 2 - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / texts_t + zz / (4 * texts_t))) / (1 + zz)
    return _share(bound * texts_t, texts_e, texts_t, texts)


def _candidates(docs: DataFrame, scratch: Scratch, texts: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """(entity, term, both, texts_e, around, many), entities as hashes: terms around an entity, in however few texts,
    and terms anywhere in its texts (then not around); many: two surroundings of the entity or more hold the term. A
    term is in at least as many texts as it was counted in here, so a pair whose share is too low even with that number
    is left out. Beside it the surroundings: (same, entity, terms)."""
    own = base_spans(docs.select(text_of().alias("text")).where(F.col("text").rlike(r"[@+]|[0-9]")))
    text = F.col("text")

    def context(x: Column) -> Column:
        left = F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["start"]))
        right = F.substring(text, x["end"] + 1, F.lit(CONTEXT))
        # words that the context cuts in two don't count
        left = F.when(x["start"] > CONTEXT, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
        right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
        return F.struct(F.xxhash64(x["kind"], F.lower(x["found"])).alias("entity"), F.array_union(_words(left), _words(right)).alias("terms"))

    # contexts are cut inside the row, so that the text isn't copied for every entity
    own = own.where(F.size("base") > 0).select(F.xxhash64("text").alias("same"), F.explode(F.transform("base", context)).alias("x"))
    own = scratch.keep(few(own.select("same", "x.*"), docs), "contexts")
    # an entity or a word that stands in very many texts is joined in parts
    seen = with_groups(own, ["entity"], "same", F.count("*").alias("texts_e"), over=own.select("entity", "same").distinct())
    pairs = seen.select("entity", "texts_e", "same", F.xxhash64(F.sort_array("terms")).alias("at"), F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "texts_e", "same", "term").agg(F.min("at").alias("at"))
    pairs = pairs.groupBy("entity", "texts_e", "term").agg(F.count("*").alias("both"), (F.min("at") != F.max("at")).alias("many"))
    pairs = pairs.withColumn("around", F.lit(True))
    around = own.select("same", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("texts_c"))
    pairs = join_unique(pairs, around, ["term"], "entity").where(F.col("texts_e") < texts)
    pairs = pairs.where(_share(F.col("both"), F.col("texts_e"), F.col("texts_c"), texts) >= least).drop("texts_c")
    wide = _wide(docs, scratch, own)
    if wide is not None:
        far = wide.withColumns({"around": F.lit(False), "many": F.lit(True)}).where((F.col("texts_e") < texts) & (_share(F.col("both"), F.col("texts_e"), F.col("both") + 1, texts) >= least))
        pairs = pairs.unionByName(far)
    return pairs, own


def _wide(docs: DataFrame, scratch: Scratch, own: DataFrame) -> DataFrame | None:
    """(entity, term, both, texts_e) of entities with two surroundings or more, from (same, entity, terms): the terms
    of their whole texts, one text for each of an entity's surroundings. both is one less than what was counted."""
    texts = own.groupBy("entity", F.xxhash64(F.sort_array("terms")).alias("around")).agg(F.min("same").alias("same"))
    many = texts.groupBy("entity").agg(F.count_distinct("same").alias("texts_e")).where("texts_e > 1")
    texts = scratch.keep(few(texts.join(many, "entity").select("entity", "texts_e", "same").distinct(), docs), "wide")
    test = _test(texts, "same")
    if test is None:
        return None
    words = docs.select(text_of().alias("text")).where(test(F.xxhash64("text")))
    words = words.select(F.xxhash64("text").alias("same"), _words(F.col("text")).alias("terms")).dropDuplicates(["same"])
    each = words.join(texts, "same").select("entity", "texts_e", F.explode("terms").alias("term"))
    each = each.groupBy("entity", "texts_e", "term").agg((F.count("*") - 1).alias("both"))
    return each.where("both > 0").select("entity", "texts_e", "term", "both")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _spots(text: Column, known: Column) -> Column:
    """(start, end, term, stem) of the known words in the whole text."""
    none = F.array().cast("array<struct<start:int,end:int,term:string,stem:string>>")
    spot = lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["found"])).cast("int").alias("end"), F.lower(x["found"]).alias("term"), F.left(x["found"], F.lit(STEM)).alias("stem"))
    pattern = lambda hits: F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(hits, "|"), F.lit(r")(?!\p{L})"))
    return let(known, lambda hits: F.when(F.size(hits) > 0, F.transform(places(text, pattern(hits)), spot)).otherwise(none))


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its mask; a span that begins inside another one adds nothing of its own."""

    def step(acc, s):
        begin = F.greatest(acc["at"], s["start"])
        kept = F.substring(text, acc["at"] + 1, begin - acc["at"])
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], kept, s["mask"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).cast("int").alias("at"), new.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def _risky(docs: DataFrame, scratch: Scratch, least: float, support: int = 1, z: float = 0.0) -> DataFrame:
    """(term, same, share): the terms that disclose at least that share of the information in some entity. Where same is
    null they go from all texts, else from the text of the entity that has this hash."""
    same = F.xxhash64("text").alias("same")
    own = docs.select(text_of().alias("text"))
    copies = scratch.keep(few(own.groupBy(same).agg(F.count("*").alias("n")), docs), "copies")
    total = F.lit(float(max(2, copies.count())))
    candidates, contexts = _candidates(docs, scratch, total, least)
    candidates = scratch.keep(few(candidates, docs), "candidates")
    test = _test(candidates)
    if test is None:
        return candidates.select("term", F.lit(None).cast("long").alias("same"), F.lit(1.0).alias("share"))
    # only texts that may have copies go through pairs of text and term; the terms of all others are counted in place
    each = lambda rows: rows.select(same, F.explode(F.filter(_words(F.col("text")), lambda w: test(w))).alias("term"))
    copied = _test(copies.where("n > 1"), "same")
    if copied is None:
        terms = each(own).select("term")
    else:
        repeats = copied(F.xxhash64("text"))
        terms = each(own.where(~repeats)).select("term").unionByName(each(own.where(repeats)).distinct().select("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("texts_t"))
    figures = [F.col(c) for c in ("both", "texts_e", "texts_t")]
    shares = candidates.join(counts, "term").select("entity", "term", "around", "many", _share(*figures, total).alias("share"), _lower_share(*figures, total, z).alias("lower"))
    shares = scratch.keep(few(shares.where(F.col("share") >= least), docs), "shares")
    sure = (F.col("lower") >= least) & (F.col("many") | F.lit(support < 2))
    risky = shares.where(sure).groupBy("term").agg(F.max("lower").alias("share")).withColumn("same", F.lit(None).cast("long"))
    if support > 1 or z > 0:
        # what stands around an entity goes from its texts; the texts of an entity are joined in parts
        around = contexts.select("same", "entity", F.explode("terms").alias("term"))
        inside = join_unique(around, shares.where("around").select("entity", "term", "share"), ["entity", "term"], "same")
        risky = risky.unionByName(inside.groupBy("same", "term").agg(F.max("share").alias("share")))
    return scratch.keep(few(risky.select("term", "same", "share"), docs), "risky")


def sanitise(spark: SparkSession, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, keep_text: bool = True, support: int = 1, z: float = 0.0) -> DataFrame:
    """Finds and masks personal data and what discloses it in the whole text of docs (text; all other columns stay).

    Adds `_base` (base spans: start, rank, kind, end, found), `_spans` (all spans: start, rank, kind, end, mask; code
    points, end exclusive) and, with keep_text, replaces `text` by the sanitised text. A term inside a base span is
    covered by it. A null text counts as empty, whole texts are read, however long. Repeated rows each get a row; equal
    texts count once in every probability, so that copies prove nothing; of equal shares none comes first, since all
    terms are masked. Columns named `_base` and `_spans` are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("_base", "_spans")
    scratch = Scratch(spark, "pii")
    risky = _risky(docs, scratch, generalise, support, z)
    test = _test(risky, "same", "term")  # a hash skips nulls, so that a row without a text is one of its term
    own = base_spans(docs.withColumn("text", text_of()), "_base")
    own = own.withColumn(ROW, F.monotonically_increasing_id()).withColumn(SAME, F.xxhash64("text"))
    places_of = F.when(F.size("_base") > 0, F.array(F.lit(None).cast("long"), F.col(SAME))).otherwise(F.array(F.lit(None).cast("long")))
    words = F.array().cast("array<string>")
    if test is not None:
        words = F.filter(_words(F.col("text")), lambda w: F.exists(places_of, lambda at: test(at, w)))
    own = own.withColumn(SPOTS, _spots(F.col("text"), words))
    if not keep_text:  # then no text is shuffled: the places of terms are known here
        own = own.withColumn("text", F.lit(None).cast("string"))
    own = scratch.keep(few(own, docs), "texts")
    masks = F.transform("_base", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mask")))
    own = own.withColumn("_spans", masks)
    if test is not None:
        plain, own = own.where(F.size(SPOTS) == 0), own.where(F.size(SPOTS) > 0)
        # a spot is looked up twice, for all texts and for this one; rows of a term or of a copied text are joined in parts
        both = F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit(0).cast("long").alias("same")), F.struct(F.lit(False).alias("all"), F.col(SAME).alias("same"))))
        each = own.select(ROW, SAME, F.explode(SPOTS).alias("x")).select(ROW, "x.*", both.alias("k")).select("*", "k.*").drop("k")
        known = risky.select("term", "share", F.isnull("same").alias("all"), F.coalesce("same", F.lit(0)).alias("same"))
        each = join_unique(each, known, ["term", "all", "same"], ROW)
        each = each.groupBy(ROW, "start", "end", "stem").agg(F.max("share").alias("share"))
        mask = F.when(F.col("share") >= remove, F.lit("[TERM]")).otherwise(F.concat("stem", F.lit("*")))
        each = each.select(ROW, F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), "end", mask.alias("mask")).alias("t"))
        own = own.join(each.groupBy(ROW).agg(F.collect_list("t").alias(TERMS)), ROW, "left")  # the places of one text
        outside = F.filter(TERMS, lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        own = own.withColumn("_spans", F.when(F.col(TERMS).isNotNull(), F.sort_array(F.concat("_spans", outside))).otherwise(F.col("_spans")))
        own = plain.unionByName(own.drop(TERMS))
    if keep_text:
        own = own.withColumn("text", _masked(F.col("text"), F.col("_spans")))
    return few(own.select(*docs.columns, "_base", "_spans"), docs)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, **SURE)
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


QUERIES = {"op2_personal_data": op2_personal_data}
SQL: dict[str, str] = {}
