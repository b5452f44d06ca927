"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Texts with the same words share a 128-bit key; only one text of each key goes on, so groups of exact copies never
   meet in a task.
2. Each text's distinct five-word shingles arrive as Poisson processes: a shingle of weight w sends exponential
   arrivals of rate w to random places of the signature and stops as soon as its next arrival is later than every
   place's earliest. All weights are 1, so that two signatures agree at a place with the Jaccard similarity of the
   sets, the one that links are verified by, however often either text repeats a shingle.
3. Bands of the signature make buckets. A small bucket gives its pairs that pass an estimate, a large one a star from
   its least key; the components of these edges are families that can hold a link.
4. Small families are verified whole, many to a task. Large ones are first dealt into blocks at random, twice, and
   each block is verified; then all are verified against the family's leader, the text that shares most places with
   others. Copies of one text and copies round one text are linked by now, with work in proportion to the family. What
   is left are texts outside the largest component of their bucket or of their family, whichever takes less work: they
   are verified against all of it, block by block, so that no link is lost. A link is a Jaccard similarity of the
   shingle sets of 0.8 or more. Each unit returns a spanning forest of its links.
5. The components of the links are the classes.

Figures of groups (buckets, families, classes, neighbours) are joined to rows in parts, so that no large group comes
together in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shingles as sh
from .common import PARTS, Scratch, table, with_groups
from .components import components

U = np.uint64
PLACES, ROWS = 216, 6
SMALL_BUCKET, BLOCK = 32, 192


def prob_minhash(h: np.ndarray, d: np.ndarray, w: np.ndarray, texts: int, places: int) -> np.ndarray:
    """Signatures (texts x places) of weighted elements (hash, text, weight); texts without elements get zeros.

    All elements of all texts send their first arrival, then those that can still matter their second, and so on.
    """
    best = np.full(texts * places, np.inf)
    which = np.zeros(texts * places, dtype=U)
    state, at, time = sh.mix(h + U(0x2545F4914F6CDD1D)), d.astype(np.int64), np.zeros(len(h))
    rate, name = w.astype(np.float64), h
    while len(state):
        state = state + U(sh.BASE)
        x = sh.mix(state)
        time = time - np.log1p(-(x >> U(11)).astype(np.float64) * 2.0**-53) / rate
        place = ((sh.mix(x ^ U(0xA0761D6478BD642F)) >> U(32)) * U(places) >> U(32)).astype(np.int64)
        slot = at * places + place
        sooner = time < best[slot]
        slot_in, time_in, name_in = slot[sooner], time[sooner], name[sooner]
        np.minimum.at(best, slot_in, time_in)
        won = time_in == best[slot_in]
        which[slot_in[won]] = name_in[won]
        last = best.reshape(texts, places).max(axis=1)
        live = time < last[at]
        state, at, time, rate, name = state[live], at[live], time[live], rate[live], name[live]
    return which.reshape(texts, places)


def signatures(texts: list[str | None], width: int, places: int) -> np.ndarray:
    out = [np.zeros((0, places), dtype=U)]
    for _, run in sh.chunks([t or "" for t in texts]):
        h, d, _ = sh.distinct(*sh.shingle_hashes(run, width))
        out.append(prob_minhash(h, d, np.ones(len(h)), len(run), places))
    return np.concatenate(out)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    n, places = signature.shape
    bands = places // rows
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    total = np.zeros((n, bands), dtype=U)
    for j in range(rows):
        total += sh.mix(parts[:, :, j] + U(j + 1)) * U(2 * j + 3)
    return sh.mix(total + np.arange(1, bands + 1, dtype=U) * U(sh.BASE)).view(np.int64)


def sketches(docs: DataFrame, width: int, places: int, rows: int, carry: bool = False) -> DataFrame:
    """(doc_id, key, bands, signature, and with carry the text and the rest of the row as `doc`): signature holds 16 bits
    of each place, little-endian. Texts without words have no bands."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc")
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([rest] if carry else []))
    carried = ["text", "doc"] if carry else []
    names = ["doc_id", "key", "bands", "signature", *carried]
    fields = StructType.fromDDL("doc_id long, key binary, bands array<long>, signature binary").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 250):
                batch = whole.slice(begin, 250)
                texts = batch.column("text").to_pylist()
                s = signatures(texts, width, places)
                bands, low = band_hashes(s, rows), s.astype(np.uint16).astype("<u2")
                some = s.any(axis=1)
                lists = pa.array([b if x else None for b, x in zip(bands, some, strict=True)], type=pa.list_(pa.int64()))
                made = [batch.column("doc_id"), pa.array([sh.word_key(t) for t in texts], type=pa.binary()), lists, pa.array([x.tobytes() for x in low], type=pa.binary())]
                yield pa.RecordBatch.from_arrays([*made, *(batch.column(c) for c in carried)], names=names)

    return own.mapInArrow(run, StructType(fields + [f for f in own.schema.fields if f.name in carried]))


def likely(pairs: DataFrame, places: int, least: float) -> DataFrame:
    """The (u, v, s, t) whose signatures s and t agree in a share of at least `least` of their places, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                b = whole.slice(begin, 2000)
                s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(-1, places) for c in ("s", "t"))
                keep = pa.array((s == t).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(keep)

    return pairs.mapInArrow(run, "u binary, v binary")


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of sets with Jaccard similarity >= least. sets: sorted, distinct."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    if n <= 8:
        root, out = list(range(n)), []
        for j in range(n):
            for i in range(j):
                if root[i] != root[j] and min(size[i], size[j]) >= least * max(size[i], size[j]) > 0:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= least * (size[i] + size[j] - common) - 1e-9:
                        old, new = root[j], root[i]
                        root = [new if r == old else r for r in root]
                        out.append((i, j))
        return out
    item, owner = np.concatenate(sets), np.repeat(np.arange(n), size.astype(int))
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    new = np.r_[True, item[1:] != item[:-1]] if len(item) else np.zeros(0, dtype=bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else new
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    common = np.zeros((n, n), dtype=np.float32)
    step = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step + 1, step))
    for k in range(len(edges) - 1):
        part = np.zeros((n, step), dtype=np.float32)
        part[owner[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * step] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    linked = (common >= least * union - 1e-6) & (common > 0)
    open_, out = np.ones(n, dtype=bool), []
    for start in range(n):
        if open_[start]:
            open_[start] = False
            queue = [start]
            while queue:
                i = queue.pop()
                found = np.flatnonzero(linked[i] & open_)
                open_[found] = False
                out += [(i, j) for j in found.tolist()]
                queue += found.tolist()
    return out


def _verify(width: int, least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, family in group.groupby("family", sort=False):
            texts, keys = [], []
            for key, text in zip(family["key"], family["text"], strict=True):
                # a doc_id may occur with several texts: only the row that has this key counts
                if sh.word_key(text) == key:
                    texts.append(text)
                    keys.append(key)
            sets: list[np.ndarray] = []
            for _, part in sh.chunks(texts):
                h, d, _ = sh.distinct(*sh.shingle_hashes(part, width))
                sets += np.split(h, np.searchsorted(d, np.arange(1, len(part))))
            out += [(keys[i], keys[j]) for i, j in forest(sets, least)]
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text; other columns are ignored).

    Returns a row per document: doc_id, class_id (the least doc_id of its class), class_size, keep (true for one
    document of each class: that of the least doc_id). Null texts count as empty; texts without words are copies of
    each other. A text of fewer than `width` words has one shingle, all its words. Repeated rows are copies; of rows
    with the same least doc_id one is kept. A null doc_id counts as larger than all others. An empty table gives an
    empty result.
    """
    return _classes(spark, docs, **options)[1].drop("row")


def deduplicate(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one of each class, with all their columns."""
    own, classes = _classes(spark, docs, carry=True, **options)
    kept = own.select("row", "text", "doc").join(classes.where("keep").select("row"), "row")
    return kept.select(*((F.col("text").cast(docs.schema[c].dataType) if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns))


def _classes(spark: SparkSession, docs: DataFrame, width: int = 5, least: float = 0.8, places: int = PLACES, rows: int = ROWS, small_bucket: int = SMALL_BUCKET, block: int = BLOCK, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the written sketches with a row number, the classes by row number)."""
    scratch = Scratch(spark, "neardup")
    own = scratch.keep(sketches(docs, width, places, rows, carry).withColumn("row", F.monotonically_increasing_id()), "sketches")
    texts = own.groupBy("key").agg(F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select("key", "x.*")
    one = own.join(texts.select("row"), "row", "left_semi")

    rows_ = one.select("key", F.explode("bands").alias("band"))
    member = scratch.keep(with_groups(rows_, ["band"], "key", F.count("*").alias("n"), F.min("key").alias("first"), where="n > 1"), "members")
    star = member.where(F.col("n") > small_bucket).select(F.col("first").alias("u"), F.col("key").alias("v"))
    lists = member.where(F.col("n") <= small_bucket).groupBy("band").agg(F.sort_array(F.collect_list("key")).alias("k"))
    pairs = lists.select(F.posexplode("k").alias("i", "u"), "k").select("u", F.explode(F.slice("k", F.col("i") + 2, F.size("k"))).alias("v")).distinct()
    signed = one.select("key", "signature")
    pairs = pairs.join(signed.select(F.col("key").alias("u"), F.col("signature").alias("s")), "u").join(signed.select(F.col("key").alias("v"), F.col("signature").alias("t")), "v")
    error = (least * (1 - least) / places) ** 0.5
    near = scratch.keep(likely(pairs.select("u", "v", "s", "t"), places, least - 5 * error), "near")
    edges = near.unionByName(star)
    families = components(scratch, edges).select(F.col("node").alias("key"), F.col("root").alias("family"))
    families = scratch.keep(with_groups(families, ["family"], "key", F.count("*").alias("size")), "families")

    if carry:
        found = own.select("row", "key", "text").join(families.join(texts, "key").select("row"), "row").select("key", "text")
    else:
        wanted = families.join(texts.select("key", F.col("doc_id").alias("id")), "key")
        whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
        found = wanted.join(whole, wanted["id"].eqNullSafe(whole["id"])).select("key", "text")
    big = families.where(F.col("size") > block).select("key")
    some_big = not big.isEmpty()
    found = scratch.keep(found, "texts") if some_big else found

    def verified(units: DataFrame, name: str) -> DataFrame:
        """The links inside units: rows (of, a, b, family, key), or (family, key) where those are many small families,
        dealt to units of about `block` texts by their family."""
        if "of" not in units.columns:
            packed = max(1, units.count() // block)
            units = units.select("family", "key", F.lit(0).alias("of"), F.pmod(F.xxhash64("family"), F.lit(packed)).cast("int").alias("a"), F.lit(0).alias("b"))
        units = units.select("of", "a", "b", "family", "key")
        grouped = found.join(units, "key").groupBy("of", "a", "b")
        return scratch.keep(grouped.applyInPandas(_verify(width, least), "u binary, v binary"), name)

    links = verified(families.where(F.col("size") <= block).select("key", "family"), "links")
    if some_big:
        ours = scratch.keep(member.join(families.where(F.col("size") > block), "key").select("band", "key", "n", "family", "size"), "big")
        more = verified(_dealt(ours, block), "dealt")
        more = more.unionByName(verified(_led(ours, _roots(scratch, more), block), "led"))
        roots = _roots(scratch, more)
        scopes = scratch.keep(_scopes(scratch, ours, roots, small_bucket, block), "scopes")
        left = verified(_mixed(scopes), "mixed")
        whole = scopes.where("not by_band").select("key").distinct()
        near = near.join(big.withColumnRenamed("key", "u"), "u", "left_semi").join(whole.withColumnRenamed("key", "u"), "u", "left_anti")
        links = links.unionByName(more).unionByName(left).unionByName(verified(_across(near, roots), "pairs"))
    classes = components(scratch, links)

    named = own.select("doc_id", "row", "key").join(classes.select(F.col("node").alias("key"), "root"), "key", "left")
    named = scratch.keep(named.select("doc_id", "row", F.coalesce("root", "key").alias("root")), "named")
    of_class = F.count("*").alias("class_size"), F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")
    out = with_groups(named, ["root"], "row", *of_class)
    return own, out.select("row", "doc_id", F.col("x.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("x.row")).alias("keep"))


def _roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    return components(scratch, links).select(F.col("node").alias("key"), "root")


def _dealt(member: DataFrame, block: int) -> DataFrame:
    """Units of about `block` texts of a family, dealt at random, twice over."""
    keys = member.select("family", "size", "key").distinct()
    units = F.ceil(F.col("size") / F.lit(float(block))).cast("int")
    rounds = F.explode(F.array(*(F.struct(F.lit(k).alias("b"), F.pmod(F.xxhash64("key", F.lit(k)), units).cast("int").alias("a")) for k in (0, 1))))
    return keys.select("key", "family", F.col("family").alias("of"), rounds.alias("x")).select("key", "family", "of", "x.a", "x.b")


def _led(member: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Units of each family's leader, the text of the most shared places, and about `block` texts of other components."""
    keys = member.groupBy("family", "size", "key").agg(F.sum("n").alias("shared")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    led = with_groups(keys, ["family"], "key", F.max_by(F.struct("key", "root"), F.struct("shared", "key")).alias("of"))
    led = led.withColumn("a", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / F.lit(float(block)))).cast("int"))
    others = led.where(F.col("root") != F.col("of.root")).select("key", "family", F.col("of.key").alias("of"), "a")
    leaders = others.select(F.col("of").alias("key"), "family", "of", "a").distinct()
    return others.unionByName(leaders).withColumn("b", F.lit(0))


def _across(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Units of the likely pairs (u, v) whose texts are in different components."""
    named = lambda k, r: roots.select(F.col("key").alias(k), F.col("root").alias(r))
    pairs = near.join(named("u", "ru"), "u", "left").join(named("v", "rv"), "v", "left")
    pairs = pairs.where(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
    return pairs.select(F.concat("u", "v").alias("family"), F.explode(F.array("u", "v")).alias("key"))


def _scopes(scratch: Scratch, member: DataFrame, roots: DataFrame, small_bucket: int, block: int) -> DataFrame:
    """(scope, key, root, major, minors, majors, by_band): the texts of every large bucket, or else of a whole family,
    that holds several components, its largest one, and the numbers of blocks of the texts outside that and in it. Of a
    family and its buckets that is taken which has fewer texts to send."""
    half = float(block)
    own = scratch.keep(member.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).select("family", "band", "n", "key", "root"), "rooted")
    bands = own.where(F.col("n") > small_bucket).select("family", F.col("band").cast("string").cast("binary").alias("scope"), "key", "root", F.lit(True).alias("by_band"))
    wholes = own.select("family", F.col("family").alias("scope"), "key", "root", F.lit(False).alias("by_band")).distinct()
    rows = bands.unionByName(wholes)
    each = rows.groupBy("family", "by_band", "scope", "root").agg(F.count("*").alias("c"))
    figures = each.groupBy("family", "by_band", "scope").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("all"))
    figures = figures.withColumn("minors", F.ceil((F.col("all") - F.col("most")) / half).cast("int")).withColumn("majors", F.ceil(F.col("most") / half).cast("int"))
    sent = F.col("most") * F.col("minors") + (F.col("all") - F.col("most")) * (F.col("majors") + F.col("minors"))
    figures = scratch.keep(figures.where("minors > 0").withColumn("sent", sent), "figures")
    costs = figures.groupBy("family").agg(F.sum(F.when(F.col("by_band"), F.col("sent"))).alias("banded"), F.sum(F.when(~F.col("by_band"), F.col("sent"))).alias("whole"))
    taken = figures.join(costs.select("family", (F.coalesce("banded", F.lit(0)) <= F.col("whole")).alias("take")), "family").where("take = by_band")
    # only these scopes are joined to their texts, each in all parts, so that no large one comes together in a task
    taken = taken.select("scope", "by_band", "major", "minors", "majors").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.drop("family").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).join(taken, ["scope", "by_band", "part"]).drop("part")


def _mixed(scopes: DataFrame) -> DataFrame:
    """Units of the texts of scopes: those outside the largest component meet all others, in units of two blocks."""
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    major = scopes.where("root = major").select("scope", "key", F.explode(to("minors")).alias("a"), dealt("majors").alias("b"))
    minor = scopes.where("root <> major").withColumn("at", dealt("minors"))
    against = minor.select("scope", "key", F.col("at").alias("a"), F.explode(to("majors")).alias("b"))
    among = minor.select("scope", "key", "at", F.explode(to("minors")).alias("other")).select("scope", "key", F.least("at", "other").alias("a"), (-1 - F.greatest("at", "other")).alias("b"))
    rows = major.unionByName(against).unionByName(among)
    return rows.select("key", F.col("scope").alias("family"), F.col("scope").alias("of"), "a", "b")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
SQL: dict[str, str] = {}
