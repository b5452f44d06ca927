"""Toxic passages by maximum-scoring segments over token log-odds.

A token's score is its log-odds of standing in a toxic rather than a clean document, from token counts under a chain of
Dirichlet priors: the corpus rate is the prior of a word's first letters, these of more letters, and those of the word,
so that unseen inflections of a toxic stem count. Evidence for either side counts; a token without clear evidence costs
a small drift. A linear-time scan finds every maximal scoring segment of a text. The best segment of a clean text of n
tokens has an extreme-value distribution, P(S >= s) = 1 - exp(-K n exp(-lambda s)): lambda solves the moment equation
of the token scores of clean texts, K is the maximum-likelihood value over their best segments. A segment's E-value is
K n exp(-lambda s); only segments at or below a level are passages. A logistic fit on the calibrated scores gives the
probability. The strength of the priors and the drift are chosen by cross-validation, and every figure that the
calibration and the logistic fit see comes from a model that was learnt without the text's own fold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, table

#: Labelled rows that the model is fitted on, at most; of more, a sample by hash. A documented bound.
FIT_ROWS = 20_000
STEMS = (3, 4, 5, 6, 7)
#: Folds of the cross-validation, and what it chooses from: strengths of the priors (in tokens) and drifts.
FOLDS, PRIORS, DRIFTS = 5, (30.0, 100.0), (0.01, 0.03, 0.1)
#: Log-odds nearer to 0 than this are no evidence; features of fewer labelled documents or tokens aren't learnt; a passage is
#: significant if at most so many as good are expected in a clean text of the same length.
LEAST_ODDS, LEAST_DOCS, LEAST_TOKENS, LEVEL = 1.0, 3, 10, 0.05
#: Words that a task remembers the scores of, for each model.
MEMO = 50_000
#: Rates at which the moments of token scores are summed.
RATES = np.geomspace(0.05, 8.0, 60)
WORD = re.compile(r"[^\W\d_]+")


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text, where token i of hits (in order) scores
    as given, for or against, and all others minus drift. Linear time: a candidate is merged with the last earlier one
    that begins lower, until none does."""
    held: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, at = 0.0, 0
    for i, s in hits:
        total -= drift * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        first, before = i, total
        total += s
        after, last = total, i
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= before:
                k -= 1
            if k < 0 or held[k][3] >= after:
                held.append((first, last, before, after))
                break
            first, before = held[k][0], held[k][2]
            del held[k:]
    return [(a, b, y - x) for a, b, x, y in held]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stems(word: str) -> list[str]:
    return [f"{k}:{word[:k]}" for k in STEMS if len(word) > k]


def above(feature: str) -> list[str]:
    """The stems of a feature, longest first: the rate of the first that is learnt is the prior of this one's."""
    kind, word = feature.split(":", 1)
    return [f"{k}:{word[:k]}" for k in reversed(STEMS) if k < (len(word) if kind == "w" else int(kind))]


@dataclass
class Words:
    """Scores of words: those of features with evidence, and zeros where a feature has less than its stem."""

    scores: dict[str, float] = field(default_factory=dict)

    def odds(self, word: str) -> float:
        """Of a lower-case word: the score of the longest feature of it that has one."""
        for f in (f"w:{word}", *reversed(stems(word))):
            if (s := self.scores.get(f)) is not None:
                return s
        return 0.0

    def hits(self, words: list[str], memo: dict[str, float]) -> list[tuple[int, float]]:
        """(place, score) of the words with a score. memo belongs to the caller's task and goes with it: what a
        broadcast value gathers stays with the worker."""
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = self.odds(w)
        return [(i, s) for i, w in enumerate(words) if (s := memo[w])]


@dataclass
class Model:
    words: Words = field(default_factory=Words)
    prior: float = PRIORS[0]
    drift: float = DRIFTS[0]
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    weights: tuple[float, ...] = (-30.0, 0.0, 0.0)

    def log_expected(self, score: float, tokens: int) -> float:
        """The logarithm of the E-value of a segment of a text of so many tokens."""
        return float(np.log(self.size * max(1, tokens)) - self.rate * score)

    def probability(self, found: list[tuple[int, int, float]], tokens: int) -> float:
        best, total = max((s for *_, s in found), default=0.0), sum(s for *_, s in found)
        z = float(np.dot(self.weights, [1.0, *_inputs(np.array([best]), np.array([total]), np.array([tokens]), self.rate, self.size)[0]]))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _inputs(best: np.ndarray, total: np.ndarray, tokens: np.ndarray, rate: float, size: float) -> np.ndarray:
    """What the logistic fit sees: minus the logarithm of the best E-value, and the size of all segments."""
    calibrated = rate * best - np.log(size * np.maximum(1, tokens))
    return np.c_[np.clip(calibrated, -10, 30) / 10, np.log1p(total)]


def _features(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(text, toxic, fold) -> (feature, n, and t0, c0, t1 ...: its tokens in toxic and clean documents of each fold) of
    the features of LEAST_DOCS documents and LEAST_TOKENS tokens or more, summed within batches first. Others stay near
    the rate of their stem, which stands for them; which they are doesn't depend on labels. Beside them the tokens of
    all words, by fold and kind."""
    schema = pa.schema([("feature", pa.string()), ("fold", pa.int32()), ("t", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of few rows at a time, since the features of a batch are many times its texts
        for b in (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200)):
            tokens: dict[tuple[int, int], Counter] = {(f, k): Counter() for f in range(FOLDS) for k in (0, 1)}
            held: dict[int, Counter] = {f: Counter() for f in range(FOLDS)}
            for text, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                own: Counter = Counter()
                for w, k in Counter(words_of(text)).items():
                    for f in (f"w:{w}", *stems(w)):
                        own[f] += k
                tokens[fold, toxic].update(own)
                held[fold].update(own.keys())
            for fold, seen in held.items():
                names = list(seen)
                yield pa.RecordBatch.from_pydict({"feature": names, "fold": [fold] * len(names), "t": [tokens[fold, 1][n] for n in names], "c": [tokens[fold, 0][n] for n in names], "n": [seen[n] for n in names]}, schema=schema)

    found = docs.select("text", "toxic", "fold").mapInArrow(run, "feature string, fold int, t long, c long, n long")
    each = [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(x))), F.lit(0)).alias(f"{x}{k}") for k in range(FOLDS) for x in ("t", "c")]
    sums = found.groupBy("feature").agg(F.sum("n").alias("n"), *each).where(F.col("n") >= LEAST_DOCS)
    sums = Scratch(docs.sparkSession, "features").keep(sums, "features")
    totals = sums.where(F.col("feature").startswith("w:")).agg(*(F.sum(f"{x}{k}") for k in range(FOLDS) for x in ("t", "c"))).first()
    totals = np.array([v or 0 for v in totals], dtype=np.float64).reshape(FOLDS, 2)
    return sums.where(" + ".join(f"{x}{k}" for k in range(FOLDS) for x in ("t", "c")) + f" >= {LEAST_TOKENS}"), totals


def _levels(features: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, the longest learnt stems of each) by number, level by level; -1 stands for the corpus rate."""
    at = {f: i for i, f in enumerate(features)}
    parent = np.array([next((at[p] for p in above(f) if p in at), -1) for f in features], dtype=np.int64)
    depth = np.array([99 if f[0] == "w" else int(f[0]) for f in features])
    return [(rows, parent[rows]) for k in (*STEMS, 99) if len(rows := np.flatnonzero(depth == k))]


def learn(features: list[str], levels: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, clean: np.ndarray, totals: np.ndarray, prior: float) -> Words:
    """The word scores from token counts of features in toxic and clean documents, and the tokens of all words in
    each."""
    if not totals[0] or not totals[1]:
        return Words()
    base = float(totals[0] / totals.sum())
    p, held = np.empty(len(features) + 1), np.zeros(len(features) + 1)  # the last place is that of the corpus rate
    p[-1], scores = base, {}
    for rows, above in levels:
        p[rows] = (toxic[rows] + prior * p[above]) / (toxic[rows] + clean[rows] + prior)
        odds = np.log(p[rows] / (1 - p[rows])) - np.log(base / (1 - base))
        odds[np.abs(odds) < LEAST_ODDS] = 0.0
        held[rows] = odds
        for i in np.flatnonzero((odds != 0) | (held[above] != 0)).tolist():
            scores[features[rows[i]]] = float(odds[i])
    return Words(scores)


def _rate(moments: np.ndarray, tokens: float, hits: float, drift: float) -> float:
    """lambda > 0 with mean exp(lambda s) = 1 over tokens of clean texts, from the sums of exp(lambda s) over their
    hits at RATES; between these, linear in the logarithm."""
    if not tokens:
        return 1.0
    value = np.log(np.maximum(moments + (tokens - hits) * np.exp(-RATES * drift), 1e-300) / tokens)
    above = np.flatnonzero(value > 0)
    if not len(above):
        return float(RATES[-1])
    k = int(above[0])
    if k == 0:
        return float(RATES[0])
    return float(RATES[k - 1] + (RATES[k] - RATES[k - 1]) * value[k - 1] / (value[k - 1] - value[k]))


def _size(best: np.ndarray, tokens: np.ndarray, rate: float) -> float:
    """K by maximum likelihood over the best segments of clean texts; a text without one is censored at the least
    score that a segment can have."""
    seen = (best > 0).sum()
    return float(max(seen, 0.5) / max(1e-9, (np.maximum(1, tokens) * np.exp(-rate * np.maximum(best, LEAST_ODDS))).sum()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-1) -> tuple[float, ...]:
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _loss(x: np.ndarray, y: np.ndarray, weights: tuple[float, ...]) -> float:
    z = np.c_[np.ones(len(x)), x] @ np.array(weights)
    return float(np.mean(np.log1p(np.exp(np.clip(np.where(y == 1, -z, z), -50, 50)))))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from docs (doc_id, text; other columns are ignored) and labels (doc_id, toxic), on at most about
    fit_rows labelled documents.

    Labels that are null, or of a document that isn't there, don't count, nor do null texts. Equal texts count once,
    toxic if any of them is; so do repeated labels. Whole texts are read, however long. Empty tables, or labels of one
    kind only, give a model that scores everything near 0.
    """
    labels = labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = labels.count()
    if n > fit_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    own = docs.select("doc_id", "text").where("text is not null").join(labels, "doc_id")
    own = own.groupBy(F.md5("text").alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    scratch = Scratch(spark, "toxicity")
    own = scratch.keep(own.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")), "sample")
    toxic, clean = own.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not toxic or not clean:
        return Model()
    table_, totals = _features(own)
    counts = table_.toArrow()  # of the bounded sample, the features of several documents
    features = counts.column("feature").to_pylist()
    t, c = (np.stack([counts.column(f"{x}{k}").to_numpy().astype(np.float64) for k in range(FOLDS)], axis=1) for x in ("t", "c"))
    del counts
    levels = _levels(features)
    without = lambda x, k: x.sum(axis=1) - x[:, k]
    folds = [[learn(features, levels, without(t, k), without(c, k), totals.sum(axis=0) - totals[k], prior) for k in range(FOLDS)] for prior in PRIORS]
    sent = spark.sparkContext.broadcast(folds)
    tried = [(p, d) for p in range(len(PRIORS)) for d in range(len(DRIFTS))]
    schema = pa.schema([("toxic", pa.int32()), ("tokens", pa.int64()), ("best", pa.list_(pa.float64())), ("total", pa.list_(pa.float64())), ("hits", pa.list_(pa.int64())), ("moments", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            memos: list[list[dict]] = [[{} for _ in range(FOLDS)] for _ in PRIORS]
            moments, hit = np.zeros((len(PRIORS), len(RATES))), np.zeros(len(PRIORS), dtype=np.int64)
            for text, label, fold in zip(*(b.column(x).to_pylist() for x in ("text", "toxic", "fold")), strict=True):
                w, best, total = words_of(text), [], []
                for p in range(len(PRIORS)):
                    hits = sent.value[p][fold].hits(w, memos[p][fold])
                    if not label and hits:
                        moments[p] += np.exp(np.outer([s for _, s in hits], RATES)).sum(axis=0)
                        hit[p] += len(hits)
                    for drift in DRIFTS:
                        found = [s for *_, s in segments(hits, drift)]
                        best.append(max(found, default=0.0))
                        total.append(sum(found))
                for name, v in zip(rows, (label, len(w), best, total, None, None), strict=True):
                    rows[name].append(v)
            if rows["toxic"]:  # the sums of the batch stand in its first row
                rows["hits"][0], rows["moments"][0] = hit.tolist(), moments.ravel().tolist()
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    seen = own.mapInArrow(measure, "toxic int, tokens long, best array<double>, total array<double>, hits array<long>, moments array<double>").toPandas()
    scratch.drop(own)
    y, tokens = seen["toxic"].to_numpy(), seen["tokens"].to_numpy()
    best, total = np.stack(seen["best"].to_numpy()), np.stack(seen["total"].to_numpy())
    hits, moments = (np.stack(seen[x].dropna().to_numpy()).sum(axis=0) for x in ("hits", "moments"))
    moments, clean_tokens = moments.reshape(len(PRIORS), len(RATES)), float(tokens[y == 0].sum())
    models = []
    for k, (p, d) in enumerate(tried):
        rate = _rate(moments[p], clean_tokens, float(hits[p]), DRIFTS[d])
        size = _size(best[y == 0, k], tokens[y == 0], rate)
        x = _inputs(best[:, k], total[:, k], tokens, rate, size)
        weights = _logistic(x, y)
        models.append((_loss(x, y, weights), k, Model(Words(), PRIORS[p], DRIFTS[d], rate, size, weights)))
    model = min(models, key=lambda m: m[:2])[2]
    model.words = learn(features, levels, t.sum(axis=1), c.sum(axis=1), totals.sum(axis=0), model.prior)
    return model


FOUND = "score double, tokens long, passages array<struct<start:int,end:int,score:double,expected:double>>"
PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def score(spark: SparkSession, docs: DataFrame, model: Model, level: float = LEVEL) -> DataFrame:
    """docs with `score` (0 to 1), `tokens` and `passages` (code points, end exclusive, score, and E-value) of the
    whole text: the segments whose E-value is at most `level`.

    All columns stay; columns of these three names are replaced. Null and empty texts have no passages and the score
    of a text without a segment. Equal texts have equal scores; repeated rows each get a row; an empty table gives an
    empty result.
    """
    docs = docs.drop("score", "tokens", "passages")
    sent = spark.sparkContext.broadcast(model)
    out = StructType(docs.schema.fields + StructType.fromDDL(FOUND).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, most, memo = sent.value, float(np.log(level)), {}
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                b = whole.slice(begin, 1000)
                scores, counts, passages = [], [], []
                for text in b.column("text").to_pylist():
                    low = (text or "").lower()
                    words = WORD.findall(low)
                    found = segments(m.words.hits(words, memo), m.drift)
                    scores.append(m.probability(found, len(words)))
                    counts.append(len(words))
                    found = [(a, z, s, e) for a, z, s in found if (e := m.log_expected(s, len(words))) <= most]
                    if found:
                        if len(low) != len(text):  # a character whose lower case is longer: take places from the text
                            spots = [x.span() for x in WORD.finditer(text)]
                            spots = spots if len(spots) == len(words) else [x.span() for x in WORD.finditer(low)]
                        else:
                            spots = [x.span() for x in WORD.finditer(low)]
                    passages.append([{"start": spots[a][0], "end": spots[z][1], "score": s, "expected": float(np.exp(e))} for a, z, s, e in found])
                added = [pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(passages, PASSAGES)]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "score", "tokens", "passages"])

    return docs.mapInArrow(run, out)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    scored = score(spark, docs, fit(spark, docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
