"""BPE encoding and decoding with a lexicon of frequent words.

Words are counted over all documents; the most frequent ones and their ids are compiled into a minimal acyclic transducer,
a file that every executor fetches once and its workers map into memory. A text is cut into words as its tokenizer cuts it,
words of the lexicon get their ids from the transducer, and the others are merged exactly, rule by rule. So the lexicon
decides the time, never the ids.
"""

from __future__ import annotations

import collections
import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .alignment import byte_of
from .common import Scratch, ship, table
from .transducer import Ids, Transducer, compiled

#: Words of the lexicon at most, and the bytes of the longest word in it. What it leaves out is merged.
LEXICON, LONGEST = 1 << 17, 64
#: Words whose ids a task remembers.
REMEMBERED = 1 << 18
#: Words of up to this many bytes are merged without a heap; the rank of pairs that no merge joins.
SHORT, NONE = 64, 1 << 30
#: Bits of an id.
WIDTH = 24


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of these characters alone are cut here, with a pattern of explicit classes; the tokenizer itself cuts the others.
#: They are composed and stay among themselves in lower case, but for the one left out.
_PLAIN = "\x00-įı-ſ"


class Tokenizer:
    """A word-level BPE tokenizer file: how it cuts texts, its merges, its tokens. Plain Python but for the cut of texts
    outside _PLAIN, for which the library's own normaliser and pre-tokenizer are called."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        model = loaded["model"]
        self.library, self.suffix, self.vocabulary = Library.from_file(path), model["end_of_word_suffix"], model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [self.vocabulary[a + b] for a, b in merges]
        self.ranks = {self.vocabulary[a] << WIDTH | self.vocabulary[b]: k for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocabulary | self.special).items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._other = re.compile(f"[^{_PLAIN}]")
        self._inner, self._last = ({b: self.vocabulary[c + end] for c, b in byte_of().items()} for end in ("", self.suffix))
        kinds: dict[str, str] = {}
        for c in map(chr, range(0x180)):
            kinds[kind] = kinds.get(kind := unicodedata.category(c)[0], "") + c
        letters, numbers = re.escape(kinds["L"]), re.escape(kinds["N"])
        spaces = r"\t-\r \x85\xa0"
        # fixed value: the contractions of the tokenizer's pattern
        self._words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")

    def words(self, text: str) -> list[str]:
        """The words of a text in order, normalised; the strings of special tokens stand for themselves."""
        out: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(part)
            elif self._other.search(part) is None:
                out += self._words.findall(part.lower())
            else:
                normal = self.library.normalizer.normalize_str(part)
                out += [normal[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def merge(self, word: str) -> Ids:
        """The ids of a word by its merges: of the pair of least rank, the first in the word, until none is left."""
        if word in self.special:
            return (self.special[word],)
        raw = word.encode()
        parts = [*map(self._inner.__getitem__, raw[:-1]), self._last[raw[-1]]]
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> Ids:
        """Of few parts the least rank is found by going through all."""
        rank, made = self.ranks.get, self.made
        ranks = [rank(a << WIDTH | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << WIDTH | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << WIDTH | parts[i + 1], NONE)
        return tuple(parts)

    def _long(self, parts: list[int]) -> Ids:
        """Of many parts, a heap holds the pairs that can be merged; those that have gone since are passed over."""
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        ranks, heap = self.ranks, []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (rank := ranks.get(parts[i] << WIDTH | parts[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(p for p in parts if p >= 0)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


@lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    return Transducer(SparkFiles.get(name))


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n) over all texts, special tokens left out; combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = tokenizer(vocabulary), collections.Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held, pa.string()), "n": pa.array(held.values(), pa.int64())})

        for b in batches:
            for text in b.column("text").to_pylist():
                held.update(own.words(text or ""))
                if len(held) > REMEMBERED:
                    yield rows()
                    held.clear()
        yield rows()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def build(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, size: int = LEXICON) -> str:
    """Compiles the lexicon of docs (text) and hands it to the executors; the name of its file among SparkFiles.

    It holds words of up to LONGEST bytes from some count on, the least that lets in no more than `size` words, so that
    what comes to the driver is bounded whatever the documents; counts are over all of them. Null texts count as empty;
    an empty table gives an empty lexicon, with which every word is merged.
    """
    ship(spark)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for b in batches:
            words = b.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array([list(own.merge(w)) for w in words.to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    # counts fall into 64 steps for each doubling, some thousand in all
    counts = word_counts(docs, vocabulary).where(F.octet_length("word") <= LONGEST).withColumn("step", F.floor(64 * F.log2("n")))
    counts, border, room = Scratch(spark, "lexicon").keep(counts, "counts"), 1 << 62, size
    for step, n in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        if n > room:
            break
        border, room = step, room - n
    often = counts.where(F.col("step") >= border)
    rows = sorted((r.word.encode(), tuple(r.ids)) for r in often.mapInArrow(run, "word string, ids array<int>").toLocalIterator())
    raw = compiled(rows)
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{hashlib.sha256(raw).hexdigest()[:16]}.bin")
    with open(path, "wb") as file:
        file.write(raw)
    name = os.path.basename(path)
    if name not in map(os.path.basename, spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


ENCODED = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _each(docs: DataFrame, vocabulary: str, lexicon: str, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fast, ids_of, tokens_of = tokenizer(vocabulary), transducer(lexicon), {}, {}
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            at = 0
            while at < len(ids):  # slices of bounded text
                size, end = 0, at
                while end < len(ids) and (end == at or size < 1 << 22):
                    size += len(texts[end].as_py() or "")
                    end += 1
                cut = [own.words(t or "") for t in texts[at:end].to_pylist()]
                if len(ids_of) > REMEMBERED:
                    ids_of.clear()
                    tokens_of.clear()
                new = list({w for words in cut for w in words if w not in ids_of})
                for w, found in zip(new, fast.look_up([w.encode() for w in new]), strict=True):
                    found = own.merge(w) if found is None else found
                    ids_of[w], tokens_of[w] = " ".join(map(str, found)), " ".join(map(own.tokens.__getitem__, found))
                joined = [(" ".join(map(ids_of.__getitem__, words)), " ".join(map(tokens_of.__getitem__, words))) for words in cut]
                rows = [row(i, *x) for i, x in zip(ids[at:end], joined, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                at = end

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _encoded(doc_id: int | None, ids: str, decoded: str) -> dict:
    return {"doc_id": doc_id, "ids": [int(i) for i in ids.split()], "decoded": decoded}


def _digests(doc_id: int | None, ids: str, decoded: str) -> dict:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {"doc_id": doc_id, "n_tokens": ids.count(" ") + bool(ids), "ids_sha256": sha(ids), "decoded_sha256": sha(decoded)}


def encode(docs: DataFrame, lexicon: str, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text) encoded: doc_id, ids, and decoded, the tokens of the ids with a space between (the tokenizer has
    no decoder of its own, so the marks of word ends and of bytes stay).

    The strings of special tokens in a text are these tokens. A null text counts as empty and has no ids; whole texts
    are read; every row has a row, repeated ones and null doc_ids too; other columns are ignored; an empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    return _each(docs, vocabulary or default_vocabulary(), lexicon, ENCODED, _encoded)


def digests(docs: DataFrame, lexicon: str, vocabulary: str | None = None) -> DataFrame:
    """What encode gives, as doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256."""
    ship(docs.sparkSession)
    return _each(docs, vocabulary or default_vocabulary(), lexicon, DIGEST, _digests)


def op12_word_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, build(spark, docs, vocabulary), vocabulary)


QUERIES = {"op12_word_bpe": op12_word_bpe}
SQL: dict[str, str] = {}
