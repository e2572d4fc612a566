"""Language identification with unigram pieces, marginalised over segmentations.

The pieces are those of a fixed public vocabulary. A word's probability in a language is the sum over all ways to
cut it into pieces, which a forward pass over its characters gives; piece probabilities are learned by
expectation maximisation with forward and backward sums. Pieces never cross words, so a text's
likelihood is the product over its words and each distinct word is summed once per batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table
from rxloom.session import materialise

#: Training documents per language, chosen by a hash of their id; the bound of the sample.
TRAINING_DOCS = 400
HASHES = 1 << 30
ROUNDS = 3
#: Words are summed in parts of at most so many characters, so that probabilities stay in range.
PART = 20
#: Weight, in pieces, of the all-language distribution in each language's.
PRIOR = 1000.0
#: Words remembered by a task, and documents whose words it looks up together.
CACHE_WORDS = 300_000
DOCS_AT_ONCE = 500
#: Letters and other numbers; words with such numbers are cut down to their letters.
WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
START = "▁"


class Pieces:
    """The vocabulary as a trie in one table, so that a batch of words walks it together.

    Node 0 is dead and node 1 the root. `ends` gives the piece that ends at a node, or -1; a single character that
    is no piece counts as the unknown piece, the last number.
    """

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ordinary = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                    if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        names = sorted({p.lower() for p in ordinary if p.strip(START) == "" or any(c.isalpha() for c in p)})
        self.unknown = len(names)
        self.count = len(names) + 1
        self.single = np.full(1 << 16, self.unknown, np.int32)
        self.column = np.zeros(1 << 16, np.int16)
        letters = sorted({c for p in names if len(p) > 1 for c in p if ord(c) < 1 << 16})
        self.column[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for number, name in enumerate(names):
            if len(name) == 1 and ord(name) < 1 << 16:
                self.single[ord(name)] = number
            if len(name) > 1 and all(ord(c) < 1 << 16 for c in name):
                node = 1
                for c in name:
                    node = nodes.setdefault((node, int(self.column[ord(c)])), len(nodes) + 2)
                ends[node] = number
        self.next = np.zeros((len(nodes) + 2, len(letters) + 1), np.int32)
        for (node, column), to in nodes.items():
            self.next[node, column] = to
        self.ends = np.full(len(nodes) + 2, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())

    def spans(self, words: list[str]) -> list[tuple[int, int, np.ndarray | slice, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in words of one length, by start."""
        n = len(words[0])
        points = np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n), (1 << 16) - 1)
        columns, single = self.column[points], self.single[points]
        out: list[tuple[int, int, np.ndarray | slice, np.ndarray]] = []
        for start in range(n):
            out.append((start, start + 1, slice(None), single[:, start]))
            rows = np.arange(len(words))
            node = self.next[1, columns[:, start]]
            for end in range(start + 1, n):
                alive = np.flatnonzero(node)
                if not len(alive):
                    break
                rows = rows[alive]
                node = self.next[node[alive], columns[rows, end]]
                found = self.ends[node]
                is_piece = np.flatnonzero(found >= 0)
                if len(is_piece):
                    out.append((start, end + 1, rows[is_piece], found[is_piece]))
        return out


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def parts(word: str) -> list[str]:
    """The letters of a word with a start mark, in parts of bounded length; nothing for a word without letters."""
    out = []
    for x in (word,) if word.isalpha() else LETTERS.findall(word):
        x = START + x
        out.extend([x] if len(x) <= PART else (x[i:i + PART] for i in range(0, len(x), PART)))
    return out


def word_values(words: list[str], vocabulary: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log likelihoods of whole words per language, and a last column that is 1 for words with letters."""
    owner, all_parts = [], []
    for i, w in enumerate(words):
        for x in parts(w):
            owner.append(i)
            all_parts.append(x)
    out = np.zeros((len(words), prob.shape[1] + 1))
    if all_parts:
        np.add.at(out[:, :-1], owner, log_likelihoods(all_parts, vocabulary, prob))
        out[owner, -1] = 1.0
    return out


def same_length(words: list[str], at_once: int) -> Iterator[list[int]]:
    """Places of words of one length, in groups of bounded size."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for places in by_length.values():
        for at in range(0, len(places), at_once):
            yield places[at:at + at_once]


def forward(spans: list[tuple], words: int, n: int, prob: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: summed probability of all segmentations up to each position."""
    alpha = np.zeros((n + 1, words, prob.shape[1]))
    alpha[0] = 1.0
    for start, end, rows, found in spans:
        alpha[end, rows] += alpha[start, rows] * prob[found]
    return alpha


def log_likelihoods(words: list[str], vocabulary: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log of the summed probability of each word per language."""
    out = np.empty((len(words), prob.shape[1]))
    for some in same_length(words, 4096):
        n = len(words[some[0]])
        out[some] = np.log(forward(vocabulary.spans([words[i] for i in some]), len(some), n, prob)[n])
    return out


def expected(words: list[str], weights: np.ndarray, vocabulary: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts per language of words with weights[word, language]."""
    total = np.zeros((vocabulary.count, prob.shape[1]))
    for some in same_length(words, 2048):
        n = len(words[some[0]])
        spans = vocabulary.spans([words[i] for i in some])
        alpha = forward(spans, len(some), n, prob)
        beta = np.zeros_like(alpha)
        beta[n] = 1.0
        scale = weights[some] / alpha[n]
        for start, end, rows, found in reversed(spans):
            ahead = prob[found] * beta[end, rows]
            np.add.at(total, found, alpha[start, rows] * ahead * scale[rows])
            beta[start, rows] += ahead
    return total


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities per language, each mixed with the distribution over all languages."""
    shared = counts.sum(1) + 0.1
    shared /= shared.sum()
    return (counts + PRIOR * shared[:, None]) / (counts.sum(0) + PRIOR)


def held_out(key: str) -> Column:
    """True where crc32 of the id as text is divisible by five, and for ids that are null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_words(df: DataFrame, key: str, text: str, lang: str, docs_per_language: int) -> DataFrame:
    """(lang, word, n) over a bounded sample: of each language about `docs_per_language` training documents by a hash of the id.

    The share to take follows from the number of each language's documents. Those counts are all that is gathered, so
    no texts are shuffled and no language's rows meet in one task.
    """
    usable = df.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    limits = {r["lang"]: docs_per_language * HASHES // r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")] if limits else F.lit(0)
    sample = usable.where(F.pmod(F.xxhash64("key"), F.lit(HASHES)) < limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: Counter = Counter()
            for language, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw.update((language, w) for w in WORD.findall(t.lower()))
            seen: Counter = Counter()
            for (language, w), n in raw.items():
                for x in parts(w):
                    seen[language, x] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                 pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    return sample.select("key", "lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(df: DataFrame, key: str, text: str, lang: str, model: str | None = None,
          docs_per_language: int = TRAINING_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and piece probabilities [piece, language].

    Sums over the sample run in Spark; what reaches the driver is one number per piece and language.
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = pieces(model)
    counted = materialise(training_words(df, key, text, lang, docs_per_language), "words")
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not languages:
        return [], np.ones((vocabulary.count, 0))
    place = {name: i for i, name in enumerate(languages)}
    prob = np.full((vocabulary.count, len(languages)), 1.0 / vocabulary.count)
    for _ in range(rounds):
        sent = df.sparkSession.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(sent.value)
            for b in batches:
                words: dict[str, int] = {}
                rows = [words.setdefault(w, len(words)) for w in b.column(1).to_pylist()]
                weights = np.zeros((len(words), len(place)))
                np.add.at(weights, (rows, [place[x] for x in b.column(0).to_pylist()]), np.asarray(b.column(2)))
                total += expected(list(words), weights, pieces(model), sent.value)
            at, which = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(which), pa.array(total[at, which])], ["piece", "which", "n"])

        sums = counted.mapInArrow(expect, "piece long, which long, n double").groupBy("piece", "which").agg(F.sum("n").alias("n"))
        counts = np.zeros_like(prob)
        for r in sums.toLocalIterator():
            counts[r["piece"], r["which"]] = r["n"]
        prob = smoothed(counts)
        sent.unpersist()
    return languages, prob


def predict(df: DataFrame, text: str, languages: list[str], prob: np.ndarray, model: str | None = None) -> DataFrame:
    """All rows and columns of `df` with `lang_pred` and `score`, the posterior under equal priors.

    Null texts and texts without a letter get `und` and score 0, as does everything where no language was learned.
    """
    taken = {"lang_pred", "score"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns already present: {sorted(taken)}")
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    sent = df.sparkSession.sparkContext.broadcast(prob)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = df.columns.index(text)
    n_lang = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        values = np.zeros((CACHE_WORDS, n_lang + 1))
        for whole in batches:
            for first in range(0, len(whole), DOCS_AT_ONCE):
                b = whole.slice(first, DOCS_AT_ONCE)
                lists = [WORD.findall(t.lower()) if t else [] for t in b.column(at).to_pylist()] if n_lang else [[]] * len(b)
                new = list({w for words in lists for w in words if w not in known})
                if len(known) + len(new) > len(values):
                    known = {}
                    new = list({w for words in lists for w in words})
                    if len(new) > len(values):
                        values = np.zeros((len(new), n_lang + 1))
                if new:
                    values[len(known):len(known) + len(new)] = word_values(new, pieces(model), sent.value)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                names, scores = [], []
                for words in lists:
                    sums = values[[known[w] for w in words]].sum(0) if words else [0.0]
                    if not sums[-1]:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = sums[:-1]
                    best = int(total.argmax())
                    names.append(languages[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 [*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)


@query("op10_unigram_language")
def op10_unigram_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    languages, prob = train(docs, "doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), "text", languages, prob)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
