"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
found by the forward algorithm; a text's is the product over its words. The
piece probabilities come from expectation-maximisation on words of labelled
documents, with expected counts by forward and backward sums.

Training uses at most about ``SAMPLE`` labelled documents of each language,
chosen by a hash of the id among those whose crc32(doc_id) mod 4 is not 2; their
words are counted in Spark and the driver gets one row for each distinct word.
A task scores a word once for each batch of documents, all new words of the
batch together, with one array operation for each piece length and position.

Words are runs of letters in lower case. A character without a piece of its own
has a small fixed probability in every language.

Defined results: a null text and one without letters is ``und`` with score 0,
and so is every text if no language is learned; rows with equal text have equal
results; a null doc_id counts as an empty id text in the split; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.common import crc_mod, documents

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FOLDS, HELD_OUT = 4, 2
SAMPLE = 500
ROUNDS = 3
FLOOR = 1e-7
#: Probability of a character that has no piece.
UNKNOWN = 1e-8
#: Probabilities are raised by this for each character, so that words of up to ``LONG`` characters stay in range.
RAISE, LONG = 1e3, 60
PRIOR = 0.05
#: Scores kept from batch to batch by a task.
CACHE = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
B = np.uint64(0x9E3779B97F4A7C15)
START = "▁"


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces made of letters, in lower case, with or without the mark of a word's start."""
    found = set()
    with open(path, "rb") as lines:
        for line in lines:
            try:
                piece = base64.b64decode(line.split()[0]).decode().lower()
            except UnicodeDecodeError:
                continue
            body = piece.removeprefix(" ")
            if body and all(c.isalpha() for c in body):
                found.add(START + body if body != piece else body)
    return sorted(found | {START})


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words, with the mark of the start, as a zero-padded matrix of code points, and their lengths."""
    n = np.array([len(w) + 1 for w in words])
    out = np.zeros((len(words), int(n.max(initial=1))), np.uint64)
    flat = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


class Lexicon:
    """Pieces by hash of their characters."""

    def __init__(self, names: list[str]):
        keys = np.zeros(len(names), np.uint64)
        with np.errstate(over="ignore"):
            for i, name in enumerate(names):
                for c in name:
                    keys[i] = (keys[i] + np.uint64(ord(c))) * B
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.longest = max(map(len, names))
        # a table of the top 16 bits bounds each search to a few keys
        self.lo = np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.depth = int(np.diff(np.append(self.lo, len(self.keys))).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; -1 for none."""
        at = self.lo[(h >> np.uint64(48)).astype(np.int64)]
        out = np.full(len(h), -1)
        for d in range(self.depth):
            i = np.minimum(at + d, len(self.keys) - 1)
            hit = self.keys[i] == h
            out[hit] = self.ids[i[hit]]
        return out

    def spans(self, words: list[str]):
        """For each end and length, the words and piece numbers found there: (end, length, rows, pieces)."""
        chars, n = codes(words)
        single = np.zeros(chars.shape, bool)
        found = []
        # h[:, t]: hash of the ``length`` characters that end at t
        h = np.zeros_like(chars)
        for length in range(1, min(self.longest, chars.shape[1]) + 1):
            if length > 1:
                before = h
                h = np.zeros_like(chars)
                h[:, 1:] = before[:, :-1]
            h = (h + chars) * B
            valid = (np.arange(chars.shape[1]) >= length - 1) & (np.arange(chars.shape[1]) < n[:, None])
            rows, ends = np.nonzero(valid)
            ids = self.find(h[rows, ends])
            hit = ids >= 0
            rows, ends, ids = rows[hit], ends[hit], ids[hit]
            if length == 1:
                single[rows, ends] = True
            order = np.argsort(ends, kind="stable")
            rows, ends, ids = rows[order], ends[order], ids[order]
            bounds = np.searchsorted(ends, np.arange(chars.shape[1] + 1))
            found.append((length, rows, ids, bounds))
        unknown = ~single & (np.arange(chars.shape[1]) < n[:, None])
        return n, chars.shape[1], found, unknown


def forward(n, width, found, unknown, p: np.ndarray, raised: float = 1.0) -> np.ndarray:
    """alpha[t] of every word and language, for t characters read, times ``raised`` to the power t."""
    alpha = np.zeros((width + 1, len(n), p.shape[1]))
    alpha[0] = 1.0
    for t in range(width):
        a = alpha[t + 1]
        for length, rows, ids, bounds in found:
            lo, hi = bounds[t], bounds[t + 1]
            if hi > lo:
                r = rows[lo:hi]
                a[r] += alpha[t + 1 - length][r] * (p[ids[lo:hi]] * raised**length)
        u = np.flatnonzero(unknown[:, t])
        a[u] += alpha[t][u] * (UNKNOWN * raised)
    return alpha


def log_probs(lexicon: Lexicon, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log of each word's probability in each language, all segmentations summed."""
    out = np.zeros((len(words), p.shape[1]))
    # words of like length together, so that padding stays small
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = [i for i in order if len(words[i]) <= LONG]
    for lo in range(0, len(short), 20_000):
        part = short[lo : lo + 20_000]
        n, *rest = lexicon.spans([words[i] for i in part])
        alpha = forward(n, *rest, p, RAISE)
        out[part] = np.log(np.maximum(alpha[n, np.arange(len(part))], 1e-300)) - (n * math.log(RAISE))[:, None]
    for i in order[len(short) :]:  # very long words one by one
        out[i] = _long(lexicon, p, words[i])
    return out


def _long(lexicon: Lexicon, p: np.ndarray, word: str) -> np.ndarray:
    """As log_probs, rescaled at each character, since a long word's probability underflows."""
    return _scaled(lexicon.spans([word]), p)[1][-1]


def _scaled(spans: tuple, p: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One word's forward (or backward) sums, each scaled to one, and the logs of their scales, by position."""
    _, width, found, unknown = spans
    sums, logs = np.ones((width + 1, p.shape[1])), np.zeros((width + 1, p.shape[1]))
    steps = range(width - 1, -1, -1) if back else range(1, width + 1)
    ending = [(length, ids, bounds) for length, _, ids, bounds in found]
    for t in steps:
        near = t + 1 if back else t - 1
        a = np.zeros(p.shape[1])
        for length, ids, bounds in ending:
            end, other = (t + length, t + length) if back else (t, t - length)
            if end <= width and bounds[end] > bounds[end - 1]:
                a += sums[other] * np.exp(logs[other] - logs[near]) * p[ids[bounds[end - 1]]]
        if unknown[0, min(t, near)]:
            a += sums[near] * UNKNOWN
        # a position that no piece reaches has no sums
        logs[t] = logs[near] + np.log(np.maximum(a, 1e-300))
        sums[t] = a / np.maximum(a, 1e-300)
    return sums, logs


def _expect_long(lexicon: Lexicon, p: np.ndarray, word: str, weight: np.ndarray, expected: np.ndarray) -> None:
    """Add a long word's expected piece counts."""
    spans = lexicon.spans([word])
    _, width, found, _ = spans
    (alpha, up), (beta, down) = _scaled(spans, p), _scaled(spans, p, back=True)
    for length, _, ids, bounds in found:
        ends = np.flatnonzero(np.diff(bounds)) + 1
        log = np.minimum(up[ends - length] + down[ends] - up[width], 700)
        gamma = alpha[ends - length] * beta[ends] * p[ids] * np.exp(log) * weight
        np.add.at(expected, ids, gamma)


def fit(lexicon: Lexicon, n_pieces: int, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of each language by expectation-maximisation; counts is words x languages."""
    p = np.full((n_pieces, counts.shape[1]), 1.0 / n_pieces)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = [i for i in order if len(words[i]) <= LONG]
    for _ in range(rounds):
        expected = np.zeros_like(p)
        for i in order[len(short) :]:
            _expect_long(lexicon, p, words[i], counts[i], expected)
        for lo in range(0, len(short), 20_000):
            part = short[lo : lo + 20_000]
            n, width, found, unknown = lexicon.spans([words[i] for i in part])
            alpha = forward(n, width, found, unknown, p, RAISE)
            beta = np.zeros_like(alpha)
            beta[n, np.arange(len(n))] = 1.0
            for t in range(width, 0, -1):
                for length, rows, ids, bounds in found:
                    lo_, hi_ = bounds[t - 1], bounds[t]
                    if hi_ > lo_:
                        r = rows[lo_:hi_]
                        beta[t - length][r] += beta[t][r] * (p[ids[lo_:hi_]] * RAISE**length)
                u = np.flatnonzero(unknown[:, t - 1])
                beta[t - 1][u] += beta[t][u] * (UNKNOWN * RAISE)
            weight = counts[part] / np.maximum(beta[0], 1e-300)
            for length, rows, ids, bounds in found:
                ends = np.repeat(np.arange(width), np.diff(bounds)) + 1
                gamma = alpha[ends - length, rows] * (p[ids] * RAISE**length) * beta[ends, rows] * weight[rows]
                for k in range(p.shape[1]):
                    expected[:, k] += np.bincount(ids, gamma[:, k], n_pieces)
        total = expected.sum(axis=0)
        p = np.maximum((expected + PRIOR) / (total + PRIOR * n_pieces), FLOOR)
        p /= p.sum(axis=0)
    return p


def sample_words(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(languages, words, counts, labelled documents of each language) of the bounded sample."""
    labelled = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return [], [], np.zeros((0, 0)), np.zeros(0)
    rank = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    # each language takes the share of ids that gives ``sample`` documents on average
    share = F.map_from_arrays(F.array(*map(F.lit, totals)), F.array(*[F.lit(int(min(1.0, sample / n) * (1 << 30))) for n in totals.values()]))
    chosen = labelled.filter(rank < F.element_at(share, F.col("lang")))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), 1)).alias("word")
    rows = chosen.select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    names = sorted(totals)
    words, at = np.unique(np.array(rows["word"].to_pylist(), object).astype(str), return_inverse=True) if len(rows) else (np.array([], str), np.array([], int))
    counts = np.zeros((len(words), len(names)))
    lang = np.array([names.index(x) for x in rows["lang"].to_pylist()], int)
    np.add.at(counts, (at, lang), rows["n"].to_numpy())
    return names, words.tolist(), counts, np.array([totals[x] for x in names], float)


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(languages, pieces, piece probabilities, log priors)."""
    names, words, counts, totals = sample_words(docs, sample)
    listed = pieces(vocabulary)
    p = fit(Lexicon(listed), len(listed), words, counts) if names else np.zeros((len(listed), 0))
    return names, listed, p, np.log(totals / totals.sum()) if names else totals


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from texts only; these replace columns of their names."""
    names, listed, p, prior = model
    rows = docs.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((listed, p))  # the vocabulary times the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, p = shared.value
        lexicon, known, table = Lexicon(listed), {}, np.zeros((0, p.shape[1]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                found = [word_list(t) for t in b.column("text").to_pylist()]
                if len(known) > CACHE:
                    known, table = {}, table[:0]
                fresh = list({w for ws in found for w in ws if w not in known})
                if fresh and names:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    table = np.concatenate([table, log_probs(lexicon, p, fresh)])
                langs, scores = [], []
                for ws in found:
                    if not ws or not names:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    total = table[[known[w] for w in ws]].sum(axis=0) + prior
                    best = int(total.argmax())
                    langs.append(names[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def word_list(text: str | None) -> list[str]:
    """Runs of letters in lower case; fractions and the like, neither digits nor letters, make no word."""
    return [w for w in LETTERS.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))] if text else []


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict the language of every row."""
    return predict(docs, train(docs, vocabulary, sample))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` whose language is known with a score of ``least``; their ``lang`` is the prediction."""
    names = {c: f"_kept_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = identify(docs.withColumnsRenamed(names)).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).withColumn("lang", F.col("lang_pred"))
    return found.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
