"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated n-gram model with absolute discounting over a
unigram base of add-one counts. As an automaton, each stored context is a
state with an arc for every stored continuation and one failure arc to the
context without its first word, whose weight is the discounted mass:

    arc(h, w)  = (c(hw) - D) / c(h) + fail(h) * P(w | h')
    fail(h)    = 1 - (mass of stored continuations of h - D * their number) / c(h)

An n-gram of two or more words is stored if it occurs ``least`` times, by
default once, so that all are; with a larger ``least``, a context's discounted
mass includes those that are not stored. Probabilities of all tokens after any history sum to one.

The automaton covers the whole training corpus, so no task holds all of it.
Documents are dealt to blocks. A block asks the counting buckets for what its
own tokens need and receives just those states and arcs:

* unigrams: distinct tokens go to buckets by hash, with their training counts;
  the buckets add up, give each token that can be stored a number, and answer
  each block in the order of its question;
* n-grams of order 2 and up to ``ORDER``, as (context number, token number):
  only those whose first and last n-1 words are stored are asked for, by bucket
  of their context, so the bucket also sees the context's continuations, and
  numbers what it stores for the next order. A context with over
  1 / (4 * buckets) of the tokens is spread over all buckets; there are at most
  4 * buckets of those, and their partial sums are put together on the driver.

Questions and answers are packed arrays (see packing.py). A block's documents are
then read left to right once, all side by side, each with its state: while the
state has no arc for the token, the weight of its failure arc is added and the
read goes on in the state that it leads to; then the arc's weight is added, and
the arc leads to the longest stored suffix of what was read.

Defined results: a null or empty text is one end token; a null doc_id counts
as an empty id text in the split; repeated rows count as often as they occur;
with no training rows N is zero and every token has probability 1 / (V + 1);
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.common import crc_mod, documents, let, lower_ascii, power_of_two, text_bytes, text_key, words
from twinsift.llm.packing import deltas, each_bucket, pack, small, unpack
from twinsift.plans.workspace import discard, materialize

ORDER = 3
#: Least count of a stored n-gram, unless the caller gives another: all are stored.
MIN_COUNT = 1
DISCOUNT = 0.75
FOLDS, HELD_OUT = 7, 2
#: Hash of the end token; no word is read as it.
END = np.uint64(0xE17A1465A5B7C3D1)
#: Numbers of the start context and of the word that never occurs; buckets number from 1.
START, NO_WORD = 0, 1
BLOCK_BYTES, LEAST_BLOCKS = 6 << 20, 24
MESSAGE = "bucket int, kind int, block int, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct pair in order of context and word, each place's pair)."""
    if not len(context):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(context * (1 << 32) + word) if max(context.max(), word.max()) < 1 << 31 else np.lexsort((word, context))
    c, w = context[order], word[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _numbers(stored: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """A number for each stored entry of a bucket that no other bucket gives; 0 for the others."""
    return np.where(stored, np.cumsum(stored) * buckets + bucket, 0)


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "kind", "block", "payload"), cols, types, strict=True)})


# --- blocks ---------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """Blocks of tokenised documents (kind 0), and their questions about tokens (kind 1).

    A block has its distinct token hashes and each document's tokens as indices of them.
    """
    key = text_key(F.col("text"))
    train = crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", key), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"),
        lower_ascii(F.coalesce("text", F.lit(""))).alias("text"),
    ).repartition(blocks, "block")  # so that the shuffle moves text, and words are hashed behind it
    tokens = rows.select("block", "doc_id", "train", let(words(F.col("text")), lambda w: F.transform(w, lambda x: F.xxhash64(x))).alias("h"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group["h"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        n = np.diff(offsets)
        ends = np.cumsum(n + 1) - 1
        stream = np.full(len(values) + len(n), END, np.uint64)
        inner = np.ones(len(stream), bool)
        inner[ends] = False
        stream[inner] = values
        vocabulary, index = np.unique(stream, return_inverse=True)
        frequent = np.argsort(-np.bincount(index), kind="stable")  # small indices for frequent tokens
        rank = np.empty(len(frequent), np.int64)
        rank[frequent] = np.arange(len(frequent))
        vocabulary, index = vocabulary[frequent], rank[index]
        train = group["train"].to_numpy()
        counts = np.bincount(index[np.repeat(train, n + 1)], minlength=len(vocabulary)).astype(np.uint32)
        block = group["block"][0].as_py()
        doc = group["doc_id"]
        ids, none = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy()
        out = [(-1, 0, block, pack(vocabulary, small(index), (n + 1).astype(np.int64), train.astype(np.uint8), ids, none.astype(np.uint8)))]
        for k, at in each_bucket((vocabulary & np.uint64(buckets - 1)).astype(np.int64)):
            out.append((k, 1, block, pack(vocabulary[at], small(counts[at]))))
        return _table(out)

    return tokens.groupBy("block").applyInArrow(run, MESSAGE)


class Block:
    """A block with the answers that have come so far.

    ``hot`` has the (mass, number of continuations) of hot contexts by order
    and context, and under "start" how often the start context occurs.
    """

    def __init__(self, rows: pa.Table, buckets: int, order: int, n_tokens: int, hot: dict, least: int):
        by_kind: dict[int, dict[int, bytes]] = {}
        for bucket, kind, payload in zip(*(rows[c].to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
            by_kind.setdefault(kind, {})[bucket] = payload
        self.vocabulary, index, self.n, train, self.ids, self.none = unpack(by_kind[0][-1])
        self.index, self.train = index.astype(np.int64), train.astype(bool)
        self.buckets, self.n_tokens, self.least = buckets, n_tokens, least
        counts, numbers = (np.zeros(len(self.vocabulary), np.int64) for _ in range(2))
        for k, at in each_bucket((self.vocabulary & np.uint64(buckets - 1)).astype(np.int64)):
            counts[at], numbers[at] = unpack(by_kind[1][k])
        self.counts = counts
        word = numbers[self.index]
        first = np.cumsum(self.n) - self.n
        self.in_train = np.repeat(self.train, self.n)
        # for each order: what every position's n-gram and its context have
        self.levels = []
        before = lambda x, at_start: np.where(starts, at_start, np.concatenate([x[:1], x[:-1]]))
        starts = np.zeros(len(word), bool)
        starts[first] = True
        # the context of one word: the word before, or the start
        context, total = before(word, START), before(counts[self.index], hot.get("start", 0))
        known, possible = total >= least, word > 0
        for level in range(2, order + 1):
            q = self.question(context, word, known, possible, total)
            if level not in by_kind:
                self.asked = q
                return
            count, number, mass, kinds = self.answer(level, q, by_kind[level], hot)
            self.levels.append((known, total, count, mass, kinds))
            # the next order's context is this n-gram, one position back
            context, total = before(number, START), before(count, 0)
            known, possible = total >= least, count >= least

    def question(self, context, word, known, possible, total):
        """Distinct (context, word) pairs by bucket; hot contexts are spread by word.

        A word that cannot continue its context stands as ``NO_WORD``, which
        occurs zero times, so that the context's mass is answered all the same.
        """
        at = np.flatnonzero(known)
        possible = possible[at]
        context, word, total = context[at], np.where(possible, word[at], NO_WORD), total[at]
        one, which = _distinct(context, word)
        count = np.bincount(which[self.in_train[at] & possible], minlength=len(one))
        context, word, total = context[one], word[one], total[one]
        hot = total * 4 * self.buckets > self.n_tokens
        bucket = (_mix(context + np.where(hot, word << 20, 0)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return at, which, context, word, count, hot, dict(each_bucket(bucket))

    def messages(self, level: int, block: int) -> list[tuple]:
        _, _, context, word, count, hot, by_bucket = self.asked
        out = []
        for k, at in by_bucket.items():  # still in order of context and word
            c, w = context[at], word[at]
            head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            step = np.diff(w, prepend=0)
            step[head] = w[head]
            out.append((k, level, block, pack(deltas(c[head]), small(np.diff(np.append(head, len(c)))), hot[at][head].astype(np.uint8), small(step), small(count[at]))))
        return out

    def answer(self, level, q, payloads, hot):
        """For every position: count and number of its n-gram, stored mass and continuations of its context."""
        at, which, context, _, _, is_hot, by_bucket = q
        found = [np.zeros(len(context), np.int64) for _ in range(4)]
        for k, payload in payloads.items():
            rows = by_bucket[k]
            stored, count, number, mass, kinds = unpack(payload)
            hits = rows[np.unpackbits(stored, count=len(rows)).astype(bool)]
            c = context[rows]
            n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])), len(c)))
            found[0][hits] = count
            if len(number):
                found[1][hits] = np.cumsum(number, dtype=np.int64)
            found[2][rows], found[3][rows] = np.repeat(mass, n), np.repeat(kinds, n)
        heads = np.flatnonzero(is_hot)
        for i in heads:
            found[2][i], found[3][i] = hot.get((level, int(context[i])), (0, 0))
        out = [np.zeros(len(self.index), np.int64) for _ in range(4)]
        for o, f in zip(out, found, strict=True):
            o[at] = f[which]
        return out


def _asked(payload: bytes) -> tuple[np.ndarray, ...]:
    """(contexts, number of words of each, hot, context and word of each pair, counts) of a question."""
    c, n, hot, step, count = unpack(payload)
    c, n = np.cumsum(c, dtype=np.int64), n.astype(np.int64)
    total = np.cumsum(step, dtype=np.int64)
    head = np.cumsum(n) - n
    word = total - np.repeat(total[head] - step[head], n)
    return c, n, hot, np.repeat(c, n), word, count.astype(np.int64)


def ask(state: DataFrame, level: int, buckets: int, n_tokens: int, hot: dict, least: int) -> DataFrame:
    """The blocks' questions about n-grams of order ``level``."""

    def run(group: pa.Table) -> pa.Table:
        block = Block(group, buckets, level, n_tokens, hot, least)
        return _table(block.messages(level, group["block"][0].as_py()))

    return state.groupBy("block").applyInArrow(run, MESSAGE)


# --- buckets --------------------------------------------------------------------------------------------------


def answer_tokens(questions: DataFrame, buckets: int, least: int) -> DataFrame:
    """Training counts and numbers of tokens (kind 1), and the bucket's distinct tokens and their sum (kind -1)."""

    def run(group: pa.Table) -> pa.Table:
        asked = [unpack(p) for p in group["payload"].to_pylist()]
        keys, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([a[1] for a in asked]), len(keys)).astype(np.int64)
        bucket, out, at = group["bucket"][0].as_py(), [], 0
        number = _numbers(total >= least, bucket, buckets)
        for block, a in zip(group["block"].to_pylist(), asked, strict=True):
            mine = inverse[at : at + len(a[0])]
            out.append((bucket, 1, block, pack(small(total[mine]), small(number[mine]))))
            at += len(a[0])
        out.append((bucket, -1, -1, pack(np.array([np.count_nonzero(total), total.sum()], np.int64))))
        return _table(out)

    return questions.groupBy("bucket").applyInArrow(run, MESSAGE)


def answer_grams(questions: DataFrame, level: int, buckets: int, last: bool, least: int) -> DataFrame:
    """Which n-grams are stored, their counts and, unless ``last``, numbers, with the stored mass of their contexts
    (kind ``level``), and parts of hot contexts (kind -1)."""

    def run(group: pa.Table) -> pa.Table:
        asked = [_asked(p) for p in group["payload"].to_pylist()]
        context, word, count = (np.concatenate([a[i] for a in asked]) for i in (3, 4, 5))
        hot = np.concatenate([np.repeat(a[2], a[1]) for a in asked]).astype(bool)
        one, which = _distinct(context, word)
        total = np.bincount(which, count, len(one)).astype(np.int64)
        context, hot = context[one], hot[one]
        stored = total >= least
        bucket = group["bucket"][0].as_py()
        number = _numbers(stored, bucket, buckets)
        names, at_name = np.unique(context, return_inverse=True)
        mass = np.bincount(at_name[stored], total[stored], len(names)).astype(np.int64)
        kinds = np.bincount(at_name[stored], minlength=len(names))
        out, at = [], 0
        for block, a in zip(group["block"].to_pylist(), asked, strict=True):
            name, mine = np.searchsorted(names, a[0]), which[at : at + len(a[4])]
            # numbers rise with context and word, as the question does
            hits = mine[stored[mine]]
            numbers = deltas(number[hits]) if not last else hits[:0]
            out.append((bucket, level, block, pack(np.packbits(stored[mine]), small(total[hits]), numbers, small(mass[name]), small(kinds[name]))))
            at += len(a[4])
        if hot.any():
            mine = np.unique(at_name[hot])
            out.append((bucket, -1, -1, pack(names[mine], mass[mine], kinds[mine])))
        return _table(out)

    return questions.groupBy("bucket").applyInArrow(run, MESSAGE)


# --- scores ---------------------------------------------------------------------------------------------------


class Automaton:
    """The states and arcs that a block's documents can meet, with log10 weights.

    A state is a context; its level is the number of its words. At each position,
    ``arcs[l]`` is the weight of the arc that the state of level ``l`` before it has
    for its token, where ``has[l]``, and ``fails[l]`` that of the state's failure arc
    to level l - 1. The empty context has an arc for every token.
    """

    def __init__(self, block: Block, n_tokens: int, n_types: int):
        count = block.counts[block.index]
        p = (count + 1) / (n_tokens + n_types + 1)
        self.base = np.log10(p)
        self.is_state = count >= block.least  # of the token alone, as a context
        self.has, self.arcs, self.fails = [np.ones(len(p), bool)], [self.base], [np.zeros(len(p))]
        self.start = 0
        for known, total, c, mass, kinds in block.levels:
            n = np.where(known, total, 1)
            fail = np.where(known, 1 - (mass - DISCOUNT * kinds) / n, 1.0)
            p = np.where(c >= block.least, (c - DISCOUNT) / n, 0.0) + fail * p
            self.has.append(known & (c >= block.least))
            self.arcs.append(np.log10(p))
            # a state all of whose mass is in its arcs is never left by its failure arc
            self.fails.append(np.log10(np.maximum(fail, 1e-300)))
        if block.levels and len(p):
            self.start = int(block.levels[0][0][0])  # the start context, if it is a state

    def read(self, n: np.ndarray) -> np.ndarray:
        """The log-probability of each document, of ``n`` tokens each, in one pass from left to right."""
        first, top = np.cumsum(n) - n, len(self.has) - 1
        order = np.argsort(-n, kind="stable")
        ends = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left")  # documents that have a token t
        place, level, score = first[order], np.full(len(n), self.start), np.zeros(len(n))
        for t, k in enumerate(ends.tolist()):
            at, state, total = place[:k] + t, level[:k], score[:k]
            for l in range(top, 0, -1):
                stuck = np.flatnonzero(state == l)
                stuck = stuck[~self.has[l][at[stuck]]]
                total[stuck] += self.fails[l][at[stuck]]
                state[stuck] = l - 1
            for l in range(top + 1):
                here = np.flatnonzero(state == l)
                total[here] += self.arcs[l][at[here]]
            state[:] = np.where((state > 0) | self.is_state[at], np.minimum(state + 1, top), 0)
        out = np.empty(len(n))
        out[order] = score
        return out


def scores_of(block: Block, n_tokens: int, n_types: int) -> dict[str, np.ndarray]:
    """Each document's figures."""
    automaton = Automaton(block, n_tokens, n_types)
    first = np.cumsum(block.n) - block.n
    add = lambda x: np.add.reduceat(x, first)
    known = (block.counts[block.index] > 0).astype(np.int64)
    return {"n_tokens": block.n, "n_known": add(known), "base_score": add(automaton.base), "score": automaton.read(block.n)}


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, least: int = MIN_COUNT) -> DataFrame:
    """Train on the training folds of ``docs`` and score every document."""
    size = text_bytes(docs)
    blocks = max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES))
    buckets = power_of_two(size / (16 << 20), 64)
    encoded = materialize(encode(docs, blocks, buckets), "blocks", free=True, parts="kind")
    state = encoded.filter("kind = 0")
    replies = materialize(answer_tokens(encoded.filter("kind = 1"), buckets, least), "tokens", free=True)
    discard(encoded, "kind=1")
    # a row for each bucket
    parts = [unpack(r["payload"])[0] for r in replies.filter("kind = -1").select("payload").collect()]
    n_types, n_tokens = (int(sum(p[i] for p in parts)) for i in (0, 1))
    starts = docs.filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).count()
    hot: dict = {"start": starts}
    state = state.union(replies.filter("kind = 1"))
    for level in range(2, order + 1):
        # the questions are written, so that the blocks' shuffle files go before the buckets' come
        asked = materialize(ask(state, level, buckets, n_tokens, hot, least), f"asked{level}", free=True)
        replies = materialize(answer_grams(asked, level, buckets, level == order, least), f"grams{level}", free=True)
        discard(asked)
        for r in replies.filter("kind = -1").select("payload").collect():  # at most 4 * buckets contexts
            for name, m, d in zip(*(x.tolist() for x in unpack(r["payload"])), strict=True):
                before = hot.get((level, name), (0, 0))
                hot[level, name] = (before[0] + m, before[1] + d)
        state = state.union(replies.filter(F.col("kind") == level))
    known = dict(hot)

    def run(group: pa.Table) -> pa.Table:
        block = Block(group, buckets, order, n_tokens, known, least)
        figures = scores_of(block, n_tokens, n_types)
        ids = pa.array(block.ids, pa.int64(), mask=block.none.astype(bool))
        return pa.table({"doc_id": ids, "held_out": ~block.train, "n_tokens": figures["n_tokens"], "n_known": figures["n_known"], "train_tokens": np.full(len(ids), n_tokens), "base_score": figures["base_score"], "score": figures["score"]})

    return state.groupBy("block").applyInArrow(run, SCORES)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
