import collections
import hashlib
import math
import os
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from twinsift.llm import chat, decontamination, langid, lines, lm_scoring, mixing, packing, quality, sharding, simhash, substrings  # noqa: E402
from twinsift.llm.registry import queries  # noqa: E402

ODD = [None, "", " \t\n", "A", "one two", "x\x0b y\x0cz\r", "ÀB é ça 日本", "a " * 30, "w " * 3000, "#$%& | <>", "12 34", "\x00 a"]


def synthetic(seed=1, n=60):
    """Rows (doc_id, text, lang, source): copies, near copies, shared passages, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 5))) for _ in range(120)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = text(70)
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 160))
        if i % 5 == 0:
            t = f"{t}\n{passage}\n{text(5)}"
        if i % 7 == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 7 == 4 and rows:
            w = rows[rng.randrange(len(rows))][1].split(" ")
            w[rng.randrange(len(w))] = "Changed"
            t = " ".join(w)
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])))
    rows += [(100 + i, t, "en", "s1") for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "null id text here", "en", None), (7, "another text of id seven", None, "s2"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


ROWS = synthetic()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(1) for c in ("words", "h", "key", "size", "n", "q", "node", "fp", "block", "bucket", "shard", "score", "rates")}
    return df.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def bag(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


# --- 1 mixing -------------------------------------------------------------------------------------------------


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = collections.Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(brute.words(t))
    want, taken = brute.targets(sizes), collections.Counter()
    assert bag(mixing.mix(docs), "doc_id", "size") == collections.Counter((d, len(brute.words(t))) for d, t in PAIRS)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], float(want[r["source"]]))
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(len(brute.words(t)) for _, t in PAIRS)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0 == mixing.mixed_documents(empty).count()


def test_mixed_rows_are_the_copies(docs):
    chosen = mixing.mix(docs).filter("copies > 0").agg(F.sum("copies")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and abs(out.count() - chosen) <= 2


def test_the_mix_is_planned_once(docs):
    """The figures of the sources come as local tables: their plans are not copied into each column that uses them."""
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 4 and plan.count("Window") <= 8, plan


def test_mixed_rows_are_exactly_those_taken(spark):
    """Equal rows, also of several sources, share their copies without loss or gain."""
    for rows in ([(1, "a b c", "s")] * 3 + [(2, "d e", "s")], [(1, "a b", s) for s in ("s", "t", None)] * 2 + [(i, "x y z", "t") for i in range(9)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("clash"))
        want = {(r["doc_id"], r["source"]): r["n"] for r in mixing.mix(df).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect() if r["n"]}
        out = mixing.mixed_documents(df)
        assert {(r["doc_id"], r["source"]): r["count"] for r in out.groupBy("doc_id", "source").count().collect()} == want
        assert out.columns == df.columns


def test_targets_stop_at_their_limit():
    sizes = {"a": 1, "b": 100, None: 100}
    got = mixing.fill_targets([1, 100, 100], [3, 1, 2], mixing.SHARE * 201, [mixing.Fraction(2 * x) for x in sizes.values()])
    assert got == list(brute.targets(sizes).values()) and got[0] == 2 and sum(got) == mixing.SHARE * 201


def test_inclusion_follows_the_design(spark):
    """Over many seeds of ids, larger documents enter more often."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 16).otherwise(1).cast("int")).alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    got = {(r["source"], r["size"]): r["m"] for r in mixing.mix(rows).groupBy("source", "size").agg(F.avg("copies").alias("m")).collect()}
    assert got["b", 16] > got["b", 1] > 0


# --- 2 language -----------------------------------------------------------------------------------------------

SMALL = ["a", "b", "c", "ab", "bc", "abc", langid.START, langid.START + "a", langid.START + "ab"]


def all_segmentations(chars, p):
    if not chars:
        return 1.0
    return sum(p.get(chars[:k], 0.0) * all_segmentations(chars[k:], p) for k in range(1, len(chars) + 1))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    p = rng.random((len(SMALL), 2))
    p /= p.sum(axis=0)
    ws = ["a", "ab", "abc", "bca", "abcabc", "ca"]
    got = langid.log_probs(langid.Lexicon(SMALL), p, ws)
    for i, w in enumerate(ws):
        for k in range(2):
            want = all_segmentations(langid.START + w, dict(zip(SMALL, p[:, k], strict=True)))
            assert math.isclose(got[i, k], math.log(want), rel_tol=1e-9)
    long = "abc" * 30
    n, *rest = langid.Lexicon(SMALL).spans([long])
    want = np.log(langid.forward(n, *rest, p)[n[0], 0])
    assert np.allclose(langid._long(langid.Lexicon(SMALL), p, long), want)


def test_words_without_pieces_do_not_underflow():
    """A word of any length gets the product of its unknown characters, with no floor that languages tie at."""
    p = np.full((len(SMALL), 2), 0.1)
    p[SMALL.index(langid.START)] = (0.2, 0.1)
    for n in (1, 37, 38, 59, 60, 61, 200):
        got = langid.log_probs(langid.Lexicon(SMALL), p, ["z" * n])[0]
        assert np.allclose(got, np.log([0.2, 0.1]) + n * math.log(langid.UNKNOWN), rtol=1e-9)


def test_long_words_train_like_short_ones(monkeypatch):
    lex, ws, counts = langid.Lexicon(SMALL), ["abc", "abab", "zcab", "bcabcabca"], np.array([[5.0, 1.0], [3.0, 0.0], [2.0, 2.0], [1.0, 4.0]])
    want = langid.fit(lex, len(SMALL), ws, counts)
    monkeypatch.setattr(langid, "LONG", 2)
    assert np.allclose(langid.fit(lex, len(SMALL), ws, counts), want)


def test_prediction_matches_brute_force(spark):
    """Languages and scores of texts from segmentations written out one by one."""
    rng = random.Random(5)
    names, p, prior = ["x", "y"], np.random.default_rng(1).random((len(SMALL), 2)), np.log([0.3, 0.7])
    p /= p.sum(axis=0)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 5))) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in langid.predict(df, (names, SMALL, p, prior)).collect():
        logs = [prior[k] + sum(math.log(all_segmentations(langid.START + w, dict(zip(SMALL, p[:, k], strict=True)))) for w in r["text"].split()) for k in range(2)]
        best = int(np.argmax(logs))
        assert r["lang_pred"] == names[best] and math.isclose(r["score"], 1 / sum(math.exp(x - logs[best]) for x in logs))


def test_em_raises_likelihood():
    lex, ws = langid.Lexicon(SMALL), ["abc", "abab", "c"]
    counts = np.array([[5.0], [3.0], [2.0]])
    like = [float((langid.log_probs(lex, langid.fit(lex, len(SMALL), ws, counts, rounds), ws) * counts).sum()) for rounds in (1, 3)]
    assert like[1] > like[0]


def test_language_accuracy_and_undecided(spark, sf, docs, empty):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    out = langid.op2_language_id(spark, sf.replace("0.001", "0.01")).join(d.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    total, right = out.count(), out.filter("lang = lang_pred").count()
    assert right / total > 0.98
    odd = {(r["doc_id"], r["text"]): r for r in langid.identify(docs).collect()}
    assert len(odd) == len(set(PAIRS))
    for (_, text), r in odd.items():
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r["score"] <= 1
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {r["score"] for r in kept.select("score").collect()} <= {1}  # the input's own column


# --- 3 decontamination ----------------------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    long = [t for _, t in PAIRS if t and len(t.split()) > 100]
    items = [(1, " ".join(long[0].upper().split()[5:40])), (2, "one, TWO!"), (10, " ".join(long[1].split()[:10])), (3, None), (4, "never seen words here at all"), (5, "..."), (2, "one, TWO!"), (None, " ".join(long[2].split()[3:14])), (11, "w " * 12), (12, "x1 " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    out = decontamination.contamination(docs, bench)
    want = collections.Counter((d, *w, w[1] > 0) for (d, _), w in zip(PAIRS, brute.contamination(PAIRS, items), strict=True))
    assert bag(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert out.filter("contaminated AND n_near = 0 AND n_items > 0").count() == 0
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


# --- 4 chat ---------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["", None, "%", "%25", "<|im_end|>\n", "%3C|", "a<", "|b", chat.CONTROL, "é\n日", "<|" * 5]
    rows = [(1, i, ("user", "assistant", None, "sys\n<|x")[i % 4], t) for i, t in enumerate(texts)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 3, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("zz"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_log(chat.conversation_events(df))).collect()}
    turns = [((r or ""), (t or "")) for _, _, r, t in rows[: len(texts)]]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert got[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"], got[1]["n_turns"]) == (len(loss), sha(loss), len(texts))
    assert got[2]["n_turns"] == 2 and got[None]["loss_chars"] == 1
    assert chat.format_log(chat.conversation_events(df.limit(0))).count() == 0


def test_chat_events_fold(spark):
    log = [
        (1, 0, "delta", None, "lost", None), (1, 1, "open", "user", "hi", None), (1, 2, "open", "assistant", "", None), (1, 3, "delta", None, "hel", None), (1, 4, "delta", None, "lo", None),
        (1, 5, "regen", None, None, None), (1, 6, "delta", None, "bye", None), (1, 7, "open", "user", "more", None), (1, 8, "edit", None, "hey", 0), (1, 9, "open", "assistant", "ok", None), (1, 10, "edit", None, "?", 9),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, target int").repartition(4)
    row = chat.format_log(df).first()
    assert chat.read_back(row["formatted"]) == [("user", "hey"), ("assistant", "ok")]
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]] == ["ok"]


def test_chat_keeps_large_ids_apart_beside_a_null(spark):
    ids = [None, 2**53, 2**53 + 1, -(2**62) - 1]
    df = spark.createDataFrame([(i, 0, "user", f"hello {i}") for i in ids], "conv_id long, turn long, role string, text string").coalesce(1)
    for log in (chat.conversation_events(df), chat.message_events(df)):
        got = {r["conv_id"]: r["formatted"] for r in chat.format_log(log).collect()}
        assert {i: chat.read_back(t) for i, t in got.items()} == {i: [("user", f"hello {i}")] for i in ids}
        assert {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_log(log)).collect()} == dict.fromkeys(ids, 1)


def test_chat_log_folds_to_the_rows(spark):
    """Drafts, deltas, regenerations and edits leave each row's text; ties, nulls, repeated rows and long texts too."""
    rows = [(1, 0, "user", "a<|b"), (1, 1, "assistant", "long " * 20_000), (1, 1, "assistant", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "user", "y"), (2, 3, "assistant", "é日"), (None, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("step", F.lit("q"))
    log = chat.message_events(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"open", "delta", "regen", "edit"}
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_log(log).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[conv] == [(r[2] or "", r[3] or "") for r in mine]
    assert chat.message_events(df.limit(0)).count() == 0


# --- 5 lines --------------------------------------------------------------------------------------------------


def test_line_simhash_is_a_majority(spark):
    import xxhash

    rng = random.Random(4)
    norms = [" ".join(rng.choices(["aa", "b", "cde", "f", "gh"], k=k)) for k in (1, 2, 7, 200)]
    df = spark.createDataFrame(list(enumerate(norms)), "node long, norm string")
    got = {r["node"]: r["sim"] % 2**64 for r in lines.simhashes(df).collect()}
    for i, norm in enumerate(norms):
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in norm.split()]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_block_keys_keep_every_near_pair():
    rng = random.Random(2)
    for count in (10, 10**6, 10**9):
        masks = [m % 2**64 for m in lines.block_keys(count)]
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(range(64), 3))
            assert any(a & m == b & m for m in masks)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_bound_is_the_edit_distance(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        a = rng.choices(["ab", "abc", "b", "xyz", "q"], k=rng.randint(1, 9))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(["ab", "q", "zz"])) if rng.random() < 0.5 else b.pop(rng.randrange(len(b))) if len(b) > 1 else None
        rows.append((" ".join(a), " ".join(b), rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "a string, b string, most int")
    got = [r[0] for r in df.select(lines._within(F.col("a"), F.col("b"), F.col("most"))).collect()]
    assert got == [levenshtein(a, b) <= m for a, b, m in rows]


def test_line_dedup(spark, docs, empty):
    base = "the quick brown fox jumps over the lazy dog and then runs back to the quiet old forest near the wide river where it sleeps all day"
    near = base.replace("wide", "wild")
    rows = [(1, f"{base}\nalpha\n12\n\nTail one"), (2, f"{near}\nAlpha!!\n12"), (3, f"other line entirely\n{base.upper()}"), (4, None), (5, ""), (3, f"other line entirely\n{base.upper()}"), (None, "alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0))
    got = {(r["doc_id"], tuple(r["removed"])) for r in lines.removed_lines(df).collect()}
    import xxhash

    words = lambda s: [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in s.split()]
    bits = lambda s: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in words(s)) > len(s.split()))
    linked = (bits(base) ^ bits(near)).bit_count() <= 3 and 1 - levenshtein(base, near) / max(len(base), len(near)) >= 0.8
    assert got == {(2, (0, 1) if linked else (1,)), (3, (1,)), (None, (0,))}
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect() if r["doc_id"] == 1}[1] == rows[0][1]
    assert lines.removed_lines(empty).count() == 0
    assert lines.dedup_lines(docs).count() == len(ROWS)


def test_line_groups_match_brute_force(spark):
    """All links within 3 bits and edit similarity 0.8 are found, and no others."""
    import xxhash

    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 6))) for _ in range(300)]
    texts = []
    for _ in range(25):
        w = rng.choices(vocab, k=rng.randint(3, 60))
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 6)):
            v = list(w)
            for _ in range(rng.randint(1, 2)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
    texts = list(dict.fromkeys(texts))
    bits = []
    for t in texts:
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in t.split()]
        bits.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3 and levenshtein(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in lines.removed_lines(df).collect()}
    assert got == {i for i in range(len(texts)) if root(i) != i}


def scattered_lines():
    """Pairs of lines with many typos, one in 81 words against 60 with the spaces gone, and the most edits of a similar pair."""
    rng = random.Random(31)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(120):
        a = " ".join(rng.choices(vocab, k=rng.randrange(25, 60)))
        b = list(a)
        for i in rng.sample([i for i, x in enumerate(b) if x != " "], int(len(b) * 0.11)):
            b[i] = rng.choice("abcdefghijklmnop")
        texts += [a, "".join(b)]
    many = rng.choices(vocab, k=81)
    texts += [" ".join(many), "".join(many[:22]) + " " + " ".join(many[22:])]
    return texts, lambda a, b: int(0.2 * max(len(a), len(b)) + 1e-9)


def test_similar_lines_that_share_a_block_are_linked(spark):
    """No link among the candidates is left out, few as the places may be in which their sketches agree."""
    texts, most = scattered_lines()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = lines.materialize(lines.distinct_lines(lines.lines(df)), "lines")
    norm = {r["node"]: r["norm"] for r in nodes.collect()}
    buckets = {}
    for r in lines.gram_buckets(nodes).select("k", "node").collect():
        buckets.setdefault(r["k"], set()).add(r["node"])
    met = {(a, b) for s in buckets.values() for a in s for b in s if a < b}
    links = [(a, b) for a, b in met if levenshtein(norm[a], norm[b]) <= most(norm[a], norm[b])]
    group = {r["node"]: r["g"] for r in lines.gram_groups(nodes).collect()}
    assert len(links) > 20 and all(group.get(a) == group.get(b, 0) for a, b in links)


def test_line_groups_in_parts_leave_no_spent_table(spark, monkeypatch):
    """Candidates are verified a part at a time with the same groups, and tables that nothing reads any more are gone."""
    rng = random.Random(33)
    texts, _ = scattered_lines()
    texts = texts[:40]
    for n_words in (30, 75):
        base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n_words)]
        for _ in range(60):
            w = list(base)
            for i in rng.sample(range(n_words), n_words // 15):
                w[i] = "".join(rng.choices("abcdefghij", k=6))
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = lines.materialize(lines.distinct_lines(lines.lines(df)), "lines")
    groups = lambda: sorted(map(tuple, lines.gram_groups(nodes).collect()))
    want, keep, made = groups(), lines.materialize, []

    def noted(df, tag, *a, **k):
        made.append((tag, keep(df, tag, *a, **k)))
        return made[-1][1]

    monkeypatch.setattr(lines, "materialize", noted)
    monkeypatch.setattr(lines, "LEAST_AT_ONCE", 1, raising=False)
    assert groups() == want and len(want) > 100
    left = {tag for tag, table in made if os.path.exists(table.twinsift_path.removeprefix("file://"))}
    assert not left & {"minima", "buckets", "candidates", "texts", "mixed"}
    assert sum(tag == "links" for tag, _ in made) > 6


def test_complete_line_groups_are_all_similar_pairs(spark):
    """Held against all pairs: also those without a common block, and of many words against fewer."""
    texts, most = scattered_lines()
    texts = texts[:24] + texts[-2:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.removed_lines(df, complete=True).collect()}
    assert gone == {j for j, b in enumerate(texts) if any(abs(len(a) - len(b)) <= most(a, b) and levenshtein(a, b) <= most(a, b) for a in texts[:j])}
    assert len(texts) - 1 in gone


def test_line_query_finds_similar_lines_of_every_length(spark, tmp_path):
    """Held against edit similarity alone: a changed word, a typo, and a few typos, in lines of 1 to 60 words."""
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    most = lambda a, b: int(0.2 * max(len(a), len(b)) + 1e-9)
    rows, kinds = [], {}
    for lo, hi in ((1, 3), (4, 7), (8, 13), (15, 26), (40, 61)):
        for kind in ("word", "typo", "typos"):
            for _ in range(60):
                a = " ".join(rng.choices(vocab, k=rng.randrange(lo, hi)))
                b = a.split(" ")
                if kind == "word":
                    b[rng.randrange(len(b))] = rng.choice(vocab)
                b = list(" ".join(b))
                for _ in range({"word": 0, "typo": 1, "typos": max(1, len(b) // 20)}[kind]):
                    b[rng.choice([i for i, x in enumerate(b) if x != " "])] = rng.choice("abcdefghijklmnop")
                b = "".join(b)
                if a != b and levenshtein(a, b) <= most(a, b):
                    i = len(rows)
                    rows += [(i, a), (i + 1, b)]
                    kinds[i + 1] = (lo, kind)
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(folder))
    got = {r["doc_id"] for r in lines.op5_line_dedup(spark, str(tmp_path)).filter("n_removed > 0").collect()}
    total, found = collections.Counter(kinds.values()), collections.Counter(k for i, k in kinds.items() if i in got)
    print({k: (found[k], n) for k, n in sorted(total.items())})
    assert all(found[k] >= 0.9 * n for k, n in total.items())


def test_line_recall_against_all_pairs(spark, sf):
    """Of all pairs of lines of up to 64 words with edit similarity 0.8 or more, nearly all share a group."""
    nodes = lines.materialize(lines.distinct_lines(lines.lines(spark.read.parquet(f"{sf}/documents.parquet"))), "lines")
    n = nodes.filter(F.size(F.split("norm", " ")) <= lines.MANY_WORDS).select("node", "norm").repartition(16)
    a, b = n.alias("a"), n.alias("b")
    most = F.floor(F.greatest(F.length("a.norm"), F.length("b.norm")) * 0.2 + 1e-9).cast("int")
    near = F.when(F.abs(F.length("a.norm") - F.length("b.norm")) <= most, F.call_function("levenshtein", F.col("a.norm"), F.col("b.norm"), most) >= 0)
    want = [tuple(r) for r in a.join(b, F.expr("a.node < b.node") & near).select("a.node", "b.node").collect()]
    group = {r["node"]: r["g"] for r in lines.gram_groups(nodes).collect()}
    assert want and sum(x in group and group[x] == group.get(y) for x, y in want) >= 0.9 * len(want)


# --- 6 language model -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [1, 2])
def test_lm_scores(docs, empty, least):
    rows = lm_scoring.score(docs, least=least).collect()
    want = collections.defaultdict(list)
    for (d, _), w in zip(PAIRS, brute.language_model(PAIRS, least=least), strict=True):
        want[d].append(w)
    assert len(rows) == len(ROWS)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
        assert r["held_out"] == (brute.crc(r["doc_id"], 7) == 2)
    for d, w in want.items():
        for a, b in zip(sorted(w), sorted(got[d]), strict=True):
            assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-9)
    assert lm_scoring.score(empty).count() == 0


def test_lm_is_normalised(spark):
    """Probabilities of all next tokens, the unknown one included, sum to one."""
    text = "a b c a b d a b c e"
    train = [i for i in range(200) if brute.crc(i, 7) != 2][:4]
    held = [i for i in range(200, 900) if brute.crc(i, 7) == 2]
    vocab = ["a", "b", "c", "d", "e", "zzz"]
    rows = [(i, text) for i in train] + [(held[k], f"a b {w}") for k, w in enumerate(vocab)] + [(held[10], "a b"), (held[11], "a")]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ends = {w: brute.language_model([*rows, (held[k], f"a b {w}")])[-1][4] for k, w in enumerate(vocab)}
    assert all(math.isclose(got[held[k]], ends[w]) for k, w in enumerate(vocab))


def test_lm_query_stores_every_ngram(spark, sf):
    """The registered query's scores are those of a model that drops no n-gram for being rare."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(d, brute.language_model([tuple(r) for r in d], least=1), strict=True)}
    got = {r["doc_id"]: (r["base_score"], r["score"]) for r in lm_scoring.op6_lm_scoring(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i][3:], rtol=1e-9) for i in want)


# --- 7 simhash ------------------------------------------------------------------------------------------------


def test_simhash(docs, empty):
    out = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    assert bag(out, "doc_id", "fingerprint", "component_id") == collections.Counter(brute.simhash_components(PAIRS))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == brute.simhash_groups(PAIRS)


def test_covering_finds_every_pair_in_the_radius():
    rng = random.Random(1)
    masks = [m % 2**64 for m in simhash.covering_masks()]
    assert len(masks) == 15
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 3))
        assert any(a & m == b & m for m in masks)


def test_dense_buckets_keep_their_components(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(63)
    fps = {centre ^ sum(1 << i for i in rng.sample(range(63), rng.randint(0, 4))) for _ in range(150)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                label[root(b)] = root(a)
    from twinsift.operators.components import connected_components

    for piece in (7, 40, 4096):
        groups = collections.defaultdict(set)
        for r in connected_components(simhash.links(df, piece=piece)).collect():
            groups[r["component"]].add(r["node"])
        want = collections.defaultdict(set)
        for f in fps:
            want[root(f)].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_majority_of_long_lists():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 150_000).astype(np.uint64)
    got = simhash.majority(h, np.array([0, 5, 5, 150_000]))
    for (a, b), f in zip([(0, 5), (5, 5), (5, 150_000)], got, strict=True):
        want = sum(1 << i for i in range(64) if 2 * int(((h[a:b] >> np.uint64(i)) & np.uint64(1)).sum()) > b - a)
        assert int(f) == want


# --- 8 sharding -----------------------------------------------------------------------------------------------


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS)
    slots = collections.defaultdict(list)
    for r in rows:
        assert r["shard"] == brute.jump(brute.stable_key(r["doc_id"]), 40) and r["grown_shard"] in (r["shard"], 40)
        assert r["grown_shard"] == brute.jump(brute.stable_key(r["doc_id"]), 41)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    import zlib

    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in PAIRS)
    assert sharding.shard_documents(empty).count() == 0
    assert "shard" in sharding.assign(docs, F.col("doc_id"), 3).columns


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_jump_hash_equals_the_loop(spark, n):
    rows = spark.range(300).select("id", sharding.jump_hash(sharding.key_halves(F.col("id")), n).alias("s")).collect()
    assert all(r["s"] == brute.jump(brute.stable_key(r["id"]), n) for r in rows)


# --- 9 quality ------------------------------------------------------------------------------------------------


def test_quality(docs, empty):
    out = quality.quality_rules(docs)
    want = collections.Counter((d, *brute.quality(t)) for d, t in PAIRS)
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.filter("kept AND base_failed").count() == 0
    assert quality.quality_rules(empty).count() == 0


def test_quality_limits_adapt(spark, sf, docs):
    """The verdicts and limits of every row are those of sorted groups, and the limits of groups differ."""
    names = [f"max_{s}" for s in quality.SIGNALS]
    rows = [(t, lang, source) for _, t, lang, source in ROWS]
    want = collections.Counter((r[0], *k) for r, k in zip(ROWS, brute.quality_kept(rows), strict=True))
    assert collections.Counter((r["doc_id"], r["kept"], tuple(r[n] for n in names)) for r in quality.quality_rules(docs).collect()) == want
    d = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = {r["doc_id"]: (r["kept"], tuple(r[n] for n in names)) for r in quality.op9_quality_rules(spark, sf.replace("0.001", "0.01")).collect()}
    assert got == {r[0]: k for r, k in zip(d, brute.quality_kept([r[1:] for r in d]), strict=True)}
    assert sum(len({limits[i] for _, limits in got.values()}) > 1 for i in range(4)) >= 3


def test_sketch_bins(spark):
    vs = [0, 1, 63, 64, 65, 127, 128, 1000, 10**6, 10**12]
    df = spark.createDataFrame([(v,) for v in vs], "v long").select("v", quality.bin_of(F.col("v")).alias("b")).withColumn("top", quality.bin_top(F.col("b")))
    rows = sorted(df.collect())
    assert all(r["v"] <= r["top"] <= r["v"] * (1 + 1 / 32) for r in rows)
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


# --- 10 substrings --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window", [50, 3])
def test_substrings(docs, empty, window):
    out = substrings.dedup_substrings(docs, window).select("doc_id", "n_removed", F.sha2("kept_text", 256).alias("sha"))
    want = collections.Counter((d, n, s) for (d, _), (_, n, s) in zip(PAIRS, brute.substrings(PAIRS, window), strict=True))
    assert bag(out, "doc_id", "n_removed", "sha") == want
    assert substrings.dedup_substrings(empty).count() == 0


def test_small_pieces_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 200)
    out = substrings.dedup_substrings(docs).select("doc_id", "n_removed")
    assert bag(out, "doc_id", "n_removed") == collections.Counter((d, n) for (d, _), (_, n, _) in zip(PAIRS, brute.substrings(PAIRS), strict=True))


def test_rolling_hash_depends_on_the_window_only():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 500).astype(np.uint64)
    for w in (1, 2, 3, 50, 64):
        a = substrings.window_hashes(h, w)
        assert len(a) == 500 - w + 1
        assert (substrings.window_hashes(h[100:], w) == a[100:]).all() and len(set(a.tolist())) == len(a)


def test_packing():
    arrays = [np.arange(1000, dtype=np.uint32), np.empty(0, np.int64), np.random.default_rng(0).integers(0, 2**63, 9), np.array([1, 0], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, packing.unpack(packing.pack(*arrays)), strict=True))


@pytest.mark.parametrize("name", sorted(queries()))
def test_registered(spark, sf, name):
    out = queries()[name](spark, sf)
    table = "conversations" if name.startswith("op4") else "documents"
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    assert out.count() == (rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count())
