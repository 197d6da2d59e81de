import math
import random
from collections import Counter

import numpy as np
import tiktoken

from gneiss.llm import abuse, bpe, leak

DOCS = "doc_id bigint, text string, ids string, windows string, score double, vote double"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "q", "q", 0.0, 0.0) for i, t in enumerate(texts)], DOCS)


def test_bpe_equals_reference_encoder(spark):
    ranks = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n \t", "<|endoftext|>", "aaaa" * 999, "naïve 漢字 👩‍🔬 ​ é", "it's they'LL 12345 x" * 50, "z" * 30001]
    texts += ["".join(rng.choice("abcé 漢1\n'.") for _ in range(rng.randint(1, 400))) for _ in range(40)] + ["same"] * 5
    rows = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(_docs(spark, texts).repartition(3), ranks).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i] == encoder.encode_ordinary(t or "")
        assert encoder.decode(rows[i]) == (t or "")
    assert bpe.encode_texts(_docs(spark, texts).limit(0), ranks).count() == 0


def _edit(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for t in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row, best = new, min(best, new[-1])
    return best


def test_myers_equals_dynamic_programming():
    rng = np.random.default_rng(0)
    for m in (1, 5, 10, 33, 63):
        patterns, texts = rng.integers(0, 4, (40, m)), rng.integers(0, 4, (40, m + 7))
        assert leak.myers(patterns, texts).tolist() == [_edit(p.tolist(), t.tolist()) for p, t in zip(patterns, texts)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 10, 14, 25]))) for _ in range(25)] + [None, "", "w1"]
    texts = [None, "", "..."]
    for _ in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        piece = (items[rng.randrange(25)]).split()
        if rng.random() < 0.5 and len(piece) > 4:
            piece[rng.randrange(len(piece))] = "new"
        at = rng.randint(0, len(body))
        texts.append(rng.choice([" ", ", ", "--"]).join(w.upper() if rng.random() < 0.3 else w for w in body[:at] + piece + body[at:]))
    texts += [" ".join(rng.choice(words) for _ in range(5000)) + " " + items[3]] + [items[4]] * 3
    spark_items = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["item_id"], r["doc_id"]): r for r in leak.find_leaks(_docs(spark, texts).repartition(4), spark_items).collect()}
    want = {}
    for i, item in enumerate(items):
        w = leak.words_of(item)
        for d, t in enumerate(texts):
            ws = leak.words_of(t)
            found = [_edit(w[k : k + 10], ws) for k in range(len(w) - 9)]
            if found and min(found) <= 1:
                want[i, d] = (sum(x <= 1 for x in found), sum(x == 0 for x in found), min(found), len(found))
    assert {k: (r["windows"], r["exact_windows"], r["distance"], r["n_windows"]) for k, r in got.items()} == want
    assert leak.find_leaks(_docs(spark, texts).limit(0), spark_items).count() == 0
    assert leak.find_leaks(_docs(spark, texts), spark_items.limit(0)).count() == 0


def test_disguises_are_undone():
    assert abuse.passages("You f.o.o.l, you are s t u p i d and baaaaad") == ["you fool you are stupid and bad"]
    assert abuse.passages("i​di­ot 1d 1 m0r0n ABC-12 2nd") == ["idiot # # moron # #"]
    assert abuse.passages("сlоwn") == ["clown"] and abuse.passages("слон") == ["слон"]
    assert abuse.passages(None) == abuse.passages(" \n ") == []
    long = " ".join(f"w{chr(97 + i % 26)}" for i in range(200))
    assert {w for p in abuse.passages(long) for w in p.split()} == set(long.split())


def test_nearest_is_exact():
    rng = random.Random(5)
    vocabulary = ["the", "of"] * 6 + [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = list({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(700)})
    df = Counter(t for s in texts for t in abuse.terms(s))
    own = abuse.Examples([(t, i) for i, t in enumerate(texts)], {i: i % 2 for i in range(len(texts))})
    vocabulary = list(dict.fromkeys(t for s in own.texts for t in abuse.terms(s)))
    own.fit(vocabulary, np.array([df[t] for t in vocabulary]), len(texts))

    def vector(s):
        v = {t: (1 + math.log(c)) * float(abuse.idf(df.get(t, 0), len(texts))) for t, c in abuse.terms(s).items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / n for t, x in v.items()}, n

    vectors = [vector(s)[0] for s in own.texts]
    queries = texts[:60] + ["unknown word here", "the", "taa tab zz the"]
    row, at, w, unknown = own.space.vectors(queries)
    for floor in (0.05, 0.2, 0.5):
        length = np.array([vector(s)[1] for s in queries])
        query, near, got = own.index.nearest(row, at, w / length[row], len(queries), 10, floor)
        for i, s in enumerate(queries):
            v, _ = vector(s)
            cos = np.array([sum(x * u.get(t, 0) for t, x in v.items()) for u in vectors])
            want = np.sort(cos[cos >= floor])[::-1][:10]
            assert np.allclose(got[query == i], want, atol=1e-9) and np.allclose(cos[near[query == i]], want, atol=1e-9)
    assert {t for t, _ in unknown[60]} >= {"unknown", "unknown word"}


def test_terms_as_an_expression(spark):
    rows = spark.createDataFrame([("a",), ("a b",), ("a b a b",), ("# x # #",)], "passage string").selectExpr("passage", abuse._TERMS + " as t").collect()
    assert all(sorted(r["t"]) == sorted(abuse.terms(r["passage"])) for r in rows)


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    bad = ["you {} fool nobody wants you here", "go away you {} clown and never return", "what a {} idiot you are"]
    good = ["run {} took many seconds on the cluster", "the {} fool proof runbook has one command", "column {} is null in most rows"]
    adjectives = ["useless", "rotten", "filthy", "sparse", "dense", "noisy", "partial"]
    texts, truth = [], []
    for i in range(400):
        parts = [rng.choice(good).format(rng.choice(adjectives)) for _ in range(3)]
        if i % 4 == 0:
            parts[rng.randrange(3)] = rng.choice(bad).format(rng.choice(adjectives))
        texts.append(". ".join(parts))
        truth.append(i % 4 == 0)
    texts += [None, "", " \n"]
    labels = [(i, int(truth[i]) if rng.random() > 0.05 else 1 - int(truth[i]), f"r{k}", None) for i in range(200) for k in range(2)] + [(0, None, "r", None), (None, 1, "r", None)]
    df = spark.createDataFrame(labels + labels[:30], "doc_id bigint, abusive int, rater string, labelled_at timestamp")
    rows = {r["doc_id"]: r for r in abuse.score_documents(_docs(spark, texts), df).collect()}
    assert len(rows) == len(texts)
    held = range(200, 400)
    right = sum((rows[i]["score"] >= 0.5) == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert all(rows[i]["score"] == 0 for i in range(400, 403))
    assert all(r["score"] == 0 or 0 < r["score"] < 1 for r in rows.values())
    none = abuse.score_documents(_docs(spark, texts), df.limit(0)).collect()
    assert len(none) == len(texts) and max(r["score"] for r in none) < 0.5
    assert abuse.score_documents(_docs(spark, texts).limit(0), df).count() == 0
