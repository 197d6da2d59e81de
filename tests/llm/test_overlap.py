import itertools
import math
import random

import pytest

from gneiss.llm import overlap

NUM, CAT = ["n1", "n2", "n3", "n4", "n5"], ["c1", "c.2"]
SCHEMA = "row_id bigint, split string, " + ", ".join(f"{c} double" for c in NUM) + ", c1 string, `c.2` string, attack string, train_id string, key string"


def _rows():
    rng = random.Random(3)
    base = [[rng.choice([0.0, -5.0, 1e-9, 100.0, 3.0, rng.uniform(1, 1e6)]) for _ in NUM] + [rng.choice("ab"), rng.choice(["x", None]), rng.choice(["DoS", " dos", None])] for _ in range(12)]
    rows = []
    for i in range(150):
        r = list(rng.choice(base)) if i % 3 else [None, float("nan"), 0.0, 0.0, float("inf"), None, None, None]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(8)
            r[k] = (r[k] or 1.0) * rng.choice([1.0099, 0.9901, 1.02]) if k < 5 else rng.choice(["a", "x", None])
        rows.append((i, rng.choice(["train", "train", "val", "test", None]), *r, "q", "q"))
    rows += [(1000 + 50 * c + i, s, *rows[i][2:]) for i in range(12) for c, s in enumerate(("train", "train", "val", "test"))]  # copies under other ids
    rows += rows[:20] + [(None, "train", *rows[0][2:])]
    return rows


def _agree(a, b, k):
    if k < 5:
        a, b = (None if x is None or not math.isfinite(x) else x for x in (a, b))
        return a is None and b is None or (a is not None and b is not None and abs(a - b) <= 0.01 * max(abs(a), abs(b)))
    if k == 7:
        a, b = (x and x.strip().lower() for x in (a, b))
    return a == b


@pytest.mark.parametrize("hot", [10**9, 1])
def test_against_brute_force(spark, hot):
    rows = _rows()
    want = {}
    for a, b in itertools.product(rows, rows):
        if a[0] is not None and a[1] == "train" and b[1] in ("val", "test"):
            d = sum(not _agree(x, y, k) for k, (x, y) in enumerate(zip(a[2:10], b[2:10])))
            if d <= 2:
                want[a[0], b[0]] = d
    got = overlap.near_rows(spark.createDataFrame(rows, SCHEMA), NUM, CAT, "attack", hot_pairs=hot).collect()
    assert {(r["train_id"], r["eval_id"]): r["n_diff"] for r in got} == want and len(got) == len(want)


def test_empty(spark):
    assert overlap.near_rows(spark.createDataFrame([], SCHEMA), NUM, CAT, "attack").count() == 0
