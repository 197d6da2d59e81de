from collections import Counter
from datetime import datetime

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from gneiss.llm import sampling

FLOWS = "row_id bigint, pool_id bigint, split string, attack string, label int, ingested_at timestamp, config_id bigint, category string"
CONFIGS = "config_id bigint, pool_id bigint, label_col string, balance string, n_samples bigint, seed int, row_id string"
TARGETS = "config_id bigint, category string, target_share double, min_rows int"


@given(
    st.integers(0, 60),
    st.lists(st.tuples(st.floats(0, 1), st.integers(0, 9), st.integers(0, 40)), min_size=1, max_size=6),
)
def test_allocate_keeps_floors_caps_and_total(n, rows):
    s, m, a = (np.array(x, float) for x in zip(*rows))
    q = sampling.allocate(n, s, m, a)
    low = np.minimum(m, a)
    assert (q >= low).all() and (q <= a).all()
    if n and s.sum() > 0:
        reachable = np.where(s > 0, a, low).sum()
        assert q.sum() == min(max(n, low.sum()), reachable)


def test_allocate_largest_remainder():
    q = sampling.allocate(10, np.array([0.55, 0.25, 0.2]), np.zeros(3), np.full(3, 100.0))
    assert q.tolist() == [6, 2, 2] or q.tolist() == [5, 3, 2]
    assert sampling.allocate(10, np.array([0.9, 0.1]), np.array([0, 4.0]), np.array([50.0, 50])).tolist() == [6, 4]
    assert sampling.allocate(100, np.array([0.5, 0.5]), np.zeros(2), np.array([10.0, 90]), shrink=True).tolist() == [10, 10]


def _tables(spark):
    t = datetime(2025, 1, 1)
    flows = []
    for i in range(300):
        # a third of all rows is one category of one pool
        attack = "Benign" if i % 3 == 0 else [" dos ", "DoS", "Worm", None][i % 4]
        flows.append((i, 1 if i % 3 == 0 else i % 3, "train" if i % 5 else "test", attack, i % 2, t, 9, "x"))
        if i % 10 == 0:
            flows.append((i, 1 if i % 3 == 0 else i % 3, "train" if i % 5 else "test", attack, i % 2, datetime(2025, 2, 1), 9, "x"))
    flows.append((None, 1, "train", "Benign", 0, t, 9, "x"))
    flows.append((900, 1, None, "Benign", 0, None, 9, "x"))
    configs = [(1, 1, "attack", "target", 40, 7, "a"), (2, 2, "label", "undersample", 30, 7, "a"), (3, 1, "attack", None, 5, 7, "a"), (4, 1, "attack", "target", None, 7, "a"), (5, 77, "attack", "target", 10, 1, "a")]
    targets = [(1, "Benign", 0.5, 3), (1, "DoS", 0.3, 0), (1, "DoS", 0.3, 0), (1, "Nothing", 0.2, 1), (2, "0", 0.5, 0), (2, "1", 0.5, 0), (4, "Benign", 1.0, 1), (5, "Benign", None, None), (6, "Benign", 1.0, 1)]
    return spark.createDataFrame(flows, FLOWS), spark.createDataFrame(configs, CONFIGS), spark.createDataFrame(targets, TARGETS)


def test_report_and_draw(spark):
    flows, configs, targets = _tables(spark)
    rows = sampling.train_rows(flows)
    report = sampling.quota_report(configs, targets, sampling.category_counts(rows))
    got = {(r["config_id"], r["category"]): r for r in report.collect()}
    brute = Counter()
    seen = {r["row_id"]: r for r in flows.filter("split = 'train' and row_id is not null").collect()}
    for r in seen.values():
        brute[r["pool_id"], (r["attack"] or "").strip().lower()] += 1
    assert got[1, "Benign"]["available"] == brute[1, "benign"]
    assert got[1, "DoS"]["available"] == brute[1, "dos"]
    assert got[1, "Nothing"]["falls_short"] and not got[4, "Benign"]["falls_short"]
    assert got[4, "Benign"]["quota"] is None and (6, "Benign") not in got
    assert not got[5, "Benign"]["falls_short"] and got[5, "Benign"]["quota"] == 0
    for parts in (1, 7):
        drawn = sampling.draw(configs, report, rows.repartition(parts)).collect()
        by = Counter((r["config_id"], r["category"]) for r in drawn)
        assert by[1, "benign"] == got[1, "Benign"]["quota"] and by[1, "dos"] == got[1, "DoS"]["quota"]
        assert by[3, None] == 5
        assert len({(r["config_id"], r["row_id"]) for r in drawn}) == len(drawn)
        key = sorted((r["config_id"], r["row_id"]) for r in drawn)
        assert parts == 1 or key == first
        first = key


def test_empty(spark):
    flows, configs, targets = (t.limit(0) for t in _tables(spark))
    rows = sampling.train_rows(flows)
    report = sampling.quota_report(configs, targets, sampling.category_counts(rows))
    assert report.count() == 0 and sampling.draw(configs, report, rows).count() == 0
