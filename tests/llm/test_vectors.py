import numpy as np
import pytest

from gneiss.llm import density, forest, hierarchy, vectors

DIMS = 8


def _cloud(seed=0, n_groups=12, each=25, noise=40, hot=0):
    rng = np.random.default_rng(seed)
    parts = []
    for g in range(n_groups):
        centre = rng.standard_normal(DIMS)
        size = each if g else each + hot
        parts.append(centre / np.linalg.norm(centre) + rng.standard_normal((size, DIMS)) * 0.05)
    parts.append(rng.standard_normal((noise, DIMS)))
    x = np.concatenate(parts) * rng.uniform(0.1, 50, (sum(map(len, parts)), 1))
    return x[rng.permutation(len(x))]


def _table(spark, x, extra=()):
    rows = [(int(i), [float(v) for v in r], "q", "q") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "point_id bigint, x_num array<double>, id string, unit string")


BAD = [(9001, None, "q", "q"), (9002, [1.0], "q", "q"), (9003, [0.0] * DIMS, "q", "q"), (9004, [float("nan")] + [1.0] * (DIMS - 1), "q", "q"),
       (9005, [None] + [1.0] * (DIMS - 1), "q", "q"), (9006, [float("inf")] * DIMS, "q", "q"), (None, [1.0] * DIMS, "q", "q")]


def _distance(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(1 - u @ u.T, 9)


def _components(d, reach, least):
    n = len(d)
    comp = np.arange(n)
    while True:
        new = np.array([comp[d[i] <= reach].min() for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    names, counts = np.unique(comp, return_counts=True)
    big = set(names[counts >= least])
    return {(i, int(c)) for i, c in enumerate(comp) if c in big}


def test_invalid_points_take_no_part(spark):
    got = vectors.unit_points(_table(spark, _cloud()[:5], [*BAD, (0, [float(v) for v in _cloud()[0]], "r", "r")]), DIMS)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4]
    huge = vectors.unit_points(_table(spark, np.array([[1e300] * DIMS, [1e-300] * DIMS])), DIMS).collect()
    assert all(abs(np.linalg.norm(np.frombuffer(r["unit"])) - 1) < 1e-9 for r in huge)


@pytest.mark.parametrize(("seed", "block", "sample"), [(1, 4096, 8192), (2, 16, 32), (3, 8, 400)])
def test_link_forest_spans_all_links(spark, seed, block, sample):
    x = _cloud(seed, hot=60)
    x = np.concatenate([x, x[:30] * 2, np.repeat(x[:1], 40, axis=0)])
    points = vectors.unit_points(_table(spark, x), DIMS)
    nodes = vectors.directions(points, 2)
    from pyspark.sql import functions as F

    links = density.link_forest(nodes.withColumn("core", F.lit(0.0)), DIMS, 0.05, sample=sample, block=block)
    ids = sorted(r["id"] for r in nodes.collect())
    d = _distance(x[ids])
    for local in (10**9, 0):
        tree, labels = density.spanning_forest(links, local_edges=local)
        comp = {r["id"]: r["comp"] for r in labels.collect()}
        want = {(ids[i], ids[c]) for i, c in _components(d, 0.05, 2)}
        assert {(i, comp.get(i, i)) for i, _ in want} == want
        assert tree.count() == len(want) - len({c for _, c in want})


def _nodes(spark, x):
    rows = [(i, np.ascontiguousarray(r).tobytes(), 0.0) for i, r in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    return spark.createDataFrame(rows, "id bigint, unit binary, core double").repartition(1)


def test_links_among_thousands_of_far_groups(spark):
    # one batch of 12,000 points, most of them alone: none may be sent to blocks of all others
    rng = np.random.default_rng(21)
    x = rng.standard_normal((12_000, 29))
    x[:200] = np.repeat(x[:40], 5, axis=0) + rng.standard_normal((200, 29)) * 0.02
    links = density.link_forest(_nodes(spark, x), 29, 0.05, sample=256, block=8).collect()
    _, labels = density.spanning_forest(spark.createDataFrame(links, density.EDGE))
    assert {(r["id"], r["comp"]) for r in labels.collect()} == _components(_distance(x), 0.05, 2)


@pytest.mark.parametrize("args", [{}, {"sample": 64, "block": 8, "chunk": 16}])
def test_heights_of_all_links(spark, args):
    x = _cloud(22, hot=60)
    d = np.triu(_distance(x), 1)
    u, v = np.nonzero((d > 0) & (d <= 0.05))
    want = density.spanning_forest(spark.createDataFrame([(int(a), int(b), float(d[a, b])) for a, b in zip(u, v)], density.EDGE))[0].collect()
    got = density.spanning_forest(density.link_forest(_nodes(spark, x), DIMS, 0.05, heights=True, **args))[0].collect()
    assert len(got) == len(want) and abs(sum(r["w"] for r in got) - sum(r["w"] for r in want)) < 1e-7


@pytest.mark.parametrize("args", [{}, {"block": 16}, {"block": 16, "sample": 128, "chunk": 2}])
def test_large_cell_that_is_not_tight(spark, args):
    # two arcs 20 degrees apart in one cell, with a few points off them
    rng = np.random.default_rng(23)
    angle = np.radians(np.r_[0, rng.uniform(10, 25, 400), -rng.uniform(10, 25, 400)])
    x = np.c_[np.cos(angle), np.sin(angle), rng.standard_normal((len(angle), DIMS - 2)) * 0.003][1:]
    x = np.concatenate([x, x[::80] + rng.standard_normal((10, DIMS)) * 0.1])
    links = density.link_forest(_nodes(spark, x), DIMS, 0.05, **args)
    _, labels = density.spanning_forest(links)
    want = _components(_distance(x), 0.05, 2)
    assert {(r["id"], r["comp"]) for r in labels.collect()} == want and len({c for _, c in want}) > 1


def test_linked_sets_with_copies(spark):
    x = _cloud(5)
    x = np.concatenate([x, np.repeat(x[:1], 150, axis=0)])
    points = vectors.unit_points(_table(spark, x, BAD), DIMS)
    got = {(r["id"], r["comp"]) for r in density.linked_sets(points, DIMS, 0.05, 5).collect()}
    assert got == _components(_distance(x), 0.05, 5)
    assert density.linked_sets(points.limit(0), DIMS, 0.05, 5).count() == 0


def test_boruvka_takes_the_least_edges(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    far, _ = density.spanning_forest(df, local_edges=0)
    near, _ = density.spanning_forest(df, local_edges=10**9)
    rows = far.collect()
    assert len(rows) == near.count() and abs(sum(r["w"] for r in rows) - sum(r["w"] for r in near.collect())) < 1e-9


def test_hierarchy_finds_the_groups(spark):
    x = _cloud(8, n_groups=4, each=30, noise=20)
    labels, clusters = hierarchy.density_clusters(vectors.unit_points(_table(spark, x), DIMS), DIMS, levels=3)
    rows = {r["point_id"]: r["y_cluster"] for r in labels.collect()}
    assert len(rows) == len(x)
    summary = clusters.collect()
    assert {r["cluster_id"] for r in summary} == set(rows.values()) - {-1}
    for r in summary:
        inside = [i for i, c in rows.items() if c == r["cluster_id"]]
        assert r["n_points"] == len(inside) and min(inside) == r["cluster_id"] and set(r["exemplars"]) <= set(inside)
    assert len(summary) >= 4


def test_stable_clusters_prefers_lasting_parts(spark):
    # one component that splits into two parts of four at the second level; the parts last
    chain = [(i, "0:0", f"1:{i // 4 * 4}", f"1:{i // 4 * 4}") for i in range(8)]
    df = spark.createDataFrame(chain, "id bigint, k0 string, k1 string, k2 string")
    members, chosen = hierarchy.stable_clusters(df, [0.3, 0.2, 0.1])
    assert {r["cluster"] for r in chosen.collect()} == {"1:0", "1:4"} and members.count() == 8


def test_nearest_against_brute_force(spark):
    x = _cloud(6, n_groups=20, each=40)
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0), x[5:9] * 3])
    d = _distance(x)
    np.fill_diagonal(d, 9)
    points = vectors.unit_points(_table(spark, x, BAD), DIMS)
    got = {r["id"]: [(n["dist"], n["id"]) for n in r["near"]] for r in forest.nearest(points, DIMS, 10).collect()}
    hits = total = 0
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:10]
        want = {(round(float(d[i, j]), 6), int(j)) for j in order}
        mine = {(round(a, 6), b) for a, b in got[i]}
        hits, total = hits + len(want & mine), total + 10
        assert [a for a, _ in got[i]] == sorted(a for a, _ in got[i]) and i not in [b for _, b in got[i]]
    assert hits / total > 0.97
    near = forest.nearest(points, DIMS, 10, max_dist=0.05).collect()
    assert all(n["dist"] <= 0.05 for r in near for n in r["near"])
    assert forest.nearest(points.limit(0), DIMS, 10).count() == 0
    assert forest.nearest(points.filter("id = 3"), DIMS, 10).count() == 0


def _recall(spark, x, rows, **forest_args):
    d = _distance(x)
    np.fill_diagonal(d, 9)
    points = vectors.unit_points(_table(spark, x), DIMS)
    got = {r["id"]: {n["id"] for n in r["near"]} for r in forest.nearest(points, DIMS, 10, **forest_args).collect()}
    return np.mean([len(got[i] & set(np.lexsort((np.arange(len(x)), d[i]))[:10].tolist())) / 10 for i in rows])


def test_nearest_in_a_dense_group_of_a_third(spark):
    rng = np.random.default_rng(9)
    dense = rng.standard_normal(DIMS) + rng.standard_normal((700, DIMS)) * 3e-3
    x = np.concatenate([dense, _cloud(9, n_groups=50, each=27, noise=50)])
    assert _recall(spark, x, range(0, 700, 7), want=24, leaf=400) > 0.9


def test_nearest_of_points_alike_after_rounding(spark):
    # 300 distinct directions at rounded distance 0: everyone's nearest are the smallest ids
    rng = np.random.default_rng(10)
    x = np.concatenate([_cloud(10, n_groups=4, each=25), rng.standard_normal(DIMS) + rng.standard_normal((300, DIMS)) * 1e-7])
    assert _recall(spark, x, range(140, len(x)), want=48) == 1


def test_leaves_share_out_the_points(spark):
    # a third of the points in one dense group, parted as evenly as the others
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.standard_normal(DIMS) + rng.standard_normal((2000, DIMS)) * 1e-4, rng.standard_normal((4000, DIMS))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = forest.Top(x[rng.permutation(len(x))[:3000]], 16, rng)
    sizes = np.unique(top.leaf(x), return_counts=True)[1]
    assert top.n == len(sizes) == 16 and sizes.max() < 2 * len(x) / 16
    assert set(forest.Top(x[:0], 1, rng).leaf(x)) == {0} and forest.Top(np.repeat(x[:1], 99, axis=0), 4, rng).n == 1


def test_strings_are_sorted_with_their_shared_prefixes():
    rng = np.random.default_rng(15)
    unit = np.concatenate([rng.standard_normal((500, DIMS)), 1 + rng.standard_normal((300, DIMS)) * 1e-3])
    order, shared, tight = forest._strings(unit, 20, np.random.default_rng(1))
    assert sorted(order) == list(range(len(unit))) and shared[0] == -1 and (shared[1:] >= 0).all() and not tight
    # the first 63 bits, worked out anew
    bits = (unit - unit.mean(axis=0)) @ np.random.default_rng(1).standard_normal((DIMS, forest.BITS)) > 0
    for i in range(1, len(unit)):
        a, b = bits[order[i - 1]], bits[order[i]]
        same = int((a != b).argmax()) if (a != b).any() else forest.BITS
        assert min(int(shared[i]), forest.BITS) == same


def test_candidates_closer_than_float32_resolves(spark):
    # 60 neighbours of one point whose distances differ by less than float32 resolves, often tied: smaller ids first
    rng = np.random.default_rng(11)
    side = rng.standard_normal((60, DIMS - 1))
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    dist = 0.01 + rng.integers(0, 12, 60) * 1e-9
    x = np.concatenate([np.c_[1 - dist, side * np.sqrt(1 - (1 - dist) ** 2)[:, None]], np.eye(1, DIMS)])
    points = vectors.unit_points(_table(spark, x), DIMS)
    unit = np.array([np.frombuffer(r["unit"]) for r in points.orderBy("id").collect()])
    d = np.round(1 - unit[:60] @ unit[60], 9)
    want = np.lexsort((np.arange(60), d))[:10]
    got = {r["id"]: [n["id"] for n in r["near"]] for r in forest.nearest(points, DIMS, 10).collect()}
    assert got[60] == want.tolist()


def test_blocks_change_no_merge_height(spark):
    # two tight subgroups 0.02 from each other in one cell
    rng = np.random.default_rng(12)
    a, b = np.eye(2, DIMS)
    x = np.concatenate([a + off * b + rng.standard_normal((60, DIMS)) * 0.004 for off in (-0.1, 0.1)])
    points = vectors.unit_points(_table(spark, x), DIMS)
    got = []
    for block in (4096, 16):
        labels, clusters = hierarchy.density_clusters(points, DIMS, block=block)
        got.append((sorted(labels.collect()), sorted((r["cluster_id"], r["n_points"], round(r["stability"], 6)) for r in clusters.collect())))
    assert got[0] == got[1] and len(got[0][1]) == 2


def test_hierarchy_splits_below_any_level(spark):
    # two dense groups 0.002 apart, each with distances of about 1e-6
    rng = np.random.default_rng(13)
    a, b = np.eye(2, DIMS)
    x = np.concatenate([a + off * b + rng.standard_normal((40, DIMS)) * 0.0005 for off in (-0.03, 0.03)])
    labels, clusters = hierarchy.density_clusters(vectors.unit_points(_table(spark, x), DIMS), DIMS)
    rows = [r["y_cluster"] for r in labels.orderBy("point_id").collect()]
    assert not set(rows[:40]) & (set(rows[40:]) - {-1}) and len({c for c in rows if c >= 0}) >= 2
    assert all(r["stability"] > 0 for r in clusters.collect())


def test_condense_weighs_every_merge():
    # two groups of three, joined within at 0.01 and 0.02, to each other at 0.04; a sixth point falls out at 0.05 (= reach)
    ids = np.arange(7)
    u, v = np.array([0, 1, 3, 4, 2, 5]), np.array([1, 2, 4, 5, 3, 6])
    w = np.array([0.01, 0.01, 0.02, 0.02, 0.04, 0.05])
    row, own, depth, stability = hierarchy.condense(ids, np.ones(7, int), np.zeros(7), u, v, w, 0.05, 3)
    assert row.tolist() == list(range(6)) and len(set(own[:3])) == len(set(own[3:])) == 1 and own[0] != own[3]
    assert np.allclose(depth, [100] * 3 + [50] * 3)
    assert np.allclose([stability[own[0]], stability[own[3]]], [3 * (100 - 25), 3 * (50 - 25)])
