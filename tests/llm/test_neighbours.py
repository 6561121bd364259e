import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.llm import common, neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asks, k):
    """Exact lists per asking id: valid vectors only, of the greatest length."""
    ok = [(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = {(i, v) for i, v in ok if len(v) == width}
    found = {}
    for i, v in ok:
        if not asks(i):
            continue
        best = found.setdefault(i, {})
        for j, w in ok:
            if i != j:
                s = float((np.array(v, "float64") * np.array(w, "float64")).sum())
                best[j] = max(best.get(j, -np.inf), s)
    return {i: sorted(b.items(), key=lambda x: (-x[1], x[0]))[:k] for i, b in found.items()}


def lists(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = found.setdefault(r["query_id"], [])
        assert r["rank"] == len(got) + 1
        got.append((r["vec_id"], r["score"]))
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def recall(got, want):
    return sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


def odd_rows(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(50)]  # copies of one vector
    rows += [(200, [0.0] * 8), (201, None), (202, []), (203, [1.0] * 3), (204, [None] + [1.0] * 7), (205, [float("nan")] * 8),
             (206, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[5][1]), (5, rows[5][1]), (20, rows[9][1]), (0, [-0.0] * 7 + [1.0])]
    return rows


def test_small_table_is_exact_with_ties_copies_and_invalid_rows(spark, clashing):
    rows = odd_rows()
    want = brute(rows, lambda i: i % 20 == 0, 5)
    got = lists(neighbours.nearest(clashing(frame(spark, rows)), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=5, trees=2,
                                   recall=1.0, leaf_rows=200))
    assert got == want


@pytest.mark.parametrize("data", ["sphere", "clusters", "lengths"])
def test_recall_and_scores_against_brute_force(spark, data):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    if data == "clusters":
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] * 3 + x * 0.3
    if data != "lengths":
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(x)]
    want = brute_matrix(rows, 50, 20)
    got = lists(neighbours.nearest(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 50 == 0, shelf_bytes=20_000, sample_rows=1000))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = np.array([v for _, v in rows], "float32").astype("float64")
    assert all(s == (exact[i] * exact[j]).sum() for i, v in got.items() for j, s in v)


def brute_matrix(rows, every, k):
    x = np.array([v for _, v in rows], "float32").astype("float64")
    found = {}
    for i in range(0, len(x), every):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:k]
        found[i] = [(int(j), float(s[j])) for j in order]
    return found


def test_structured_data_is_searched_in_part(spark):
    """On clusters the stop lets a search see a small share of the table."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] * 5 + rng.normal(size=(2000, 16)) * 0.2
    forest = neighbours.fit(x, float(np.sqrt((x * x).sum(axis=1)).max()), 20)
    assert forest.share < 0.5
    everywhere = neighbours.fit(rng.normal(size=(2000, 16)), 8.0, 20)
    assert forest.share < everywhere.share


def test_queue_names_leaves_in_order_and_each_once():
    rng = np.random.default_rng(3)
    points = neighbours.lifted(rng.normal(size=(500, 6)), 6.0)
    forest = neighbours.Forest([neighbours.grow(points, rng, 20) for _ in range(3)], 6.0, 1.0)
    queries = neighbours.asking(rng.normal(size=(4, 6)))
    for q, walk in zip(queries, neighbours.visits(forest, queries)):
        order = list(walk)
        assert sorted(order) == list(range(forest.first_leaf[-1]))
        own = [neighbours.route(t, q[None])[0] + f for t, f in zip(forest.trees, forest.first_leaf)]
        assert set(order[:3]) == set(own)
        costs = {}
        for t, f in zip(forest.trees, forest.first_leaf):
            todo = [(0, 0.0)]
            while todo:
                at, cost = todo.pop()
                if at < 0:
                    costs[~at + f] = cost
                    continue
                m = float(q @ t.normal[at] - t.cut[at])
                todo += [(int(t.child[at][0]), cost + max(m, 0) ** 2), (int(t.child[at][1]), cost + max(-m, 0) ** 2)]
        assert all(costs[a] <= costs[b] + 1e-12 for a, b in zip(order, order[1:]))


def test_equal_points_do_not_split_for_ever():
    tree = neighbours.grow(np.ones((100, 4)), np.random.default_rng(0), 8)
    assert tree.leaves == 1 and not neighbours.route(tree, np.ones((3, 4))).any()


def test_shelves_bound_rows_and_parts_cover_large_leaves():
    sizes = np.array([5, 5, 30, 1, 1, 0, 9, 4])
    shelf, parts = neighbours._shelves(sizes, 10, np.array([0, 4, 8]))
    assert parts.tolist() == [1, 1, 3, 1, 1, 1, 1, 1]
    load = {}
    for s, p, n in zip(shelf, parts, sizes):
        for i in range(p):
            load[s + i] = load.get(s + i, 0) + n / p
    assert max(load.values()) <= 11 and shelf[4] != shelf[3]


def test_few_rows_nobody_asks_and_empty_tables(spark):
    two = frame(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])])
    near = lambda df, asks: lists(neighbours.nearest(df, "vec_id", "embedding", asks))
    assert near(two, F.col("vec_id") == 0) == {0: [(3, 4.0)]}
    assert near(two, F.col("vec_id") == 9) == {}
    assert near(two.filter("vec_id = 0"), F.lit(True)) == {}
    assert near(two.filter("false"), F.lit(True)) == {}


def test_double_and_very_large_components(spark):
    rows = [(i, [1e300 * (i + 1), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") == 0).count() == 20
    small = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, 0.1]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = lists(neighbours.nearest(small, "vec_id", "embedding", F.col("vec_id") == 0))
    assert got == {0: [(2, 0.1), (1, 0.1 * 0.3 + 0.2 * 0.1)]}


def test_spread_join_splits_one_key(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 900, "a").when(F.col("id") < 950, "b").alias("x"), F.col("id").alias("by"))
    one = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "x string, y int")
    got = common.spread_join(many, one, "x", "by", rows=100)
    assert got.count() == 950 and {(r["x"], r["y"]) for r in got.collect()} == {("a", 1), ("b", 2)}
