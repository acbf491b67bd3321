"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import forest, vector_dedup
from tidegrid.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cell string, rank string"


@pytest.fixture(scope="session")
def vectors(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 16)).round(3)
    points[100:140] = points[0] + 0.1 * rng.normal(size=(40, 16))
    points[140:160] = points[1]
    rows = [(n, [float(x) for x in p], n % 2 if n < 290 else None, "x", "x", "x") for n, p in enumerate(points)]
    rows += [
        (300, None, 1, *"xxx"), (301, [0.0] * 16, 1, *"xxx"), (302, [float("nan")] * 16, 0, *"xxx"), (303, [None] * 16, 0, *"xxx"),
        (304, [float("inf")] * 16, 0, *"xxx"), (305, [1.0, 2.0], 0, *"xxx"), (306, [1.0, 2.0], 0, *"xxx"), (None, rows[0][1], 0, *"xxx"), (400, [], 0, *"xxx"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _matrix(frame):
    rows = [r for r in frame.collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    return [(r["vec_id"], r["label"], np.array(r["embedding"], float)) for r in rows]


def _cosine(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if len(a) == len(b) else -2.0


def test_near_duplicates_match_all_pairs(spark, vectors):
    rows = _matrix(vectors)
    links = [[j for j, b in enumerate(rows) if i != j and a[1] is not None and a[1] == b[1] and _cosine(a[2], b[2]) >= 0.93] for i, a in enumerate(rows)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[root[i]] = min(vec_id, least.get(root[i], vec_id))
    found = {r["vec_id"]: r for r in vector_dedup.near_duplicates(vectors).collect()}
    assert len(found) == vectors.count()
    for i, (vec_id, _, _) in enumerate(rows):
        assert (found[vec_id]["n_links"], found[vec_id]["component_id"]) == (len(links[i]), least[root[i]])
        assert found[vec_id]["kept"] == (vec_id == least[root[i]])
    for vec_id in (300, 301, 302, 303, 304, 400):
        assert (found[vec_id]["n_links"], found[vec_id]["component_id"]) == (0, vec_id)
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_link_is_lost_between_cells(spark):
    threshold = 0.8
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = np.roll(x, 1, axis=0)  # each partner lies towards another vector of the table
    side = other - (x * other).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = threshold + 0.005
    points = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * side])
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    want = (unit @ unit.T >= threshold).sum(axis=1) - 1
    rows = [(n, [float(v) for v in p], 1) for n, p in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(table, threshold=threshold).collect()}
    assert [found[n] for n in range(len(points))] == want.tolist()


def test_neighbours_match_brute_force(spark, vectors):
    rows = [r for r in _matrix(vectors) if r[0] is not None]
    asks = (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 305)
    found = {}
    for r in forest.neighbours(vectors, asks, 5, leaf=40, search_share=4.0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for vec_id, _, own in rows:
        if vec_id % 50 and vec_id != 305:
            continue
        near = sorted((-_cosine(own, b), i) for i, _, b in rows if i != vec_id and len(b) == len(own))[:5]
        total += len(near)
        hits += len({i for _, i in near} & {i for i, _ in found.get(vec_id, [])})
        for i, score in found[vec_id]:
            assert abs(score - _cosine(own, next(b for j, _, b in rows if j == i))) < 1e-12
    assert found[305] == [(306, pytest.approx(1.0))] and hits / total >= 0.9
    assert forest.neighbours(spark.createDataFrame([], SCHEMA), asks).count() == 0


def test_repeated_rows_and_ids_hide_no_neighbour(spark):
    rng = np.random.default_rng(3)
    hot, far = rng.normal(size=16), rng.normal(size=(60, 16))
    rows = [(i, hot) for i in (1, 1, 1, 2, 2, 2, 3)] + [(4, far[0])] * 6 + [(5, far[0])]
    rows += [(20, far[1])] + [(21, far[1] + 0.01 * rng.normal(size=16)) for _ in range(40)]  # one id, many near vectors
    rows += [(22 + n, far[1] + 0.2 * rng.normal(size=16)) for n in range(6)] + [(21, far[1])]
    rows += [(50, far[2] * n) for n in range(1, 40)] + [(51, far[2] * 50), (52, far[2] * 60)]
    rows += [(100 + n, p) for n, p in enumerate(far[3:])]
    rows = [(i, [float(x) for x in p]) for i, p in rows]
    asks = F.col("vec_id").isin(1, 3, 5, 20, 21, 51)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in forest.neighbours(table, asks, 5, leaf=1000).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for query in (1, 3, 5, 20, 21, 51):
        best = {}
        for i, a in rows:
            for j, b in rows if i == query else []:
                if j != query:
                    best[j] = max(best.get(j, -2.0), _cosine(np.array(a), np.array(b)))
        want = sorted((-round(s, 9), j) for j, s in best.items())[:5]
        assert sorted((-round(s, 9), j) for j, s in found[query]) == want


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, points = zip(*[(r["vec_id"], r["embedding"]) for r in table.collect()])
    unit = np.array(points) / np.linalg.norm(points, axis=1)[:, None]
    got = {(r["query_id"], r["vec_id"]) for r in forest.neighbours(table, F.col("vec_id") % 50 == 0).collect()}
    want = set()
    for n, vec_id in enumerate(ids):
        if vec_id % 50 == 0:
            score = unit @ unit[n]
            score[n] = -9
            want |= {(vec_id, ids[j]) for j in np.argsort(-score)[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(139, 200), (50, 50)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 140)}, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaves_that_a_query_visits_do_not_grow_with_the_vectors():
    points = np.random.default_rng(2).normal(size=(4_000, 8))
    visited = []
    for total in (20_000, 100_000):
        trees = forest.build(points, total, 3, 512)
        sizes = np.full((3, 1 << trees[0].depth), total >> trees[0].depth)
        visited.append(len(forest.search(trees, sizes, points[0], 1.8 * total)))
    assert visited[1] <= 1.1 * visited[0]
