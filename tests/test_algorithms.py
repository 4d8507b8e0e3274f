"""Distributed algorithms against brute force on small data."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoplane.operators import batching as B
from cytoplane.operators import cluster as K
from cytoplane.operators import graph as G
from cytoplane.operators import metrics as M
from cytoplane.operators import ordering as O
from cytoplane.operators import similarity as S
from cytoplane.operators import text as X

# ------------------------------------------------------------- shared runs


def _longest(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def _texts(rng, n):
    base = ["".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(60)), "".join(rng.choice("abc de") for _ in range(80)), "один два три четыре пять шесть семь"]
    out = [None, "", "one two three", "one two three", "我来到北京", "我来到北京清华大学", "é", "😀😀"]
    while len(out) < n:
        t = rng.choice(base)
        i = rng.randrange(len(t))
        out.append("".join(rng.choice("xyz 文") for _ in range(rng.randint(0, 12))) + t[i : i + rng.randint(1, 40)] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 9))))
    return out


@pytest.mark.parametrize("shared", [X.SHARED_BYTES, 0])
def test_every_pair_with_a_shared_run_is_found(spark, shared):
    rng = random.Random(5)
    a, b = _texts(rng, 110), _texts(rng, 90)
    left, right = (spark.createDataFrame(list(enumerate(t)), "id bigint, text string") for t in (a, b))
    got = {tuple(r) for r in X.candidate_pairs(left, right, 12, shared).collect()}
    want = {(i, j) for i, s in enumerate(a) for j, t in enumerate(b) if s and t and _longest(s, t) >= min(12, len(s), len(t))}
    assert got == want and len(want) > 100
    assert (2, 2) in got and (4, 5) in got and (7, 7) in got


def test_runs_of_short_and_unspaced_texts(spark):
    left = spark.createDataFrame([(1, "我来到北京清华大学"), (2, "a b c"), (3, None), (4, "")], "id bigint, text string")
    right = spark.createDataFrame([(7, "清华大学"), (8, "xx a b c yy"), (9, "我来到北京清华大学")], "id bigint, text string")
    rows = {(r["left_id"], r["right_id"]): r["length"] for r in X.longest_common_substring_join(left, right).collect()}
    assert rows == {(1, 7): 4, (1, 9): 9, (2, 8): 5}
    both = {(r["left_id"], r["right_id"]): r["length"] for r in X.longest_common_subsequence_join(left, right).collect()}
    assert both == rows


# ------------------------------------------------------------- silhouette


def test_silhouette_from_sums_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((70, 5)) + 1000.0
    label = [*rng.integers(0, 4, 69).tolist(), 9]  # the last is alone
    x[np.array(label) == 1] += 3
    d = ((x[:, None] - x) ** 2).sum(2)
    s = []
    for i, own in enumerate(label):
        others = [d[i][np.array(label) == c].mean() for c in set(label) if c != own]
        same = np.array(label) == own
        a = d[i][same].sum() / max(same.sum() - 1, 1)
        s.append(0.0 if same.sum() == 1 else (min(others) - a) / max(a, min(others)))
    points = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(70)], "id bigint, vec array<double>, label int")
    for block in (64 << 20, 64):  # all clusters at once, and one at a time
        row = M.silhouette_squared(points, block).first()
        assert row["silhouette"] == pytest.approx(np.mean(s), abs=1e-9) and row["n"] == 70
    assert M.silhouette_squared(points.where("1 = 0")).first()["silhouette"] is None


# ------------------------------------------------------------- metric index


@pytest.mark.parametrize("metric", ["inner", "euclidean"])
@pytest.mark.parametrize("drop_self", [False, True])
def test_index_gives_the_same_neighbours_and_visits_less(spark, metric, drop_self):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 6)) * 20
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.standard_normal((300, 6)), np.repeat(centres[:1], 150, 0)])  # a crowd of equal rows
    points = spark.createDataFrame([(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)], "id bigint, vec array<double>, label int")
    found, visits = S.knn_indexed(points, points, 6, metric, drop_self, block_rows=20, pivots=21)
    plain = S.knn(points, points, 6, metric, drop_self)
    key = ["query_id", "rank", "ref_id", "sim", "label"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))
    row = visits.first()
    assert row["visited"] < (0.5 if metric == "euclidean" else 0.9) * row["possible"]
    few = S.knn_indexed(points.limit(3), points.limit(4), 6, metric, drop_self)[0]
    assert few.count() == sum(4 - (drop_self and i < 4) for i in range(3))
    assert S.knn_indexed(points, points.where("1 = 0"), 6, metric)[0].collect() == []


# ------------------------------------------------------------- communities


def test_every_community_is_connected(spark):
    rng = np.random.default_rng(1)
    pairs = set()
    for g in range(6):
        own = range(g * 8, g * 8 + 8)
        pairs |= {(a, b) for a in own for b in own if a < b and rng.random() < 0.6}
    pairs |= {(a, b) for a in range(48) for b in range(a + 1, 48) if rng.random() < 0.03}
    both = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    edges = spark.createDataFrame(both, "src bigint, dst bigint, w double")
    found = G.communities(edges, [0.2, 1.0], rounds=8, levels=3).cache()
    quality = {r["res"]: r["modularity"] for r in G.modularity(edges, found).collect()}
    assert quality[1.0] > 0.45
    for res in (0.2, 1.0):
        label = {r["node"]: r["label"] for r in found.where(F.col("res") == res).collect()}
        assert len(label) == len({n for p in pairs for n in p})
        for c in set(label.values()):
            own = {n for n, x in label.items() if x == c}
            seen, todo = {c}, [c]
            while todo:
                n = todo.pop()
                near = {b for a, b, _ in both if a == n and b in own} - seen
                seen |= near
                todo += near
            assert seen == own


def test_a_torn_community_is_split(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in ((1, 2), (2, 1), (3, 4), (4, 3), (4, 5), (5, 4))], "src bigint, dst bigint, w double")
    torn = spark.createDataFrame([(1.0, n, 7) for n in range(1, 6)], "res double, node bigint, label bigint")
    got = {r["node"]: r["label"] for r in G.connected_parts(edges, torn).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}


# ------------------------------------------------------------- spectral


def test_eigenvectors_of_the_laplacian(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 3))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    edges = G.knn_graph(points, 8)
    _, values, errors = K.spectral_embedding(edges, 4)
    w = np.zeros((80, 80))
    for r in edges.collect():
        w[r["src"], r["dst"]] = r["w"]
    root = np.sqrt(w.sum(1))
    want = np.sort(1 - np.linalg.eigvalsh(w / np.outer(root, root)))[:4]
    assert errors.max() < 1e-3 and np.abs(values - want).max() < 1e-5


def test_two_rings_are_told_apart(spark):
    angle = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    rows = [(i, [float(r * np.cos(t)), float(r * np.sin(t))]) for r, base in ((1.0, 0), (4.0, 60)) for i, t in enumerate(angle, base)]
    points = spark.createDataFrame(rows, "id bigint, vec array<double>")
    got = {r["id"]: r["cluster"] for r in K.spectral(points, 2, 4, restarts=3).collect()}
    assert len({got[i] for i in range(60)}) == 1 == len({got[i] for i in range(60, 120)}) and got[0] != got[60]


# ------------------------------------------------------------- order and samples


@pytest.mark.parametrize("n", [0, 1, 37, 2999, 3000, 4000])
def test_sample_is_the_beginning_of_the_shuffle(spark, n, monkeypatch):
    monkeypatch.setattr(B, "_DIGITS", 1)
    monkeypatch.setattr(B, "_LAST", 5)
    rows = spark.range(3000).withColumn("key", F.col("id") % 2000)
    got = B.sample_n(rows, n, ["key"], 3)
    want = sorted(r["d"] for r in rows.select(B.seeded_key(3, "key").alias("d")).collect())[:n]
    assert sorted(r["d"] for r in got.select(B.seeded_key(3, "key").alias("d")).collect()) == want
    assert got.select("id").distinct().count() == min(n, 3000)


def test_running_figures_equal_pandas(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 400), "t": rng.permutation(400), "x": rng.integers(0, 100, 400).astype(float)})
    rows = [(None if g == 2 else int(g), int(t), None if x < 40 else float(x)) for g, t, x in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "g int, t int, x double").repartition(5)
    kinds = {k: (k, "x") for k in ("sum", "min", "max", "last")}
    for group in ([], ["g"]):
        for before in (False, True):
            got = {r["t"]: r for r in O.with_running(df, group, ["t"], kinds, before).collect()}
            for g, t, x in rows:
                held = [b for a, u, b in sorted(rows, key=lambda r: r[1]) if (u < t if before else u <= t) and (not group or a == g) and b is not None]
                want = (sum(held), min(held), max(held), held[-1]) if held else (None,) * 4
                assert tuple(got[t][k] for k in kinds) == want


# ------------------------------------------------------------- matrix files


def test_matrix_files_in_splits(spark, tmp_path):
    from cytoplane.sources import tables as T

    rng = random.Random(3)
    genes, cells = [f"G{i}\tENS{i}" for i in range(300)], [f"cell-{i}" for i in range(500)]
    entries = [(rng.randint(1, 300), rng.randint(1, 500), float(rng.randint(1, 9))) for _ in range(4000)]
    lines = ["%%MatrixMarket matrix coordinate real general", "% made here", f"300 500 {len(entries) + 1}"]
    lines += [f"{g} {c} {v}" for g, c, v in entries] + [f"300 500 {len(entries) + 1}"]  # an entry that reads like the head
    for name, rows in (("m.mtx", lines), ("g.tsv", genes), ("c.tsv", cells)):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for shared in (1 << 20, 0):
            found = T.read_matrix(spark, *(str(tmp_path / n) for n in ("m.mtx", "g.tsv", "c.tsv")), shared_bytes=shared)
            got = sorted(tuple(r) for r in found.collect())
            want = [(f"cell-{c - 1}", f"G{g - 1}", v) for g, c, v in entries] + [("cell-499", "G299", 4001.0)]
            assert got == sorted(want)
        assert [r["line"] for r in T.read_lines(spark, str(tmp_path / "g.tsv")).orderBy("pos").collect()] == genes
        (tmp_path / "g.tsv").write_text("one\n")
        with pytest.raises(ValueError, match="1 lines"):
            T.read_matrix(spark, *(str(tmp_path / n) for n in ("m.mtx", "g.tsv", "c.tsv")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# ------------------------------------------------------------- sparse components


def _records(spark, dense):
    rows = [(i, [int(g) for g in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, "cell_id bigint, feature array<bigint>, value array<double>").repartition(3)


def test_sparse_components_equal_the_dense_ones(spark):
    from cytoplane.operators import encode as E

    rng = np.random.default_rng(9)
    hidden = rng.standard_normal((120, 3)) @ (rng.standard_normal((3, 64)) * [[3], [2], [1]])
    dense = np.maximum(hidden + rng.standard_normal((120, 64)) * 0.3, 0)
    dense[:, 7] = 0.0  # shown by no cell
    dense[5] = 0.0  # an empty cell
    found, values = E.fit_sparse_embedding(_records(spark, dense), 64, 3, tolerance=1e-9)
    scale = dense.std(0, ddof=1)
    x = (dense - dense.mean(0)) / np.where(scale > 0, scale, 1)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.abs(values - (s**2 / 119)[:3]).max() < 1e-6
    want = x @ v[:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r["vec"] for r in found.orderBy("cell_id").collect()])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-3


def test_sparse_components_of_many_genes(spark):
    from cytoplane.operators import encode as E

    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):  # three kinds of cells, each with genes of its own among 20,000
        own = rng.choice(np.arange(i % 3 * 300, i % 3 * 300 + 300), 60, replace=False)
        genes = np.unique(np.concatenate([own, rng.integers(900, 20_000, 30)]))
        rows.append((i, [int(g) for g in genes], [1.0 + float(x) for x in rng.random(len(genes))]))
    records = spark.createDataFrame(rows, "cell_id bigint, feature array<bigint>, value array<double>")
    found, values = E.fit_sparse_embedding(records, 20_000, 2, rounds=6)
    vec = np.array([r["vec"] for r in found.orderBy("cell_id").collect()])
    near = vec @ vec.T
    same = np.arange(90)[:, None] % 3 == np.arange(90) % 3
    assert near[same].min() > near[~same].max() and values[0] >= values[1] > 0
