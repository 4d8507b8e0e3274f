"""One behaviour whatever the size: parity of physical forms, and cases that used to be refused."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytoplane.operators import annotation as A
from cytoplane.operators import cluster as K
from cytoplane.operators import cohort as C
from cytoplane.operators import graph as G
from cytoplane.operators import hvg as H
from cytoplane.operators import losses as L
from cytoplane.operators import matching
from cytoplane.operators import metrics as M
from cytoplane.operators import similarity as S
from cytoplane.operators import text as X
from cytoplane.sources import records as R


def rows_of(df):
    return sorted(map(str, df.collect()))


# ------------------------------------------------------------------- cohorts


def test_means_of_more_than_ten_thousand_genes(spark):
    expr = spark.createDataFrame([(1, 5, 2.0), (1, 10_049, 4.0), (2, 5, 6.0), (3, 7, 1.0)], "cell_id long, gene_id long, value double")
    obs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "cell_id long, sample string")
    genes = spark.range(10_050).withColumnRenamed("id", "gene_id")
    got = C.mean_by_sample(expr, obs, genes)
    assert got.count() == 2 * 10_050
    assert {(r["sample"], r["gene_id"]): r["mean_value"] for r in got.where("mean_value > 0").collect()} == {
        ("a", 5): 4.0, ("a", 10_049): 2.0, ("b", 7): 1.0,
    }


def test_composition_keeps_missing_clusters_and_odd_names(spark):
    rows = spark.createDataFrame([("`x`", "s"), ("`x`", "s"), (None, "s"), ("s", "t")], "cluster string, s string")
    got = {(r["s"], r["cluster"]): r["share"] for r in C.composition(rows, "cluster", "s").collect()}
    assert got == {("s", "`x`"): 2 / 3, ("s", None): 1 / 3, ("s", "s"): 0.0, ("t", "`x`"): 0.0, ("t", None): 0.0, ("t", "s"): 1.0}


def test_scores_of_cells_without_marker_rows(spark):
    expr = spark.createDataFrame([(1, 1, 4.0), (1, 9, 6.0)], "cell_id long, gene_id long, value double")
    markers = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "set_name string, gene_id long")
    cells = spark.createDataFrame([(1,), (2,)], "cell_id long")
    got = {(r["cell_id"], r["set_name"]): r["score"] for r in C.signature_score(expr, cells, markers, 10).collect()}
    assert got == {(1, "A"): 1.0, (1, "B"): -1.0, (2, "A"): 0.0, (2, "B"): 0.0}


def test_top_genes_of_each_label(spark):
    weights = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 3, 0.9), (3, 1, 0.1)], "cell_id long, gene_ix long, weight double")
    obs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "cell_id long, grp string")
    got = C.attention_summary(weights, obs, "grp", n_top=2).orderBy("grp", "rank").collect()
    assert [(r["grp"], r["gene_ix"], r["rank"]) for r in got] == [("a", 3, 1), ("a", 1, 2), ("b", 1, 1)]


# ------------------------------------------------------- genes over batches


def test_gene_of_one_batch_counts_zero_elsewhere(spark):
    """A gene shown by one batch only has its score divided by the number of batches."""
    rng = np.random.default_rng(0)
    rows = [
        (b, g, float(rng.uniform(0.1, 3)), float(rng.uniform(0.1, 9)))
        for b in range(3) for g in range(60) if g != 7 or b == 0
    ]
    moments = spark.createDataFrame(rows, "batch int, gene_id long, mean double, variance double")
    scored = {(r["batch"], r["gene_id"]): r["score"] for r in H.normalized_dispersion(moments).collect()}
    got = {r["gene_id"]: r["score"] for r in H.select_hvg_batched(moments, 60).collect()}
    for gene in (3, 7, 20):
        per_batch = [scored[b, gene] if (b, gene) in scored else 0.0 for b in range(3)]
        known = [s for s in per_batch if s is not None]
        assert got[gene] == (pytest.approx(sum(known) / len(known), abs=1e-9) if known else None)


# -------------------------------------------------------------------- text


@pytest.fixture()
def vocab(spark):
    rows = [("[UNK]", 0), ("a", 1), ("##b", 2), ("ab", 3), ("c", 4), ("c", 9), ("zz", 4)]
    return spark.createDataFrame(rows, "token string, id long")


def test_ids_to_tokens_both_forms(spark, vocab):
    rows = spark.createDataFrame([(1, [0, 7, 1]), (2, []), (3, [4, 4]), (4, None)], "doc_id long, ids array<int>")
    small = {r["doc_id"]: r["tokens"] for r in X.ids_to_tokens(rows, vocab).collect()}
    large = {r["doc_id"]: r["tokens"] for r in X.ids_to_tokens(rows, vocab, limit=0).collect()}
    assert small == large == {1: ["[UNK]", "[UNK]", "a"], 2: [], 3: ["c", "c"], 4: []}


def test_wordpiece_both_forms(spark, vocab):
    docs = spark.createDataFrame([(1, ["ab", "abb", "c", "qq"]), (2, [])], "doc_id long, words array<string>")
    assert rows_of(X.wordpiece(docs, vocab)) == rows_of(X.wordpiece(docs, vocab, limit=0))
    assert rows_of(X.whole_word_ids(docs, vocab)) == rows_of(X.whole_word_ids(docs, vocab, limit=0).select("doc_id", "words", "ids"))
    empty = vocab.where("1 = 0")
    assert rows_of(X.wordpiece(docs, empty)) == rows_of(X.wordpiece(docs, empty, limit=0))


def test_load_vocab_by_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_bytes("[PAD]\r\n[UNK]\n the \nthe\né".encode())
    got = X.load_vocab(spark, str(tmp_path / "v.txt"), start=1).collect()
    assert {r["token"]: r["id"] for r in got} == {"[PAD]": 1, "[UNK]": 2, "the": 3, "é": 5}
    saved = spark.createDataFrame([(f"t{i}", i) for i in range(300)], "token string, id long")
    X.save_vocab(saved.repartition(7), str(tmp_path / "parts"))
    assert {(r["token"], r["id"]) for r in X.load_vocab(spark, str(tmp_path / "parts")).collect()} == {(f"t{i}", i) for i in range(300)}


def test_common_runs_and_subsequences_by_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = "".join(rng.choice("abd") for _ in range(rng.randint(0, 14)))
        runs = [(-n, i + n, j + n) for i in range(len(a)) for j in range(len(b)) for n in range(1, 15) if len(a[i : i + n]) == n and a[i : i + n] == b[j : j + n]]
        want = min(runs, default=(0, 0, 0))
        assert X.common_run(a, b) == (-want[0], want[1], want[2])
        pairs = X.common_subsequence(a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_segments_keep_the_text_and_the_limit():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("ab. \n") for _ in range(rng.randint(0, 80)))
        pieces = X._pieces(text, 9, "\n. ", None)
        assert "".join("".join(pieces).split()) == "".join(text.split())
        for p in pieces:
            # a longer piece is one that no separator can cut
            assert len(p) <= 9 or not any(s in p.strip() for s in " \n") or max(map(len, p.split())) >= 8


def test_offsets_of_lowered_text(spark):
    df = spark.createDataFrame([("Ab́C\x00 Éd", ["ab", "##c", "ed"])], "t string, k array<string>")
    got = df.select(X.token_offsets(F.col("t"), F.col("k"), lower=True).alias("o")).first()["o"]
    assert [(o["start"], o["end"]) for o in got] == [(0, 2), (3, 4), (6, 8)]


# ------------------------------------------------------------ other operators


def test_dense_rows_of_a_wide_vocabulary(spark):
    recs = spark.createDataFrame([(i, [i, 199_999], [1.0, 2.0]) for i in range(40)], "cell_id long, feature array<long>, value array<double>")
    got = R.densify(recs, 200_000, 0.5, batch_bytes=4 << 20).select(
        "cell_id", F.size("feature").alias("n"), F.aggregate("value", F.lit(0.0), lambda a, x: a + x).alias("s")
    )
    assert {(r["n"], r["s"]) for r in got.collect()} == {(200_000, 100_003.0)}


def test_assignment_in_parts_equals_all_permutations(spark):
    rng = random.Random(10)
    for _ in range(4):
        # two parts that share no rows, of three labels and three clusters each
        data = [(t + 10 * k, rng.randint(0, 2) + 10 * k) for k in (0, 1) for t in [rng.randint(0, 2) for _ in range(20)]]
        labels, clusters = sorted({t for t, _ in data}), sorted({p for _, p in data})
        size = max(len(labels), len(clusters))
        labels = labels + [None] * (size - len(labels))
        best = max(sum(dict(zip(clusters, order)).get(p) == t for t, p in data) for order in itertools.permutations(labels, len(clusters)))
        got = M.cluster_accuracy(spark.createDataFrame(data, "truth int, pred int")).first()
        assert (got["matched"], got["n"]) == (best, 40)


def test_many_labels_are_not_refused(spark):
    rows = spark.range(6000).select(F.col("id").alias("truth"), (F.col("id") + 1).alias("pred"))
    assert M.cluster_accuracy(rows).first()["matched"] == 6000


def test_losses_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(0, i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), int(i % 3)) for i in range(23)]
    df = spark.createDataFrame(rows, "minibatch_id long, id long, a array<double>, b array<double>, label int")
    vecs = df.select("minibatch_id", "id", F.col("a").alias("vec"), "label")
    whole = [L.contrastive_loss(df).first()["loss"], L.supervised_contrastive(vecs).first()["loss"]]

    def direct(v, w):
        u = np.vstack([v, w])
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        s = u @ u.T / L.CONTRASTIVE_TEMPERATURE
        np.fill_diagonal(s, -np.inf)
        n = len(v)
        return np.mean([np.log(np.exp(s[i]).sum()) - s[i, (i + n) % (2 * n)] for i in range(2 * n)]) * 2

    assert whole[0] == pytest.approx(direct(np.array([r[2] for r in rows]), np.array([r[3] for r in rows])))


def test_soft_assignment_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(9)], "id long, vec array<double>")
    centres = rng.normal(size=(5, 3))
    whole = {r["id"]: r["q"] for r in K.soft_assign(pts, centres).collect()}
    monkeypatch.setattr(K, "CENTRE_BYTES", 48)
    parts = {r["id"]: r["q"] for r in K.soft_assign(pts, centres).collect()}
    assert all(np.allclose(whole[i], parts[i], atol=1e-12) for i in whole)


def test_neighbours_in_both_forms(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(30)], "id long, vec array<double>")
    assert rows_of(S.knn(pts, pts, 3)) == rows_of(S.knn(pts, pts, 3, resident_bytes=0, block_rows=7))
    empty = pts.where("1 = 0")
    assert S.knn(pts, empty, 3).count() == S.knn(pts, empty, 3, resident_bytes=0, block_rows=7).count() == 0


def test_two_cliques_are_the_communities(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 8) for b in range(base, base + 8) if a != b]
    edges += [(0, 10, 1.0), (10, 0, 1.0)]
    got = G.communities(spark.createDataFrame(edges, "src long, dst long, w double"), [1.0]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["label"], set()).add(r["node"])
        assert r["settled"]
    assert sorted(map(sorted, groups.values())) == [list(range(8)), list(range(10, 18))]


def test_full_pairing(spark):
    a = spark.createDataFrame([(1, [1]), (2, [2])], "cell_id long, feature array<long>")
    b = spark.createDataFrame([(2, [5]), (3, [6])], "cell_id long, feature array<long>")
    got = {r["cell_id"]: (r["feature_x"], r["feature_y"], r["present_in"]) for r in A.pair_all(a, b, ("x", "y")).collect()}
    assert got == {1: ([1], None, "x"), 2: ([2], [5], "both"), 3: (None, [6], "y")}
    assert {(r["cell_id"], r["present_in"]) for r in A.unpaired(a, b, ("x", "y")).collect()} == {(1, "x"), (3, "y")}


def test_positions_in_a_hot_group_move_no_rows(spark):
    from cytoplane.operators.ordering import with_position_in_group

    df = spark.range(500).select("id", F.lit("all").alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = with_position_in_group(df, ["g"], ["id"], "pos")
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(g" not in plan
        assert {(r["id"], r["pos"]) for r in placed.collect()} == {(i, i) for i in range(500)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _best_total(cells):
    """Largest total of a one-to-one match, by trying all."""
    table = {(a, b): n for a, b, n in cells}
    rows = sorted({a for a, _, _ in cells})

    def best(k, taken):
        if k == len(rows):
            return 0
        own = [(b, n) for (a, b), n in table.items() if a == rows[k] and b not in taken]
        return max([best(k + 1, taken)] + [n + best(k + 1, taken | {b}) for b, n in own])

    return best(0, frozenset())


def _one_to_one(got, cells):
    assert len({r["a"] for r in got}) == len({r["b"] for r in got}) == len(got)
    assert {tuple(r) for r in got} <= set(cells)


@pytest.mark.parametrize("limits", [{}, {"DRIVER_CELLS": 0}, {"DENSE_CELLS": 0}])
def test_matching_in_every_form(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(matching, name, value)
    rng = np.random.default_rng(8)
    cells = [(a, f"c{b}", int(rng.integers(1, 9))) for a in range(5) for b in range(4) if rng.random() < 0.8]
    got = matching.best_pairs(spark.createDataFrame(cells, "a int, b string, n long")).collect()
    _one_to_one(got, cells)
    assert sum(r["n"] for r in got) == _best_total(cells)
    assert matching.best_pairs(spark.createDataFrame([], "a int, b string, n long")).collect() == []


def test_auction_with_ties_and_large_counts(spark):
    for cells in ([(a, b, 3) for a in range(4) for b in range(3)], [(0, 0, 10**9), (0, 1, 10**9 - 1), (1, 0, 10**9 - 1)], [(7, 7, 1)]):
        got = matching.auction(spark.createDataFrame(cells, "a int, b int, n long")).collect()
        _one_to_one(got, cells)
        assert sum(r["n"] for r in got) == _best_total(cells)


def test_safe_pairs_lose_nothing(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        cells = [(a, b, int(rng.integers(1, 6)) * (5 if a == b else 1)) for a in range(6) for b in range(6) if rng.random() < 0.7]
        table = spark.createDataFrame(cells, "a int, b int, n long")
        safe = matching.safe_pairs(table).collect()
        _one_to_one(safe, cells)
        rest = [c for c in cells if c[0] not in {r["a"] for r in safe} and c[1] not in {r["b"] for r in safe}]
        assert sum(r["n"] for r in safe) + _best_total(rest) == _best_total(cells)


def test_grid_of_a_large_dimension_is_made_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "i int, name string")
    others = spark.createDataFrame([(None, "x")] + [(k, "y" * k) for k in range(30)], "k int, text string")
    want = sorted(map(str, C.with_each(rows, others).collect()))
    monkeypatch.setattr(C, "SHARED_BYTES", 200)
    got = C.with_each(rows, others)
    assert got.columns == ["i", "name", "k", "text"]
    assert sorted(map(str, got.collect())) == want
    assert len(want) == 5 * 31
    assert C.with_each(rows, others.limit(0)).count() == 0


def test_word_pieces_are_cut_in_bounded_slices(spark, monkeypatch):
    lists = pa.array([["ab", "a"], None, [], ["ab"] * 7, ["b", "ab"], ["a"]], pa.list_(pa.string()))
    vocab = {"[UNK]": 0, "a": 1, "##b": 2}
    whole = X._cut_words(lists, vocab, 3, {}).to_pylist()
    assert whole[0] == {"pieces": ["a", "##b", "a"], "ids": [1, 2, 1]} and whole[1] == whole[2] == {"pieces": [], "ids": []}
    assert whole[4] == {"pieces": ["b", "a", "##b"], "ids": [0, 1, 2]}
    monkeypatch.setattr(X, "AT_ONCE", 3)
    seen = []

    def work(part):
        seen.append(len(part.flatten()))
        return X._cut_words(part, vocab, 3, {})

    assert X._by_slices(lists, work, X._PIECES).to_pylist() == whole
    assert seen == [2, 7, 3]  # a row longer than the bound goes alone
    named = X._by_slices(
        pa.array([[2, 9, 1], None, [None, 2]], pa.list_(pa.int32())),
        lambda part: X._named(part, np.array([1, 2]), pa.array(["a", "##b", X.UNK])),
        pa.list_(pa.string()),
    )
    assert named.to_pylist() == [["##b", X.UNK, "a"], [], [X.UNK, "##b"]]


def test_rows_without_words_have_no_pieces(spark):
    docs = spark.createDataFrame([(1, None), (2, ["ab"])], "doc_id long, words array<string>")
    vocab = spark.createDataFrame([("[UNK]", 0), ("a", 1), ("##b", 2)], "token string, id long")
    for limit in ({}, {"limit": 0}):
        got = {r["doc_id"]: (r["pieces"], r["ids"]) for r in X.wordpiece(docs, vocab, **limit).collect()}
        assert got == {1: ([], []), 2: (["a", "##b"], [1, 2])}


def test_places_are_found_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(X, "AT_ONCE", 2)
    tokens = pa.array([["[CLS]", "un", "##able", "ok"], [], None, ["a"], ["b"]], pa.list_(pa.string()))
    texts = pa.array(["un\x01able ok", "x", None, " a", "b"])
    sizes = []

    def work(part, text):
        sizes.append(len(part.flatten()))
        return X._located(part, text, False)

    got = X._by_slices(tokens, work, pa.list_(X._SPAN), texts).to_pylist()
    assert [[s and (s["start"], s["end"]) for s in row] for row in got] == [[None, (0, 2), (3, 7), (8, 10)], [], [], [(1, 2)], [(0, 1)]]
    assert sizes == [4, 2]
    found = X._located(tokens[:1], texts[:1], False, with_text=True).to_pylist()[0]
    assert [s and s["text"] for s in found] == [None, "un", "able", "ok"]


@pytest.mark.parametrize("name", ["wordpiece_tokenize", "wordpiece_tokenize_by_join", "encode_text", "decode_ids", "token_offsets"])
def test_words_of_documents_are_not_written(spark, tmp_path, monkeypatch, name):
    from cytoplane.plans import QUERIES
    from cytoplane.plans import text as plan

    spark.createDataFrame([(1, "an able man"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    plain = plan.cut
    monkeypatch.setattr(plan, "cut", lambda df: written.append(df.schema) or plain(df))
    assert QUERIES[name](spark, str(tmp_path)).count() == 3
    assert written and not any(f.dataType.typeName() == "array" for s in written for f in s)
