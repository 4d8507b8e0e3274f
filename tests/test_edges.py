"""Hand-made edge cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.functions import strings as ST
from cytoplane.functions import vectors as V
from cytoplane.operators import batching as B
from cytoplane.operators import cohort as C
from cytoplane.operators import encode as E
from cytoplane.operators import hvg as H
from cytoplane.operators import metrics as M
from cytoplane.operators import ordering as O
from cytoplane.operators import preprocess as P
from cytoplane.operators import similarity as S
from cytoplane.operators import text as X
from cytoplane.operators import transfer as T
from cytoplane.operators.matching import best_assignment
from cytoplane.session import workspace
from cytoplane.sources import records as R

EXPR = "cell_id bigint, gene_id bigint, value double"


def rows(df):
    return sorted(map(tuple, df.collect()))


# --------------------------------------------------------------- expression


def test_zero_total_and_small_cells(spark):
    expr = spark.createDataFrame([(1, 1, 0.0), (2, 1, 3.0), (2, 2, 1.0), (3, 1, 2.0)], EXPR)
    assert rows(P.normalize_total(expr, 100.0)) == [(1, 1, 0.0), (2, 1, 75.0), (2, 2, 25.0), (3, 1, 100.0)]
    assert {r[0] for r in rows(P.filter_cells(expr, 2))} == {2}
    assert rows(P.filter_genes(expr, 2)) == [(1, 1, 0.0), (2, 1, 3.0), (3, 1, 2.0)]
    fused = rows(P.preprocess(expr, 1, 100.0))
    stepped = rows(P.log1p(P.normalize_total(P.filter_cells(expr, 1), 100.0)).select("cell_id", "gene_id", "value"))
    assert [r[:2] for r in fused] == [r[:2] for r in stepped]
    assert [r[2] for r in fused] == pytest.approx([r[2] for r in stepped])


def test_gene_filter_counts_values_above_zero(spark):
    expr = spark.createDataFrame([(1, 1, 0.0), (2, 1, 3.0), (2, 2, 1.0), (3, 2, 2.0)], EXPR)
    assert {r["gene_id"] for r in P.filter_genes(expr, 2).collect()} == {2}


def test_missing_gene_counts_as_zero_mean(spark):
    expr = spark.createDataFrame([(1, 1, float(np.log1p(4.0))), (2, 1, float(np.log1p(2.0)))], EXPR)
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id bigint")
    genes = spark.createDataFrame([(1,), (9,)], "gene_id bigint")
    got = {r["gene_id"]: (r["mean"], r["variance"]) for r in H.gene_moments(expr, cells, genes).collect()}
    assert got[1] == pytest.approx((2.0, 4.0)) and got[9] == (0.0, 0.0)


def test_dispersion_with_equal_means_and_lonely_bin(spark):
    moments = spark.createDataFrame(
        [(1, 1.0, 2.0), (2, 1.0, 4.0), (3, 50.0, 9.0), (4, 1.0, 0.0)], "gene_id bigint, mean double, variance double"
    )
    got = {r["gene_id"]: (r["bin"], r["score"]) for r in H.normalized_dispersion(moments).collect()}
    assert got[3] == (20, 1.0) and got[4][1] is None
    assert got[1][1] == pytest.approx(-got[2][1])
    flat = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 4.0)], moments.schema)
    assert {r["bin"] for r in H.normalized_dispersion(flat).collect()} == {1}


def test_hvg_keeps_ties(spark):
    moments = spark.createDataFrame(
        [(g, 1.0, v) for g, v in enumerate([8.0, 4.0, 4.0, 1.0])], "gene_id bigint, mean double, variance double"
    )
    assert {r["gene_id"] for r in H.select_hvg(moments, n_top=2).collect()} == {0, 1, 2}


def test_unseen_label_fails(spark):
    saved = spark.createDataFrame([("batch", "a", 0)], "kind string, value string, code int")
    obs = spark.createDataFrame([(1, "a"), (2, "b")], "cell_id bigint, batch string")
    with pytest.raises(Exception, match="not in dictionary"):
        R.apply_dictionary(obs, saved, "batch", "batch", "code").collect()
    loose = R.apply_dictionary(obs, saved, "batch", "batch", "code", strict=False)
    assert {r["code"] for r in loose.collect()} == {0, None}


def test_dictionary_follows_first_appearance(spark):
    obs = spark.createDataFrame([(3, "a"), (1, "z"), (2, "m"), (9, "z")], "cell_ix bigint, batch string")
    got = {r["value"]: r["code"] for r in R.encode_dictionary(obs, {"batch": "batch"}).collect()}
    assert got == {"z": 0, "m": 1, "a": 2}


def test_records_keep_empty_cells_and_dense_form(spark):
    expr = spark.createDataFrame([(1, 2, 5.0), (1, 0, 1.0)], "cell_id bigint, gene_ix bigint, value double")
    cells = spark.createDataFrame([(1, 0), (7, 0)], "cell_id bigint, batch int")
    recs = R.build_records(expr, cells)
    got = {r["cell_id"]: (r["feature"], r["value"]) for r in recs.collect()}
    assert got == {1: ([0, 2], [1.0, 5.0]), 7: ([], [])}
    dense = {r["cell_id"]: r["value"] for r in R.densify(recs, 4, 0.5).collect()}
    assert dense == {1: [1.5, 0.5, 5.5, 0.5], 7: [0.5] * 4}


def test_single_batch_export_refuses_two(spark):
    recs = spark.createDataFrame([(1, 0), (2, 1)], "cell_id bigint, batch int")
    with pytest.raises(ValueError, match="one batch"):
        R.write_single_batch(recs, workspace(spark, "t"))


def test_batch_filter_prunes_partitions_and_rerun_keeps_others(spark):
    path = workspace(spark, "records")
    schema = "cell_id bigint, feature array<bigint>, value array<double>, batch int"
    recs = spark.createDataFrame([(i, [1], [1.0], i % 3) for i in range(9)], schema)
    R.write_records(recs, path)
    plan = R.read_selected(spark, path, only=[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    R.write_records(recs.where("batch = 1").limit(1), path)
    got = {r["batch"]: r["count"] for r in R.read_records(spark, path).groupBy("batch").count().collect()}
    assert got == {0: 3, 1: 1, 2: 3}


def test_vocabulary_of_wrong_size_fails(spark):
    expr = spark.createDataFrame([(1, 1, 1.0)], EXPR)
    genes = spark.createDataFrame([(1, 0)], "gene_id bigint, gene_ix bigint")
    with pytest.raises(ValueError, match="vocabulary"):
        P.align_to_vocabulary(expr, genes, declared=2)


def test_null_aware_filter(spark):
    obs = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "cell_id bigint, s string")
    pick = lambda **kw: {r[0] for r in P.filter_obs(obs, **kw).collect()}
    assert pick(among={"s": ["a", None]}) == {1, 2}
    assert pick(among={"s": ["a"]}) == {1}
    assert pick(outside={"s": ["a"]}) == {2, 3}
    assert pick(differs={"s": "a"}) == {2, 3}
    assert pick(equal={"s": None}) == {2}


# -------------------------------------------------------------- neighbours

VECS = "id bigint, vec array<double>, label int"


def test_equal_similarities_take_smaller_id_and_k_beyond_table(spark):
    refs = spark.createDataFrame([(5, [1.0, 0.0], 1), (2, [1.0, 0.0], 0), (9, [0.0, 1.0], 1)], VECS)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vec array<double>")
    for layout in ({}, {"resident_bytes": 0, "block_rows": 1}):
        got = [r["ref_id"] for r in S.knn(q, refs, 10, **layout).orderBy("rank").collect()]
        assert got == [2, 5, 9]


def test_equal_vote_goes_to_earlier_neighbour(spark):
    near = spark.createDataFrame(
        [(1, 10, 0.5, 7, 1), (1, 11, 0.5, 3, 2), (2, 10, 0.6, 7, 1), (2, 11, 0.4, 3, 2), (2, 12, 0.4, 3, 3)],
        "query_id bigint, ref_id bigint, sim double, label int, rank int",
    )
    got = {r["query_id"]: (r["label"], round(r["confidence"], 6)) for r in T.vote(near).collect()}
    assert got == {1: (7, 0.5), 2: (3, 0.4)}


def test_blocks_agree_with_shared_matrix_on_a_hot_group(spark):
    rng = np.random.default_rng(0)
    pts = [(i, [float(x) for x in rng.normal(size=6)], i % 3, "hot" if i % 3 else f"g{i % 5}") for i in range(300)]
    df = spark.createDataFrame(pts, "id bigint, vec array<double>, label int, grp string")
    for metric in ("inner", "euclidean"):
        one = rows(S.knn(df, df, 4, metric).drop("label"))
        two = rows(S.knn(df, df, 4, metric, resident_bytes=0, block_rows=17).drop("label"))
        assert one == two
    plain = df.drop("grp")
    assert rows(S.similarity_summary(plain, plain).select("query_id", "n")) == rows(
        S.similarity_summary(plain, plain, resident_bytes=0, block_rows=32).select("query_id", "n")
    )
    a = M.silhouette(plain).first()["silhouette"]
    b = M.silhouette(plain, resident_bytes=0, block_rows=40).first()["silhouette"]
    assert a == pytest.approx(b)


def test_mining_drops_rank_one_or_self(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 1.0], 1)], VECS)
    by_rank = {(r["query_id"], r["ref_id"]) for r in T.mine_neighbours(pts, 1).collect()}
    assert (1, 1) in by_rank  # its best match is point 2, which rank 1 drops
    by_id = {(r["query_id"], r["ref_id"]) for r in T.mine_neighbours(pts, 1, drop_by_id=True).collect()}
    assert (1, 2) in by_id and all(a != b for a, b in by_id)


def test_zero_vector_and_constant_cell(spark):
    v = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert rows(v.select(V.l2_normalize(F.col("v")))) == [([0.0, 0.0],), ([0.6, 0.8],)]
    expr = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], EXPR)
    obs = spark.createDataFrame([(1, "x")], "cell_id bigint, grp string")
    genes = spark.createDataFrame([(1,), (2,)], "gene_id bigint")
    assert {r["scaled"] for r in C.marker_heatmap(expr, obs, genes, "grp").collect()} == {0.0}


# ------------------------------------------------------------------ metrics


def preds(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "truth int, pred int")


def test_metrics_at_the_edges(spark):
    one = preds(spark, [(1, 1)] * 4)
    assert M.adjusted_rand(one).first()[0] == 1.0
    assert M.normalized_mutual_info(one).first()[0] == 1.0
    same = preds(spark, [(1, 5), (1, 5), (2, 6), (3, 7)])
    assert M.adjusted_rand(same).first()[0] == pytest.approx(1.0)
    assert M.normalized_mutual_info(same).first()[0] == pytest.approx(1.0)
    odd = preds(spark, [(0, 0), (0, 2), (1, 0)])
    f1 = {r["label"]: r["f1"] for r in M.f1_by_class(odd).collect()}
    assert f1 == {0: 0.5, 1: 0.0, 2: 0.0}


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for shape in [(1, 1), (3, 3), (4, 4), (5, 5), (3, 5), (5, 2)]:
        for _ in range(15):
            gain = rng.integers(0, 9, shape)
            n = max(shape)
            full = np.zeros((n, n), int)
            full[: shape[0], : shape[1]] = gain
            best = max(sum(full[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            pairs = best_assignment(gain)
            assert len({r for r, _ in pairs}) == len(pairs) == len({c for _, c in pairs})
            assert sum(gain[r, c] for r, c in pairs) == best


def test_cluster_error_needs_equal_numbers(spark):
    with pytest.raises(ValueError):
        M.cluster_error(preds(spark, [(0, 0), (1, 0)]))


def test_ranksum_against_pair_counting(spark):
    rng = np.random.default_rng(4)
    data = [("c", g, float(v)) for g in "xy" for v in rng.integers(0, 6, 12)] + [("d", "x", 1.0), ("d", "y", 1.0)]
    df = spark.createDataFrame(data, "by string, g string, v double")
    got = {r["by"]: r for r in C.ranksum(df, ["by"], "g", "v", [("x", "y")]).collect()}
    xs = [v for b, g, v in data if (b, g) == ("c", "x")]
    ys = [v for b, g, v in data if (b, g) == ("c", "y")]
    u = sum((a > b) + 0.5 * (a == b) for a in xs for b in ys)
    assert got["c"]["u"] == u
    assert got["d"]["z"] is None and got["d"]["p"] is None and got["d"]["mark"] is None


def test_group_with_one_sample(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", 100.0)], "g string, v double")
    got = {r["g"]: r for r in C.box_stats(df, ["g"], "v").collect()}
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["outliers"]) == (1.0, 1.0, 0)
    assert got["b"]["median"] == 3.0


# ----------------------------------------------------------------- ordering


def test_positions_sums_and_quantiles_with_a_hot_key(spark):
    rng = np.random.default_rng(7)
    data = [(i, "hot" if i % 3 else f"k{i % 7}", float(rng.integers(0, 20))) for i in range(1000)]
    df = spark.createDataFrame(data, "id bigint, k string, v double")
    placed = {r["id"]: r["p"] for r in O.with_position(df, ["id"], "p").collect()}
    assert placed == {i: i for i in range(1000)}
    inside = {r["id"]: (r["p"], r["n"]) for r in O.with_position_in_group(df, ["k"], ["id"], "p", "n").collect()}
    runs = {r["id"]: r["s"] for r in O.with_running_sums(df, ["k"], ["id"], {"s": "v"}).collect()}
    for key in {k for _, k, _ in data}:
        mine = [(i, v) for i, k, v in data if k == key]
        assert [inside[i] for i, _ in mine] == [(j, len(mine)) for j in range(len(mine))]
        assert [runs[i] for i, _ in mine] == pytest.approx(list(np.cumsum([v for _, v in mine])))
    got = {r["k"]: (r["lo"], r["mid"]) for r in O.exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
    for key, pair in got.items():
        assert pair == pytest.approx(tuple(np.quantile([v for _, k, v in data if k == key], [0.1, 0.5])))
    whole = O.exact_quantiles(df, [], "v", {"q": 0.25}).first()
    assert whole["q"] == np.quantile([v for *_, v in data], 0.25) and whole["n"] == 1000


def test_minibatches_drop_the_remainder(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(13)], "cell_id bigint, batch string")
    got = B.assign_minibatches(df, 3).groupBy("batch", "minibatch_id").count().collect()
    assert {(r["batch"], r["minibatch_id"], r["count"]) for r in got} == {
        ("a", 0, 3), ("a", 1, 3), ("b", 0, 3), ("b", 1, 3),
    }
    assert B.assign_minibatches(df, 100).count() == 0
    assert B.sample_n(df, 5, ["cell_id"], 1).count() == 5
    assert B.sample_n(df, 50, ["cell_id"], 1).count() == 13


def test_top_k_is_cut_before_the_shuffle(spark, folder):
    from __spark_entry__ import queries

    plan = queries()["topk_per_key"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan


# ------------------------------------------------------------------ encoder


def test_cell_without_entries_and_join_form(spark):
    recs = spark.createDataFrame(
        [(1, [0, 3], [1.0, 2.0]), (2, [], []), (3, [99], [1.0])], "cell_id bigint, feature array<bigint>, value array<double>"
    )
    rng = np.random.default_rng(0)
    genes = spark.createDataFrame(
        [(g, [float(x) for x in rng.normal(size=4)]) for g in range(5)], "gene_ix bigint, vec array<double>"
    )
    w = E.AttentionWeights(1.5, 0.1, rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4), np.ones(4), np.zeros(4))
    a = {r["cell_id"]: r["z"] for r in E.pool_cells(recs, genes, w).collect()}
    b = {r["cell_id"]: r["z"] for r in E.pool_cells(recs, genes, w, limit=0).collect()}
    assert a.keys() == b.keys() == {1, 2, 3}
    assert all(a[c] == pytest.approx(b[c]) for c in a) and a[2] == [0.0] * 4 == a[3]
    for limit in (0, 1 << 20):
        att = E.export_attention(recs, genes, w, "RNA", limit=limit)
        assert att.groupBy("cell_id").agg(F.sum("weight")).collect()[0][1] == pytest.approx(1, abs=1e-5)


# --------------------------------------------------------------------- text


def slow_run(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while n <= min(i, j) and a[i - n] == b[j - n]:
                n += 1
            if n > best[0]:
                best = (n, i + 1, j + 1)
    return best


def slow_subsequence(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def test_common_runs_and_subsequences():
    rng = np.random.default_rng(2)
    for _ in range(150):
        a = "".join(rng.choice(list("abé"), rng.integers(0, 14)))
        b = "".join(rng.choice(list("abé"), rng.integers(0, 14)))
        assert X.common_run(a, b) == slow_run(a, b)
        pairs = X.common_subsequence(a, b)
        assert len(pairs) == slow_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


def words_of(spark, text, **kw):
    return spark.createDataFrame([(text,)], "t string").select(X.basic_words(F.col("t"), **kw)).first()[0]


def test_basic_words(spark):
    assert words_of(spark, "") == []
    assert words_of(spark, "\x01\x02​") == []
    assert words_of(spark, "中文abc,x") == ["中", "文", "abc", ",", "x"]
    assert words_of(spark, "Éa\tb　c") == ["Éa", "b", "c"]
    assert words_of(spark, "ÉA ï", lower=True) == ["ea", "i"]
    assert words_of(spark, "a$b ≠ §") == ["a", "$", "b", "≠", "§"]


VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "un", "##aff", "##able", "able", "a", "##b", ","]


def vocab(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(VOCAB)], "token string, id bigint")


def test_wordpiece_both_forms(spark):
    docs = spark.createDataFrame(
        [(1, ["unaffable", "able", "zq", ","]), (2, []), (3, ["ab", "unx"])], "doc_id bigint, words array<string>"
    )
    want = {
        1: (["un", "##aff", "##able", "able", "z", "##q", ","], [5, 6, 7, 8, 1, 1, 11]),
        2: ([], []),
        3: (["a", "##b", "un", "##x"], [9, 10, 5, 1]),
    }
    for limit in (0, 1 << 20):
        got = {r["doc_id"]: (r["pieces"], r["ids"]) for r in X.wordpiece(docs, vocab(spark), limit).collect()}
        assert got == want
    plain = docs.select("doc_id", "words")
    for limit in (0, 1 << 20):
        ids = {r["doc_id"]: r["ids"] for r in X.whole_word_ids(plain, vocab(spark), limit).collect()}
        assert ids == {1: [1, 8, 1, 11], 2: [], 3: [1, 1]}


def pop_until(a, b, most):
    a, b = list(a), list(b)
    while len(a) + len(b) > most:
        (a if len(a) > len(b) else b).pop(-2)
    return a, b


def test_pair_truncation_against_popping(spark):
    special = {"[CLS]": 2, "[SEP]": 3}
    for la, lb, most in itertools.product(range(0, 9, 2), range(0, 9, 3), (5, 8, 11)):
        x, y = list(range(100, 100 + la)), list(range(200, 200 + lb))
        df = spark.createDataFrame([(x, y)], "x array<int>, y array<int>")
        ids, seg = X.encode(F.col("x"), special, F.col("y"), maxlen=most)
        row = df.select(ids.alias("i"), seg.alias("s")).first()
        a, b = pop_until([2, *x, 3], [*y, 3], most)
        assert (row["i"], row["s"]) == (a + b, [0] * len(a) + [1] * len(b))
    ids, seg = X.encode(F.col("x"), special, maxlen=4)
    row = spark.createDataFrame([([7, 8, 9],)], "x array<int>").select(ids, seg).first()
    assert tuple(row) == ([2, 7, 8, 3], [0, 0, 0, 0])


def test_decoding(spark):
    def text(*tokens):
        return spark.createDataFrame([(list(tokens),)], "t array<string>").select(X.decode_tokens(F.col("t"))).first()[0]

    assert text("[CLS]", "un", "##able", ",", "it", "'", "s", "ok", "[SEP]") == "unable, it's ok"
    assert text("中", "文", "abc") == "中文abc"
    assert text("3", ".", "5", "(", "x", ")") == "3.5(x)"
    assert text() == ""


def test_offsets(spark):
    def spans(t, tokens, **kw):
        df = spark.createDataFrame([(t, tokens)], "t string, k array<string>")
        got = df.select(X.token_offsets(F.col("t"), F.col("k"), **kw)).first()[0]
        return [s if s is None else (s["start"], s["end"]) for s in got]

    assert spans("un\x01able ok", ["[CLS]", "un", "##able", "ok"]) == [None, (0, 2), (3, 7), (8, 10)]
    assert spans("ÉA é", ["ea", "e"], lower=True) == [(0, 2), (3, 4)]


def test_segments(spark):
    assert X._pieces("  short ", 10, "\n", None) == ["short"]
    assert X._pieces("aaaa bbbb cccc", 6, " ", None) == ["aaaa", "bbbb", "cccc"]
    assert X._pieces("aa bb\ncc dd", 6, "\n ", None) == ["aa bb", "cc dd"]
    assert X._pieces("x" * 30, 10, "\n ", None) == ["x" * 30]
    assert X._pieces("", 5, "\n", None) == [""]


def test_text_helpers(spark):
    df = spark.createDataFrame([("ＡＢ　！", bytearray(b"a\xffb\xc3\xa9"), "ab")], "t string, b binary, s string")
    row = df.select(
        ST.fullwidth_to_halfwidth(F.col("t")),
        ST.safe_decode(F.col("b")),
        ST.inner_substring(F.col("s"), 2, 3),
        ST.any_pattern_match(F.col("s"), ["x", "b$"]),
        ST.any_pattern_match(F.col("s"), []),
    ).first()
    assert tuple(row) == ("AB !", "abé", "", True, False)


def test_vocab_simplification(spark):
    v = spark.createDataFrame(
        [("[UNK]", 0), ("the", 1), ("a,", 2), ("中", 3), ("中文", 4), (",", 5), ("##,x", 6), ("##ab", 7), ("[PAD]", 8)],
        "token string, id bigint",
    )
    got = [tuple(r) for r in X.simplify_vocab(v, ["[PAD]", "[UNK]"]).orderBy("id").collect()]
    assert got == [("[PAD]", 0, 8), ("[UNK]", 1, 0), ("the", 2, 1), ("中", 3, 3), (",", 4, 5), ("##ab", 5, 7)]


def test_schedule_before_between_and_after(spark):
    df = spark.createDataFrame([(0,), (500,), (1000,), (1500,), (9000,)], "t int")
    got = [r[0] for r in df.select(V.piecewise_linear(F.col("t"), {1000: 1.0, 2000: 0.1})).collect()]
    assert got == pytest.approx([0.0, 0.5, 1.0, 0.55, 0.1])


def test_stream_matches_batch(spark):
    from cytoplane.streaming.transfer import read_arriving, transfer_arriving

    rng = np.random.default_rng(5)
    make = lambda lo, hi: [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(lo, hi)]
    refs, q = spark.createDataFrame(make(0, 40), VECS), spark.createDataFrame(make(100, 120), VECS).drop("label")
    folder, out = workspace(spark, "in"), workspace(spark, "out")
    q.where("id < 110").coalesce(1).write.mode("append").parquet(folder)
    q.where("id >= 110").coalesce(1).write.mode("append").parquet(folder)
    stream = transfer_arriving(read_arriving(spark, folder, 1), refs, 3, out, workspace(spark, "state"))
    stream.awaitTermination(120)
    got = spark.read.parquet(out).drop("part")
    assert rows(got) == rows(T.transfer_labels(q, refs, 3))
