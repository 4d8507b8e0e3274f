"""Near vectors, token alignment and source divergence against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cytoplane.llm import alignment, divergence, vectors

LETTERS = " \n\t\r  ▁ab'cE1ß中文é😀.,!<s>0"


# ----------------------------------------------------------- 11: near vectors


def brute_vectors(rows, cosine=0.9):
    able = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        scaled = np.array(v, float) / max(map(abs, v)) if ok else None
        able.append(scaled / np.linalg.norm(scaled) if ok else None)
    n = len(rows)
    near = [[i != j and able[i] is not None and able[j] is not None and len(able[i]) == len(able[j]) and able[i] @ able[j] >= cosine for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j in range(n):
                if near[k][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], sum(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def crowd(rng, n, dims):
    """Random vectors, a crowd of near copies, a chain of links, and copies at other scales."""
    rows = [rng.standard_normal(dims) for _ in range(n)]
    middle = rng.standard_normal(dims)
    rows += [middle + rng.standard_normal(dims) * 0.18 for _ in range(n)]
    step = rng.standard_normal(dims)
    rows += [middle * 3 + step * 0.3 * k for k in range(8)]
    rows += [rows[0] * 2.0, rows[0] * 2.0, rows[1] * 1e-20]
    return rows


@pytest.mark.parametrize("dims,tile", [(64, None), (20, 40), (3, 30)])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, dims, tile):
    if tile:  # many small boxes, crowded ones in several tiles
        monkeypatch.setattr(vectors, "TILE_BYTES", tile * 8 * dims)
    rows = [(i * 7 % 1009, [float(x) for x in v]) for i, v in enumerate(crowd(np.random.default_rng(dims), 90, dims))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in vectors.near_vectors(table).collect()), key=str)
    assert got == brute_vectors(rows)
    assert any(r[1] > 50 for r in got)


def test_near_vectors_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
        (8, [2.0, -0.0]), (7, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1e300, 1e299]), (10, [1e-300, 0.0]), (None, None), (11, [0.0, 1.0]), (12, [0.0, 1.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, node string, times int")
    want = brute_vectors(rows)
    assert sorted((tuple(r) for r in vectors.near_vectors(table).collect()), key=str) == want
    assert vectors.near_vectors(table.where("1 = 0")).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(table.where("vec_id = 1")).collect()] == [(1, 0, 1, True)]


def test_a_near_pair_is_within_some_block():
    rng = np.random.default_rng(5)
    edges, turn = vectors.block_edges(64), vectors.rotation(64)
    x = rng.standard_normal((3000, 64))
    x = vectors._unit(x) @ turn
    y = vectors._unit(x + rng.standard_normal(x.shape) * 0.06)
    near = (x * y).sum(1) >= 0.9
    inside = [((x - y)[:, a:b] ** 2).sum(1) <= 0.2 * (b - a) / 64 + 1e-9 for a, b in zip(edges, edges[1:])]
    assert near.sum() > 500 and np.any(inside, axis=0)[near].all()
    assert not np.all(inside, axis=0)[near].all()  # one block alone would lose pairs


def test_boxes_visit_all_within_reach():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((800, 4)) * 0.2
    boxes = vectors.Boxes(x[:400], 12)
    home = np.full(len(x), -1)
    for box, rows in boxes.visits(x, 0):
        assert (home[rows] == -1).all()
        home[rows] = box
    assert (home >= 0).all() and len(set(home)) == boxes.n > 8
    seen = {(int(r), box) for box, rows in boxes.visits(x, 0.1) for r in rows}
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    assert all((i, int(home[j])) in seen for i, j in zip(*np.nonzero(far <= 0.1)))
    assert len(seen) < len(x) * boxes.n / 2


# ------------------------------------------------------------- 12: alignment


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{alignment.FOLDER}/piece_bpe_32k.model")
    letters = alignment._byte_of_letter()
    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append((0, 0, [], []))
            continue
        ids = a.encode(" " + text, add_special_tokens=False)
        one = [bytes(letters[c] for c in t) for t in ids.tokens]
        other = [bytes([b.id_to_piece(i) and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b.encode(text)]
        if b"".join(one) != b"".join(other) or b"".join(one) != (" " + text).encode():
            rows.append((0, 0, [], []))
            continue

        def spans(ids, parts):
            at, out = 0, []
            for i, p in zip(ids, parts):
                out.append((i, at, at + len(p)))
                at += len(p)
            return out

        x, y = spans(ids.ids, one), spans(b.encode(text), other)
        links = [(i, j) for i, s, e in x for j, t, f in y if s < f and t < e]
        counts.update(links)
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, low = [], 0
        for high in cuts:
            groups.append(",".join(str(i) for i, s, e in x if low < e <= high) + "|" + ",".join(str(i) for i, s, e in y if low < e <= high))
            low = high
        rows.append((len(x), len(y), groups, links))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (na, nb, len(g), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, g, k in rows
    ]


@pytest.mark.parametrize("shared", [alignment.BROADCAST_BYTES, 0])
def test_alignment_equals_brute_force(spark, folder, shared):
    rng = random.Random(4)
    given = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(40).collect()]
    texts = [None, "", " ", "a", "a", " a", "a ", "▁", "<s> a </s>", "<|endoftext|> word", "<0x41>", "x\r\ny", "\n\n  z", ");\r {\r", "ab" * 3000, "\t" * 50]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [" ".join(t.split(" ")[:120]) if t else t for t in given]
    rows = [(i, t, 9, "x") for i, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, pair int, rid string"), shared_bytes=shared).collect()
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in got}
    assert len(got) == len(texts)
    assert [found[i] for i in range(len(texts))] == brute_alignment(texts)
    assert alignment.align(spark.createDataFrame(rows[:0], "doc_id long, text string, pair int, rid string"), shared_bytes=shared).collect() == []


def test_gallop_is_a_rank():
    rng = np.random.default_rng(1)
    held = np.unique(rng.integers(0, 5000, 900))
    want = np.unique(rng.integers(-5, 5010, 700))
    for guess in (np.zeros(len(want), int), np.full(len(want), len(held)), rng.integers(-3, len(held) + 3, len(want))):
        assert (alignment.gallop(want, held, guess) == np.searchsorted(held, want)).all()


# ------------------------------------------------------------ 13: divergence


def brute_audit(rows):
    docs = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    words = [(lang, source, re.findall(divergence.TERM, text)) for text, lang, source in docs]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [(a, b, [w.translate(low) for w in ws]) for a, b, ws in words]
    out = set()
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        held = Counter(t for _, _, ws in own for t in set(ws))
        kept = sorted(t for t, n in held.items() if n >= divergence.MIN_DOCS)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(Counter(t for _, _, ws in own for t in ws))
        counts = {s: Counter(t for _, b, ws in own if b == s for t in ws) for s in {w[1] for w in own}}
        p = {s: shares(c) for s, c in counts.items()}

        def price(x, y):
            return (x - y) ** 2 // (x + y)

        for s in p:
            pairs = [(sum(price(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(price(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= divergence.TOP}
    return out


@pytest.mark.parametrize("terms,sources", [(256, 64), (7, 3)])
def test_audit_equals_plain_sums(spark, monkeypatch, terms, sources):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcXYZé中") for _ in range(rng.randint(1, 4))) for _ in range(90)]
    rows = []
    for i in range(260):
        text = rng.choice([" ", "-", "\n", "1"]).join(rng.choices(vocab, weights=range(1, 91), k=rng.randint(0, 40)))
        rows.append((i, rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None]), rng.choice([f"s{k}" for k in range(8)] + [None]), 0, "x"))
    rows += [(300 + k, None, "xx", f"t{k}", 0, "x") for k in range(3)] + [(400, "a " * 50_000, "en", "s1", 0, "x"), rows[0], rows[0]]
    schema = "doc_id long, text string, lang string, source string, n int, term string"
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources)
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema)).collect()}
    assert got == brute_audit(rows)
    assert divergence.audit(spark.createDataFrame(rows[:0], schema)).collect() == []


def test_joint_tables_are_counts_of_terms():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (60, 3))
    codes, starts, _ = divergence._indicators(counts, [100, 100, 100], 60)
    n = int(codes.max()) + 1
    found = np.zeros((n, n), int)
    for i, j, terms in divergence.joint_tables((codes, n), (codes, n), np.ones(60, np.float32)):
        found[i, j] += terms
    levels = [np.unique(counts[:, s]) for s in range(3)]
    for s in range(3):
        for o in range(3):
            for x, a in enumerate(levels[s]):
                for y, b in enumerate(levels[o]):
                    assert found[starts[s] + x, starts[o] + y] == ((counts[:, s] == a) & (counts[:, o] == b)).sum()


# ------------------------------------------------- columns and labels of the stages


def test_further_columns_keep_their_names_and_values(spark):
    from cytoplane.llm import langid, lines, mixing

    names = ["gone", "part", "whole", "before", "s", "score", "lang_pred", "node", "key"]
    texts = {"en": "the quick brown fox jumps over the lazy dog again ", "de": "der schnelle braune fuchs springt über den faulen hund "}
    rows = [(i, texts[k] * 3 + str(i), k, k, *[i * 10 + j for j in range(len(names))]) for i, k in enumerate(["en", "de"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in names))
    for stage in (lines.dedup_lines, mixing.mix_documents, langid.reject_unknown):
        found = stage(docs).select("doc_id", *names).collect()
        assert found and all(tuple(r)[1:] == tuple(r["doc_id"] * 10 + j for j in range(len(names))) for r in found)


def test_no_language_to_learn_from(spark):
    from cytoplane.llm import langid

    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "12 34", None), (4, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs).collect()}
    assert got == {i: ("und", 0.0) for i in range(1, 5)}
    assert [r["doc_id"] for r in langid.reject_unknown(docs).collect()] == [1]
