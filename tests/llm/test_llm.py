"""The text operators against SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from cytoplane import session
from cytoplane.llm import bytework, decontam, htmltext, langid, lines, minhash, mixing, quality, secrets, toxicity, warc
from cytoplane.llm.common import components
from cytoplane.llm.queries import QUERIES
from cytoplane.llm.sql import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n):
    return [("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))) for _ in range(n)]


#: Null, empty, blank, one word, ties, copies and one very long text.
ODD = [None, "", " \n\t", "word", "word", "a b c d e", "a b c d e", "x " * 50_000, "line\nline\nline", "\n\n", "é" * 3000, "1 2 3 4 5 6 7 8 9"]


# ------------------------------------------------------------------ SQL twins


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, folder, name):
    assert oracle.compare(spark, oracle.connect(folder), QUERIES[name], ORACLES[name], folder) is None


def odd_table(spark, tmp_path):
    """A folder whose documents are ODD, repeated rows, null ids and sources, and a clashing extra column."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", 0, i) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id at all, " * 9, "en", "s1", 0, 1), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", size long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pages = [(i, f"http://x/{i}" if i % 3 else None, t, "x") for i, t in enumerate(ODD)] + [(None, None, None, None), (3, "a\r\nb", "word", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(0, "a b c d e"), (1, None), (2, ""), (0, "a b c d e")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    spark.createDataFrame([(3, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    vectors = [(0, [1.0, 2.0], 0), (1, [2.0, 4.0], 1), (2, None, 0), (3, [], None), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [-1.0, 0.5], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


#: Rows of a query on the odd tables where they are not one for each document.
ODD_ROWS = {"op4_warc": len(ODD) + 2, "op9_html_text": len(ODD) + 2, "op11_near_vectors": 7, "op7_decontamination": None, "op13_divergence": None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, tmp_path, name):
    odd = odd_table(spark, tmp_path / "odd")
    got = QUERIES[name](spark, odd).collect()
    assert ODD_ROWS.get(name, len(ODD) + 3) in (len(got), None)
    empty = tmp_path / "empty"
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{table}.parquet").where("1 = 0").write.parquet(str(empty / f"{table}.parquet"))
    assert QUERIES[name](spark, str(empty)).collect() == []


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op9_html_text"}))
def test_twin_on_odd_table(spark, tmp_path, name):
    odd = odd_table(spark, tmp_path)
    con = oracle.duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet/*.parquet'")
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], odd) is None


# ------------------------------------------------------------------ 1: lines


def brute_lines(spark, docs):
    """Which (doc, position) stay, from all pairs of lines."""
    table = lines.line_table(docs).collect()
    norm = {
        (r["doc_id"], r["pos"]): r["norm"]
        for r in docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "pos", F.array_join(lines.line_words(F.col("line")), " ").alias("norm")).collect()
    }
    places = [(r["doc_id"], r["pos"]) for r in table]
    root = {p: p for p in places}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for i, p in enumerate(places):
        for q in places[:i]:
            a, b = norm[p].split(" "), norm[q].split(" ")
            same = norm[p] == norm[q]
            near = min(len(a), len(b)) >= 5
            if same or near and edits(a, b) <= max(len(a), len(b)) // lines.EDIT_SHARE:
                x, y = find(p), find(q)
                root[max(x, y)] = min(x, y)
    return {p for p in places if find(p) == p}, norm


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(3)
    base = [words(rng, rng.randint(20, 60)) for _ in range(6)]
    texts = []
    for i in range(40):
        own = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = "changed" + str(rng.randint(0, 3))
            own.append(" ".join(line).upper() if rng.random() < 0.3 else " ".join(line) + "!")
        own.append(" ".join(words(rng, 9)))
        texts.append("\n".join(own))
    docs = docs_of(spark, texts)
    stay, norm = brute_lines(spark, docs)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) in stay or not norm.get((i, k))) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == want
    assert any(got[i] != t for i, t in enumerate(texts))


def near_groups(rows):
    """The first of each group of lines whose words are equal or a fifth of the longer line's apart, from all pairs."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            near = min(len(a), len(b)) >= 5 and edits(a, b) <= max(len(a), len(b)) // 5
            if a == b or near:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def test_near_lines_of_any_length_are_found(spark):
    """Lines of 5 to 60 words with up to the allowed fifth changed, dropped or added, by edit similarity alone."""
    rng = random.Random(8)
    rows = []
    for n in [*range(5, 31), 40, 44, 60]:
        base = words(rng, n)
        rows.append(base)
        for k in (1, n // 5, n // 5 + 1):
            own = list(base)
            for at in rng.sample(range(n), k):
                own[at] = "new" + "".join(rng.choice("klmnop") for _ in range(5))
            rows.append(own)
        own = list(base)
        for _ in range(n // 5):
            del own[rng.randrange(len(own))]
        rows.append(own)
        own = list(base)
        for _ in range((n + 1) // 5 if n % 5 == 4 else n // 5):
            own.insert(rng.randrange(len(own)), "added" + "".join(rng.choice("klmnop") for _ in range(5)))
        rows.append(own)
    rng.shuffle(rows)
    got = {r["doc_id"] for r in lines.dedup_lines(docs_of(spark, [" ".join(x) for x in rows])).where("n_removed = 0").collect()}
    assert got == near_groups(rows)
    assert len(got) < len(rows) / 2


def test_digits_marks_and_signs_tell_lines_apart(spark):
    texts = [
        "Revenue 2019 1,234\nx = 1\nChapter 7\n-----\nकि", "Revenue 2020 5,678\nx = 2\nChapter 8\n*****\nकु", "  revenue 2019: 1 234\n-----\n\n",
        "12 34\nnew", "12 34\nold", "-----\n12 34", " \n\n\n ",
    ]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == {
        0: (texts[0], 5, 0), 1: (texts[1], 5, 0), 2: ("\n", 2, 2), 3: (texts[3], 2, 0), 4: ("old", 2, 1), 5: ("", 2, 2), 6: (texts[6], 0, 0),
    }


def packed_batches(rows, size):
    """``rows`` of (part, key below 2**40, node) as the tasks send them, ``size`` to a batch."""
    for low in range(0, len(rows), size):
        parts, data = [], []
        for part in sorted({r[0] for r in rows[low : low + size]}):
            own = [(node, key & 0xFFFFFFFF, key >> 32) for p, key, node in rows[low : low + size] if p == part]
            parts.append(part)
            data.append(np.array(own, lines.PACKED).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


@pytest.mark.parametrize("held", [3, 20, 1 << 21])
def test_shared_keys_whatever_a_task_holds(monkeypatch, held):
    """All lines of a key are told of under one name, also if the task had to reduce what it holds many times."""
    monkeypatch.setattr(lines, "PART_KEYS", held)
    rng = random.Random(held)
    rows = [(rng.randrange(3), rng.choice([5, 7, 1 << 39, 900 + rng.randrange(200)]), rng.randrange(-20, 60)) for _ in range(400)]
    rows += rng.sample(rows, 60)
    want, got = {}, {}
    for part, key, node in rows:
        want.setdefault((part, key), set()).add(node)
    for out in lines._shared(packed_batches(rows, 7)):
        for name, node in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            got.setdefault(name, set()).add(node)
    several = {frozenset(nodes) for nodes in want.values() if len(nodes) > 1}
    assert several and {frozenset(nodes) for nodes in got.values()} == several


def test_runs_left_by_the_allowed_edits():
    """Of two lines within the allowed edits some key is the same, for every length up to 45 and edits of all kinds."""
    rng = random.Random(4)
    for n in range(5, 46):
        for _ in range(40):
            base = [rng.randrange(1 << 32) for _ in range(n)]
            own, edits = list(base), 0
            while True:
                kind, longer = rng.choice("sid"), max(n, len(own) + 1)
                if edits + 1 > (longer if kind == "i" else max(n, len(own))) // lines.EDIT_SHARE or (kind == "d" and len(own) == lines.LEAST_WORDS):
                    break
                at = rng.randrange(len(own))
                own[at : at + (kind != "i")] = [] if kind == "d" else [rng.randrange(1 << 32)]
                edits += 1
            w = np.array(base + own, np.uint32)
            size = (w % 9 + 1).astype(np.uint8)
            key, row = lines._line_keys(w, size, np.repeat([0, 1], [n, len(own)]))
            assert set(key[row == 0]) & set(key[row == 1]), (n, len(own), edits)


def test_line_dedup_leaves_one_table_and_no_shuffles(spark):
    """What its steps pass on and shuffle is deleted once read: only the places to remove stay until the result is written."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tables = Path(session._tables(spark).removeprefix("file:"))

    def left():
        shuffles = {f for top in manager.localDirs() for f in Path(top.getPath()).rglob("shuffle_*.data")}
        return shuffles, set(tables.glob("*")) if tables.is_dir() else set()

    rng = random.Random(6)
    base = [words(rng, 12) for _ in range(30)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:5], "changed", *x[6:]]) for x in base]
    docs = docs_of(spark, texts)
    before = left()
    found = lines.dedup_lines(docs)
    after = left()
    assert len(after[1] - before[1]) == 1
    assert sum(f.stat().st_size for f in after[0] - before[0] if f.exists()) < 2000  # of the sums that plan the steps
    assert found.where("n_removed = 0").count() == 30


def test_line_dedup_odd(spark):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, ODD)).collect()}
    assert got[0]["text"] is None and got[1]["text"] == "" and got[2]["text"] == " \n\t"
    assert got[3]["text"] == "word" and got[4]["text"] == "" and got[4]["n_removed"] == 1
    assert got[8]["text"] == "line" and got[8]["n_removed"] == 2


# ---------------------------------------------------------------- 2: MinHash


def brute_classes(texts):
    weights = {i: minhash._weights(t) for i, t in enumerate(texts) if t and t.split()}
    root = {i: i for i in range(len(texts))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in weights:
        for b in weights:
            if a < b and minhash.similarity(weights[a], weights[b]) >= minhash.SIMILARITY:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(5)
    texts = list(ODD[:7])
    for _ in range(8):
        base = words(rng, rng.randint(30, 200))
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "zz" + str(rng.randint(0, 99))
            texts.append(" ".join(own))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == brute_classes(texts)
    kept = {r["doc_id"] for r in minhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == {i for i, c in got.items() if i == c}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 300).astype(np.uint64)
    own = rng.integers(0, 2**63, (2, 100)).astype(np.uint64)
    a = np.concatenate([shared, shared[:50], own[0]])  # 50 shingles twice
    b = np.concatenate([shared, own[1]])
    hashes, rows = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    kept = minhash.signatures(hashes, rows, 2, k=2048)
    assert abs((kept[0] == kept[1]).mean() - 300 / (len(a) + len(b) - 300)) < 0.04


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + k: 100 for k in range(60)}, 200: 200, 201: 200}


def test_bytework_words_and_shingles():
    texts = ["a bb  ccc\x1cd", None, "", "x", "é y z", "one two three four five six"]
    raw, rows = [], []
    for low, _, data, offsets in bytework.blocks(pa.array(texts), limit=8):
        starts, ends, owner = bytework.word_bounds(data, offsets)
        raw += [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
        rows += (owner + low).tolist()
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(zip(rows, raw)) == want


# ----------------------------------------------------------------- 3: mixing


def test_targets_stop_at_twice_the_size():
    assert mixing.targets([100, 100, 10], [3, 1, 2], 315.0) == [200.0, 95.0, 20.0]
    assert mixing.targets([], [], 0.0) == []
    assert mixing.targets([0, 0], [3, 1], 0.0) == [0.0, 0.0]


def test_flow_meets_quotas_at_least_cost():
    # pattern 0 may serve both sources, patterns 1 and 2 one each
    sent = mixing.route([(0, 1), (0,), (1,)], [50, 100, 10], [120, 60])
    by_source = [sum(w for (_, s), w in sent.items() if s == k) for k in (0, 1)]
    given = [sum(w for (p, _), w in sent.items() if p == k) for k in range(3)]
    assert by_source == [120, 60]
    assert all(g <= 2 * s for g, s in zip(given, [50, 100, 10]))
    # least repetition: of 180 words 160 are fresh, so 20 are repeats
    assert sum(max(0, g - s) for g, s in zip(given, [50, 100, 10])) == 20


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 50), rng.choice([["a"], ["b"], ["a", "b"], ["b", None]])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, own array<string>")
    mixed, told = mixing.mix(docs, "own")
    got = mixed.collect()
    assert len(got) == 500 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(r["target"] for r in told.collect())) <= 3
    again, _ = mixing.mix(docs.repartition(7), "own")
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mixed_words_come_near_targets(spark, folder):
    got = QUERIES["op3_mixing"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source")
    for r in got.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect():
        assert abs(r["t"] - r["w"]) <= 0.5


# ------------------------------------------------------------------- 4: WARC


def record(page, payload, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Block-Digest: sha1:{warc.sha1_base32(block)}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def test_salvage_recovers_whole_records_and_logs_gaps():
    a, b, c = record(1, b"one"), bytearray(record(2, b"two " * 50)), record(3, b"three WARC/1.1\r\nnot a record")
    b[-30] ^= 1
    packed, cut = gzip.compress(record(4, b"four")), gzip.compress(record(5, b"five"))[:-9]
    data = a + bytes(b) + c + b"junk" + packed + cut + record(6, b"six") + record(7, b"seven")[:-3]
    found = list(warc.salvage(data))
    assert [x.headers["warc-record-id"] for x in found if not isinstance(x, tuple)] == [f"<urn:page:{k}>" for k in (1, 3, 4, 6)]
    gaps = [x for x in found if isinstance(x, tuple)]
    assert [(g[0], g[1]) for g in gaps] == [
        (len(a), len(b)), (len(a + b + c), 4), (len(a + b + c) + 4 + len(packed), len(cut)), (len(data) - len(record(7, b"seven")) + 3, len(record(7, b"seven")) - 3),
    ]
    covered = sum(x[1] if isinstance(x, tuple) else x.length for x in found)
    assert covered == len(data)


def test_damaged_archive_on_disk(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>page {i}</p>" * 5) for i in range(20)], "page_id long, url string, html string")
    warc.write_pages(pages.coalesce(1), str(tmp_path / "w"))
    path = next((tmp_path / "w").glob("part-*"))
    data = bytearray(path.read_bytes())
    at = data.index(b"page 7</p>")
    data[at] ^= 1
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    path.write_bytes(bytes(data))
    found = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted(int(r["record_id"][10:-1]) for r in found if r["reason"] is None) == [i for i in range(20) if i != 7]
    gap = next(r for r in found if r["reason"])
    assert gap["offset"] <= at < gap["offset"] + gap["length"] and gap["reason"] == "block digest"
    assert {bytes(r["payload"]).decode() for r in found if r["reason"] is None} == {f"<p>page {i}</p>" * 5 for i in range(20) if i != 7}


def test_revisits(spark, tmp_path):
    rows = [(5, "u", "same"), (2, "u", "same"), (9, "u", "same"), (4, "u", None), (3, "u", ""), (7, "u", "other"), (None, "u", "same")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")).collect()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert kinds == {
        2: ("response", None, 4), 5: ("revisit", 2, 4), 9: ("revisit", 2, 4), None: ("revisit", 2, 4),
        3: ("response", None, 0), 4: ("revisit", 3, 0), 7: ("response", None, 5),
    }


# ---------------------------------------------------------------- 5: secrets


def test_base_spans_are_those_of_the_patterns():
    text = 'PassWord" : "abc12345" token=short ſecret=aaaaaaaaaa AKIAABCDEFGHIJKL AKIA12 ' + "0f" * 16 + " " + "ab" * 15 + " apikey=x.y/z+w=="
    got = secrets.base_spans(text)
    assert [(k, text[a:b]) for a, b, k in sorted(got)] == [
        ("assign", 'PassWord" : "abc12345'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0f" * 16), ("assign", "apikey=x.y/z+w=="),
    ]


def test_windows_equal_direct_entropy():
    rng = random.Random(4)
    for _ in range(60):
        s = "".join(rng.choice("0123456789abcdef" if rng.random() < 0.5 else "aab0") for _ in range(rng.randint(20, 90)))
        hot = set()
        for i in range(len(s) - secrets.WINDOW + 1):
            w = s[i : i + secrets.WINDOW]
            h = -sum(w.count(c) / len(w) * np.log2(w.count(c) / len(w)) for c in set(w))
            if h >= 3.0 - 1e-9:
                hot |= set(range(i, i + secrets.WINDOW))
        assert {k for a, b in secrets._hot_windows(s, 3.0) for k in range(a, b)} == hot


def test_allow_list_suppresses():
    for s in ("123e4567-e89b-12d3-a456-426614174000", "a" * 40, "some-long-hyphenated-name-of-words", "2020-01-01-2021-02-02-333", "abcdefghijklmnopqrst0123"):
        assert secrets.entropy_spans(s) == [], s
    assert secrets.entropy_spans("x 9fKq2LmZ7vB1xT4cW8sD0pRjH6 y")[0][2] == "entropy_base64"


def test_secret_digest(spark):
    r = secrets.scan(docs_of(spark, ["ok", "key: token=abcdefgh1"])).orderBy("doc_id").collect()
    assert r[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and r[1]["base_sha256"] == hashlib.sha256(b"assign:5:20").hexdigest()


# ------------------------------------------------------------ 6: language id


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = langid.Network.start(("a", "b", "c"), hidden=3, seed=2)
    net = langid.Network(net.langs, {k: v.astype(np.float64) for k, v in net.weights.items()})
    x, mask, y = rng.integers(97, 103, (5, 4)), np.ones((5, 4)), np.array([0, 1, 2, 1])
    mask[3:, 2] = 0
    _, grad = net.gradients(x, mask, y)
    for name, w in net.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name.startswith("in_"):
                at = (at[0], int(x[0, 0]))
            keep = w[at]
            w[at] = keep + 1e-5
            up, _ = net.gradients(x, mask, y)
            w[at] = keep - 1e-5
            down, _ = net.gradients(x, mask, y)
            w[at] = keep
            assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-6, name


def test_language_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op6_langid"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == r["lang"] for r in got if r["held_out"]]
    assert np.mean(held) >= 0.95


def test_language_of_texts_without_letters(spark):
    docs = docs_of(spark, [None, "", "12 34 !!", "the and of", "und der die"])
    net = langid.train(["the and of to in " * 9, "der die das und " * 9], ["en", "de"], steps=30)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, net).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] == "en" and got[4][0] == "de"


def test_archives_of_skewed_pages_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 18)
    rows = [(i, f"u{i}", f"small {i}") for i in range(990)] + [(1000 + i, None, f"{i}" + "y" * 100_000) for i in range(10)] + [(2000, "u", "z" * 600_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    got = warc.round_trip(pages, str(tmp_path / "w")).collect()
    assert {r["page_id"]: r["payload_bytes"] for r in got} == {i: len(h) for i, _, h in rows} and len(got) == len(rows)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert sizes[-1] < 602_000 and all(x <= 1 << 18 for x in sizes[:-1])


def test_salvage_of_broken_starts_is_linear():
    began = time.time()
    for unit in (b"WARC/1.1\r\nx", b"WARC/1.1\r\na: b\r\n", b"\x1f\x8b\x08", b"WARC/1.1\r\n\r\n"):
        data = unit * ((1 << 20) // len(unit))
        gaps = list(warc.salvage(data))
        assert [(g[0], g[1]) for g in gaps] == [(0, len(data))]
    plain = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    member = gzip.compress(plain)
    found = list(warc.salvage(member * 8000 + b"junk" + plain))
    assert len(found) == 8002 and [x[:2] for x in found if isinstance(x, tuple)] == [(8000 * len(member), 4)]
    assert all(x.block == b"hi" for x in found if not isinstance(x, tuple))
    assert time.time() - began < 20


def test_member_that_inflates_too_far_is_a_gap(monkeypatch):
    monkeypatch.setattr(warc, "INFLATED_BYTES", 1 << 20)
    assert [x[2] for x in warc.salvage(gzip.compress(b"0" * (1 << 22)))][:1] == ["gzip member too large"]


# -------------------------------------------------------- 7: decontamination

ITEM = "A train leaves Boston at 9:30 and travels 120 miles to Albany in 3 hours, so how fast does the train from Boston go per hour?"


def test_templates_and_slots(spark):
    moved = ITEM.replace("Boston", "Paris").replace("120", "450").replace("Albany", "Lyon").replace("3 hours", "5 hours")
    mixed = moved.replace("train from Paris", "train from Rome")  # one name for two
    far = "A train is a thing that leaves one place and so it goes on and on until the other place is reached by everyone in it."
    texts = [ITEM, "Intro words here. " + moved + " More words.", far, None, "", ITEM + " " + ITEM, mixed]
    bench = spark.createDataFrame([(1, ITEM), (2, "other words that occur in none of these texts at all, ever")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert {k for k in got} >= {(0, 1), (1, 1), (5, 1)} and (2, 1) not in got
    assert got[0, 1]["n_changed"] == 0 and got[1, 1]["n_changed"] >= 3
    assert (6, 1) not in got or got[6, 1]["n_windows"] < got[1, 1]["n_windows"]
    left = {r["doc_id"] for r in decontam.remove(docs_of(spark, texts), bench).collect()}
    assert left & {0, 1, 2, 3, 4, 5} == {2, 3, 4}


def test_forms_of_the_window_join_agree(spark, folder, monkeypatch):
    """A sieve that lets nearly all pass, and a join without broadcast, find the same."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(200)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    one = sorted(map(str, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "SIEVE_WORDS", 16)
    monkeypatch.setattr(decontam, "share_if_small", lambda df, _: df)
    assert sorted(map(str, decontam.contaminated(docs, bench).collect())) == one and one


def test_short_items_mark_only_lines_of_their_own(spark):
    items = ["Paris", "Yes.", "in the end", "Who wrote the Iliad?"]
    texts = ["A long text about Paris in spring", "He said yes and left", "so in the end all was well", "Paris\nYes.", "asked:\n- In the end!\nthen",
             "people ask who wrote the iliad? and more", "Who wrote the Iliad?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(4, 2), (6, 3)}
    left = {r["item_id"]: r["reason"] for r in decontam.left_out(bench).collect()}
    assert left == {0: "1 of 3 tokens", 1: "1 of 3 tokens"}


def test_equal_items_and_repeated_documents(spark):
    bench = spark.createDataFrame([(i, ITEM) for i in range(3000)] + [(5000, ITEM), (5000, "one more text that belongs to this item only")], "item_id long, text string")
    docs = docs_of(spark, [" ".join([ITEM] * 50)] * 2 + ["nothing"]).withColumn("doc_id", F.floor(F.col("doc_id") / 2).cast("long"))
    got = decontam.contaminated(docs, bench).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items")).collect()
    assert [tuple(r) for r in got] == [(0, 6002, 3001)]


def test_copies_without_literals_or_sentence_start_are_found(spark):
    items = ["WHO WROTE THE OLD GREEK POEM CALLED ILIAD AND WHEN DID HE", "Compute 3 + 4 * 5 - 6", "Who wrote the Iliad?", "The Quick Brown Fox Jumps"]
    texts = [f"A heading without a stop\n{x}\nand some more words" for x in items] + ["A heading\nWho wrote the Odyssey?", "Compute 3 + 4 * 5 - 7", "who knows"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (4, 2): 1}


def test_contamination_equals_direct_search(spark, folder):
    """Copied passages of eight words or more, found with a plain set of word runs."""

    def plain(t):
        return [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in t.split()) if w]

    bench = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        own = plain(r["text"])
        runs = {tuple(own[k : k + 8]) for k in range(len(own) - 7)}
        for item, t in bench.items():
            theirs = {tuple(t[k : k + 8]) for k in range(len(t) - 7)}
            if theirs and len(theirs & runs) >= 0.5 * len(theirs):
                want.add((r["doc_id"], item))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, folder).collect()}
    assert got == want


# ---------------------------------------------------------------- 8: quality


def test_repeat_words_by_hand(spark):
    run = " ".join(f"w{i}" for i in range(10))
    texts = [run, run + " " + run, "a " * 9, "x " + run + " y " + run, "l\nl\n \nm\nl"]
    got = {r["doc_id"]: r for r in quality.assess(docs_of(spark, texts)).collect()}
    assert [got[i]["n_repeat_words"] for i in range(4)] == [0, 20, 9, 20]
    assert got[4]["n_dup_lines"] == 2


def test_stop_words_count_only_where_listed(spark, tmp_path):
    rng = random.Random(9)
    russian = " ".join("".join(rng.choice("абвгдежзик") for _ in range(5)) for _ in range(60))
    latin = " ".join(words(rng, 60))
    rows = [(0, russian, "ru"), (1, russian, None), (2, latin, "pl"), (3, latin, "en"), (4, latin, None), (5, latin + " The OF", "en-GB"),
            (6, " ".join(words(rng, 400)) + " the of", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, con, QUERIES["op8_quality"], ORACLES["op8_quality"], str(tmp_path)) is None


def test_quality_plan_is_one_projection(spark, folder):
    plan = quality.assess(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_prose_is_kept(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op8_quality"](spark, folder).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    assert got.where("kept").count() >= 0.97 * got.count()


# ------------------------------------------------------------------- 9: HTML

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header class="site-header">Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<main><article><header><h1>The &lt;Title&gt;</h1></header><p>First   <b>bold</b>&nbsp;words.<p>Second<br>line
<div class="ad"><p>Buy!</p></div><script>var a = "</p><p>x";</script><ul><li>one<li>two</ul><form>Mail <input> me</form>
<blockquote>quoted &amp; said</blockquote></article><section id="comments"><p>I disagree strongly.</p></section></main>
<aside>related</aside><footer>&copy; foot</footer></body></html>"""


def test_article_only():
    want = "The <Title>\nFirst bold words.\nSecond\nline\none\ntwo\nquoted & said"
    assert htmltext.extract(PAGE) == want


def test_pages_without_marked_article():
    long = "This is a long paragraph of running text that goes on for quite a while. " * 5
    page = f"<body><div><a href=x>a</a></div><div><a href=y>b</a></div><ul><li><a>c</a></ul><p>{long}</p><p>short.</p><p>{long}</p></body>"
    assert htmltext.extract(page) == "\n".join([long.strip(), "short.", long.strip()])
    assert htmltext.extract(None) == "" and htmltext.extract("plain & simple") == "plain & simple"
    assert htmltext.extract("<article><p>cut off <a href='x") == "cut off"


def test_distribution_decides_beside_marked_article():
    body = [f"Paragraph {i} of the body, in a plain element, with enough words in it to be running text on any page." for i in range(4)]
    teaser = "<article><a href=x>Read this too</a></article>"
    page = f"<body><div>Menu</div><div><a href=y>z</a></div><p><a href=z>all</a></p>{teaser}<div>" + "".join(f"<p>{x}</p>" for x in body) + "</div></body>"
    assert htmltext.extract(page) == "\n".join(["Read this too", *body])
    huge = "word " * 4000
    assert htmltext.extract("".join(f"<p>{x}</p>" for x in [*body, huge])) == "\n".join([*body, huge.strip()])


@pytest.mark.parametrize(
    "around",
    ["<body class='no-sidebar'>", "<div id='content-with-sidebar'>", "<article class='post comments-open'>", "<article class='social-science'>",
     "<main id=search>", "<html class='has-banner sidebar'>", "<div class='col social-science'>"],
)
def test_theme_classes_are_not_outside(around):
    text = "Running text of the article that is long enough to be kept by its own weight, wherever on the page it stands."
    assert htmltext.extract(f"{around}<p>{text}</p><div class='sidebar-left ad'>{text}</div><div id=comment-list>{text}</div><p>End.</p>") == text + "\nEnd."


# -------------------------------------------------------------- 10: toxicity


def test_severity_orders_and_separates():
    rng = random.Random(6)
    texts, toxic = [], []
    for i in range(600):
        own = words(rng, rng.randint(20, 120))
        bad = i % 8 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            own[rng.randrange(len(own))] = rng.choice(["horrid", "nasty", "vile"])
        texts.append(" ".join(own))
        toxic.append(int(bad))
    model = toxicity.fit(texts[:400], toxic[:400])
    assert model.cuts[0] < model.cuts[1]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts[400:]})
    got = pa.Table.from_batches(list(toxicity._grader(model)(iter([batch])))).to_pydict()
    assert np.mean([a == bool(b) for a, b in zip(got["toxic"], toxic[400:])]) >= 0.97
    assert all(0 <= s <= 2 for s in got["severity"])


def test_severity_without_labels(spark):
    docs = docs_of(spark, ["a b c", None])
    got = toxicity.predict(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 2 and not any(r["toxic"] for r in got)


# -------------------------------------------------------------- the pipeline


def test_pipeline_stage_by_stage(spark, folder, tmp_path):
    """Each stage on what the one before kept, its decisions checked by hand; ``run`` gives the last."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 150")
    odd = spark.createDataFrame([(900_000, None, "en", "src1", 0), (900_001, "", "en", None, 0), (900_002, "123 456", None, "src1", 7)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 3"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in P.STAGES:
        after = stage(spark, at, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = (at.collect(), after.collect())
        if name != "mix":
            assert after.columns == docs.columns
        at = after
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} >= {900_000, 900_001, 900_002}
    assert len(after) >= 0.97 * (len(before) - 3)
    before, after = seen["line_dedup"]
    kept_lines = [lines_ for r in after for lines_ in set(re.sub(r"[^\w]+", " ", r["text"].lower()).strip() for _ in (0,))]
    assert len(kept_lines) == len(after) and all(len(r["text"]) == r["n_chars"] for r in after)
    before, after = seen["near_dedup"]
    rows = sorted({(r["doc_id"], r["text"]) for r in before}, key=lambda r: r[0])
    classes = brute_classes([t for _, t in rows])
    assert sorted(r["doc_id"] for r in after) == sorted(rows[i][0] for i, c in classes.items() if i == c)
    before, after = seen["decontamination"]
    bad = {r["doc_id"] for r in decontam.contaminated(spark.createDataFrame(before, docs.schema), bench).collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
    _, after = seen["mix"]
    assert all(0 < r["taken"] <= 2 * r["size"] for r in after)
    ran = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, ran)) == sorted(map(str, after))


def test_links_titles_and_anchors_of_pages():
    text = "A paragraph that is long enough to be the article of this page, with some more words in it."
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("One", "Two", "Three", "Four"))
    page = f"<article><h1>Title</h1><p>{text}</p><ul>{menu}</ul><p>{text}</p><ul>{menu}</ul></article>"
    assert htmltext.extract(page) == "\n".join(["Title", text, text])
    assert htmltext.extract(f"<div class='post-header'><h1>Title</h1></div><p>{text}</p>") == f"Title\n{text}"
    assert htmltext.extract(f"<div class='site-header'><h1>Site</h1></div><p>{text}</p>") == text
    assert htmltext.extract(f"<a name=top><p>{text}</p><p><a href=x>link</a> and words</p>") == f"{text}\nlink and words"


def test_unclosed_elements_cost_their_bytes():
    began = time.time()
    text = "words " * 30
    assert htmltext.extract("<div></b>" * 50_000 + text) == text.strip()
    assert htmltext.extract("<b>" * 50_000 + f"<p>{text}" * 100) == "\n".join([text.strip()] * 100)
    assert time.time() - began < 10
