"""Queries: vocabulary, tokenisation, encoding, segmentation, text overlaps.

Token lists are compared by length and digest, one row per document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions import strings as ST
from cytoplane.operators import text as X
from cytoplane.plans import fixtures as fx
from cytoplane.plans.registry import block, query
from cytoplane.session import cut, spread, workspace

block(
    "vocab",
    "",
    """SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id, n FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents) WHERE token <> '' GROUP BY token)""",
)
SPECIAL_ROWS = ", ".join(f"('{t}', {i})" for i, t in enumerate(X.SPECIALS))
block(
    "full_vocab",
    "vocab",
    f"""SELECT token, id + {len(X.SPECIALS)} AS id FROM vocab UNION SELECT * FROM (VALUES {SPECIAL_ROWS}) v(token, id)""",
)
FORCED = [X.PAD, X.UNK, X.CLS, X.SEP]


def _docs(spark, d):
    return spread(fx.table(spark, d, "documents").select("doc_id", "text"))


@query("build_vocab", "vocab", "SELECT token, id, n FROM vocab")
def build_vocab(spark, d):
    return X.build_vocab(_docs(spark, d))


@query("load_vocab", "vocab", "SELECT token, id FROM vocab")
def load_vocab(spark, d):
    """A vocabulary written as lines and read back with ids by line."""
    path = workspace(spark, "vocab_lines")
    X.save_vocab(X.build_vocab(_docs(spark, d)), path)
    return X.load_vocab(spark, path)


@query("save_vocab", "vocab", "SELECT token FROM vocab")
def save_vocab(spark, d):
    """Round trip through token lines."""
    path = workspace(spark, "vocab")
    X.save_vocab(X.build_vocab(_docs(spark, d)), path)
    return spark.read.text(path).withColumnRenamed("value", "token")


@query(
    "simplify_vocab",
    "full_vocab",
    f"""SELECT token, row_number() OVER (ORDER BY forced DESC, id) - 1 AS id, id AS old_id FROM (
  SELECT *, token IN ('{"', '".join(FORCED)}') AS forced FROM full_vocab)
WHERE forced OR length(token) = 1 OR NOT regexp_matches(regexp_replace(token, '^##', ''), '[{X.CJK}{X.SIGNS}]')""",
)
def simplify_vocab(spark, d):
    vocab = X.build_vocab(_docs(spark, d), X.SPECIALS)
    return X.simplify_vocab(vocab, FORCED)


def _words_sql(text: str) -> str:
    """SQL twin of the basic tokeniser: a list of words."""
    return f"""list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace({text},
      '([{X.CJK}{X.SIGNS}])', ' \\1 ', 'g'), '[\\p{{Z}}\\n\\r\\t]', ' ', 'g'), '[\\x{{0}}\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}]', '', 'g'), ' +'), lambda w: w <> '')"""


@query(
    "basic_tokenize",
    "",
    f"""SELECT doc_id, form, len(words) AS n_words, md5(array_to_string(words, ' ')) AS digest FROM (
  SELECT doc_id, 'cased' AS form, {_words_sql('text')} AS words FROM documents
  UNION ALL SELECT doc_id, 'lower', {_words_sql('strip_accents(lower(text))')} FROM documents)""",
)
def basic_tokenize(spark, d):
    docs = _docs(spark, d)
    both = docs.select("doc_id", F.lit("cased").alias("form"), X.basic_words(F.col("text")).alias("words")).unionByName(
        docs.select("doc_id", F.lit("lower").alias("form"), X.basic_words(F.col("text"), lower=True).alias("words"))
    )
    return both.select(
        "doc_id", "form", F.size("words").cast("bigint").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest")
    )


# The piece vocabulary: frequent words, and frequent short pieces of words at
# their start or (marked) inside, all taken from the documents.
block("doc_words", "", f"SELECT doc_id, {_words_sql('text')} AS words FROM documents")
block(
    "word_counts",
    "doc_words",
    "SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM doc_words) GROUP BY word",
)
block(
    "piece_vocab",
    "word_counts",
    """SELECT token, row_number() OVER (ORDER BY first DESC, n DESC, token) - 1 AS id FROM (
    SELECT token, max(first) AS first, max(n) AS n FROM (
      SELECT word AS token, n, 0 AS first FROM word_counts WHERE n >= 20
      UNION ALL SELECT CASE WHEN i > 1 THEN '##' ELSE '' END || substr(word, CAST(i AS BIGINT), CAST(l AS BIGINT)) AS token, sum(n) AS n, 0 AS first
        FROM (SELECT word, n, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS i FROM word_counts), (SELECT unnest(range(1, 4)) AS l)
        WHERE i + l - 1 <= length(word) GROUP BY 1 HAVING sum(n) >= 50
      UNION ALL SELECT unnest(['[UNK]', '[CLS]', '[SEP]', '[PAD]', '[MASK]']), 0, 1) GROUP BY token)""",
)


def _tokens(spark, d):
    return _docs(spark, d).select("doc_id", X.basic_words(F.col("text")).alias("words"))


def _words_and_vocab(spark, d):
    """The words of all documents, made anew where they are read, and the piece vocabulary made of them."""
    words = _tokens(spark, d)
    return words, _piece_vocab(spark, words)


def _piece_vocab(spark, tokens):
    from cytoplane.operators.ordering import with_position

    words = tokens.select(F.explode_outer("words").alias("word")).where("word IS NOT NULL")
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    frequent = counts.where("n >= 20").select(F.col("word").alias("token"), "n")
    starts = F.explode(F.sequence(F.lit(1), F.length("word")))
    cuts = (
        counts.withColumn("i", starts)
        .withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .where("i + l - 1 <= length(word)")
    )
    sub = F.concat(F.when(F.col("i") > 1, X.CONTINUES).otherwise(""), F.expr("substring(word, i, l)"))
    short = cuts.groupBy(sub.alias("token")).agg(F.sum("n").alias("n")).where("n >= 50")
    special = spark.createDataFrame([(t, 0, 1) for t in X.SPECIALS], "token string, n bigint, first int")
    merged = (
        frequent.unionByName(short)
        .withColumn("first", F.lit(0))
        .unionByName(special)
        .groupBy("token")
        .agg(F.max("first").alias("first"), F.max("n").alias("n"))
    )
    numbered = with_position(merged, [F.desc("first"), F.desc("n"), F.col("token")], "id")
    return cut(numbered.select("token", "id"))


# Greedy longest match, one step of every open word per recursion.
block(
    "cuts",
    "word_counts piece_vocab",
    """SELECT word, 0 AS pos, []::VARCHAR[] AS pieces FROM word_counts
  UNION ALL
  SELECT word, pos + greatest(coalesce(max(length(v.token) - m), 1), 1), list_append(any_value(pieces),
    coalesce(arg_max(v.token, length(v.token)), CASE WHEN pos > 0 THEN '##' ELSE '' END || substr(word, pos + 1, 1)))
  FROM (SELECT c.word, c.pos, c.pieces, CASE WHEN c.pos > 0 THEN 2 ELSE 0 END AS m,
          unnest(list_transform(range(1, CAST(least(length(c.word) - c.pos, (SELECT max(length(token)) FROM piece_vocab)) AS BIGINT) + 1), lambda l: CASE WHEN c.pos > 0 THEN '##' ELSE '' END || substr(c.word, CAST(c.pos + 1 AS BIGINT), l))) AS try
        FROM cuts c WHERE c.pos < length(c.word)) t LEFT JOIN piece_vocab v ON v.token = t.try GROUP BY word, pos""",
)
block(
    "word_pieces",
    "cuts piece_vocab",
    """SELECT word, list(token ORDER BY k) AS pieces, list(coalesce(v.id, (SELECT id FROM piece_vocab WHERE token = '[UNK]')) ORDER BY k) AS ids
  FROM (SELECT word, unnest(pieces) AS token, generate_subscripts(pieces, 1) AS k FROM cuts WHERE pos >= length(word)) LEFT JOIN piece_vocab v USING (token) GROUP BY word""",
)
block(
    "doc_pieces",
    "doc_words word_pieces",
    """SELECT d.doc_id, flatten(coalesce(list(p.pieces ORDER BY k) FILTER (p.word IS NOT NULL), [])) AS pieces, flatten(coalesce(list(p.ids ORDER BY k) FILTER (p.word IS NOT NULL), [])) AS ids
  FROM doc_words d LEFT JOIN (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM doc_words) w USING (doc_id)
  LEFT JOIN word_pieces p USING (word) GROUP BY d.doc_id""",
)

PIECES_SQL = "SELECT doc_id, CAST(len(pieces) AS BIGINT) AS n_pieces, md5(array_to_string(pieces, ' ')) AS digest, md5(array_to_string(ids, ' ')) AS id_digest FROM doc_pieces"


def _piece_rows(df):
    return df.select(
        "doc_id",
        F.size("pieces").cast("bigint").alias("n_pieces"),
        F.md5(F.array_join("pieces", " ")).alias("digest"),
        F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("id_digest"),
    )


@query("wordpiece_tokenize", "doc_pieces", PIECES_SQL)
def wordpiece_tokenize(spark, d):
    return _piece_rows(X.wordpiece(*_words_and_vocab(spark, d)))


@query("wordpiece_tokenize_by_join", "doc_pieces", PIECES_SQL)
def wordpiece_tokenize_by_join(spark, d):
    """The same by joins, as for a vocabulary too large to share."""
    return _piece_rows(X.wordpiece(*_words_and_vocab(spark, d), limit=0))


CODE = {"cls": "(SELECT id FROM piece_vocab WHERE token = '[CLS]')", "sep": "(SELECT id FROM piece_vocab WHERE token = '[SEP]')"}


@query(
    "encode_text",
    "doc_pieces piece_vocab",
    f"""SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ' ')) AS digest, CAST(0 AS BIGINT) AS segment_sum FROM (
  SELECT doc_id, list_concat([{CODE['cls']}], CASE WHEN len(ids) > 126 THEN ids[1:126] ELSE ids END, [{CODE['sep']}]) AS ids FROM doc_pieces)""",
)
def encode_text(spark, d):
    words, vocab = _words_and_vocab(spark, d)
    rows = X.wordpiece(words, vocab)
    ids, segments = X.encode(F.col("ids"), X.special_ids(vocab), maxlen=128)
    return _encoded(rows.select("doc_id", ids.alias("ids"), segments.alias("segments")), "doc_id")


def _encoded(rows, *keys):
    return rows.select(
        *keys,
        F.size("ids").cast("bigint").alias("n_ids"),
        F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"),
        F.aggregate("segments", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("segment_sum"),
    )


# Both turns go through the vocabulary of the conversations' own words.
block("turn_words", "", f"SELECT conv_id, turn, {_words_sql('text')} AS words FROM conversations")
block(
    "turn_vocab",
    "turn_words",
    """SELECT word AS token, row_number() OVER (ORDER BY n DESC, word) + 4 AS id FROM (
    SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM turn_words) GROUP BY word HAVING count(*) >= 2)""",
)
block(
    "turn_ids",
    "turn_words turn_vocab",
    """SELECT t.conv_id, t.turn, coalesce(list(coalesce(v.id, 1) ORDER BY k) FILTER (word IS NOT NULL), []) AS ids
  FROM turn_words t LEFT JOIN (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM turn_words) w
    ON w.conv_id = t.conv_id AND w.turn = t.turn LEFT JOIN turn_vocab v ON v.token = w.word GROUP BY t.conv_id, t.turn""",
)


@query(
    "encode_text_pair",
    "turn_ids",
    """SELECT conv_id, turn, CAST(len(a) + len(b) AS BIGINT) AS n_ids, md5(array_to_string(list_concat(a, b), ' ')) AS digest, CAST(len(b) AS BIGINT) AS segment_sum FROM (
  SELECT conv_id, turn, list_concat([2], x[1:ka - 2], [3]) AS a, list_concat(y[1:kb - 1], [3]) AS b FROM (
    SELECT *, CASE WHEN la + lb <= 48 OR la <= 24 THEN la WHEN lb <= 24 THEN 48 - lb ELSE 24 END AS ka,
      CASE WHEN la + lb <= 48 OR lb <= 24 THEN lb WHEN la <= 24 THEN 48 - la ELSE 24 END AS kb FROM (
      SELECT p.conv_id, p.turn, p.ids AS x, q.ids AS y, len(p.ids) + 2 AS la, len(q.ids) + 1 AS lb
      FROM turn_ids p JOIN turn_ids q ON q.conv_id = p.conv_id AND q.turn = p.turn + 1)))""",
)
def encode_text_pair(spark, d):
    """Consecutive turns as two segments, cut to 48 ids from the longer side."""
    from cytoplane.operators.ordering import with_position

    turns = cut(
        fx.table(spark, d, "conversations").select("conv_id", "turn", X.basic_words(F.col("text")).alias("words"))
    )
    counts = turns.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 2")
    numbered = with_position(counts, [F.desc("n"), F.col("token")], "id")
    vocab = numbered.select("token", (F.col("id") + len(X.SPECIALS)).alias("id")).unionByName(
        spark.createDataFrame([(t, i) for i, t in enumerate(X.SPECIALS)], "token string, id bigint")
    )
    vocab = cut(vocab)
    coded = cut(X.whole_word_ids(turns, vocab))
    first = coded.select("conv_id", "turn", F.col("ids").alias("x"))
    second = coded.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("y"))
    pairs = first.join(second, ["conv_id", "turn"])
    ids, segments = X.encode(F.col("x"), X.special_ids(vocab), F.col("y"), maxlen=48)
    return _encoded(
        pairs.select("conv_id", "turn", ids.alias("ids"), segments.alias("segments")), "conv_id", "turn"
    )


def _clean_sql(text: str) -> str:
    close = X.CLOSE_CLASS.replace("'", "''")
    return f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, ' +', ' ', 'g'),
    ''' (re|m|s|t|ve|d|ll) ', '''\\1 ', 'g'), '({close}) ', '\\1', 'g'), '(\\d\\.) (\\d)', '\\1\\2', 'g'))"""


_LAST = "regexp_matches(kept[i - 1], '[" + X.CJK + "]$')"
DECODE_PART = f"""CASE WHEN starts_with(t, '##') THEN substr(t, 3) WHEN length(t) = 1 AND regexp_matches(t, '^[{X.CJK}]$') THEN t
  WHEN length(t) = 1 AND regexp_matches(t, '^[{X.SIGNS}]$') THEN t || ' ' WHEN i > 1 AND {_LAST} THEN t ELSE ' ' || t END"""


@query(
    "decode_ids",
    "doc_pieces piece_vocab",
    f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM (SELECT doc_id, {_clean_sql("array_to_string(list_transform(kept, lambda t, i: " + DECODE_PART + "), '')")} AS text FROM (
  SELECT doc_id, list_filter(list_transform(ids, lambda x: names[x + 1]), lambda t: NOT (starts_with(t, '[') AND ends_with(t, ']'))) AS kept
  FROM doc_pieces, (SELECT list(token ORDER BY id) AS names FROM piece_vocab)))""",
)
def decode_ids(spark, d):
    """Ids of whole documents back to readable text."""
    words, vocab = _words_and_vocab(spark, d)
    rows = X.wordpiece(words, vocab)
    named = X.ids_to_tokens(rows.select("doc_id", "ids"), vocab)
    text = X.decode_tokens(F.col("tokens"))
    return named.select("doc_id", text.alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest")
    )


@query(
    "token_offsets",
    "doc_pieces",
    """SELECT doc_id, CAST(len(pieces) AS BIGINT) AS n_tokens, CAST(len(pieces) AS BIGINT) AS n_exact,
  CAST(CASE WHEN len(pieces) > 0 THEN length(regexp_replace(text, '[\\p{Z}\\p{Cc}\\p{Cf}\\x{FFFD}]+$', '')) END AS BIGINT) AS last_end
FROM doc_pieces JOIN documents USING (doc_id)""",
)
def token_offsets(spark, d):
    """Places of all word pieces in the original text, with the text found there."""
    docs = _docs(spark, d).select("doc_id", "text", X.basic_words(F.col("text")).alias("words"))
    vocab = _piece_vocab(spark, docs)
    spans = X.wordpiece(docs, vocab).withColumn("spans", X.token_offsets(F.col("text"), F.col("pieces"), with_text=True))
    good = F.zip_with("pieces", "spans", lambda p, s: s["text"] == F.regexp_replace(p, "^##", ""))
    return spans.select(
        "doc_id",
        F.size("spans").cast("bigint").alias("n_tokens"),
        F.size(F.filter(good, lambda g: g)).cast("bigint").alias("n_exact"),
        F.try_element_at("spans", F.lit(-1))["end"].cast("bigint").alias("last_end"),
    )


@query("segment_text")
def segment_text(spark, d):
    """All documents cut at line ends, then full stops, then blanks, below 200 characters."""
    parts = X.segment_text(F.col("text"), 200, "\n. ")
    rows = _docs(spark, d).select("doc_id", F.posexplode_outer(parts).alias("pos", "piece"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "piece")


@query(
    "segment_text_rebuilt",
    "",
    """SELECT doc_id, md5(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]', '', 'g')) AS digest, CAST(0 AS BIGINT) AS n_long FROM documents""",
)
def segment_text_rebuilt(spark, d):
    """The pieces of ``segment_text`` put together again, and how many are too long."""
    parts = segment_text(spark, d).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"), F.count_if(F.length("piece") > 200).alias("n_long")
    )  # a document's own pieces
    return parts.select("doc_id", F.md5(F.regexp_replace(F.array_join("p.piece", ""), r"[\t\n\x0B\f\r ]", "")).alias("digest"), "n_long")


@query(
    "fullwidth_to_halfwidth",
    "",
    """SELECT doc_id, md5(translate(text, '"""
    + chr(0x3000)
    + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    + """', ' '
  || '!"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~')) AS digest
FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, translate(text, 'abcdefghij ', 'ａｂｃｄｅｆｇｈｉｊ"""
    + chr(0x3000)
    + """') FROM benchmark)""",
)
def fullwidth_to_halfwidth(spark, d):
    """Documents, and benchmark texts first written in wide forms."""
    wide = F.translate("text", "abcdefghij ", "ａｂｃｄｅｆｇｈｉｊ" + chr(0x3000))
    items = fx.table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), wide.alias("text"))
    rows = _docs(spark, d).unionByName(items)
    return rows.select("doc_id", F.md5(ST.fullwidth_to_halfwidth(F.col("text"))).alias("digest"))


@query("safe_decode", "", "SELECT doc_id, md5(replace(text, chr(65533), '')) AS digest, CAST(length(replace(text, chr(65533), '')) AS BIGINT) AS n_chars FROM documents")
def safe_decode(spark, d):
    """Bytes with a stray 0xFF in front of every text decode to the text."""
    raw = F.concat(F.lit(bytearray(b"\xff")), F.encode("text", "UTF-8"))
    rows = _docs(spark, d).select("doc_id", ST.safe_decode(raw).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


# --------------------------------------------------------------------- overlaps

# Runs of 24 characters that both sides have; a text shorter than that is a run by itself.
block("doc_runs", "", "SELECT DISTINCT doc_id AS id, unnest(list_transform(range(1, length(text) - 22), lambda i: substring(text, i, 24))) AS g FROM documents WHERE length(text) >= 24")
block("item_runs", "", "SELECT DISTINCT item_id AS id, unnest(list_transform(range(1, length(text) - 22), lambda i: substring(text, i, 24))) AS g FROM benchmark WHERE length(text) >= 24")
block(
    "pair_candidates",
    "doc_runs item_runs",
    """SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM doc_runs a JOIN item_runs b USING (g)
  UNION SELECT doc_id, item_id FROM documents d JOIN benchmark b ON least(length(d.text), length(b.text)) BETWEEN 1 AND 23
    AND (contains(d.text, b.text) OR contains(b.text, d.text))""",
)


def _sides(spark, d):
    docs = _docs(spark, d).withColumnRenamed("doc_id", "id")
    items = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return docs, items


@query("candidate_pairs", "pair_candidates", "SELECT left_id, right_id FROM pair_candidates")
def candidate_pairs(spark, d):
    return X.candidate_pairs(*_sides(spark, d))


# Equal runs of 24 characters in a row on one diagonal make a longer run; a shorter text is a run by itself.
block("doc_places", "", "SELECT doc_id AS id, i - 1 AS i, substring(text, CAST(i AS BIGINT), 24) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 22)) AS i FROM documents WHERE length(text) >= 24)")
block("item_places", "", "SELECT item_id AS id, i - 1 AS i, substring(text, CAST(i AS BIGINT), 24) AS g FROM (SELECT item_id, text, unnest(range(1, length(text) - 22)) AS i FROM benchmark WHERE length(text) >= 24)")
block(
    "shared_spans",
    "doc_places item_places",
    """SELECT left_id, right_id, count(*) + 23 AS length, min(i) AS i, min(j) AS j FROM (
    SELECT left_id, right_id, i, j, i - row_number() OVER (PARTITION BY left_id, right_id, j - i ORDER BY i) AS island
    FROM (SELECT a.id AS left_id, b.id AS right_id, a.i, b.i AS j FROM doc_places a JOIN item_places b USING (g)))
  GROUP BY left_id, right_id, j - i, island
  UNION SELECT doc_id, item_id, least(length(d.text), length(b.text)), greatest(strpos(d.text, b.text), 1) - 1, greatest(strpos(b.text, d.text), 1) - 1
  FROM documents d JOIN benchmark b ON least(length(d.text), length(b.text)) BETWEEN 1 AND 23 AND (contains(d.text, b.text) OR contains(b.text, d.text))""",
)


@query(
    "longest_common_substring_join",
    "shared_spans",
    """SELECT left_id, right_id, CAST(length AS INTEGER) AS length, CAST(i AS INTEGER) AS left_start, CAST(i + length AS INTEGER) AS left_end,
  CAST(j AS INTEGER) AS right_start, CAST(j + length AS INTEGER) AS right_end FROM (
  SELECT *, row_number() OVER (PARTITION BY left_id, right_id ORDER BY length DESC, i, j) AS place FROM shared_spans) WHERE place = 1""",
)
def longest_common_substring_join(spark, d):
    return X.longest_common_substring_join(*_sides(spark, d))


@query("longest_common_subsequence_join")
def longest_common_subsequence_join(spark, d):
    out = X.longest_common_subsequence_join(*_sides(spark, d))
    return out.select(
        "left_id",
        "right_id",
        F.col("length").cast("bigint").alias("length"),
        F.col("mapping")[0]["left_pos"].cast("bigint").alias("first_left"),
        F.try_element_at("mapping", F.lit(-1))["left_pos"].cast("bigint").alias("last_left"),
    )
