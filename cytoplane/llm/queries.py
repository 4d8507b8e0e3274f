"""The registered text queries: each applies one operator to its whole table."""

from __future__ import annotations

from cytoplane.llm import alignment, decontam, divergence, htmltext, langid, lines, minhash, mixing, quality, secrets, toxicity, vectors, warc
from cytoplane.llm.common import table
from cytoplane.llm.sql import ORACLES  # noqa: F401
from cytoplane.session import workspace

QUERIES = {}



def query(func):
    QUERIES[func.__name__] = func
    return func


@query
def op1_line_dedup(spark, d):
    """Every document with its repeated lines removed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


@query
def op2_minhash(spark, d):
    """One row per document with its class of near-duplicates."""
    return minhash.near_duplicates(table(spark, d, "documents")).select("doc_id", "class_id")


@query
def op3_mixing(spark, d):
    """Words that the mix takes of every document."""
    return mixing.mix_sources(table(spark, d, "documents")).drop("source")


@query
def op4_warc(spark, d):
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, d, "pages"), workspace(spark, "warc"))


@query
def op5_secrets(spark, d):
    """Secrets in every document."""
    return secrets.scan(table(spark, d, "documents"))


@query
def op6_langid(spark, d):
    """Predicted language of every document."""
    return langid.predict(table(spark, d, "documents"))


@query
def op7_decontamination(spark, d):
    """Documents that contain benchmark items."""
    return decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("copy")


@query
def op8_quality(spark, d):
    """Counts and verdict of every document."""
    found = quality.assess(table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_html_text(spark, d):
    """Main text of every page."""
    return htmltext.main_text(table(spark, d, "pages"))


@query
def op10_toxicity(spark, d):
    """Expected severity of every document."""
    return toxicity.predict(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op13_divergence(spark, d):
    """How the sources of each language differ in their words."""
    return divergence.audit(table(spark, d, "documents"))


@query
def op11_near_vectors(spark, d):
    """Every vector with its links to near ones and its component."""
    return vectors.near_vectors(table(spark, d, "embeddings"))


@query
def op12_alignment(spark, d):
    """How the tokens of two tokenizers cover each document."""
    return alignment.align(table(spark, d, "documents"))
