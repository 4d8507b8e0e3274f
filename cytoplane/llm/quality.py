"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import GAP, WORD, once

WINDOW = 8
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for on was as are this from by an or "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als "
    "le la les de des et un une du en que est pour qui dans sur pas au avec par "
    "el los las del y se por con para su al lo como es una no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` <= numerator / denominator <= ``high`` (None: open), compared in whole numbers.

    Bounds are in thousandths. A rule whose denominator is 0 passes if the
    numerator is 0 too, or if it has no upper bound.
    """

    name: str
    numerator: str
    denominator: str | None = None
    low: int | None = None
    high: int | None = None

    def passes(self, row: dict[str, Column]) -> Column:
        value = row[self.numerator] * 1000
        unit = row[self.denominator] if self.denominator else F.lit(1)
        tests = [F.lit(True)]
        if self.low is not None:
            tests.append(value >= unit * self.low)
        if self.high is not None:
            tests.append(value <= unit * self.high)
        return reduce(lambda a, b: a & b, tests)


#: Ratios outside these bounds mark text that is not prose; the rules of LISTED_RULES say so only in languages that have a list.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2_000, high=20_000),
    Rule("symbol_ratio", "n_symbols", "n_words", high=500),
    Rule("stop_words", "n_stop", low=2_000),
    Rule("letter_words", "n_letter_words", "n_words", low=600),
    Rule("capital_words", "n_capital_words", "n_words", high=500),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=900),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=500),
)


#: Stop words among all words.
STOP_RATIO = Rule("stop_ratio", "n_stop_words", "n_words", low=20)
LISTED_RULES = frozenset(("stop_words", "stop_ratio"))
#: Languages whose words STOP_WORDS lists; a text of one of these, or of none that is known.
LISTED = ("en", "de", "fr", "es")
NOT_KNOWN = ("", "und")


def _has_list(docs: DataFrame) -> Column:
    """Does the language a document is said to have allow the rules on stop words? True if nothing is said."""
    if "lang" not in docs.columns:
        return F.lit(True)
    lang = F.lower(F.split(F.col("lang").cast("string"), "[-_]")[0])
    return F.coalesce(lang.isin(*LISTED, *NOT_KNOWN), F.lit(True))


def _covered(keys: Column) -> Column:
    """Words lying in a window whose key occurs again; ``keys[i]`` is of the window at word i."""

    def starts(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, j: ((j > 0) & (F.get(s, j - 1)["k"] == x["k"])) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    return F.aggregate(
        once(placed, starts),
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )


def _repeat_words(words: Column) -> Column:
    def windows(hashes: Column) -> Column:
        n = F.size(hashes) - (WINDOW - 1)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return F.when(n >= 2, each).otherwise(F.array().cast("array<bigint>"))

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_covered(keys))

    return once(once(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def measures(text: Column) -> dict[str, Column]:
    """The counts of one text that rules and reports use; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.size(F.array_intersect(F.transform(w, lambda x: F.lower(x)), F.array(*map(F.lit, STOP_WORDS)))).alias("n_stop"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"^\P{L}*\p{IsLatin}"))).alias("n_latin_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"^\P{L}*\p{Lu}{2}") & (x == F.upper(x)))).alias("n_capital_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•‣·]"))).alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "w": once(words, of_words),
        "l": once(lines, of_lines),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
    }


def assess(docs: DataFrame, rules: tuple[Rule, ...] = (*RULES, STOP_RATIO)) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, one ``ok_<rule>`` per rule, and ``kept``.

    One projection, no shuffle. Base: fewer than 20 words, or more than 30 % of
    the words in eight-word windows found twice or more in the text. ``kept``
    is false for base failures, else true if every rule passes. The rules on
    stop words pass if most words are not in Latin script, or if a column
    ``lang`` names a language that ``STOP_WORDS`` does not list.

    Windows are compared by 64-bit hashes within their text. A null or empty
    text has no words and fails the base. Repeated rows give repeated results;
    other columns are not passed on, so names cannot clash; an empty table
    gives an empty result.
    """
    found = docs.select("doc_id", _has_list(docs).alias("__has_list"), *[c.alias(f"__{k}") for k, c in measures(F.col("text")).items()])
    flat = found.select(
        "doc_id", "__has_list", F.col("__w.*"), F.col("__l.*"), F.col("__word_chars").alias("word_chars"), F.col("__n_symbols").alias("n_symbols")
    )
    counts = [c for c in flat.columns if c not in ("doc_id", "__has_list")]
    flat = flat.select("doc_id", "__has_list", *[F.col(c).cast("long").alias(c) for c in counts])
    row = {c: F.col(c) for c in counts}
    listed = F.col("__has_list") & (2 * row["n_latin_words"] >= row["n_letter_words"])
    passes = {r.name: r.passes(row) | ~listed if r.name in LISTED_RULES else r.passes(row) for r in rules}
    failed = (row["n_words"] < 20) | (100 * row["n_repeat_words"] > 30 * row["n_words"])
    good = reduce(lambda a, b: a & b, passes.values())
    return flat.select(
        "doc_id", *counts, failed.alias("base_failed"), *[ok.alias(f"ok_{k}") for k, ok in passes.items()], (~failed & good).alias("kept")
    )
