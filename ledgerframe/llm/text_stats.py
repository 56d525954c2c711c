"""Statistics of a text as built-in column expressions, shared by the quality operators.

Null texts count as empty; shares of an empty text are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import SPACES, UPPER, n_chars_of, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Inputs of the learned rules, in this order. Labels, language, source and ids are not among them.
FEATURES = ["n_words", "word_length", "symbol_share", "upper_share", "exclaim_share", "stop_share", "distinct_share", "dup_line_share", "line_words", "digit_share"]


def per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _repeated_words(w: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more."""
    n = F.size(w)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        # sorted by hash, windows that are found again stand next to each other
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return _let(placed, lambda s: _let(starts(s), total))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def with_counts(docs: DataFrame, text: str, repeats: bool = False) -> DataFrame:
    """``docs`` with a column for each count, see ``count_of``; n_repeat_words only where ``repeats``."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.withColumn("_t", t).withColumn("_w", words(F.col("_t"))).withColumn("_l", _lines(F.col("_t")))
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.translate(F.col("_t"), SPACES, "")),
        "n_symbols": n_chars_of(F.col("_t"), SYMBOLS),
        "n_upper": n_chars_of(F.col("_t"), UPPER),
        "n_digits": n_chars_of(F.col("_t"), "0123456789"),
        "n_exclaim": F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit(""))),
        "n_short": F.size(F.filter("_w", lambda x: F.length(x) <= 3)),
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
    }
    if repeats:
        counts["n_repeat_words"] = _repeated_words(F.col("_w"))
    return named.withColumns({f"_st_{n}": c for n, c in counts.items()}).drop("_t", "_w", "_l")


def count_of(name: str) -> Column:
    return F.col(f"_st_{name}")


def without_counts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_st_")])


def features() -> dict[str, Column]:
    words_, chars = count_of("n_words"), count_of("word_chars")
    return {
        "n_words": words_.cast("double"),
        "word_length": per(chars, words_),
        "symbol_share": per(count_of("n_symbols"), chars),
        "upper_share": per(count_of("n_upper"), chars),
        "exclaim_share": per(count_of("n_exclaim"), chars),
        "stop_share": per(count_of("n_short"), words_),
        "distinct_share": per(count_of("n_distinct"), words_),
        "dup_line_share": per(count_of("n_dup_lines"), count_of("n_lines")),
        "line_words": per(words_, count_of("n_lines")),
        "digit_share": per(count_of("n_digits"), chars),
    }


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``docs`` joined with ``label``, for at most ``most`` labelled documents that aren't held out.

    The sample follows from a hash of the ids, so it is the same in each run; ``most`` bounds it at
    every size of the input, small enough to broadcast. A document with several labels has the
    largest; null labels don't count.
    """
    ids = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(ids), "doc_id")
