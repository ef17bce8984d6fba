"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

A null text counts as an empty one (and so fails for want of words); ties cannot occur, repeated rows are judged one by
one, and other columns of the input are left as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, let

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Function words of the four languages; any language may use the whole list.
STOP_WORDS = (
    "the of and to in is that for with by on at as from this are was it be or an not "
    "le la les un une des du de et en est que qui dans pour par sur au avec ce il elle ou "
    "der die das und ist von mit dem den ein eine zu auf im nicht es sich als auch an "
    "el los las y que del por con para una su al lo se como"
).split()


class Rule(NamedTuple):
    """A document passes if ``least <= measure <= most``; a missing bound is open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios are of words, characters or lines, as MEASURES says.
RULES = (
    Rule("words", least=50),
    Rule("repeat_ratio", most=0.5),
    Rule("mean_word_chars", least=1.5, most=25),
    Rule("symbol_ratio", most=0.3),
    Rule("stop_word_ratio", least=0.005),
    Rule("dup_line_ratio", most=0.7),
)

#: What each measure is, over the counts below.
MEASURES = {
    "words": lambda c: c["n_words"].cast("double"),
    "repeat_ratio": lambda c: _ratio(c["n_repeat_words"], c["n_words"]),
    "mean_word_chars": lambda c: _ratio(c["word_chars"], c["n_words"]),
    "symbol_ratio": lambda c: _ratio(c["n_symbols"], c["n_words"]),
    "stop_word_ratio": lambda c: _ratio(c["n_stop_words"], c["n_words"]),
    "dup_line_ratio": lambda c: _ratio(c["n_dup_lines"], c["n_lines"]),
}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeat_words(words: Column) -> Column:
    """Words in a 3-word window that is found twice or more. Sorting brings equal windows together: first their hashes,
    and only where two of these are equal the windows themselves, each followed by its place."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    maybe = let(F.sort_array(hashes), lambda h: F.size(h) > F.size(F.array_distinct(h)))
    keyed = F.sort_array(
        F.transform(places, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), F.lpad(i.cast("string"), 10, "0")))
    )

    def covered(keys: Column) -> Column:
        pairs = F.transform(keys, lambda k: F.struct(F.substring_index(k, " ", 3).alias("g"), F.substring_index(k, " ", -1).cast("int").alias("p")))
        return let(
            pairs,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"])),
                            lambda x: F.sequence(x["p"], x["p"] + 2),
                        )
                    )
                )
            ),
        )

    return F.when(n < 4, 0).when(maybe, let(keyed, covered)).otherwise(0).cast("long")


def counts(text: Column) -> Column:
    """A struct of the counts that the table's measures use, each from the whole text."""
    text = F.coalesce(text, F.lit(""))

    def over(t: Column) -> Column:
        words = F.array_remove(F.split(t, SPACE_RUN), "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

        def build(w: Column) -> Column:
            return let(
                lines,
                lambda ls: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                    (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    F.size(ls).cast("long").alias("n_lines"),
                    F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                    _repeat_words(w).alias("n_repeat_words"),
                ),
            )

        return let(words, build)

    return let(text, over)


def verdict(c: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether counts ``c`` stay within every bound of the table."""
    tests = []
    for r in rules:
        m = MEASURES[r.measure](c)
        if r.least is not None:
            tests.append(m >= F.lit(float(r.least)))
        if r.most is not None:
            tests.append(m <= F.lit(float(r.most)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document: its counts, whether a base rule failed, whether it is kept."""
    out = let(
        counts(F.col("text")),
        lambda c: F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")],
            base_failed(c).alias("base_failed"),
            (~base_failed(c) & verdict(c, rules)).alias("kept"),
        ),
    )
    return docs.select(F.col("doc_id"), out.alias("quality")).select("doc_id", "quality.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, all columns, without the documents that the rules reject."""
    return docs.filter(let(counts(F.col("text")), lambda c: ~base_failed(c) & verdict(c, rules)))
