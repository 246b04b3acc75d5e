"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
_WORD_CHAR = r"[^\x20\x09-\x0D]"

# Frequent function words of the languages that the rules serve.
STOP_WORDS = (
    "the be to of and that have with in is for on was at by this from or an are "
    "le la les de des du et un une que qui pour dans par sur pas est avec "
    "der die das und den von zu mit sich des auf ein eine im nicht ist es "
    "el los las y que por para con una se del no "
    "o os as da do em um uma com di il che per non"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if the metric lies below `low` or above `high`."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Lenient production thresholds: clean prose of any of the languages passes every one.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("digit_ratio", None, 0.5),
    Rule("stop_words", 2, None),
    Rule("dup_line_ratio", None, 0.6),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _dup_windows(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    Windows are told apart by a hash. Only a text with a repeated hash is put
    into order, as plain longs: the hash above, the place in the low bits, as
    many as the number of words takes.
    """
    none = F.lit(0).cast("long")
    hashes = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column, bits: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
        mark = lambda x: F.call_function("shiftright", x, bits)
        twice = lambda s: F.filter(s, lambda e, k: (mark(e) == mark(F.get(s, k + 1))) | (k > 0) & (mark(e) == mark(F.get(s, F.greatest(k - 1, F.lit(0))))))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        places = F.sort_array(F.transform(let(packed, twice), lambda e: e.bitwiseAND(low)))
        start = F.struct(F.lit(-3).cast("long").alias("last"), none.alias("total"))
        step = lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("total"))
        return F.aggregate(places, start, step, lambda a: a["total"])

    repeated = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h, F.length(F.bin(F.size(h).cast("long"))))).otherwise(none)
    return F.when(F.size(w) >= 4, let(hashes, repeated)).otherwise(none)


def quality_metrics(text: Column) -> Column:
    """All counts of one text as a struct; a null text has no words and counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(_WORD_CHAR))
    stops = F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)])
    count = lambda chars: F.size(F.regexp_extract_all(t, F.lit(chars), F.lit(0))).cast("long")
    by_word = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _dup_windows(w).alias("n_repeat_words"), F.size(F.array_intersect(stops, w)).cast("long").alias("stop_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(by_word.alias("w"), by_line.alias("l"), count(f"[{SYMBOLS}]").alias("n_symbols"), count("[0-9]").alias("n_digits"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Adds the struct `quality` with counts, `base_failed` and `kept` to each row.

    One projection: no shuffle, no user function, every row and every other
    column kept. Null or empty texts have no words and fail the base rules;
    repeated rows and ties are judged alike; an empty table gives an empty one;
    texts of any length are judged whole (a row holds its text's words and
    hashes); a column named `quality` is replaced.
    """
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))

    def judged(m: Column) -> Column:
        n = m["w"]["n_words"]
        value = {
            "mean_word_chars": ratio(m["w"]["word_chars"], n),
            "symbol_ratio": ratio(m["n_symbols"], n),
            "digit_ratio": ratio(m["n_digits"], m["w"]["word_chars"]),
            "stop_words": m["w"]["stop_words"],
            "dup_line_ratio": ratio(m["l"]["n_dup_lines"], m["l"]["n_lines"]),
        }
        base = (n < min_words) | (100 * m["w"]["n_repeat_words"] > max_repeat_percent * n)
        bad = base
        for r in rules:
            bad = bad | (value[r.metric] < r.low if r.low is not None else F.lit(False)) | (value[r.metric] > r.high if r.high is not None else F.lit(False))
        return F.struct(
            n.alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"), base.alias("base_failed"), (~bad).alias("kept"), *[value[r.metric].cast("double").alias(f"m_{r.metric}") for r in rules],
        )

    return docs.withColumn("quality", let(quality_metrics(F.col("text")), judged))
