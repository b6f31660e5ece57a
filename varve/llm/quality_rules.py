"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule names a measure and an inclusive range; the rules, the counts under
them and the verdict are plain Column expressions, so a filter on ``kept`` runs
in one pass over the text without a shuffle and without Python on executors.

Edge cases: a null text counts as empty (all counts zero, ``base_failed``);
ratios over zero words are zero; repeated rows are judged independently; extra
columns of the input pass through untouched, whatever they are called, but where
a name that ``apply_rules`` adds (with the caller's prefix) is one of theirs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.words import BLANKS, let, unused, without, words

WINDOW = 5
#: Symbols counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the and of to in that is was with for are this on by it as at be from or an not "
    "le la les de des du et que qui un une en dans pour est pas sur au par ce "
    "der die das und den von zu mit ist im dem nicht ein eine als auf für sich "
    "el los las y del se con para por una su al lo como es"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document when ``low <= measure <= high``; an open end is None."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production thresholds.
RULES = (
    Rule("n_words", low=10),
    Rule("repeat_ratio", high=0.2),
    Rule("symbol_ratio", high=0.25),
    Rule("mean_word_chars", low=1.5, high=20),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_ratio", low=0.02),
    Rule("upper_ratio", high=0.6),
)


def _hashes(n_words: Column, w: Column) -> Column:
    """A 64-bit hash of every run of WINDOW words."""
    at = F.sequence(F.lit(0), n_words - F.lit(WINDOW))
    return F.when(
        n_words >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(h: Column) -> Column:
    """Words inside a run whose hash is in the array twice or more.

    Pairs of hash and place are sorted; those equal to a neighbour are repeats,
    and sorted by place each adds the words up to the next one, WINDOW at most.
    """
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(p, k)["h"] == F.get(p, k + d)["h"], F.lit(False))
        marked = F.transform(p, lambda x, k: F.when(same(k, -1) | same(k, 1), x["i"]))
        return F.sort_array(F.array_compact(marked))

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(pairs, lambda p: let(places(p), total))


def measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the base counts and the measures that rules refer to.

    ``fence`` is not deterministic: a filter that also reads it stays above the
    projection, where it would otherwise copy the word arrays into every lambda.
    """
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = unused(docs.columns, "__words", "__hashes", "__lines")
    w, h, lines = (F.col(c) for c in own)
    df = docs.withColumn(own[0], words(F.col(text_col)))
    df = df.withColumn(f"{p}n_words", F.size(w).cast("long"))
    df = df.withColumn(own[1], _hashes(F.size(w), w))
    df = df.withColumn(own[2], F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    stop = set(STOP_WORDS)
    return df.withColumns(
        {
            f"{p}fence": F.monotonically_increasing_id(),
            f"{p}word_chars": F.length(without(text, BLANKS)).cast("long"),
            f"{p}n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
            f"{p}n_lines": F.size(lines).cast("long"),
            f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{p}n_repeat_words": F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                _covered(h)
            ),
            f"{p}n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*stop))).cast("long"),
            f"{p}n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        }
    ).drop(*own)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def verdict(rules=RULES, prefix: str = "") -> tuple[Column, Column]:
    """(base_failed, kept) from the columns that ``measures`` adds."""
    c = lambda k: F.col(prefix + k)
    value = {
        "n_words": c("n_words"),
        "repeat_ratio": _ratio(c("n_repeat_words"), c("n_words")),
        "symbol_ratio": _ratio(c("n_symbols"), c("n_words")),
        "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "stop_ratio": _ratio(c("n_stop_words") + 1, c("n_words")),  # one more, so that few words prove nothing
        "upper_ratio": _ratio(c("n_upper"), c("word_chars")),
    }
    tests = [value[r.measure] >= r.low for r in rules if r.low is not None]
    tests += [value[r.measure] <= r.high for r in rules if r.high is not None]
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    return failed, ~failed & reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_rules(docs: DataFrame, rules=RULES, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``fence`` (each with ``prefix``)."""
    failed, kept = verdict(rules, prefix)
    return measures(docs, text_col, prefix).withColumns({f"{prefix}base_failed": failed, f"{prefix}kept": kept})


def accepted(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    df = apply_rules(docs, rules, text_col, prefix).filter(F.col(f"{prefix}kept") & (F.col(f"{prefix}fence") >= 0))
    return df.select(*[f"`{c}`" for c in docs.columns])
