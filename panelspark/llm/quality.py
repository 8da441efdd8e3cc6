"""Quality rules with thresholds that adapt to each language and source.

Word, symbol, line and repetition counts of every text are taken in one pass of
built-in functions.  Fences come from quantile sketches per (language, source):
a sketch is a histogram whose bucket is the value cut to three leading decimal
digits (relative error below 1 %), so that sketches merge by adding counts, in
any order and with the same result on every run.  The sketch of a language, and
of the whole corpus, is the sum of its parts; a group with fewer than
``min_support`` documents takes the fences of its language, or else of the corpus.
A value is out of line when it lies more than ``REACH`` spreads above (or, where
the rule says so, below) the median; the spread is the distance from the lower
quartile to the median, at least the rule's own least spread.

Defined results: a null text has no words and fails the base rules; null
languages and sources are groups of their own; an empty table gives an empty
result; repeated rows are judged alike; a result column replaces an input column
of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, join_small, staged, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
REACH = 6
MIN_SUPPORT = 200

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """An integer measure of a text and the least spread its fence is built with."""

    name: str
    value: Column
    least_spread: int
    both_sides: bool = False


def _share(part: str, whole: str) -> Column:
    """Ten-thousandths, cut to a whole number."""
    return F.expr(f"cast(floor({part} * 10000 / greatest({whole}, 1)) as bigint)")


def rules() -> list[Rule]:
    return [
        Rule("symbols", _share("n_symbols", "word_chars"), 50),
        Rule("capitals", _share("n_upper", "word_chars"), 250),
        Rule("dup_lines", _share("n_dup_lines", "n_lines"), 700),
        Rule("word_length", F.expr("cast(floor(word_chars * 1000 / greatest(n_words, 1)) as bigint)"), 500, True),
    ]


def measures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` packed in ``row`` with the counts of the text beside it."""
    keep = df.columns if keep is None else keep
    has_word = "[^\\x20\\x09-\\x0D]"
    a = df.select(
        F.struct(*[col(c) for c in keep]).alias("row"),
        F.coalesce(col(text), F.lit("")).alias("t"),
        words(col(text)).alias("w"),
    )
    b = a.select(
        "row",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(has_word))).alias("l"),
        F.transform(
            F.slice("w", F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get("w", i + k) for k in range(1, WINDOW)]),
        ).alias("h"),
    )
    # only texts with a window found twice go on to place it: sorted windows next to an equal one
    c = b.select(
        "row", "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    d = c.withColumn(
        "p",
        F.sort_array(
            F.transform(
                F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    ).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _bucket(value: Column) -> Column:
    """The value cut to three leading decimal digits."""
    unit = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("bigint")
    return value - value % unit


def sketches(measured: DataFrame, lang: Column, source: Column) -> DataFrame:
    """Histogram sketches: (lang, source, rule, bucket, n), at most some thousand
    buckets for each rule of each group however many rows it has."""
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), _bucket(r.value).alias("bucket")) for r in rules()])
    return (
        measured.select(lang.alias("lang"), source.alias("source"), F.explode(values).alias("v"))
        .groupBy("lang", "source", F.col("v.rule").alias("rule"), F.col("v.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """One row per (lang, source): ``f_<rule>_lo`` and ``f_<rule>_hi`` of every rule,
    from the finest of group, language and corpus with ``min_support`` documents."""

    def quartiles(*keys: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*keys, "rule")
        up_to = part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = merged.select(*keys, "rule", "bucket", F.sum("n").over(up_to).alias("c"), F.sum("n").over(part).alias("total"))
        return ranked.groupBy(*keys, "rule").agg(
            F.struct(
                F.max("total").alias("n"),
                F.min(F.when(4 * F.col("c") >= F.col("total"), F.col("bucket"))).alias("q1"),
                F.min(F.when(2 * F.col("c") >= F.col("total"), F.col("bucket"))).alias("q2"),
            ).alias("q")
        )

    own = quartiles("lang", "source").withColumnRenamed("q", "own")
    by_lang = quartiles("lang").select(F.col("lang").alias("l_"), F.col("rule").alias("r_"), F.col("q").alias("of_lang"))
    corpus = quartiles().withColumnRenamed("q", "of_all")
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_")) & (F.col("rule") == F.col("r_"))).join(corpus, "rule")
    q = F.when(F.col("own.n") >= min_support, F.col("own")).when(F.col("of_lang.n") >= min_support, F.col("of_lang")).otherwise(F.col("of_all"))
    picked = joined.select("lang", "source", "rule", q.alias("q"))
    ends = []
    for r in rules():
        reach = REACH * F.greatest(F.col("q.q2") - F.col("q.q1"), F.lit(r.least_spread))
        ends.append(F.max(F.when(F.col("rule") == r.name, F.col("q.q2") + reach)).alias(f"f_{r.name}_hi"))
        low = F.col("q.q2") - reach if r.both_sides else F.lit(None).cast("bigint")
        ends.append(F.max(F.when(F.col("rule") == r.name, low)).alias(f"f_{r.name}_lo"))
    return picked.groupBy("lang", "source").agg(*ends)


def apply_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    keep: list[str] | None = None, min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """The ``keep`` columns (default: all) of every row with the base counts,
    ``base_failed``, ``kept`` and ``failed_rules`` (names joined by commas)."""
    cols = docs.columns if keep is None else keep
    l_, s_ = fresh(docs, "__lang", "__source")
    prepared = docs.withColumns({l_: col(lang), s_: col(source)})
    measured = measures(prepared, text, [*cols, l_, s_])
    rows = staged(
        measured.select("row", *BASE, "n_lines", "n_upper", F.col("row")[l_].alias("lang"), F.col("row")[s_].alias("source")),
        "quality",
    )
    limits = staged(fences(sketches(rows, F.col("lang"), F.col("source")), min_support), "fences")
    judged = join_small(rows, limits, ["lang", "source"])
    out = [
        F.when((r.value > F.col(f"f_{r.name}_hi")) | (r.value < F.coalesce(F.col(f"f_{r.name}_lo"), r.value)), F.lit(r.name))
        for r in rules()
    ]
    judged = judged.withColumn("failed_rules", F.concat_ws(",", F.when(base_failed(), F.lit("base")), *out))
    results = [
        *[(b, F.col(b)) for b in BASE],
        ("base_failed", base_failed()),
        ("kept", F.col("failed_rules") == ""),
        ("failed_rules", F.col("failed_rules")),
    ]
    names = {n.lower() for n, _ in results}
    return judged.select(
        *[F.col("row")[c].alias(c) for c in cols if c.lower() not in names], *[c.alias(n) for n, c in results]
    )
