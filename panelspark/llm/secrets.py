"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

Fixed patterns (assignments, access keys, long hex runs) give the base spans.  Any
other token of ``MIN_TOKEN`` or more characters of ``[A-Za-z0-9+/_=-]`` is a
candidate.  Its encoding is inferred from the characters it uses (decimal, letters,
hex, base32, lower-case or mixed alphanumeric, base64), and the battery asks
whether it looks like uniform draws from that alphabet: chi-squared uniformity,
runs about the middle of the alphabet, lag-1 serial correlation (each at
``ALPHA`` / 3).  The evidence of a candidate that passes is the likelihood of its neighbouring
characters under uniform draws from its alphabet against written text in the
same alphabet: written text exceeds a ratio R with a probability of at most 1/R, which is
the p-value.  Frequencies of written pairs come from the short words of all whole texts
and, for the other half, from a fixed list of words; where both
cases are in the alphabet, a change of case between letters counts with ``CASE_CHANGES``.  A second
test asks whether a token changes between lower case, capitals, digits and signs more
often than written text does; the lesser p-value counts twice.  Benjamini-Hochberg control at ``FDR``
runs over all candidates of the corpus in each stratum of lengths, on a histogram of
p-values (at most ``_BUCKETS`` rows a stratum), so that nothing is sorted.

Defined results: null and empty texts have no spans; a candidate that overlaps a
base span is left out; repeated rows have the same spans; a corpus without
candidates has base spans only; matches of a very long text are placed in blocks of
``_BLOCK``, so that the work grows with them; result columns replace input columns of the same name.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, staged

# Fixed patterns; the letters of the names in either case, ASCII only.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
# The shortest matches that count are the whole of a run, so the least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHA = 0.001
FDR = 0.01
# Share of neighbouring characters of written tokens (names, paths) that differ in class.
TEXT_CHANGES = 0.15
STRATA = (20, 32, 48, 64, 128)
_BUCKETS = 400

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# (name, pattern, alphabet in order); the first that fits is taken.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS),
    ("lower", r"^[a-z]+$", _LOWER),
    ("upper", r"^[A-Z]+$", _UPPER),
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"),
    ("alnum_lower", r"^[a-z0-9]+$", _DIGITS + _LOWER),
    ("alnum_upper", r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("alnum", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("any", r"", _UPPER + _LOWER + _DIGITS + "+/-_="),
)

# Written characters: letters in either case, digits and signs; and words that any corpus is counted with.
_WRITTEN = _LOWER + _DIGITS + "+/-_="
CASE_CHANGES = 0.15
# Draws a pair's frequency is held towards that of its second character.
_HELD = 10.0
_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there "
    "would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two "
    "may first then do any like my now over such our man me even most made after also did many before must through back years where much your way "
    "well down should because each just those people how too little state good very make world still see own men work long get here between both life "
    "being under never day same another know while last might great old year off come since against go came right used take three super califragilistic "
    "expialidocious question example extra quick jump lazy boxes zero azure haunt voluptuous exploit optimize hydroxide methyl ethyl sulphur phosphate "
    "administrator configuration implementation international authentication environment performance development request response database http https "
    "index value string number object class public static final return import package default user name file path page html json test data 2019 2020 "
    "2021 2022 2023 2024 1999 2000 100 1000 10 12 15 20 25 30 50 60 000 long-term well-known get_value set_name to_string is_valid a/b and/or src/main "
    + "1234567890 0123456789 " * 5 + "0987654321 0000 1111 2222 3333 4444 5555 6666 7777 8888 9999"
)

_SPAN = "array<struct<start:int,end:int,found:string>>"
_BLOCK = 256


def located(text: Column, pattern: str) -> Column:
    """Matches of the pattern with their places in code points: what lies between
    them (a split by the same pattern) gives the distances."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.filter(F.zip_with(found, gaps, lambda f, g: F.struct(F.length(g).alias("gap"), f.alias("found"))), lambda s: s["found"].isNotNull())
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        a = acc["at"] + s["gap"]
        b = a + F.length(s["found"])
        new = F.array(F.struct(a.alias("start"), b.alias("end"), s["found"].alias("found")))
        return F.struct(b.alias("at"), F.concat(acc["out"], new).alias("out"))

    def placed(steps: Column) -> Column:
        # places within blocks first, then the blocks one after another: no list grows by a match at a time
        firsts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(_BLOCK))
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(steps, i, F.lit(_BLOCK)), none, step))
        return F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(bs, _before(bs), lambda b, at: F.transform(
            b["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["found"].alias("found"))))))

    spans = F.get(F.flatten(F.transform(F.array(steps), placed)), F.lit(0))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(_SPAN))


def _before(blocks: Column) -> Column:
    """Code points before every block: one number a block."""
    return F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )["out"]


def _upper_tail(z: Column) -> Column:
    """Share of a normal distribution above ``z`` (rational approximation, error below 1e-7 times the density)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def written(docs: DataFrame, text: str = "text") -> dict[tuple[str, str], float]:
    """How often written characters follow one another in short words of the corpus."""
    # candidates themselves are no written words
    own = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,19}(?![A-Za-z0-9+/_=-])"
    words = docs.select(F.explode(F.regexp_extract_all(col(text), F.lit(own), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1))
    pairs = words.select("w", "n", at.alias("i")).groupBy(F.expr("substring(w, i, 2)").alias("pair")).agg(F.sum("n").alias("n"))
    return {(r.pair[0], r.pair[1]): float(r.n) for r in pairs.collect()}  # at most len(_WRITTEN) squared rows


def _shares(counts: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """How likely a written character is after another."""
    after = dict.fromkeys(_WRITTEN, 1.0)
    total = dict.fromkeys(_WRITTEN, 0.0)
    for (p, c), n in counts.items():
        after[c] += n
        total[p] += n
    every = sum(after.values())
    return {(p, c): (counts.get((p, c), 0.0) + _HELD * after[c] / every) / (total[p] + _HELD) for p in _WRITTEN for c in _WRITTEN}


def ratios(counts: dict[tuple[str, str], float]) -> dict[str, list[float]]:
    """By encoding, the log likelihood ratio of uniform draws against written text for every
    pair of written characters (row by row), given that the second is in the encoding."""
    listed: dict[tuple[str, str], float] = {}
    for word in _WORDS.split():
        for pair in zip(word[:-1], word[1:], strict=True):
            listed[pair] = listed.get(pair, 0.0) + 1.0
    # text may be written as in the corpus or as in the list,
    corpus, fixed = _shares(counts), _shares(listed)
    out = {}
    for name, _, alphabet in ENCODINGS:
        used = sorted(set(alphabet.lower()))
        both = alphabet.lower() != alphabet and alphabet.upper() != alphabet
        table = []
        for p in _WRITTEN:
            share = {c: (corpus[p, c] + fixed[p, c]) / 2 for c in used}
            whole = sum(share.values())
            # a letter of either case is two of the draws
            table += [
                round(math.log((2 if both and c in _LOWER else 1) / len(alphabet) * whole / share[c]), 4) if c in share else 0.0 for c in _WRITTEN
            ]
        out[name] = table
    return out


def _table(spark: SparkSession, counts: dict[tuple[str, str], float]) -> DataFrame:
    """(encoding_, ratios) of every encoding."""
    rows = json.dumps([{"encoding_": e, "ratios": x} for e, x in ratios(counts).items()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<encoding_:string,ratios:array<double>>>")))


def battery(tokens: DataFrame, counts: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """``tokens`` (with ``token``) and their ``encoding``, ``length``, the p-values
    ``p_uniform``, ``p_runs``, ``p_serial`` under uniform draws, ``p_text``: how
    often a written token changes class as often as this one, and ``p_fit``: how often written
    text (``counts`` of its pairs) is as near to uniform draws."""
    table = staged(_table(tokens.sparkSession, written(tokens.limit(0), "token") if counts is None else counts), "written")
    bare = F.regexp_replace("token", "=+$", "")
    a = tokens.withColumn("s", bare).withColumn("length", F.length("s")).filter(F.col("length") >= STRATA[0])
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for enc, pattern, alphabet in reversed(ENCODINGS):
        fits = F.rlike(F.col("s"), F.lit(pattern))
        name, letters = F.when(fits, F.lit(enc)).otherwise(name), F.when(fits, F.lit(alphabet)).otherwise(letters)
    a = a.withColumns({"encoding": name, "alphabet": letters})
    a = a.withColumns({"c": F.filter(F.split("s", ""), lambda c: c != ""), "k": F.length("alphabet").cast("double"), "n": F.col("length").cast("double")})
    a = a.withColumn("v", F.transform("c", lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")))
    n, k = F.col("n"), F.col("k")
    # chi-squared over the alphabet; Wilson-Hilferty gives its normal score
    counts = F.transform(F.array_distinct("c"), lambda c: (n - F.length(F.replace(F.col("s"), c, F.lit("")))).cast("double"))
    a = a.withColumn("chi", k / n * _sum(F.transform(counts, lambda x: x * x)) - n)
    a = a.withColumn("mean", _sum(F.col("v")) / n)
    a = a.withColumn("high", F.transform("v", lambda x: (x >= k / 2).cast("double")))
    a = a.withColumn("n1", _sum(F.col("high")))
    pairs = F.sequence(F.lit(0), F.col("length") - 2)
    a = a.withColumns({
        "runs": 1 + _sum(F.transform(pairs, lambda i: (F.get("high", i) != F.get("high", i + 1)).cast("double"))),
        "lag": _sum(F.transform(pairs, lambda i: (F.get("v", i) - F.col("mean")) * (F.get("v", i + 1) - F.col("mean")))),
        "var": _sum(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean")))),
        "class": F.transform("c", lambda c: F.when(F.rlike(c, F.lit("[a-z]")), 0).when(F.rlike(c, F.lit("[A-Z]")), 1).when(F.rlike(c, F.lit("[0-9]")), 2).otherwise(3)),
    })
    a = a.withColumn("changes", _sum(F.transform(pairs, lambda i: (F.get("class", i) != F.get("class", i + 1)).cast("double"))))
    a = a.join(F.broadcast(table), F.col("encoding") == F.col("encoding_"))  # a row an encoding
    a = a.withColumn("w", F.transform("c", lambda c: F.instr(F.lit(_WRITTEN), F.lower(c)) - 1))
    a = a.withColumn("fit", _sum(F.transform(pairs, lambda i: F.get("ratios", F.get("w", i) * len(_WRITTEN) + F.get("w", i + 1)))))
    # case: a draw takes either, written letters mostly go on as they are
    both = F.col("encoding").isin([e for e, _, x in ENCODINGS if x.lower() != x and x.upper() != x])
    letters_ = F.transform(pairs, lambda i: F.when(F.greatest(F.get("class", i), F.get("class", i + 1)) > 1, 0.0)
        .when(F.get("class", i) != F.get("class", i + 1), math.log(0.5 / CASE_CHANGES)).otherwise(math.log(0.5 / (1 - CASE_CHANGES))))
    a = a.withColumn("fit", F.col("fit") + F.when(both, _sum(letters_)).otherwise(0.0))
    df = k - 1
    z_uniform = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    n1, n2 = F.col("n1"), n - F.col("n1")
    runs_mean = 2 * n1 * n2 / n + 1
    runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
    z_runs = F.when(runs_var > 0, (F.col("runs") - runs_mean) / F.sqrt(runs_var)).otherwise(F.lit(99.0))
    z_serial = F.when(F.col("var") > 0, (F.col("lag") / F.col("var") + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    expected = (n - 1) * TEXT_CHANGES
    z_text = (F.col("changes") - 0.5 - expected) / F.sqrt(expected * (1 - TEXT_CHANGES))
    return a.select(
        *[col(c) for c in tokens.columns], "encoding", "length",
        _upper_tail(z_uniform).alias("p_uniform"),
        (2 * _upper_tail(F.abs(z_runs))).alias("p_runs"),
        (2 * _upper_tail(F.abs(z_serial))).alias("p_serial"),
        _upper_tail(z_text).alias("p_text"),
        F.exp(-F.greatest(F.col("fit"), F.lit(0.0))).alias("p_fit"),
    )


def discoveries(tested: DataFrame, alpha: float = ALPHA, fdr: float = FDR) -> DataFrame:
    """The tested tokens that pass the battery and the false-discovery control of their stratum."""
    stratum = F.lit(0)
    for i, least in enumerate(STRATA):
        stratum = F.when(F.col("length") >= least, F.lit(i)).otherwise(stratum)
    random = F.least("p_uniform", "p_runs", "p_serial") >= alpha / 3
    # tenths of a power of ten; a token that fails the battery counts as a test without evidence
    power = F.floor(-10 * F.log10(F.greatest(2 * F.least("p_text", "p_fit"), F.lit(1e-40)))).cast("int")
    rows = tested.withColumns({"__s": stratum, "__b": F.when(random, F.least(F.greatest(power, F.lit(0)), F.lit(_BUCKETS))).otherwise(F.lit(0))})
    counts = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy("__s")
    at_least = part.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select("__s", "__b", F.sum("n").over(at_least).alias("r"), F.sum("n").over(part).alias("m"))
    bound = F.pow(F.lit(10.0), -F.col("__b") / 10.0)  # no p-value of the bucket is above it
    limits = ranked.filter(F.col("m") * bound <= fdr * F.col("r")).groupBy(F.col("__s").alias("__t")).agg(F.min("__b").alias("least"))
    # one row a stratum
    return rows.join(F.broadcast(limits), (F.col("__s") == F.col("__t")) & (F.col("__b") >= F.col("least")) & (F.col("__b") > 0)).drop("__s", "__b", "__t", "least")


def _free(rows: DataFrame) -> DataFrame:
    """(rid, start, end, found) of the candidates that overlap no base span of their row: in the order of places,
    the farthest end of the base spans that begin before a candidate ends lies at or before its start."""
    alone = rows.filter(F.size("base") == 0).select("rid", F.inline("random"))
    both = rows.filter((F.size("base") > 0) & (F.size("random") > 0))
    spans = both.select("rid", F.inline("base")).select("rid", F.col("start").alias("at"), F.lit(1).alias("order"), F.col("end").alias("reach"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("found", "string"))])
    asked = both.select("rid", F.inline("random")).select("rid", F.col("end").alias("at"), F.lit(0).alias("order"), F.lit(0).alias("reach"), "start", "end", "found")
    so_far = Window.partitionBy("rid").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = spans.unionByName(asked).withColumn("reach", F.max("reach").over(so_far))
    return alone.unionByName(told.filter(F.col("found").isNotNull() & (F.col("reach") <= F.col("start"))).select(*alone.columns))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) of every row with ``n_assign``,
    ``n_access``, ``n_hex``, ``n_random``, ``base_sha256`` and ``spans``."""
    cols = docs.columns if keep is None else keep
    t = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.struct(*[col(c) for c in cols]).alias("row"),
        *[located(t, pattern).alias(kind) for kind, pattern in (*KINDS, ("random", TOKEN))],
    )
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_VALUE)
    rows = rows.withColumn("assign", long_enough)
    kinds = [k for k, _ in KINDS]

    def of_kind(i: int) -> Column:
        return F.transform(kinds[i], lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    rows = rows.withColumn("base", F.sort_array(F.concat(*[of_kind(i) for i in range(len(kinds))])))
    rows = staged(rows.select("rid", "row", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds], "base", "random"), "secrets")
    tokens = _free(rows).select("rid", "start", "end", F.col("found").alias("token"))
    found = discoveries(staged(battery(tokens, written(docs, text)).drop("token"), "secret-tests"))
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    more = found.groupBy(F.col("rid").alias("rid_")).agg(F.collect_list(span).alias("more"))
    joined = rows.join(more, F.col("rid") == F.col("rid_"), "left")
    names = F.array(*[F.lit(k) for k in (*kinds, "random")])

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more")))
    results = [
        *[(f"n_{k}", F.col(f"n_{k}")) for k in kinds],
        ("n_random", F.when(F.col("more").isNull(), F.lit(0)).otherwise(F.size("more")).cast("bigint")),
        ("base_sha256", F.sha2(told(F.col("base")), 256)),
        ("spans", told(every)),
    ]
    taken = {n for n, _ in results}
    return joined.select(*[F.col("row")[c].alias(c) for c in cols if c.lower() not in taken], *[c.alias(n) for n, c in results])
