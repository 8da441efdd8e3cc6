"""Benchmark decontamination by normalised word windows.

Benchmark items and documents are lower-cased (A-Z only) and cut into words.  A
window is 13 consecutive words of an item; an item of fewer words is one window.
The distinct beginnings (up to five words) of the windows form a hash set that is
broadcast while its size allows; the words of every document are scanned
against it position by position inside generated code, and only the positions that
hit are carried on (beyond that size the hashes of all positions are dealt by hash, without words, and
the words of the documents that hit are read again): the words there are compared in full with the windows, and the
hit words, the items they belong to and the verdict are gathered per document.

Defined results: null and empty texts have no words and no hits; an item without
words has no window; rows that repeat another in id and text are judged alike;
an empty benchmark leaves every document clean; result columns replace input
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, staged

WINDOW = 13
BEGINNING = 5
# Contaminated: hit words are at least one in 20.
SHARE = 20
# A hash set of so many longs is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000
# Copies of a larger set, so that a frequent beginning is dealt to as many tasks.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{IsTitlecase}&&[^A-Z]]"


def normal_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    # lower() is the fast way where it changes nothing but A-Z
    low = F.when(F.rlike(t, F.lit(_OTHER_CAPITALS)), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, _BREAK), "")


def _beginning(w: str, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])


def _beginnings(w: str, k: int) -> Column:
    """At every word the hash of the ``k`` words from there."""
    return F.transform(w, lambda _, i: _beginning(w, i, k))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``window`` (words joined by spaces), ``m`` words, hash ``h``
    of its beginning of ``k`` words, ``items`` (ids as strings)."""
    a = benchmark.select(col(item_id).cast("string").alias("item"), normal_words(col(text)).alias("w")).filter(F.size("w") > 0)
    a = a.withColumn("m", F.least(F.size("w"), F.lit(WINDOW)))
    a = a.select("item", "m", "w", F.explode_outer(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("i"))
    k = F.least(F.col("m"), F.lit(BEGINNING))
    h = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for n in range(1, BEGINNING + 1):
        h = h.when(k == n, _beginning("w", F.col("i"), n))
    a = a.select("item", "m", F.array_join(F.slice("w", F.col("i") + 1, F.col("m")), " ").alias("window"), k.alias("k"), h.alias("h"))
    return a.groupBy("window", "m", "k", "h").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per distinct (``d`` = id, ``x`` = hash of the text) with a window:
    ``spans`` (sorted (start, m) in words), ``items`` (sorted ids as strings)."""
    win = staged(windows(benchmark), "windows")
    keys = staged(win.select("h", "k", "m").distinct(), "window-keys")
    ks = sorted(r["k"] for r in keys.select("k").distinct().collect())  # at most BEGINNING values
    scan = docs.select(col(doc_id).alias("d"), text_key(col(text)).alias("x"), normal_words(col(text)).alias("w"))
    scan = scan.select(
        "d", "x", "w",
        F.concat(F.array().cast("array<bigint>"), *[_beginnings("w", k) for k in ks]).alias("hs"),
    )
    # outer, as the filter that Spark derives from an inner one would compute the words anew for every place
    at = scan.select("d", "x", "w", F.posexplode_outer("hs").alias("p", "h"))
    i = F.col("p") % F.size("w")
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        found = at.join(F.broadcast(keys.select("h", "m")), "h").filter(i + F.col("m") <= F.size("w")).select("d", "x", "w", i.alias("i"), "m")
    else:
        hit = staged(_dealt(at.select("d", "x", i.alias("i"), F.size("w").alias("n"), "h"), keys), "benchmark-places")
        texts = scan.select("d", "x", "w").join(hit.withColumnsRenamed({"d": "d_", "x": "x_"}), F.col("d").eqNullSafe(F.col("d_")) & (F.col("x") == F.col("x_")))
        found = texts.select("d", "x", "w", F.inline("places"))
    found = found.select("d", "x", "i", "m", F.array_join(F.slice("w", F.col("i") + 1, F.col("m")), " ").alias("window"))
    verified = found.join(win.select("window", "items"), "window")
    return verified.groupBy("d", "x").agg(
        F.sort_array(F.collect_set(F.struct("i", "m"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _dealt(at: DataFrame, keys: DataFrame) -> DataFrame:
    """Where documents may hold a window: one row per distinct (d, x) with ``places`` (i, m).
    ``at``: (d, x, i, n words, h); the side of the keys is copied per salt, the hashes are dealt over the salts."""
    salted = at.filter(F.col("h").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("x", "i"), F.lit(SALTS)).cast("int"))
    copies = keys.select("h", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = salted.join(copies, ["h", "salt"]).filter(F.col("i") + F.col("m") <= F.col("n"))
    return found.groupBy("d", "x").agg(F.collect_set(F.struct("i", "m")).alias("places"))


def _hit_words(spans: str) -> Column:
    """Words under the union of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["i"] + s["m"]
        new = F.greatest(end - F.greatest(acc["end"], s["i"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, start, add)["n"].cast("bigint")


def judge(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """The ``keep`` columns (default: all) of every row with ``n_words``, ``n_hit``,
    ``n_items``, ``items_sha256``, ``contaminated`` and ``hit_spans``."""
    cols = docs.columns if keep is None else keep
    found = hits(docs, benchmark, text, doc_id)
    per_doc = found.select(
        F.col("d").alias("__d"), F.col("x").alias("__x"), F.col("spans").alias("__spans"), "items", _hit_words("spans").alias("hit")
    )
    rows = docs.select(
        F.struct(*[col(c) for c in cols]).alias("row"), col(doc_id).alias("d"), text_key(col(text)).alias("x"),
        F.coalesce(F.regexp_count(col(text), F.lit(_WORD)), F.lit(0)).cast("bigint").alias("n"),
    )
    joined = rows.join(per_doc, F.col("d").eqNullSafe(F.col("__d")) & (F.col("x") == F.col("__x")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    none = F.array().cast("array<string>")
    results = [
        ("n_words", F.col("n")),
        ("n_hit", n_hit),
        ("n_items", F.size(F.coalesce("items", none)).cast("bigint")),
        ("items_sha256", F.sha2(F.array_join(F.coalesce("items", none), ","), 256)),
        ("contaminated", (n_hit > 0) & (SHARE * n_hit >= F.col("n"))),
        ("hit_spans", F.col("__spans")),
    ]
    names = {n for n, _ in results}
    return joined.select(*[F.col("row")[c].alias(c) for c in cols if c.lower() not in names], *[c.alias(n) for n, c in results])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    n_, x_ = fresh(docs, "__n", "__x")
    found = hits(docs, benchmark, text, doc_id).select("d", F.col("x").alias("hx"), _hit_words("spans").alias("hit"))
    bad = staged(found, "benchmark-hits")
    rows = docs.withColumns({x_: text_key(col(text)), n_: F.coalesce(F.regexp_count(col(text), F.lit(_WORD)), F.lit(0))})
    on = col(doc_id).eqNullSafe(F.col("d")) & (col(x_) == F.col("hx")) & (SHARE * F.col("hit") >= col(n_))
    return rows.join(bad, on, "left_anti").drop(x_, n_)


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows; hit words and the characters before each of them are cut from the texts."""
    (x_,) = fresh(docs, "__x")
    found = hits(docs, benchmark, text, doc_id).select("d", F.col("x").alias("hx"), "spans")
    joined = docs.withColumn(x_, text_key(col(text))).join(found, col(doc_id).eqNullSafe(F.col("d")) & (col(x_) == F.col("hx")), "left")
    w = F.regexp_extract_all(col(text), F.lit(_WORD), F.lit(0))
    gaps = F.split(col(text), _WORD)
    joined = joined.withColumns({"__w": F.when(F.col("spans").isNotNull(), w), "__gaps": F.when(F.col("spans").isNotNull(), gaps)})
    kept = F.transform(
        "__w",
        lambda x, i: F.when(F.exists("spans", lambda s: (i >= s["i"]) & (i < s["i"] + s["m"])), F.lit("")).otherwise(F.concat(F.get("__gaps", i), x)),
    )
    cut = F.concat(F.array_join(kept, ""), F.get("__gaps", F.size("__w")))
    return joined.select(*[(F.coalesce(cut, col(c)) if c == text else col(c)).alias(c) for c in docs.columns])
