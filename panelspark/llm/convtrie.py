"""Conversations as a prefix trie, kept as a z-fast trie.

A turn is a hash of its role and text; a prefix of a conversation has a name of 127 bits, a
polynomial of its turns' hashes, computed along ranges of the sorted turns (each range
by itself, then moved by what lies before it, one small row a range), so that no conversation
has to fit a task.  A compacted node stands for the prefixes of depth ``a`` (exclusive) to ``b`` that no other
conversation leaves.  Its handle is its prefix of the depth in that interval with the
most trailing zero bits, and the handles are a hash table keyed by (depth, name); another has the first prefix of every edge.

Conversations are inserted in batches.  Each finds its exit node by fat binary search: the depth with the most trailing
zero bits of what is left of its depths is looked up among the handles, a hit goes on below the node found, a miss above;
a binary search on the names along that node's edge finds where the conversation leaves it.
Of the conversations that leave at the same place by the same turn the one with the least hash of its id is
inserted (its own hash is random, so that the batches needed grow with the logarithm of
their number), which splits the edge it leaves; the others look again from there.  At the end edges
are expanded to one row per prefix, and sums over subtrees go from the last batch to the first along inserted paths.

Defined results: turns are ordered by turn (null first), ties by role, then by the turn's hash, and repeated
rows are turns one by one; null role and text are empty; rows with a null conv_id belong to no conversation; a conversation
without turns is a member of the root alone; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, staged

# Names: polynomials modulo a prime, in a fixed base.
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1234567_89ABCDEF01234567
# Names of a conversation in one row.
CHUNK = 4096
_NAME = 16
_ZERO = bytes(_NAME)


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(uid, c, turn, role, x, n): per turn its hash and the code points of its text."""
    r, t = F.coalesce(col(role).cast("string"), F.lit("")), F.coalesce(col(text), F.lit(""))
    x = F.unhex(F.md5(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t)))
    kept = df.filter(col(conv).isNotNull())
    return kept.select(
        F.monotonically_increasing_id().alias("uid"), col(conv).cast("bigint").alias("c"), col(turn).alias("turn"), r.alias("role"), x.alias("x"), F.char_length(t).cast("bigint").alias("n")
    )


def rebuilt(rows: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(c, part, turn, role, x, uid, n) of the rebuilt conversations, in this order, and the ids of all conversations.

    Conversation c begins with the first h turns of c - c % group; its own follow from the h-th on."""
    ids = staged(rows.select("c").distinct(), "conversations")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    # a task passes on at most so many rows of a conversation before the shuffle
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "x", "uid")
    first = staged(rows.withColumn("i", F.row_number().over(order)).filter(F.col("i") < most), "first-turns")
    own = rows.join(first.filter(F.col("i") <= h).select("uid"), "uid", "left_anti")
    own = own.select("c", F.lit(1).alias("part"), "turn", "role", "x", "uid", "n")
    roots = first.filter(F.col("c") % group == 0).select(F.col("c").alias("r"), "i", "turn", "role", "x", "uid", "n")
    given = ids.withColumn("r", F.col("c") - F.col("c") % group).join(roots, "r").filter(F.col("i") <= h)
    # in the order of i, which is theirs
    given = given.select("c", F.lit(0).alias("part"), F.col("i").cast(own.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), "x", "uid", "n")
    return given.unionByName(own), ids


def _number(x: bytes) -> int:
    return int.from_bytes(x, "big") % PRIME


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, p, total): name and code points so far of every prefix of every conversation.

    Tasks take sorted ranges; what a range's first conversation has in earlier ones comes
    from a table of one row a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, d, p, total = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            ds, ps, totals = [], [], []
            for c, x, n in zip(batch.column("c").to_pylist(), batch.column("x").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if c != now:
                    now, d, p, total = c, 0, 0, 0
                d, p, total = d + 1, (p * BASE + _number(x) + 1) % PRIME, total + n
                ds.append(d)
                ps.append(p.to_bytes(_NAME, "big"))
                totals.append(total)
            cols = [pa.array([part] * len(ds), pa.int32()), batch.column("c"), pa.array(ds, pa.int64()), pa.array(ps, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "c", "d", "p", "total"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("c"), F.col("part"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("x"), F.col("uid")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("c", "x", "n")
    local = staged(dealt.mapInArrow(run, "part int, c bigint, d bigint, p binary, total bigint"), "ranges")
    # one row per range: its first conversation, and where its last one stands
    ends = local.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "d", "p", "total")).alias("last")).orderBy("part").collect()
    carry, now = {}, (None, 0, 0, 0)
    for e in ends:
        if e["first"] == now[0]:
            carry[e["part"]] = now
        last = e["last"]
        if last["c"] == now[0]:
            now = (now[0], now[1] + last["d"], (now[2] * pow(BASE, last["d"], PRIME) + _number(last["p"])) % PRIME, now[3] + last["total"])
        else:
            now = (last["c"], last["d"], _number(last["p"]), last["total"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for part, c, d, p, total in zip(*[batch.column(x).to_pylist() for x in ("part", "c", "d", "p", "total")], strict=True):
                if part in carry and carry[part][0] == c:
                    _, before, q, chars = carry[part]
                    p = ((q * pow(BASE, d, PRIME) + _number(p)) % PRIME).to_bytes(_NAME, "big")
                    d, total = d + before, total + chars
                moved.append((c, d, p, total))
            cols = list(zip(*moved, strict=True)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["c", "d", "p", "total"])

    done = local.select("c", "d", "p", "total") if not carry else local.mapInArrow(move, "c bigint, d bigint, p binary, total bigint")
    return staged(done, "prefixes")


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] with the most trailing zero bits (a < b)."""
    high = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return b.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), high.cast("int")))


class _Names:
    """Names of conversations' prefixes: rows of (c, chunk, names), ``chunk`` depths each."""

    def __init__(self, prefix: DataFrame, chunk: int, longest: int):
        self.chunk, self.longest = chunk, longest
        numbered = prefix.withColumn("k", F.floor((F.col("d") - 1) / chunk).cast("bigint"))
        listed = numbered.groupBy("c", "k").agg(F.array_sort(F.collect_list(F.struct("d", "p"))).alias("l"))  # at most ``chunk``
        joined = F.unhex(F.array_join(F.transform("l", lambda s: F.hex(s["p"])), ""))
        self.rows = staged(listed.select(F.col("c").alias("__c"), F.col("k").alias("__k"), joined.alias("__names")), "names")

    def of(self, df: DataFrame, who: str, k: Column, out: str) -> DataFrame:
        """Adds the names of ``who``'s depths from k * chunk + 1 on."""
        found = df.join(self.rows, (F.col(who) == F.col("__c")) & (k == F.col("__k")), "left")
        return found.withColumnRenamed("__names", out).drop("__c", "__k")

    def pick(self, names: Column, depth: Column) -> Column:
        place = (F.pmod(depth - 1, F.lit(self.chunk)) * _NAME + 1).cast("int")
        return F.when(depth == 0, F.lit(_ZERO)).otherwise(F.call_function("substring", names, place, F.lit(_NAME)))

    def at(self, df: DataFrame, who: str, depth: str, out: str) -> DataFrame:
        """Adds the name of ``who``'s prefix of ``depth`` (0: zeros; null where there is none).  Where no
        conversation has more than one chunk, ``__own`` may hold the names of ``c``."""
        if who == "c" and "__own" in df.columns:
            return df.withColumn(out, self.pick(F.col("__own"), F.col(depth)))
        k = F.floor((F.col(depth) - 1) / self.chunk).cast("bigint")
        return self.of(df, who, k, "__of").withColumn(out, self.pick(F.col("__of"), F.col(depth))).drop("__of")

    def agree(self, df: DataFrame) -> DataFrame:
        """Raises ``l`` to the last depth up to ``r`` at which ``c`` and ``owner`` have the same name."""
        # whole chunks first, by the name at their end
        df = df.withColumn("__lo", F.floor(F.col("l") / self.chunk)).withColumn("__hi", F.floor(F.col("r") / self.chunk))
        for _ in range((self.longest // self.chunk).bit_length()):
            df = df.withColumn("__m", F.floor((F.col("__lo") + F.col("__hi") + 1) / 2)).withColumn("__d", F.col("__m") * self.chunk)
            df = self.at(self.at(df, "c", "__d", "__x"), "owner", "__d", "__y")
            same = F.coalesce(F.col("__x") == F.col("__y"), F.lit(False))
            higher, lower = F.when(same, F.col("__m")).otherwise(F.col("__lo")), F.when(same | (F.col("__lo") >= F.col("__hi")), F.col("__hi")).otherwise(F.col("__m") - 1)
            df = df.withColumns({"__lo": higher, "__hi": lower})
        df = df.withColumn("l", F.greatest("l", F.col("__lo") * self.chunk)).withColumn("r", F.greatest("l", F.least("r", (F.col("__lo") + 1) * self.chunk)))
        # then inside one
        df = self.of(df, "owner", F.col("__lo"), "__theirs")
        df = df.withColumnRenamed("__own", "__mine") if "__own" in df.columns else self.of(df, "c", F.col("__lo"), "__mine")
        l, r, mine, theirs = F.col("l"), F.col("r"), F.col("__mine"), F.col("__theirs")

        def halve(span: Column, _: Column) -> Column:
            m = F.floor((span["l"] + span["r"] + 1) / 2)
            same = F.coalesce(self.pick(mine, m) == self.pick(theirs, m), F.lit(False))
            stays = span["l"] >= span["r"]
            return F.struct(
                F.when(same & ~stays, m).otherwise(span["l"]).alias("l"), F.when(same | stays, span["r"]).otherwise(m - 1).alias("r")
            )

        steps = F.sequence(F.lit(1), F.lit(min(self.chunk, self.longest).bit_length() + 1))
        found = F.aggregate(steps, F.struct(l.alias("l"), r.alias("r")), halve)["l"]
        return df.withColumn("l", found).withColumnRenamed("__mine", "__own").drop("r", "__lo", "__hi", "__m", "__d", "__x", "__y", "__theirs")


_NODE = ["a", "b", "owner", "batch"]


def _exits(active: DataFrame, nodes: DataFrame, names: _Names) -> DataFrame:
    """Adds to (c, len, lo) the exit node (a, b, owner, batch; all null at the root) and ``leave``, the
    depth to which the conversation follows its edge.  ``lo`` is a depth known to be in the trie."""
    handles = nodes.select(F.col("f").alias("__f"), F.col("hp").alias("__hp"), *[F.col(x).alias(f"__{x}") for x in _NODE])
    df = active
    if names.longest <= names.chunk:
        df = names.of(df, "c", F.lit(0).cast("bigint"), "__own")
    mine = [x for x in df.columns if x == "__own"]
    for x in _NODE:
        df = df.withColumn(x, F.lit(None).cast("bigint"))
    df = df.withColumn("l", F.lit(0).cast("bigint")).withColumn("r", F.col("len"))
    for _ in range(names.longest.bit_length() + 1):
        open_ = F.col("l") < F.col("r")
        df = df.withColumn("f", F.when(open_, fattest(F.col("l"), F.greatest(F.col("r"), F.col("l") + 1))))
        df = names.at(df, "c", "f", "fp").join(handles, (F.col("f") == F.col("__f")) & (F.col("fp") == F.col("__hp")), "left")
        hit = F.col("__f").isNotNull()
        df = df.select(
            "c", "len", "lo", *mine,
            *[F.when(hit, F.col(f"__{x}")).otherwise(F.col(x)).alias(x) for x in _NODE],
            F.when(hit, F.least(F.col("__b"), F.col("r"))).otherwise(F.col("l")).alias("l"),
            F.when(open_ & ~hit, F.col("f") - 1).otherwise(F.col("r")).alias("r"),
        )
    # a conversation that leaves an edge above its handle has found the node above it: the next turn tells
    df = names.at(df.withColumn("f", F.coalesce(F.col("b"), F.lit(0)) + 1), "c", "f", "fp")
    tops = nodes.select((F.col("a") + 1).alias("__f"), F.col("tp").alias("__hp"), *[F.col(x).alias(f"__{x}") for x in _NODE])
    df = df.join(tops, (F.col("f") == F.col("__f")) & (F.col("fp") == F.col("__hp")), "left")
    hit = F.col("__f").isNotNull()
    df = df.select("c", "len", "lo", *mine, *[F.when(hit, F.col(f"__{x}")).otherwise(F.col(x)).alias(x) for x in _NODE])
    # along the edge: the last depth whose names agree
    df = df.withColumn("l", F.greatest(F.coalesce(F.col("a"), F.lit(0)), F.col("lo")))
    df = df.withColumn("r", F.greatest(F.least(F.coalesce(F.col("b"), F.lit(0)), F.col("len")), F.col("l")))
    df = names.agree(df).withColumnRenamed("l", "leave")
    return df if mine else df.drop("__own")


def _handled(nodes: DataFrame, names: _Names) -> DataFrame:
    """Adds a node's handle (depth and name) and the name of its edge's first depth."""
    handled = names.at(nodes.withColumn("f", fattest(F.col("a"), F.col("b"))), "owner", "f", "hp")
    return names.at(handled.withColumn("t", F.col("a") + 1), "owner", "t", "tp").drop("t")


def build(sequences: DataFrame, names: _Names) -> tuple[DataFrame, int]:
    """The compacted nodes (a, b, owner, batch, up_owner, f, hp, tp) of the sequences (c, len), all different and not empty, and the number of batches.

    ``owner`` is the conversation whose insertion made the path a node lies on, ``batch`` the batch of it."""
    spark = sequences.sparkSession
    kind = "a bigint, b bigint, owner bigint, batch bigint, up_owner bigint, f bigint, hp binary, tp binary"
    nodes = spark.createDataFrame([], kind)
    active = sequences.select("c", F.col("len"), F.lit(0).cast("bigint").alias("lo"))
    batch = 0
    while True:
        found = _exits(active, nodes, names) if batch else active.select("*", *[F.lit(None).cast("bigint").alias(x) for x in _NODE], F.lit(0).cast("bigint").alias("leave"))
        out = names.at(found.withColumn("next", F.col("leave") + 1), "c", "next", "np").drop("__own")
        out = staged(out.withColumn("over", F.col("leave") < F.col("len")), "exits")
        lead = out.filter("over").groupBy("next", "np").agg(F.min(F.struct(F.xxhash64("c"), "c")).alias("m")).select(F.col("m.c").alias("c"))
        new = staged(out.join(lead, "c").select("c", "len", "leave", "owner"), "inserted")
        # edges that a conversation leaves or ends in are cut there
        cuts = out.filter((F.col("leave") > F.col("a")) & (F.col("leave") < F.col("b"))).select("owner", "a", F.col("leave").alias("cut")).distinct()
        cut_edges = cuts.select("owner", "a").distinct()
        touched = nodes.join(cut_edges, ["owner", "a"], "left_semi")
        bounds = touched.select("owner", "a", F.col("b").alias("cut")).unionByName(cuts).join(touched.select("owner", "a", "batch", "up_owner"), ["owner", "a"])
        in_edge = Window.partitionBy("owner", "a").orderBy("cut")
        start = F.coalesce(F.lag("cut").over(in_edge), F.col("a"))
        up = F.when(F.lag("cut").over(in_edge).isNull(), F.col("up_owner")).otherwise(F.col("owner"))
        split = bounds.select(start.alias("s"), F.col("cut").alias("b"), "owner", "batch", up.alias("up_owner")).withColumnRenamed("s", "a")
        leaves = new.select(
            F.col("leave").alias("a"), F.col("len").alias("b"), F.col("c").alias("owner"), F.lit(batch).cast("bigint").alias("batch"), F.col("owner").alias("up_owner")
        )
        fresh = _handled(split.select("a", "b", "owner", "batch", "up_owner").unionByName(leaves), names)
        nodes = staged(nodes.join(cut_edges, ["owner", "a"], "left_anti").select(*[x.split()[0] for x in kind.split(", ")]).unionByName(fresh), "nodes")
        rest = out.filter("over").join(new.select("c"), "c", "left_anti")
        # they share the next turn with the one inserted there
        active = staged(rest.select("c", "len", F.col("next").alias("lo")), "active")
        batch += 1
        if active.isEmpty():
            return nodes, batch


def _ends(conversations: DataFrame) -> DataFrame:
    """Per (len, p) the conversations of exactly these turns: how many, the least, and the SHA-256 of their ids joined.

    Ids are joined range by range of their order, so that a task holds a range's part at most; a hash is
    fed with the parts one after another."""
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["len", "p", "c"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, first = None, [], None
        names = ["len", "p", "first", "n", "ids"]

        def out() -> pa.RecordBatch:
            row = [[now[0]], [now[1]], [first], [len(ids)], [",".join(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=names)

        for batch in batches:
            for key in zip(*[batch.column(x).to_pylist() for x in order], strict=True):
                if now is not None and (key[:2] != now or len(ids) >= 100_000):
                    yield out()
                    ids = []
                if not ids:
                    now, first = key[:2], key[2]
                ids.append(str(key[2]))
        if ids:
            yield out()

    dealt = conversations.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    joined = staged(dealt.mapInArrow(join, "len bigint, p binary, first bigint, n bigint, ids string"), "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, least, total = None, None, 0, 0

        def row() -> tuple:
            return (*now, least, total, sha.hexdigest())

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["len", "p", "least", "n", "sha"])

        for batch in batches:
            rows = []
            for length, p, first, n, ids in zip(*[batch.column(x).to_pylist() for x in ("len", "p", "first", "n", "ids")], strict=True):
                if (length, p) != now:
                    if now is not None:
                        rows.append(row())
                    now, sha, least, total = (length, p), hashlib.sha256(), first, 0
                else:
                    sha.update(b",")
                sha.update(ids.encode())
                total += n
            yield frame(rows)
        if now is not None:
            yield frame([row()])

    by_end = joined.repartition("len", "p").sortWithinPartitions("len", "p", "first")
    return staged(by_end.mapInArrow(digest, "len bigint, p binary, least bigint, n bigint, sha string"), "digests")


def _suffix(keys: list[str], order: str) -> Window:
    """A node and what hangs below it on its path."""
    return Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)


def _subtrees(nodes: DataFrame, batches: int) -> DataFrame:
    """Adds to (a, b, owner, batch, up_owner, ends, end_least, chars, kids) the sums over subtrees: ``n`` and ``least`` of
    the members, ``leaves``, and ``saved`` of the whole edge and below it."""
    done: DataFrame | None = None
    hanging: DataFrame | None = None
    for batch in range(batches - 1, -1, -1):
        mine = nodes.filter(F.col("batch") == batch)
        if hanging is not None:
            mine = mine.join(hanging.withColumnsRenamed({"up_owner": "owner", "a": "b"}), ["owner", "b"], "left")
        else:
            mine = mine.select("*", *[F.lit(None).cast("bigint").alias(f"h_{x}") for x in ("n", "least", "leaves", "saved")])
        below = _suffix(["owner"], "b")
        for x, own in (("n", F.col("ends")), ("leaves", (F.col("kids") == 0).cast("bigint"))):
            mine = mine.withColumn(x, F.sum(own + F.coalesce(f"h_{x}", F.lit(0))).over(below))
        mine = mine.withColumn("least", F.min(F.least("end_least", "h_least")).over(below))
        mine = mine.withColumn("saved", F.sum((F.col("n") - 1) * F.col("chars") + F.coalesce("h_saved", F.lit(0))).over(below))
        mine = staged(mine.drop("h_n", "h_least", "h_leaves", "h_saved"), "subtrees")
        done = mine if done is None else done.unionByName(mine)
        # the top of every path hangs on a path of an earlier batch (or on the root)
        tops = mine.filter(~F.col("up_owner").eqNullSafe(F.col("owner"))).groupBy("up_owner", "a")
        tops = tops.agg(F.sum("n").alias("h_n"), F.min("least").alias("h_least"), F.sum("leaves").alias("h_leaves"), F.sum("saved").alias("h_saved"))
        both = tops if hanging is None else tops.unionByName(hanging)
        hanging = staged(
            both.groupBy("up_owner", "a").agg(F.sum("h_n").alias("h_n"), F.min("h_least").alias("h_least"), F.sum("h_leaves").alias("h_leaves"), F.sum("h_saved").alias("h_saved")),
            "hanging",
        )
    return done


def prefix_trie(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 100, most: int = 6, chunk: int = CHUNK
) -> DataFrame:
    """One row per prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    given, ids = rebuilt(staged(turns(df, conv, turn, role, text), "turns"), group, most)
    prefix = prefixes(given)
    # the end of every conversation that has turns
    last = prefix.groupBy("c").agg(F.max(F.struct("d", "p")).alias("m")).select("c", F.col("m.d").alias("len"), F.col("m.p").alias("p"))
    bare = ids.join(last, "c", "left_anti").select("c", F.lit(0).cast("bigint").alias("len"), F.lit(_ZERO).alias("p"))
    ends = _ends(staged(last.unionByName(bare), "lengths"))
    longest = ends.agg(F.max("len")).first()[0] or 0
    names = _Names(prefix, chunk, longest)
    sequences = ends.filter("len > 0").select(F.col("least").alias("c"), "len")
    nodes, batches = build(sequences, names)

    # what a compacted node has itself: its ends, the code points along its edge, the nodes below it
    kids = nodes.groupBy(F.col("up_owner").alias("owner"), F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    with_end = names.at(nodes.drop("f", "hp", "tp"), "owner", "b", "p").join(
        ends.select(F.col("len").alias("b"), "p", F.col("n").alias("ends"), F.col("least").alias("end_least"), "sha"), ["b", "p"], "left"
    )
    full = with_end.drop("p").join(kids.filter("owner is not null"), ["owner", "b"], "left").fillna(0, ["ends", "kids"])
    upto = prefix.select(F.col("c").alias("owner"), F.col("d").alias("b"), F.col("total").alias("to_b"))
    full = full.join(upto, ["owner", "b"]).join(upto.withColumnsRenamed({"b": "a", "to_b": "to_a"}), ["owner", "a"], "left")
    full = staged(full.fillna(0, ["to_a"]).withColumn("chars", F.col("to_b") - F.col("to_a")), "compacted")
    done = staged(_subtrees(full, batches), "summed")

    # edges expanded: the prefixes of one edge have its members, and each one's subtree the rest of the edge
    tops = done.select(F.col("owner").alias("up_owner"), F.col("b").alias("a"), F.col("least").alias("up_least"))
    root = ends.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.coalesce(F.max(F.when(F.col("len") == 0, F.col("sha"))), nothing).alias("sha"))
    under = done.filter(F.col("a") == 0).agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = root.filter("n is not null").crossJoin(under)  # one row each
    below = done.join(tops, ["up_owner", "a"], "left").withColumn("d", F.explode(F.sequence(F.col("a") + 1, F.col("b"))))
    before = prefix.select(F.col("c").alias("owner"), (F.col("d") + 1).alias("d"), F.col("total").alias("before"))
    below = below.join(before, ["owner", "d"], "left")
    at_end = F.col("d") == F.col("b")
    root_least = F.lit(ends.agg(F.min("least")).first()[0]).cast("bigint")
    parent = F.when(F.col("d") > F.col("a") + 1, F.col("least")).when(F.col("a") == 0, root_least).otherwise(F.col("up_least"))
    # the edge's part above this prefix
    above = F.coalesce("before", F.lit(0)) - F.col("to_a")
    rows = below.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        parent.alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_end, F.col("kids")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * above).alias("saved_tokens"),
        F.when(at_end, F.coalesce("sha", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    top = root.select(
        F.col("least").alias("conv_id"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("bigint").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.col("sha").alias("ends_sha256"),
    )
    return top.unionByName(rows)
