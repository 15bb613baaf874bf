"""The trie of conversations' prefixes by prefix doubling.

Turns are named by dense numbers: equal (role, text) have equal names.  In each round two
neighbouring blocks of 2^k turns make one of 2^(k+1), and pairs of names are named anew, so
that after log2(longest) rounds every aligned block of a power of two has a name.  The first d turns
are composed from the blocks of d's binary digits, the largest first: the prefix up to d
without its lowest digit, which has a name from a round before, and one block.  All prefixes
with one lowest digit are named in one round.  (depth, name) is a node, and rows (conversation,
depth, name) are grouped by it.

Sums over subtrees need no walk: a conversation owns the nodes that it is the smallest member
of, which are its deepest ones, and adds what lies at or below its own depth to each
of its prefixes.  These suffix sums are differences of running sums in the order (conversation, depth).

Texts stay where they are: what travels is a SHA-256 of each turn and its length.  No group is
held by one task: a node's members are counted in part before the shuffle, names of frequent
keys are broadcast (fewer than HOT_KEYS), long conversations are numbered across range partitions, and
ids of conversations that end at a node are joined in pieces, which a task passes through a
running hash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense_names, frugal, looked_up, positioned, union_all

#: Conversation ids in a piece, at most.
PIECE = 4096


def _turn(role, text):
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"), F.char_length(text).cast("bigint").alias("size")


def numbered_turns(scratch: Scratch, turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((c, i, key, size), (c, n)): every turn of conversation c with its place from 0, and the conversations' turns.

    Order: turn (null first), then the turn's hash.  Rows without a conversation's id are no turns.
    """
    own = turns.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("c"), F.col(turn).alias("t"), *_turn(F.col(role), F.col(text)), F.lit(1).alias("one"))
    rows = positioned(own, ["c", "t", "key"], {"at": "one"}).select("c", "at", "key", "size")
    starts = scratch.keep(rows.groupBy("c").agg(F.min("at").alias("start"), F.count("*").alias("n_")))
    out = scratch.keep(looked_up(rows, starts, ["c"], rows.count()).select("c", (F.col("at") - F.col("start")).alias("i"), "key", "size"))
    return out, starts.select("c", F.col("n_").alias("n"))


def rebuilt(scratch: Scratch, rows: DataFrame, sizes: DataFrame, every: int = 100, parts: int = 6) -> tuple[DataFrame, DataFrame]:
    """The same of conversations rebuilt on shared heads: the first h turns of c - c % every, then c's own after its first h; h = crc32(c) % parts."""
    base = rows.where((F.col("c") % every == 0) & (F.col("i") < parts - 1)).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "key", "size"))).alias("head"))
    convs = sizes.select("c", F.col("n").alias("n_"), (F.crc32(F.col("c").cast("string")) % parts).alias("h"), (F.col("c") - F.col("c") % every).alias("base"))
    convs = convs.join(base, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,key:binary,size:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = scratch.keep(convs.withColumn("m", F.size("head").cast("bigint")))
    heads = convs.select("c", F.explode("head").alias("x")).select("c", "x.i", "x.key", "x.size")
    own = looked_up(rows, convs.select("c", "h", "m", "n_"), ["c"], rows.count()).where("i >= h").select("c", (F.col("m") + F.col("i") - F.col("h")).alias("i"), "key", "size")
    return scratch.keep(heads.unionByName(own)), convs.select("c", (F.col("m") + F.greatest(F.col("n_") - F.col("h"), F.lit(0))).alias("n"))


def _prefixes(scratch: Scratch, rows: DataFrame, longest: int) -> DataFrame:
    """(c, d, p): the name of the first d turns of c, for d from 1; names are told apart within one d."""
    blocks = [dense_names(scratch, scratch.keep(rows.select("c", F.col("i").alias("j"), "key")), ["key"], "b")]
    while 1 << len(blocks) <= longest:
        j = F.col("j")
        pairs = blocks[-1].groupBy("c", F.shiftright(j, 1).alias("up")).agg(F.max(F.when(j % 2 == 0, F.col("b"))).alias("x"), F.max(F.when(j % 2 == 1, F.col("b"))).alias("y"))
        blocks.append(dense_names(scratch, scratch.keep(pairs.where("x is not null and y is not null").withColumnRenamed("up", "j")), ["x", "y"], "b"))
    named: list[DataFrame] = []
    for k in reversed(range(len(blocks))):
        part = blocks[k].where("j % 2 = 0").select("c", F.shiftleft("j", k).alias("d"), "b")
        first = part.where("d = 0").withColumn("p", F.lit(-1).cast("bigint"))
        later = part.where("d > 0").join(union_all(named), ["c", "d"]) if named else part.limit(0).withColumn("p", F.lit(0).cast("bigint"))
        both = scratch.keep(first.unionByName(later).withColumn("d", F.col("d") + (1 << k)))
        named.append(dense_names(scratch, both.select("c", "d", F.col("d").alias("e"), "p", "b"), ["e", "p", "b"], "q").withColumnRenamed("q", "p"))
    return union_all(named)


def _ends(last: DataFrame) -> DataFrame:
    """(d, p, ends): the hash of the ids of conversations that end at a node, rising and comma-joined."""
    pieces = last.groupBy("d", "p", F.floor(F.col("c") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        frugal()
        node, state = None, None
        for x in batches:
            out = []
            for d, p, ids in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
                if (d, p) != node:
                    if state is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, p), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _named(out)
        if state is not None:
            yield _named([(*node, state.hexdigest())])

    def _named(out):
        d, p, ends = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(ends, pa.string())], names=["d", "p", "ends"])

    dealt = pieces.repartition("d", "p").sortWithinPartitions("d", "p", "piece").select("d", "p", "ids")
    return dealt.mapInArrow(hashed, "d bigint, p bigint, ends string")


def trie_nodes(scratch: Scratch, rows: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences: rows (c, i, key, size), members (c, n) with n rows each, which may be none.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every distinct prefix, the empty one included.
    """
    members = scratch.keep(members)
    longest = members.agg(F.max("n")).first()[0] or 0
    root = members.select("c", F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("p"))
    paths = root if longest == 0 else _prefixes(scratch, rows, longest).select("c", "d", "p").unionByName(root)
    nodes = scratch.keep(paths.groupBy("d", "p").agg(F.min("c").alias("conv"), F.count("*").alias("n_convs")))
    # the representative's last turn and the node above
    at = nodes.join(rows.select(F.col("c").alias("conv"), (F.col("i") + 1).alias("d"), "size"), ["conv", "d"], "left")
    at = at.join(paths.select(F.col("c").alias("conv"), (F.col("d") + 1).alias("d"), F.col("p").alias("up")), ["conv", "d"], "left")
    at = scratch.keep(at)
    below = at.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("up").alias("p")).agg(F.count("*").alias("n_children"))
    worth = (F.col("n_convs") - 1) * F.coalesce("size", F.lit(0).cast("bigint"))
    at = scratch.keep(at.join(below, ["d", "p"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))).withColumn("worth", worth))
    # suffix sums along every conversation
    own = at.select(F.col("conv").alias("c"), "d", "worth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"))
    summed = paths.join(own, ["c", "d"], "left").withColumns({k: F.coalesce(k, F.lit(0).cast("bigint")) for k in ("worth", "leaf")})
    summed = positioned(summed, ["c", "d"], {"worth_upto": "worth", "leaf_upto": "leaf"})
    ends = scratch.keep(summed.groupBy("c").agg(F.max("worth_upto").alias("worth_all"), F.max("leaf_upto").alias("leaf_all"), F.count("*").alias("n_")))
    suffix = {k: F.sum(F.col(f"{k}_all") - F.col(f"{k}_upto") + F.col(k)).alias(f"{k}_sum") for k in ("worth", "leaf")}
    sums = looked_up(summed, ends, ["c"], summed.count()).groupBy("d", "p").agg(*suffix.values())
    # the parents' representatives
    parents = scratch.keep(nodes.select((F.col("d") + 1).alias("d"), F.col("p").alias("up"), F.col("conv").alias("parent")).join(at.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("p").alias("up"), F.col("n_children").alias("n_")), ["d", "up"]))
    with_parent = looked_up(at.where("d > 0"), parents, ["d", "up"], at.count()).unionByName(at.where("d = 0").withColumn("parent", F.lit(None).cast("bigint")))
    last = paths.join(members, "c").where("d = n").select("c", "d", "p")
    out = with_parent.join(sums, ["d", "p"]).join(_ends(last), ["d", "p"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaf_sum").alias("n_leaves"), F.col("worth_sum").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, every: int | None = None, parts: int = 6, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie of all conversations' turns (role, text), one row each:

    conv_id, the smallest member (members: conversations that start with the node's turns);
    depth, those turns; parent_conv_id, the parent's conv_id (root: null); n_convs; n_children;
    n_leaves, nodes without children in the subtree, the node included; saved_tokens, the sum over the
    subtree of (n_convs - 1) times the code points of a node's last text, which is what computing each
    prefix once saves; ends_sha256, of the ids of conversations that end here.

    Turns are ordered by turn (null first; of equal ones by their hash), null roles and texts are empty.
    Rows whose conv_id is null belong to no conversation.  With `every`, conversations are first
    rebuilt on shared heads (see rebuilt()); one left without turns counts for the root.  A
    conversation that repeats another's turns, however many do, adds a member and no node.
    An empty table has no nodes.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    rows, sizes = numbered_turns(scratch, turns, id, turn, role, text)
    if every is not None:
        rows, sizes = rebuilt(scratch, rows, sizes, every, parts)
    return trie_nodes(scratch, rows, sizes)
