"""The prefix trie of conversations, and subtree totals by depth-band rollup.

Every distinct sequence of a conversation's first turns is a node; the empty sequence is the root.

Names.  A node is named by the digest of its sequence.  A conversation's sequence is cut into bands of
``HEIGHT`` turns, and only the turns of one band ever meet in one row; a band's digests go on from a
name for all the bands before it, which comes from the same cut applied to the sequence of band digests,
and so on, until one band holds all.  So a conversation of any length takes a logarithmic number of
rounds, and none is ever collected whole.

Totals.  A node explodes to its ancestors within its own band alone, at most ``HEIGHT`` rows.  What
hangs below a band's last nodes is totalled first: each band's sum goes, as one row, into the trie of
the bands' names, which is rolled up by the same rule, and the completed totals come back to the
nodes they hang on.  Rounds and explosion are both bounded: by the logarithm of the depth, and by the height.

Digests of members.  The ids of conversations that end at a node are joined in sorted pieces of a bounded
width of ids; a node with several pieces streams them in order through one hash state.

Turns of equal number stand in order of the digest of role and text; repeated rows are turns of their
own.  A null turn number comes first; null role or text counts as empty; texts are taken whole.  Rows
without conv_id belong to no conversation.  Without any conversation there is no node.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut_lineage, numbered, written
from storyloom.llm.importance import CRC_STEPS, crc_sql

#: Turns in a band.
HEIGHT = 32
#: Bits of the width of a piece of a list of members, in conversation ids, and of a block of places.
PIECE, BLOCK = 12, 16


def _digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _block(place: Column) -> Column:
    return F.shiftright(place, BLOCK)


def turn_keys(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, the digest ``key`` of role and text, and ``chars``, the code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null")
    return rows.select("conv_id", "turn", _digest(own.cast("binary")).alias("key"), F.length(text).cast("long").alias("chars"))


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with ``pos`` from 1 in their conversation, and conversations with their number of turns ``n``.

    Places come from a sort of all turns by range: a conversation that spans several ranges is split.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    turns = written(numbered(turn_keys(conversations), "place", *order))
    convs = written(turns.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    # The place of a conversation's first turn lies at most n places back; joined by blocks of places, no conversation meets in one task.
    starts = convs.select("conv_id", "first", F.explode(F.sequence(_block(F.col("first")), _block(F.col("first") + F.col("n") - 1))).alias("block"))
    placed = turns.withColumn("block", _block(F.col("place"))).join(starts, ["conv_id", "block"])
    return placed.select("conv_id", (F.col("place") - F.col("first") + 1).alias("pos"), "key", "chars"), convs.select("conv_id", "n")


def rebuilt(conversations: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with the first turns of the head of their family.

    ``conv_id``, ``p``, ``key``, ``chars``: the first h = crc32(conv_id) % ``most`` turns of
    conv_id - conv_id % ``family``, then the conversation's own turns after its first h; p counts from 1,
    and a row of p = 0 stands for each conversation, also one without turns.
    """
    turns, convs = placed_turns(conversations)
    turns = written(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("has"))
    plans = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("head")).join(heads, "head", "left")
    plans = written(plans.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))))
    lead = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "head")
    taken = plans.where("taken > 0").select("conv_id", "head", "taken").join(lead, "head").where("pos <= taken")
    # A conversation's turns may be a third of all: its plan goes to each block of its turns.
    shifts = plans.where("n > h").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), _block(F.col("n")))).alias("block"))
    own = turns.withColumn("block", _block(F.col("pos"))).join(shifts, ["conv_id", "block"]).where("pos > h")
    zero = plans.select("conv_id", F.lit(0).cast("long").alias("p"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("chars"))
    return zero.unionByName(taken.select("conv_id", F.col("pos").alias("p"), "key", "chars")).unionByName(
        own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("p"), "key", "chars")
    )


class Named:
    """Rows of (``conv_id``, ``p``, ``key``, ...) with the name of each prefix, one row for each band.

    ``bands`` has ``conv_id``, ``k``, ``items`` (structs by p), ``before`` (the name of all before the
    band, null in the first) and ``names`` of the prefixes that end in it.  ``upper`` is the level of band
    digests, where there is more than one band.
    """

    def __init__(self, rows: DataFrame, *payload: str) -> None:
        cell = F.struct("p", "key", *payload)
        bands = rows.groupBy("conv_id", F.floor(F.col("p") / HEIGHT).alias("k")).agg(F.array_sort(F.collect_list(cell)).alias("items"))
        chain = "aggregate(items, {start}, (a, x) -> unhex(substr(sha2(concat(a, x.key), 256), 1, 32)))"
        bands = written(bands.withColumn("own", F.expr(chain.format(start="X''"))))
        self.upper: Named | None = None
        if bands.where("k > 0").isEmpty():
            bands = bands.withColumn("before", F.lit(None).cast("binary")).withColumn("after", F.lit(None).cast("binary"))
        else:
            self.upper = Named(bands.select("conv_id", F.col("k").alias("p"), F.col("own").alias("key")))
            above = self.upper.bands.select("conv_id", F.explode(F.arrays_zip(F.col("items.p").alias("k"), F.col("names").alias("after"), F.col("befores").alias("before"))).alias("x"))
            bands = bands.join(above.select("conv_id", "x.k", "x.before", "x.after"), ["conv_id", "k"])
        # A whole band's last prefix goes by the name that the level above gives to the end of the band.
        names = f"""aggregate(items, CAST(array() AS array<binary>), (a, x) -> concat(a, array(
            IF(x.p % {HEIGHT} = {HEIGHT - 1} AND after IS NOT NULL, after,
               unhex(substr(sha2(concat(coalesce(try_element_at(a, -1), before, X''), x.key), 256), 1, 32))))))"""
        bands = bands.withColumn("names", F.expr(names))
        self.bands = written(bands.withColumn("befores", F.expr("concat(array(before), slice(names, 1, size(names) - 1))")).drop("own", "after"))


def _nodes(level: Named, *payload: str) -> DataFrame:
    """One row for each prefix of each conversation: ``name``, ``parent``, ``before`` (of its band), ``way`` (ancestors in the band and itself), ``p``, payload."""
    fields = ["i.p", *(f"i.{c}" for c in payload)]
    rows = level.bands.select(
        "conv_id", "before", "names", F.posexplode(F.arrays_zip(F.col("items").alias("i"), F.col("names").alias("name"), F.col("befores").alias("parent"))).alias("at", "x")
    )
    return rows.select("conv_id", "before", F.expr("slice(names, 1, at + 1)").alias("way"), "x.name", "x.parent", *(f"x.{f}" for f in fields))


def rolled_up(level: Named, nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``name`` and the ``sums`` over each node's subtree; ``nodes`` has ``name``, ``way``, ``before`` and a node's own values."""
    add = [F.sum(c).alias(c) for c in sums]
    if level.upper is not None:
        hanging = nodes.where("before is not null").groupBy("before").agg(*add).withColumnRenamed("before", "name")
        places = _nodes(level.upper).groupBy("name").agg(F.first("way").alias("way"), F.first("before").alias("before"))
        below = rolled_up(level.upper, cut_lineage(hanging.join(places, "name")), sums)
        more = below.select("name", *(F.col(c).alias(f"below_{c}") for c in sums))
        joined = nodes.join(more, "name", "left")
        nodes = joined.select("name", "way", *((F.col(c) + F.coalesce(f"below_{c}", F.lit(0))).alias(c) for c in sums))
    return cut_lineage(nodes.select(F.explode("way").alias("name"), *sums).groupBy("name").agg(*add))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order: one hash state is held, not the pieces."""
    name, state = None, sha256()
    for batch in batches:
        done = []
        for own, piece in zip(batch.column("name"), batch.column("piece"), strict=True):
            if own.as_py() != name:
                if name is not None:
                    done.append((name, state.hexdigest()))
                name, state = own.as_py(), sha256()
                state.update(piece.as_py().encode())
            else:
                state.update(b"," + piece.as_py().encode())
        yield _digests(done)
    yield _digests([] if name is None else [(name, state.hexdigest())])


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["name", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """``name`` and SHA-256 of the sorted, comma-joined conv_ids that end there, from rows of both."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = cut_lineage(members.groupBy("name", F.shiftright("conv_id", PIECE).alias("at")).agg(F.array_join(ids, ",").alias("piece")))
    count = pieces.groupBy("name").agg(F.count("*").alias("n"), F.first("piece").alias("piece"))
    single = count.where("n = 1").select("name", F.sha2("piece", 256).alias("ends_sha256"))
    several = pieces.join(count.where("n > 1").select("name"), "name", "left_semi")
    in_order = several.repartition("name").sortWithinPartitions("name", "at").select("name", "piece")
    return single.unionByName(in_order.mapInArrow(_streamed, "name binary, ends_sha256 string"))


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie over conversations given as ``conv_id``, ``p`` (0 for the root, then turns from 1), ``key`` and ``chars``.

    ``name``, ``conv_id`` (smallest member), ``depth``, ``parent`` (a name), ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    level = Named(rows, "chars")
    places = _nodes(level, "chars")
    same = [F.first(c).alias(c) for c in ("parent", "before", "way", "chars")]  # equal for all members
    nodes = cut_lineage(places.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p").alias("depth"), *same))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select("name", "way", "before", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rolled_up(level, own, ["n_leaves", "saved_tokens"])
    last = level.bands.groupBy("conv_id").agg(F.max_by(F.element_at("names", -1), "k").alias("name"))
    told = nodes.drop("before", "way", "chars").join(totals, "name").join(ends(last), "name", "left")
    # Children of one node may be many: they are the side that adaptive execution can split.
    parents = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return told.join(parents, "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op13(conversations: DataFrame) -> DataFrame:
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return trie(rebuilt(conversations)).select(*columns)


_PREFIX = "md5(array_to_string(list_transform(keys[:d], lambda k: length(k[1]) || ':' || length(k[2]) || ':' || k[1] || k[2]), ''))"

#: Every node meets its ancestors through the conversations that hold both.
ORACLE = f"""
WITH steps AS {CRC_STEPS},
own AS (SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS keys FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
plan AS (SELECT conv_id, keys, conv_id - conv_id % 100 AS head, {crc_sql('conv_id::VARCHAR')} % 6 AS h FROM own, steps),
built AS (SELECT p.conv_id, coalesce(o.keys, [])[:h] || p.keys[h + 1:] AS keys FROM plan p LEFT JOIN own o ON o.conv_id = p.head),
placed AS (SELECT conv_id, d, len(keys) AS n, CASE WHEN d = 0 THEN '' ELSE {_PREFIX} END AS name, CASE WHEN d = 0 THEN 0 ELSE length(keys[d][2]) END AS chars,
  FROM (SELECT conv_id, keys, unnest(range(0, len(keys) + 1)) AS d FROM built) x),
nodes AS (SELECT d, name, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM placed GROUP BY d, name),
edges AS (SELECT DISTINCT a.d, a.name, b.name AS child FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
kids AS (SELECT d, name, count(*) AS n FROM edges GROUP BY d, name),
valued AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.name = nodes.name),
under AS (SELECT DISTINCT a.d, a.name, b.d AS bd, b.name AS bname FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND b.d >= a.d),
totals AS (SELECT u.d, u.name, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens FROM under u JOIN valued v ON v.d = u.bd AND v.name = u.bname GROUP BY u.d, u.name)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends AS ends_sha256
FROM valued v JOIN totals t ON t.d = v.d AND t.name = v.name
LEFT JOIN edges e ON e.d = v.d - 1 AND e.child = v.name LEFT JOIN nodes up ON up.d = e.d AND up.name = e.name
"""

