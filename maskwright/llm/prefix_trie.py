"""Prefix trie of conversations with sums over subtrees.

A node is a distinct sequence of first turns, known by a 128-bit digest; its
edge is the digest of the sequence without the last turn. Digests are made of
blocks of ``BLOCK`` turns and, for longer conversations, by doubling over
blocks. Sums over subtrees come from pointer jumping: in round k every node
that has an ancestor 2**k above hands it what it has gathered from less than
2**k below, then doubles its pointer; so there are as many rounds as the
logarithm of the greatest depth, each over fewer nodes.

No group is gathered in one task, however many conversations share a turn, an
opening or all of their turns: counts, sums and least ids are aggregations that
begin on the map side, pointers are joined to unique nodes by plain joins that
Spark splits, and the first level's pointer, the root, isn't joined at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordered import doubled, joined_sha256, placed

#: Turns whose digests are made in one row.
BLOCK = 64
#: Ids from a range this wide (a power of two) are listed in one row.
SPAN_BITS = 8
#: First turns of which another conversation's are taken, at most.
HEAD = 5

NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _digest(bytes_: Column) -> Column:
    return F.unhex(F.substring(F.sha2(bytes_, 256), 1, 32))


def turns_in_order(df: DataFrame) -> DataFrame:
    """conv_id, pos, role, text of the rows with a conv_id: by turn (null first),
    then role and text; a null role or text becomes empty. Other columns go."""
    clean = df.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return placed(clean, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).select("conv_id", "pos", "role", "text")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation's first h turns, h = crc32 of its
    decimal id modulo 6, replaced by as many (or all) of those of the
    conversation whose id is its own rounded down to a hundred; none if that isn't there."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < HEAD))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("head"))
    convs = turns.where("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    none = F.array().cast("array<struct<pos:bigint,role:string,text:string>>")
    convs = stored(convs.join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("head")), "heads")
    taken = convs.select("conv_id", F.inline("head")).select("conv_id", "pos", "role", "text")
    own = turns.withColumn("h", h).where("pos >= h").join(convs.select("conv_id", F.size("head").alias("n")), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "role", "text")
    return taken.unionByName(own), convs.select("conv_id")


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, node, parent, size) for each turn, the parent of first
    turns empty; (conv_id, node) with the node where each conversation ends."""
    one = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = turns.select("conv_id", F.expr(f"pos div {BLOCK}").alias("blk"), F.struct("pos", F.substring(one, 1, 32).alias("t"), F.length("text").alias("size")).alias("x"))
    blocks = rows.groupBy("conv_id", "blk").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    hexes = F.transform("xs", lambda x: x["t"])
    own = F.transform("xs", lambda x, i: _digest(F.array_join(F.slice(hexes, F.lit(1), i + 1), "")))
    blocks = stored(blocks.select("conv_id", "blk", own.alias("nodes"), F.transform("xs", lambda x: x["size"]).alias("sizes")), "blocks")
    most = blocks.agg(F.max("blk")).first()[0] or 0
    before = F.lit(b"").alias("before")
    if most:
        tips = blocks.select("conv_id", "blk", F.element_at("nodes", -1).alias("tip"))
        chained = doubled(tips, "conv_id", "blk", "tip", most, lambda a, b: _digest(F.concat(a, b)))
        after = lambda df, c, name: df.select("conv_id", (F.col("blk") + 1).alias("blk"), c.alias(name))
        wide = blocks.join(after(chained, F.col("tip"), "_chain"), ["conv_id", "blk"], "left")
        moved = F.when(F.col("_chain").isNull(), F.col("nodes")).otherwise(F.transform("nodes", lambda n: _digest(F.concat("_chain", n))))
        blocks = stored(wide.select("conv_id", "blk", moved.alias("nodes"), "sizes"), "blocks")
        blocks = blocks.join(after(blocks, F.element_at("nodes", -1), "_end"), ["conv_id", "blk"], "left")
        before = F.coalesce("_end", F.lit(b"")).alias("before")
    blocks = blocks.select("conv_id", "blk", "nodes", "sizes", before)
    parents = F.concat(F.array("before"), F.slice("nodes", F.lit(1), F.size("nodes") - 1))
    each = blocks.select("conv_id", "blk", F.posexplode(F.arrays_zip("nodes", parents.alias("parents"), "sizes")).alias("i", "z"))
    each = each.select("conv_id", (F.col("blk") * BLOCK + F.col("i") + 1).alias("depth"), F.col("z.nodes").alias("node"), F.col("z.parents").alias("parent"), F.col("z.sizes").alias("size"))
    return each, blocks.groupBy("conv_id").agg(F.max_by(F.element_at("nodes", -1), "blk").alias("node"))


def _rolled(nodes: DataFrame, deepest: int) -> DataFrame:
    """(node, leaf, saved): sums over what lies below each node that has anything below."""
    active, step, given = nodes.select("node", "depth", F.col("parent").alias("up"), "leaf", "saved").where("depth > 0"), 1, []
    while True:
        got = stored(active.groupBy(F.col("up").alias("node")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "given")
        given.append(got)
        if 2 * step > deepest:
            break
        deeper = active.where(F.col("depth") >= 2 * step)
        more = got.select("node", F.col("leaf").alias("_leaf"), F.col("saved").alias("_saved"))
        add = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        summed = deeper.join(more, "node", "left").select("node", "depth", "up", add("leaf"), add("saved"))
        top = summed.where(F.col("depth") == 2 * step).withColumn("up", F.lit(b""))
        jumps = active.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        rest = summed.where(F.col("depth") > 2 * step).join(jumps, "up").select("node", "depth", F.col("_up").alias("up"), "leaf", "saved")
        active, step = stored(top.unionByName(rest), "active"), 2 * step
    every = given[0]
    for more in given[1:]:
        every = every.unionByName(more)
    return every.groupBy("node").agg(F.sum("leaf").alias("_leaves"), F.sum("saved").alias("_saved_below"))


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) over the ids, ascending, of the conversations that end
    at a node. Ids of a range are listed first, so that a node where very many
    end has few rows, which pass through one task as a stream: the digest asks for that."""
    span = F.shiftright("conv_id", SPAN_BITS).alias("span")
    listed = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    return joined_sha256(ends.groupBy("node", span).agg(listed), "node", ["span"], "ids", ",").withColumnRenamed("sha256", "ends_sha256")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, pos from 0 without
    gaps, role, text; none null) of the conversations ``convs`` (conv_id, each
    once; those without turns are members of the root only): conv_id (the least
    member's), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Without conversations no rows.

    saved_tokens sums (n_convs - 1) times the last text's code points over the subtree.
    """
    each, ends = _prefixes(turns)
    own = each.groupBy("node").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    root = convs.groupBy().agg(F.lit(b"").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).alias("size"))
    found = stored(own.unionByName(root.where("n_convs > 0")), "nodes")
    deepest, first = found.agg(F.max("depth"), F.min("conv_id")).first()
    # The first level's parent is the root, whose least member is the least of all.
    up = found.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    low = found.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first).cast("long")))
    named = stored(low.unionByName(found.where("depth > 1").join(up, "parent")), "named")
    children = found.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = named.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = stored(known.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}), "known")
    sums = _rolled(known, deepest or 0)
    ended = _ends(convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(b"")).alias("node")))
    whole = known.join(sums, "node", "left").join(ended, "node", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", add("leaf", "_leaves").alias("n_leaves"), add("saved", "_saved_below").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
