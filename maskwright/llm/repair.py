"""Repair of a conversation's structure by cost layers.

The turns of a repaired conversation have the role initials ``(s?(ua)+)?``. For
each cost, from 0 up, a bit set for each turn says from which states of that
grammar the rest can be repaired at just that cost (as approximate matching by
bit vectors keeps a vector for each number of errors); a layer follows from the
layers 3, 4 and 6 before it. The first layer that holds the start state gives
the cost, and walking forward through the layers, least letter first, gives the
least of the cheapest edit strings.

Conversations are cut into blocks of ``BLOCK`` turns. One that has a single
block is done in one go. Of the others each block gives its costs between
states; these are combined from the end by doubling (min-plus), blocks are
traced for every state that they may be entered in, and the states they are
entered in follow by doubling again. So no conversation is one task's, whatever
its length; only its edit string is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordered import doubled, placed

#: Turns of a block.
BLOCK = 128
# Costs of edits, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: White space of the contract.
WHITE = " \t\n\x0b\x0c\r"
#: More than any cost.
NEVER = 1_000_000_000

# States: 0 nothing yet, 1 after a system turn, 2 after a user's, 3 after an assistant's; 0 and 3 may end.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The state that the next user's or assistant's turn leads to; there is just one.
_FORCED = (2, 2, 3, 2)


def _before(leads: tuple) -> bytes:
    """For each set of states, those that lead into it."""
    return bytes(sum(1 << s for s in range(4) if leads[s] is not None and into >> leads[s] & 1) for into in range(16))


_KEPT, _PUT = {r: _before(x) for r, x in _NEXT.items()}, _before(_FORCED)
_NONE = bytes(16)


def layers(turns: list[tuple[str, int]], exits: list[int], last: bool, wanted: int) -> tuple[list[bytearray], list[int]]:
    """The layers of a block, and the least costs of the four states to enter it in.

    turns: role initial, and 0 sound, 1 to be deleted, 2 truncated; exits: what
    each state costs at the block's end; last: whether turns may be put in
    there; wanted: the set of states whose costs are asked for."""
    n, found, costs, out = len(turns), 0, [NEVER] * 4, []
    most = 4 * n + 9 + min(exits)
    kept = [_NONE if fault == 1 else _KEPT.get(role, _NONE) for role, fault in turns]
    extra = [TRUNCATED if fault == 2 else 0 for _, fault in turns]
    may = [_NONE if fault == 1 else _PUT for _, fault in turns]
    empty = bytearray(n + 1)
    for cost in range(most + 1):
        here = bytearray(n + 1)
        put = out[cost - INSERT] if cost >= INSERT else empty
        cut = out[cost - DELETE] if cost >= DELETE else empty
        late = out[cost - REROLE - TRUNCATED] if cost >= REROLE + TRUNCATED else empty
        m = sum(1 << s for s in range(4) if exits[s] == cost)
        if last:
            m |= _PUT[put[n]]
        here[n] = m
        for i in range(n - 1, -1, -1):
            # A sound turn is kept at this cost, a truncated one at TRUNCATED more, which is what INSERT and REROLE cost too.
            m = cut[i + 1] | _PUT[put[i]]
            if extra[i]:
                m |= kept[i][put[i + 1]] | may[i][late[i + 1]]
            else:
                m |= kept[i][here[i + 1]] | may[i][put[i + 1]]
            here[i] = m
        out.append(here)
        new = here[0] & ~found
        if new:
            for s in range(4):
                if new >> s & 1:
                    costs[s] = cost
            found |= new
            if found & wanted == wanted:
                break
    return out, costs


def traced(turns: list[tuple[str, int]], exits: list[int], last: bool, found: list[bytearray], state: int, cost: int) -> tuple[list[str], list[str], int]:
    """The least cheapest edits from a state: for each turn its letters (those
    put in before it, its own, and after the last one those put in at the end),
    likewise the initials that turns get (``-``: its own role), and the state at the end."""
    n, i, edits, roles = len(turns), 0, [""], [""]
    has = lambda c, at, s: s is not None and c >= 0 and found[c][at] >> s & 1
    while i < n or exits[state] != cost:
        forced, letter = _FORCED[state], "-ua"[_FORCED[state] - 1]
        if i < n:
            role, fault = turns[i]
            more = TRUNCATED if fault == 2 else 0
            onward = None if fault == 1 else _NEXT.get(role, (None,) * 4)[state]
        if i < n and has(cost - DELETE, i + 1, state):
            edit, given, cost, step = "D", "-", cost - DELETE, 1
        elif has(cost - INSERT, i, forced):
            edit, given, cost, step, state = "I", letter, cost - INSERT, 0, forced
        elif has(cost - more, i + 1, onward):
            edit, given, cost, step, state = "K", "-", cost - more, 1, onward
        else:
            edit, given, cost, step, state = "R", letter, cost - REROLE - more, 1, forced
        edits[-1] += edit
        roles[-1] += given
        i += step
        if step and i < n:
            edits.append("")
            roles.append("")
    return edits, roles, state


_ENDS = [0, NEVER, NEVER, 0]


def _blocks(batches: Iterator[pa.RecordBatch], more: int, block: int) -> Iterator[tuple[list, list[tuple[str, int]], str | None]]:
    """Blocks from rows sorted by them: key columns (conv, blk and ``more``
    others), turns, and the initial of the turn after the block."""
    key, turns, peek = None, [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if key is None or row[:2] != tuple(key[:2]):
                if key is not None:
                    yield key, turns, peek
                key, turns, peek = list(row[: 2 + more]), [], None
            pos, role, fault = row[2 + more :]
            if pos - row[1] * block < block:
                turns.append((role, fault))
            else:
                peek = role
    if key is not None:
        yield key, turns, peek


def _first_pass(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations of one block; of others the costs between states."""
    out: list[dict] = []
    for (conv, blk), turns, peek in _blocks(batches, 0, block):
        initials = [r for r, _ in turns] + ([peek] if peek is not None else [])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        row = {"conv": conv, "blk": blk, "illegal": illegal, "cost": None, "costs": None, "edits": None, "roles": None}
        if peek is None and blk == 0:
            found, costs = layers(turns, _ENDS, True, 1)
            edits, roles, _ = traced(turns, _ENDS, True, found, 0, costs[0])
            row |= {"cost": costs[0], "edits": edits, "roles": roles}
        elif peek is None:
            costs = layers(turns, _ENDS, True, 15)[1]
            row["costs"] = [c for s in range(4) for c in (costs[s], NEVER, NEVER, NEVER)]
        else:
            to = [layers(turns, [0 if s == t else NEVER for s in range(4)], False, wanted)[1] for t, wanted in enumerate((1, 3, 15, 15))]
            row["costs"] = [to[t][s] for s in range(4) for t in range(4)]
        out.append(row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _FIRST)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _FIRST)


_FIRST = pa.schema([("conv", pa.string()), ("blk", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string()))])
_FIRST_DDL = "conv string, blk long, illegal long, cost long, costs array<long>, edits array<string>, roles array<string>"
_SECOND = pa.schema([("conv", pa.string()), ("blk", pa.int64()), ("leads", pa.list_(pa.int32())), ("edits", pa.list_(pa.list_(pa.string()))), ("roles", pa.list_(pa.list_(pa.string())))])
_SECOND_DDL = "conv string, blk long, leads array<int>, edits array<array<string>>, roles array<array<string>>"


def _second_pass(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Traces of a block for each state that it may be entered in."""
    for (conv, blk, exits), turns, peek in _blocks(batches, 1, block):
        exits = _ENDS if peek is None else [x - min(exits) for x in exits]
        found, costs = layers(turns, exits, peek is None, 15)
        each = [traced(turns, exits, peek is None, found, s, costs[s]) for s in range(4)]
        row = {"conv": conv, "blk": blk, "leads": [x[2] for x in each], "edits": [x[0] for x in each], "roles": [x[1] for x in each]}
        yield pa.RecordBatch.from_pylist([row], _SECOND)


def _min_plus(a: Column, b: Column) -> Column:
    cell = lambda s, t: F.least(F.lit(NEVER), *[a[4 * s + k] + b[4 * k + t] for k in range(4)])
    return F.array(*[cell(s, t) for s in range(4) for t in range(4)])


def _sorted_blocks(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv", "blk").sortWithinPartitions("conv", "blk", "pos").select("conv", "blk", *more, "pos", "initial", "fault")


def edits_of(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of ``turns`` (conv, pos from 0 without gaps, initial,
    fault 0 sound, 1 to be deleted, 2 truncated): by block (conv, blk, edits,
    roles: arrays of strings for each turn, see ``traced``), and by conversation (conv, illegal, cost)."""
    cut = F.expr(f"pos div {block}")
    # A block's first turn is also shown to the block before.
    blks = F.when((F.col("pos") > 0) & (F.col("pos") % block == 0), F.array(cut, cut - 1)).otherwise(F.array(cut))
    rows = turns.select("conv", F.explode(blks).alias("blk"), "pos", "initial", "fault")
    first = stored(_sorted_blocks(rows).mapInArrow(lambda batches: _first_pass(batches, block), _FIRST_DDL), "first")
    done = first.where("edits IS NOT NULL").select("conv", "blk", "edits", "roles")
    most = first.agg(F.max("blk")).first()[0] or 0
    cost = first.where("blk = 0").select("conv", "cost")
    if most:
        suffix = doubled(first.where("costs IS NOT NULL").select("conv", "blk", "costs"), "conv", "blk", "costs", most, _min_plus, backward=True)
        ends = suffix.select("conv", (F.col("blk") - 1).alias("blk"), F.array(*[F.col("costs")[4 * s] for s in range(4)]).alias("exits"))
        long = rows.join(suffix.select("conv", "blk"), ["conv", "blk"], "left_semi").join(ends, ["conv", "blk"], "left")
        second = stored(_sorted_blocks(long, "exits").mapInArrow(lambda batches: _second_pass(batches, block), _SECOND_DDL), "second")
        through = doubled(second.select("conv", "blk", "leads"), "conv", "blk", "leads", most, lambda a, b: F.transform(a, lambda s: F.get(b, s)))
        entered = through.select("conv", (F.col("blk") + 1).alias("blk"), F.get("leads", F.lit(0)).alias("state"))
        chosen = second.join(entered, ["conv", "blk"], "left").withColumn("state", F.coalesce("state", F.lit(0)))
        done = done.unionByName(chosen.select("conv", "blk", F.get("edits", F.col("state")).alias("edits"), F.get("roles", F.col("state")).alias("roles")))
        cost = cost.join(suffix.where("blk = 0").select("conv", F.col("costs")[0].alias("_cost")), "conv", "left").select("conv", F.coalesce("cost", "_cost").alias("cost"))
    illegal = first.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    return stored(done, "edits"), illegal.join(cost, "conv")


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) damaged by crc32 of ``conv:turn`` modulo 20: 0
    drops the row, 1 empties its text, 2 removes its marks ``.!?``, 3 repeats it, 4
    sets its role to user. Nulls are one space; ``conv`` is the conversation's id as text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = df.select(space("conv_id").alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("conv", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text; only turn may be null) by turn (null first),
    then role and text: with ``pos`` and ``flaw``, the first of blank, duplicate
    (role and text seen earlier) and truncated (the last character but white
    space isn't one of ``.!?``) that holds, or null."""
    placed_ = placed(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    placed_ = placed_.withColumn("_said", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    again = placed_.groupBy("conv", "_said").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    bare = F.rtrim("text", F.lit(WHITE))
    flaw = F.when(bare == "", "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return stored(placed_.join(again, ["conv", "_said"], "left").withColumn("flaw", flaw).drop("_said", "_first"), "faulty")


def repaired(rows: DataFrame, *, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv, turn, role, text): (summary, turns).

    summary, a row for each conversation: conv, gaps, blank, duplicate,
    truncated, illegal, cost (longs) and audit, the edits' initials: Keep, Rerole,
    Delete, Insert. turns: conv, pos, i (those put in and the turn itself, in
    order), edit, role, text of the repaired conversations. An empty table gives
    empty ones; results don't depend on ``block``."""
    seen = faulty(rows)
    fault = F.when(F.col("flaw").isin("blank", "duplicate"), 1).when(F.col("flaw") == "truncated", 2).otherwise(0)
    edits, costs = edits_of(seen.select("conv", "pos", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), block)
    counts = [F.count_if(F.col("flaw") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    turns = seen.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    flaws = seen.groupBy("conv").agg(*counts)
    parts = edits.select("conv", F.struct("blk", F.array_join("edits", "").alias("s")).alias("part"))
    audit = parts.groupBy("conv").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    audit = audit.select("conv", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("audit"))
    summary = flaws.join(turns, "conv").join(costs, "conv").join(audit, "conv")
    each = edits.select("conv", "blk", F.posexplode(F.arrays_zip("edits", "roles")).alias("i", "z"))
    each = each.select("conv", (F.col("blk") * block + F.col("i")).alias("pos"), "z.edits", "z.roles")
    split = lambda c: F.split(c, "", -1)
    full = seen.select("conv", "pos", "role", "text").join(each, ["conv", "pos"])
    full = full.select("conv", "pos", "role", "text", F.posexplode(F.arrays_zip(split("edits").alias("e"), split("roles").alias("r"))).alias("i", "z")).where("z.e NOT IN ('', 'D')")
    role = F.when(F.col("z.r") == "u", "user").when(F.col("z.r") == "a", "assistant").otherwise(F.col("role"))
    return summary, full.select("conv", "pos", "i", F.col("z.e").alias("edit"), role.alias("role"), F.when(F.col("z.e") == "I", "").otherwise(F.col("text")).alias("text"))
