"""Prefix trie and structure repair against their SQL, on odd conversations too."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from maskwright.llm import ordered, prefix_trie, queries as Q, repair

KIND = "conv_id long, turn long, role string, text string, pos int, node string"


def conversations(spark, rows, path):
    spark.createDataFrame([(*r, 7, "clash") for r in rows], KIND).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def same(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    want = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[n] for n in names) for r in Q.QUERIES[name](spark, path).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
    return got


def odd_rows(seed):
    """Shared openings, copies, a long conversation, nulls, ties, gaps, repeated rows."""
    some = random.Random(seed)
    rows, words = [], ["Hi.", "Yes!", "no", "", " ", "Why?\n", None, "a b.", "\U0001f600"]
    for conv in [*range(0, 12), *range(100, 112), 250, 251, 300, -1, -100]:
        for turn in range(some.randrange(0, 7)):
            rows.append((conv, some.choice([turn, turn, turn + 3, None]), some.choice(["user", "assistant", "system", "", None, "tool"]), some.choice(words)))
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}.") for c in (400, 401, 402, 500) for t in range(5)]
    rows += [(600, t, some.choice(["user", "assistant", "system"]), f"{some.choice(words)} {t % 40}") for t in range(150)]
    rows += [(601, t, "user", "x.") for t in range(70)] + rows[:5]
    some.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [64, 3])
def test_trie_equals_its_sql(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    got = same(spark, conversations(spark, odd_rows(block), tmp_path), "op12_prefix_trie")
    assert max(r[1] for r in got) > 100


def test_trie_of_nothing(spark, tmp_path):
    path = conversations(spark, [(None, 1, "user", "no id")], tmp_path)
    assert Q.op12_prefix_trie(spark, path).collect() == []


@pytest.mark.parametrize("block", [128, 2, 5])
def test_repair_equals_its_sql(spark, tmp_path, monkeypatch, block):
    plain = repair.repaired
    monkeypatch.setattr(repair, "repaired", lambda rows: plain(rows, block=block))
    rows = odd_rows(block) + [(None, 2, "user", None), (None, None, None, "x"), (9, 10**9, "user", "far.")]
    got = same(spark, conversations(spark, rows, tmp_path), "op13_repair")
    assert max(len(r[7]) for r in got) > 100


def test_repair_of_nothing(spark, tmp_path):
    assert Q.op13_repair(spark, conversations(spark, [], tmp_path)).collect() == []


def every_edit(turns):
    """Least (cost, edits) by trying all of them, with one turn put in at each place at most twice."""
    best = None
    puts = ["", "I", "II"]
    for own in itertools.product("DKR", repeat=len(turns)):
        for where in itertools.product(puts, repeat=len(turns) + 1):
            cost, state, text, fits = 0, 0, "", True
            for i, puts_ in enumerate(where):
                for _ in puts_:
                    cost, text, state = cost + 3, text + "I", repair._FORCED[state]
                if i == len(turns):
                    break
                (role, fault), step = turns[i], own[i]
                text += step
                if step == "D":
                    cost += 4
                    continue
                lead = repair._FORCED[state] if step == "R" else repair._NEXT.get(role, (None,) * 4)[state]
                if fault == 1 or lead is None:
                    fits = False
                    break
                cost, state = cost + (3 if step == "R" else 0) + (3 if fault == 2 else 0), lead
            if fits and state in (0, 3) and (best is None or (cost, text) < best):
                best = cost, text
    return best


def test_layers_find_what_trying_all_edits_finds():
    some = random.Random(5)
    for _ in range(120):
        turns = [(some.choice("suat"), some.choice([0, 0, 1, 2])) for _ in range(some.randrange(0, 5))]
        found, costs = repair.layers(turns, repair._ENDS, True, 1)
        edits, _, state = repair.traced(turns, repair._ENDS, True, found, 0, costs[0])
        assert (costs[0], "".join(edits)) == every_edit(turns) and state in (0, 3)


def test_places_of_a_group_that_holds_most_rows(spark):
    rows = [("hot", i % 500, f"{i:05d}") for i in range(3000)] + [(f"k{i}", 1, "x") for i in range(50)] + [("hot", 3, "same")] * 40
    df = spark.createDataFrame(rows, "k string, turn long, text string").repartition(7)
    got = ordered.placed(df, "k", [F.col("turn"), F.col("text")])
    at = {}
    for r in sorted(got.collect(), key=lambda r: (r.k, r.pos)):
        at.setdefault(r.k, []).append((r.pos, r.turn, r.text))
    for k, xs in at.items():
        assert [x[0] for x in xs] == list(range(len(xs))) and [x[1:] for x in xs] == sorted(x[1:] for x in xs), k
