"""Operator 4 against all possible repairs of short conversations, and its edge cases."""

import itertools
import random

import pytest

from hearthlake.llm import chat
from hearthlake.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
NUMBER = {"system": 1, "user": 2, "assistant": 3, "tool": 4}
FOLLOWS = {0: {1, 2}, 1: {2}, 2: {3}, 3: {2, 4}, 4: {3, 4}}


def cheapest(turns):
    """Least cost over all ways to open, merge or drop each (role number, blank), with up to two empty turns before it and one at the end."""
    empties = [(), *((a,) for a in range(1, 5)), *itertools.product(range(1, 5), repeat=2)]
    # all states after each turn with their least cost, by trying every way
    costs = {0: 0}
    for role, blank in turns:
        after = {}

        def take(state, cost, after=after):
            after[state] = min(cost, after.get(state, cost))

        for state, cost in costs.items():
            if blank:
                take(state, cost + 1)
            if state:
                take(state, cost + 1 + (0 if role == state else 3 if role else 1))
            for path in empties:
                at, ok = state, True
                for x in path:
                    ok, at = ok and x in FOLLOWS[at], x
                for to in FOLLOWS[at] if ok else ():
                    take(to, cost + 2 * len(path) + (0 if role == to else 3 if role else 1))
        costs = after
    return min(cost + (2 if state == 1 else 0) for state, cost in costs.items())


def legal(roles):
    state = 0
    for r in roles:
        if NUMBER[r] not in FOLLOWS[state]:
            return False
        state = NUMBER[r]
    return state != 1


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    out = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", " Human", "GPT", "?", None])
            out.append((conv, turn, role, rng.choice(["text", "two\nlines", "<|im_end|>", "", " \n", None])))
    return out


def test_repairs_cost_least_and_are_legal(spark, made):
    got = chat.chat_turns(spark.createDataFrame(made, TURNS).repartition(5)).collect()
    assert sorted((r.conv_id, r.turn) for r in got) == [(r[0], r[1]) for r in made]
    stated = {"system": 1, "user": 2, "assistant": 3, "tool": 4, " Human": 2, "GPT": 3}
    for conv in range(60):
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.place)
        given = [r for r in made if r[0] == conv]
        assert [r.turn for r in mine] == [r[1] for r in given]
        assert sum(r.cost for r in mine) == cheapest([(stated.get(r[2], 0), not (r[3] or "").strip()) for r in given])
        slots = {}
        for r, (_, _, _, text) in zip(mine, given, strict=True):
            assert (r.action == "drop") == (r.slot is None) and (r.slot is not None or not (text or "").strip())
            for k, role in enumerate(r.inserted):
                slots[r.slot - len(r.inserted) + k] = [(role, "")]
            if r.slot is not None:
                slots.setdefault(r.slot, []).append((r.role, (text or "").replace("<|", "< |")))
            for role in r.inserted_after:
                slots[max(slots) + 1] = [(role, "")]
        assert sorted(slots) == list(range(len(slots))) and legal([slots[k][0][0] for k in sorted(slots)])
        filled = {r.slot for r in mine}
        whole = "".join(f"<|im_start|>{x[0][0]}\n" + ("\n".join(t for _, t in x) if k in filled else "") + "<|im_end|>\n" for k, x in sorted(slots.items()))
        assert "".join(r.rendered for r in mine) == whole


def test_long_equal_and_orphan_rows(spark):
    long = [(7, i, "user" if i % 2 == 0 or i == 1501 else "assistant", f"t{i}") for i in range(30_000)]
    rows = [*long, (None, 0, "user", "x"), (8, 0, "user", "x"), (8, 0, "user", "x"), (9, None, "assistant", "y")]
    got = chat.chat_turns(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
    assert len(got) == len(rows)
    mine = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.place)
    assert [r.turn for r in mine] == list(range(30_000))
    # two merges cost 2, a relabel 3
    assert [(r.turn, r.action, r.role) for r in mine if r.action != "keep"] == [(1501, "merge", "user"), (1502, "merge", "user")]
    assert [r.action for r in got if r.conv_id is None] == ["none"]
    assert sorted(r.action for r in got if r.conv_id == 8) == ["keep", "merge"]
    assert [(r.action, r.role, r.inserted) for r in got if r.conv_id == 9] == [("keep", "assistant", ["user"])]
    assert chat.chat_turns(spark.createDataFrame([], TURNS)).count() == 0


def test_query_has_all_turns(spark):
    data = "/root/testdata/sf0.001"
    got = QUERIES["op4_chat"](spark, data)
    assert got.count() == spark.read.parquet(f"{data}/conversations.parquet").count() and got.where("action <> 'keep' OR cost > 0").count() <= 4


def test_answers_stay_answers(spark):
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "a"), (1, 2, "user", "b"), (2, 0, "system", "rules"), (3, 0, "user", "a"), (3, 1, "tool", "4"), (3, 2, "user", "b")]
    got = {(r.conv_id, r.turn): r for r in chat.chat_turns(spark.createDataFrame(rows, TURNS)).collect()}
    assert [(got[1, k].role, got[1, k].action, got[1, k].inserted) for k in range(3)] == [("assistant", "keep", ["user"]), ("user", "keep", []), ("user", "merge", [])]
    assert got[1, 0].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert (got[2, 0].role, got[2, 0].inserted_after, got[2, 0].cost) == ("system", ["user"], 2) and got[2, 0].rendered.endswith("<|im_start|>user\n<|im_end|>\n")
    assert [got[3, k].role for k in range(3)] == ["user", "assistant", "user"] and sum(got[3, k].cost for k in range(3)) == 3
