"""Operator 4: chat formatting with minimum-cost repair of roles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import WORD, broadcast_if_small, cut, lower_ascii, table

#: States of the automaton: nothing yet, or the role of the turn that is open. A stated role has its state's number, an unknown one 0.
START, SYSTEM, USER, ASSISTANT, TOOL = range(5)
ROLES = [None, "system", "user", "assistant", "tool"]
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "tool": TOOL, "function": TOOL}
#: Turns that may follow each state, and the states in which a conversation may end.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (ASSISTANT, TOOL)}
ENDS = (ASSISTANT, USER, TOOL, START)
OPEN, MERGE, DROP = range(3)
#: What a repair costs; a role that is unknown has no more to lose than a name. An empty turn costs less than another role.
RELABEL, NAME, INSERT, JOIN, BLANK = 3, 1, 2, 1, 1
#: Longest conversation whose repair is remembered by its roles.
REMEMBERED = 64
#: Rows of a batch that is returned.
BATCH = 65_536


def _between(state: int, to: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from a state to where ``to`` may follow; None where none do."""
    ways, seen = [((), state)], {state}
    while ways:
        after = []
        for path, at in ways:
            if to in FOLLOWS[at]:
                return path
            for step in FOLLOWS[at]:
                if step not in seen:
                    seen.add(step)
                    after.append(((*path, step), step))
        ways = after
    return None


#: Roles of empty turns by their code; what must come before each turn, and after the last one where a conversation may not end.
INSERTED = sorted({p for s in range(5) for t in range(1, 5) if (p := _between(s, t)) is not None} | {(USER,)}, key=lambda p: (len(p), p))
LAST = {s: () if s in ENDS else (USER,) for s in range(5)}


def _moves(symbol: int) -> list[list[tuple[int, int, int, int]]]:
    """(state before, cost, what is done, code of the empty turns before it) of all ways into each state by one turn; of equal ones the first is taken."""
    role, blank = divmod(symbol, 2)

    def named(state: int) -> int:
        return 0 if role == state else RELABEL if role else NAME

    out = []
    for to in range(5):
        ways = [(s, named(to), OPEN, 0) for s in range(5) if to in FOLLOWS[s]]
        if to != START:
            ways.append((to, JOIN + named(to), MERGE, 0))
        if blank:
            ways.append((to, BLANK, DROP, 0))
        if to != START:
            ways += [(s, INSERT * len(p) + named(to), OPEN, INSERTED.index(p)) for s in range(5) if (p := _between(s, to))]
        out.append(ways)
    return out


MOVES = [_moves(symbol) for symbol in range(10)]
_FAR = 1 << 60


def repair(symbols: bytes) -> tuple[np.ndarray, ...]:
    """What is done with each turn, its new role, cost and slot, whether it is its slot's last, and the codes of the empty turns before
    and after it, at the least cost in all.

    A symbol is a turn's stated role x 2, plus 1 for a blank text. The state
    carried from turn to turn is five costs; a turn leaves five bytes.
    """
    costs, back = [0, _FAR, _FAR, _FAR, _FAR], bytearray()
    for symbol in symbols:
        after = []
        for ways in MOVES[symbol]:
            best, code = _FAR, 0
            for way, (state, cost, _, _) in enumerate(ways):
                if costs[state] + cost < best:
                    best, code = costs[state] + cost, way
            after.append(best)
            back.append(code)
        costs = after
    state = min((*ENDS, SYSTEM), key=lambda s: costs[s] + INSERT * len(LAST[s]))
    done, role, paid, before_it, after_it = (np.zeros(len(symbols), np.int8) for _ in range(5))
    if len(symbols):
        after_it[-1], paid_last = INSERTED.index(LAST[state]), INSERT * len(LAST[state])
    for i in range(len(symbols) - 1, -1, -1):
        before, paid[i], done[i], before_it[i] = MOVES[symbols[i]][state][back[5 * i + state]]
        role[i] = state
        state = before
    if len(symbols):
        paid[-1] += paid_last
    kept = np.flatnonzero(done != DROP)
    last = np.zeros(len(symbols), bool)
    last[kept] = np.append(done[kept][1:] == OPEN, True)[: len(kept)]
    more = np.array([len(p) for p in INSERTED])
    return done, role, paid, np.cumsum((done == OPEN) + more[before_it]) - 1, last, before_it, after_it


_remembered = lru_cache(4096)(repair)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stand by conversation and in order; a conversation may go over many batches."""
    names = ["id", "done", "new", "cost", "slot", "last", "before", "after", "place"]
    conv, symbols, ids, out, rows = None, bytearray(), [], [], 0

    def finish() -> None:
        found = _remembered(bytes(symbols)) if len(symbols) <= REMEMBERED else repair(bytes(symbols))
        out.append((np.concatenate(ids), *found, np.arange(len(symbols))))

    def flush() -> Iterator[pa.RecordBatch]:
        whole = [np.concatenate(x) for x in zip(*out, strict=True)]
        for at in range(0, len(whole[0]), BATCH):
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH]).cast(k) for x, k in zip(whole, kinds, strict=True)], names)
        out.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        of, symbol, at = (batch.column(n).to_numpy() for n in ("conv_id", "symbol", "id"))
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if ids and of[a] != conv:
                finish()
                rows += len(symbols)
                symbols, ids = bytearray(), []
                if rows >= BATCH:
                    yield from flush()
                    rows = 0
            conv = of[a]
            symbols += symbol[a:b].astype(np.uint8).tobytes()
            ids.append(at[a:b])
    if ids:
        finish()
    if out:
        yield from flush()


def _stated(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, lower_ascii(F.trim(role))), F.lit(0))


def _pick(names: list, code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), code + 1)


def chat_turns(turns: DataFrame) -> DataFrame:
    """All conversations with legal roles, rendered; one row for each row of (conv_id, turn, role, text).

    Legal is: a system turn or none, then user and assistant by turns, tool turns
    between two assistant turns; the last may be any but the system turn (a
    conversation that ends with the user waits for its answer). A repair opens
    a turn under its stated role (free) or another one (3; 1 where the stated role
    is none of the known), merges it into the turn before (1 more), puts empty turns
    before it (2 each) or, where a conversation would end with its system turn, an empty user turn after it, or, of blank
    text only, drops it (1); no text is dropped. The cheapest
    of all repairs of a conversation is found by dynamic programming over the
    automaton's states.

    ``place`` is the row's number within its conversation, ``slot`` that of the turn it
    belongs to (empty turns are counted), ``inserted`` and ``inserted_after`` the roles of the empty turns before and after it,
    ``rendered`` its part of the rendered conversation, with those: parts joined by place
    are the whole. Marks within texts are opened ("< |"), so that only turns have
    them. Equal numbers of turns stand by role and text; rows without conv_id belong to
    no conversation and are returned with the action "none".

    Only a few bytes a turn pass the dynamic program, in order; texts are joined by
    row, so neither a long conversation nor a hot one gathers them. Columns of ``turns`` but these four are not read; an empty table gives no rows.
    """
    rows = cut(turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("id")))
    symbol = 2 * _stated(F.col("role")) + F.when(F.coalesce(F.col("text").rlike(WORD), F.lit(False)), 0).otherwise(1)
    narrow = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", F.xxhash64("text").alias("h"), symbol.cast("int").alias("symbol"), "id")
    narrow = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h", "id").select("conv_id", "symbol", "id")
    done = cut(narrow.mapInArrow(_repaired, "id long, done int, new int, cost int, slot int, last boolean, before int, after int, place int"))
    named = F.when(_stated(F.col("role")) == F.col("new"), False).otherwise(True)
    action = (
        F.when(F.col("done").isNull(), "none").when(F.col("done") == DROP, "drop").when(F.col("done") == MERGE, F.when(named, "merge_relabel").otherwise("merge")).when(named, "relabel").otherwise("keep")
    )
    kept = F.col("done") != DROP
    role = _pick(ROLES, F.col("new"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    head = F.when(F.col("done") == OPEN, F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))).otherwise("")
    rendered = F.when(kept, F.concat(head, body, F.when(F.col("last"), "<|im_end|>\n").otherwise("\n"))).when(F.col("done") == DROP, "")
    empty = ["".join(f"<|im_start|>{ROLES[r]}\n<|im_end|>\n" for r in p) for p in INSERTED]
    roles = F.array(*[F.array(*[F.lit(ROLES[r]) for r in p]).cast("array<string>") for p in INSERTED])
    whole = F.concat(_pick(empty, F.col("before")), rendered, _pick(empty, F.col("after")))
    return rows.join(broadcast_if_small(done), "id", "left").select(
        "conv_id", "turn", "place", F.when(kept, F.col("slot")).alias("slot"), F.col("role").alias("stated_role"), F.when(kept, role).alias("role"), action.alias("action"), "cost",
        F.element_at(roles, F.col("before") + 1).alias("inserted"), F.element_at(roles, F.col("after") + 1).alias("inserted_after"), whole.alias("rendered"),
    )


def op4_chat(spark, sf_dir: str) -> DataFrame:
    return chat_turns(table(spark, sf_dir, "conversations"))
