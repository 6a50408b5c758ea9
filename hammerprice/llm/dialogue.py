"""Repair of conversations' structure by the cheapest edits, among these the first in order.

A conversation's role initials must read ``(s?(ua)+)?``. Each turn is met by one macro
edit: a run of inserted turns, then Keep, Rerole or Delete. The codes of macros (``D``,
``ID``, ``IK``, ...) are prefix-free, so audit strings of as many turns compare as their
sequences of codes do. A layer of the dynamic programme - after each turn, for each state
reached from each state before - therefore needs a cost and a rank, never a string: the
next rank follows from the pair (rank, code). Parent pointers lead back.

Costs less their minimum and ranks take few different values, so layers are met by a memo.

Turns are range-sorted and cut into parts of bounded length, wherever a conversation ends.
A part is solved for every state that it may begin in; a conversation's parts are then
chained like turns, and each part is walked back between its two states. So one
conversation's turns are spread over as many tasks as its length asks for. Equal rows are
counted before they move and stay one row with a number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: A part has so many rows, or so many characters of text, at most (and one row at least).
PART_ROWS, PART_CHARS = 4096, 1 << 22
#: Rows in a batch that a task hands back.
BATCH = 8192

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after an inserted or reroled turn.
NEXT = (USER, USER, ASSISTANT, USER)
#: What a kept turn's initial needs, and where it leads.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Inserted turns after the last one that make a whole of each state.
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
MACROS = sorted("I" * j + edit for j in range(3) for edit in "KRD")
LEGAL = {"su", "ua", "au"}


@lru_cache(maxsize=None)
def _moves(initial: str | None, cut: bool) -> tuple[tuple[int, int, int, int], ...]:
    """``(before, after, cost, macro)``: the best macro between each two states for a turn.

    ``initial`` is None where the turn must be deleted, empty where it can't be kept.
    """
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for before in range(4):
        for number, macro in enumerate(MACROS):
            at, cost = before, INSERT * (len(macro) - 1)
            for _ in macro[1:]:
                at = NEXT[at]
            if macro[-1] == "D":
                cost += DELETE
            elif initial is None:
                continue
            elif macro[-1] == "R":
                at, cost = NEXT[at], cost + REROLE + CUT * cut
            elif at in KEPT.get(initial, {}):
                at, cost = KEPT[initial][at], cost + KEEP + CUT * cut
            else:
                continue
            best[before, at] = min(best.get((before, at), (cost, number)), (cost, number))
    return tuple((x, y, cost, number) for (x, y), (cost, number) in best.items())


#: A layer: for each (first state, state now), at 4 * first + now, cost above the least and rank; None if out of reach.
Layer = tuple[tuple[int, int] | None, ...]


def _opening(starts: Iterable[int]) -> Layer:
    return tuple((0, 0) if i // 4 == i % 4 and i // 4 in starts else None for i in range(16))


def _ranked(found: dict[int, tuple[int, tuple[int, int]]]) -> tuple[Layer, int]:
    """Costs above the least, ranks in place of what they rank; the least cost."""
    least = min(cost for cost, _ in found.values())
    rank = {key: i for i, key in enumerate(sorted({key for _, key in found.values()}))}
    return tuple((found[i][0] - least, rank[found[i][1]]) if i in found else None for i in range(16)), least


@lru_cache(maxsize=1 << 16)
def _step(layer: Layer, initial: str | None, cut: bool) -> tuple[Layer, int, tuple[tuple[int, int] | None, ...]]:
    """The next layer, what it adds to all costs, and each entry's (state before, macro)."""
    found: dict[int, tuple[int, tuple[int, int]]] = {}
    parent: dict[int, tuple[int, int]] = {}
    for before, after, cost, macro in _moves(initial, cut):
        for first in range(0, 16, 4):
            if was := layer[first + before]:
                new = (was[0] + cost, (was[1], macro))
                if first + after not in found or new < found[first + after]:
                    found[first + after], parent[first + after] = new, (before, macro)
    return (*_ranked(found), tuple(parent.get(i) for i in range(16)))


class Turn(NamedTuple):
    conv_id: object
    turn: int | None
    role: str
    text: str
    n: int
    late: bool
    blank: bool
    cut: bool

    @property
    def initial(self) -> str | None:
        """Of the first of the equal rows; the others are always deleted."""
        return None if self.blank or self.late else self.role[:1]

    @property
    def more(self) -> int:
        """Equal rows after the first, in a run: each but the last is deleted where it stands."""
        return self.n - 1


def _solved(turns: list[Turn], opening: Layer) -> tuple[Layer, int, list[tuple]]:
    """The last layer, the cost that all its entries share, and the pointers of each step.

    A run of deleted rows takes one step for its last row; the rows before it are deleted in
    place, since ``D`` comes before ``I``.
    """
    layer, total, parents = opening, 0, []
    for t in turns:
        layer, cost, back = _step(layer, t.initial, t.cut)
        total += cost
        parents.append(back)
        if t.more:
            layer, cost, back = _step(layer, None, False)
            total += cost + DELETE * (t.more - 1)
            parents.append(back)
    return layer, total, parents


def _walked(parents: list[tuple], first: int, last: int) -> list[tuple[int, str]]:
    """``(state before, macro)`` of each step from ``first`` to ``last``."""
    out = []
    for back in reversed(parents):
        last, macro = back[4 * first + last]
        out.append((last, MACROS[macro]))
    return out[::-1]


SUMMARY = "struct<layer:array<int>,cost:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,opens:string,closes:string,low:bigint,high:bigint,turns:bigint>"


def _summary(turns: list[Turn], opening: Layer) -> dict:
    """A part's last layer, flat (-1: out of reach), and what its rows count."""
    layer, cost, _ = _solved(turns, opening)
    known = [t.turn for t in turns if t.turn is not None]
    initials = [t.role[:1] for t in turns]
    return {
        "layer": [x for e in layer for x in (e or (-1, -1))],
        "cost": cost,
        "blank": sum(t.n for t in turns if t.blank),
        "duplicate": sum(t.n - (not t.late) for t in turns if not t.blank),
        "truncated": sum(t.cut and t.initial is not None for t in turns),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(t.more for t in turns if t.role[:1] * 2 not in LEGAL),
        "opens": initials[0],
        "closes": initials[-1],
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "turns": len(set(known)),
    }


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "")
        if len(held) >= BATCH or size >= PART_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            yield from batch.slice(i, 1024).to_pylist()


def _parts(rows: Iterator[dict], most: int) -> Iterator[list[Turn]]:
    part: list[Turn] = []
    size = 0
    for row in rows:
        t = Turn(**row)
        if part and (part[0].conv_id != t.conv_id or len(part) >= most or size >= PART_CHARS):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t.text)
    if part:
        yield part


def _cut_up(schema: pa.Schema, most: int) -> Callable:
    """Sorted rows with part and place; a part's last row carries its summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            part = TaskContext.get().partitionId() << 32
            before: object = run  # the partition's first conversation may have begun in another
            for turns in _parts(_streamed(batches), most):
                begun = before is run or before == turns[0].conv_id
                summary = _summary(turns, _opening(range(4) if begun else (START,)))
                for place, t in enumerate(turns):
                    yield t._asdict() | {"part": part, "place": place, "summary": summary if place == len(turns) - 1 else None}
                before, part = turns[0].conv_id, part + 1

        yield from _batches(rows(), schema)

    return run


def _chained(schema: pa.Schema) -> Callable:
    """For each part the states that it begins and ends in, turns to insert at its end, and on the
    conversation's first part what the conversation counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for conv_id, group in groupby(_streamed(batches), itemgetter("conv_id")):
                layer, total, parents, ids = _opening((START,)), 0, [], []
                count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                low = high = closes = None
                for row in group:
                    s = row["summary"]
                    found: dict[int, tuple[int, tuple[int, int]]] = {}
                    parent: dict[int, int] = {}
                    for i in range(16):
                        cost, rank = s["layer"][2 * i : 2 * i + 2]
                        if (was := layer[i // 4]) and cost >= 0:
                            new = (was[0] + cost, (was[1], rank))
                            if i % 4 not in found or new < found[i % 4]:
                                found[i % 4], parent[i % 4] = new, i // 4
                    layer, least = _ranked(found)
                    total += s["cost"] + least
                    parents.append(parent)
                    ids.append(row["part"])
                    for k in count:
                        count[k] += s[k]
                    count["illegal"] += closes is not None and closes + s["opens"] not in LEGAL
                    count["turns"] -= high is not None and high == s["low"]
                    closes = s["closes"]
                    low, high = s["low"] if low is None else low, high if s["high"] is None else s["high"]
                cost, _, tail, last = min((e[0] + INSERT * TAIL[y], e[1], TAIL[y], y) for y, e in enumerate(layer[:4]) if e)
                gaps = 0 if low is None else high - low + 1 - count.pop("turns")
                report = count | {"gaps": gaps, "cost": total + cost}
                ways = []
                for parent, part in zip(reversed(parents), reversed(ids)):
                    ways.append({"part": part, "first": parent[last], "last": last, "tail": 0, "report": None})
                    last = parent[last]
                ways[0]["tail"], ways[-1]["report"] = tail, report
                for way in reversed(ways):
                    yield way | {"conv_id": conv_id}

        yield from _batches(rows(), schema)

    return run


def _edited(schema: pa.Schema) -> Callable:
    """The rows of each part under their edits, inserted turns among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for part, group in groupby(_streamed(batches), itemgetter("part")):
                held = list(group)
                way, turns = held[0], [Turn(**{k: r[k] for k in Turn._fields}) for r in held]
                base = {"conv_id": way["conv_id"], "part": part}
                _, _, parents = _solved(turns, _opening((way["first"],)))
                steps = iter(_walked(parents, way["first"], way["last"]))
                place = 0

                def edits(t: Turn, first: bool) -> Iterator[dict]:
                    at, macro = next(steps)
                    if not first and t.more > 1:
                        yield {"edit": "D", "times": t.more - 1, "turn": t.turn, "role": None, "text": None}
                    for _ in macro[1:]:
                        at = NEXT[at]
                        yield {"edit": "I", "times": 1, "turn": None, "role": ROLE[at], "text": ""}
                    role = {"K": t.role, "R": ROLE[NEXT[at]], "D": None}[macro[-1]]
                    yield {"edit": macro[-1], "times": 1, "turn": t.turn, "role": role, "text": t.text if role is not None else None}

                for t in turns:
                    for first in (True, False)[: 1 + bool(t.more)]:
                        for e in edits(t, first):
                            yield base | e | {"place": place}
                            place += 1
                at = way["last"]
                for _ in range(way["tail"]):
                    at = NEXT[at]
                    yield base | {"edit": "I", "times": 1, "turn": None, "role": ROLE[at], "text": "", "place": place}
                    place += 1

        yield from _batches(rows(), schema)

    return run


def _digested(schema: pa.Schema) -> Callable:
    """Audit string and hash of each conversation, read turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for conv_id, group in groupby(_streamed(batches), itemgetter("conv_id")):
                audit, sha, begun = [], hashlib.sha256(), False
                for r in group:
                    audit.append(r["edit"] * r["times"])
                    if r["role"] is not None:
                        sha.update(("\n" * begun + r["role"] + ":" + r["text"]).encode())
                        begun = True
                yield {"conv_id": conv_id, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        yield from _batches(rows(), schema)

    return run


def _arrow(df: DataFrame, ddl: str) -> tuple[pa.Schema, str]:
    """The schema of ``conv_id`` as in ``df`` and the named columns, for Arrow and for Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {ddl}"
    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema), ddl


def _mapped(df: DataFrame, function: Callable, ddl: str, *more: object) -> DataFrame:
    schema, ddl = _arrow(df, ddl)
    return df.mapInArrow(function(schema, *more), ddl)


def repaired(conversations: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """What the conversations (conv_id, turn, role, text) count, and their turns under the cheapest edits.

    The report has a row for each conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost``. The turns have a row for each edit: ``conv_id, part, place`` (the order),
    ``edit`` (K, R, D or I), ``times`` (equal rows deleted one after the other), ``turn, role,
    text`` (role and text null where deleted, turn null where inserted).

    Rows are taken by turn, nulls first, then by role and text; equal rows stand side by side
    and all but the first are duplicates. Null roles and texts count as one space. A null
    conv_id is a conversation like others. A role whose initial is not s, u or a is never
    kept. An empty table gives two empty results; other columns are not read. ``part_rows``
    bounds what a task holds, not results.
    """
    spare = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", spare).alias("role"), F.coalesce("text", spare).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))), "turns")
    firsts = rows.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    firsts = written(firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), "first"), "turns-first")
    met = rows.join(firsts, rows.conv_id.eqNullSafe(firsts["_c"]) & (rows.role == firsts["_r"]) & (rows.sha == firsts["_s"]), "left")
    late = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    plain = met.select("conv_id", "turn", "role", "text", "n", late.alias("late"), blank.alias("blank"), (~whole).alias("cut"))
    # a text's beginning is enough to deal rows out; the sort sees the whole of it
    order = plain.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    turn = "turn bigint, role string, text string, n bigint, late boolean, blank boolean, cut boolean"
    cut_up = written(_mapped(order, _cut_up, f"{turn}, part bigint, place int, summary {SUMMARY}", part_rows), "turns-cut")
    summaries = cut_up.where("summary IS NOT NULL").select("conv_id", "part", "summary").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    counts = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint>"
    ways = written(_mapped(summaries, _chained, f"part bigint, first int, last int, tail int, report {counts}"), "turns-ways")
    report = ways.where("report IS NOT NULL").select("conv_id", "report.*")
    parts = cut_up.drop("summary").join(ways.select("part", "first", "last", "tail"), "part").repartition("part").sortWithinPartitions("part", "place")
    return report, _mapped(parts, _edited, "part bigint, place int, edit string, times bigint, turn bigint, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of the turns that ``repaired`` returns.

    The hash of a conversation is sequential, so one task reads all its turns, but holds a
    batch of them only."""
    sorted_turns = turns.select("conv_id", "part", "place", "edit", "times", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return _mapped(sorted_turns, _digested, "audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32(``conv_id:turn``) % 20: 0 a turn is lost, 1 its text is
    empty, 2 has no sentence ends, 3 the turn is there twice, 4 its role is user. Nulls count as one space."""
    spare = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), spare), F.lit(":"), F.coalesce(F.col("turn").cast("string"), spare))
    kind = F.crc32(key.cast("binary")) % 20
    raw = F.coalesce("text", spare)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(raw, "[.!?]", "")).otherwise(raw)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", spare))
    times = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_times")).drop("_times")
