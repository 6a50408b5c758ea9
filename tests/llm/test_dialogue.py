"""Conversation repair against a dynamic programme over whole audit strings."""

import hashlib
import random
import re
import zlib

import pytest

from hammerprice.llm import dialogue
from hammerprice.llm.queries import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, report int, n string"  # the last three clash with names used inside
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def table(path):
    import duckdb

    return duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{path}/conversations.parquet'").fetchall()


def fits(initials):
    """States by what a sequence of roles may still become."""
    return re.fullmatch("s?(ua)*u?", initials) is not None


def brute(rows):
    """What one conversation counts, its audit string and repaired lines; every edit of every turn is tried."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    count = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    count["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    seen, best = set(), {"": (0, "", ())}  # by the initials so far, shortened: what may follow depends on the last one alone

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for initials, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if fits(initials + role[0]):
                        put(out, initials + role[0], (cost + 3, audit + "I", (*lines, role + ":")))
        return out

    def put(states, initials, new):
        key = initials if len(initials) < 2 and initials in ("", "s") else initials[-1]
        if key == "a":
            key = "ua"
        if key not in states or new < states[key]:
            states[key] = new

    for turn, role, text in rows:
        stripped = text.strip(" \t\n\v\f\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        after = {}
        for initials, (cost, audit, lines) in inserted(best).items():
            put(after, initials, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault else 0
            if role[:1] and role[0] in "sua" and fits(initials + role[0]):
                put(after, initials + role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if fits(initials + new[0]):
                    put(after, initials + new[0], (cost + extra + 3, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "ua"))
    return count | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def check(spark, rows, part_rows=4096):
    report, turns = dialogue.repaired(frame(spark, rows), part_rows)
    found = {r["conv_id"]: r.asDict() for r in report.collect()}
    for r in dialogue.digests(turns).collect():
        found[r["conv_id"]] |= r.asDict()
    groups = {}
    for c, *rest in rows:
        groups.setdefault(c, []).append(rest)
    assert found == {c: {"conv_id": c} | brute(own) for c, own in groups.items()}
    return turns.collect()


def invented(seed, conversations=60, longest=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", None, " \t", "é?", "a.\n", "b  ", "x. "]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system"] * 2 + ["tool", "", None, "Assistant", "utility"]
    return [(r.choice([c, c, c, None] if c == 7 else [c]), r.choice([t, t, t, t * 2, None]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{t}.") for c in range(conversations) for t in range(r.randint(1, longest))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed):
    check(spark, invented(seed))


@pytest.mark.parametrize("part_rows", [1, 2, 7])
def test_parts_of_any_length(spark, part_rows):
    rows = invented(5, 30) + [(1000, t, r, x) for _, t, r, x in invented(6, 1, 60)] + [(1001, t, ("user", "assistant")[t % 3 % 2], f"{t}" + "." * (t % 4 > 0)) for t in range(60)]
    check(spark, rows, part_rows)


def test_many_equal_rows_and_ties(spark):
    rows = [(1, 0, "user", "Hi.")] * 700 + [(1, 1, "assistant", "Yes.")] * 3 + [(1, 1, "assistant", "yes.")] + [(2, None, "user", "Hi.")] * 5 + [(3, 4, "user", " ")] * 9 + [(4, 0, "system", "Do.")]
    rows += [(5, i, "user", "Again.") for i in range(300)]
    turns = check(spark, rows, part_rows=50)
    assert len([t for t in turns if t["conv_id"] == 1]) < 20
    assert {t["conv_id"]: t["edit"] for t in turns if t["conv_id"] == 4} == {4: "D"}


def test_long_text_and_empty_table(spark):
    check(spark, [(1, 0, "user", "a" * 3_000_000 + "."), (1, 1, "assistant", "é" * 3_000_000), (1, 2, "user", "a" * 3_000_000 + ".")])
    report, turns = dialogue.repaired(frame(spark, []))
    assert report.collect() == [] and dialogue.digests(turns).collect() == []


def test_query_against_brute_force(spark):
    found = {r["conv_id"]: r.asDict() for r in op12_conversation_repair(spark, SMALL).collect()}
    groups = {}
    for c, t, role, text in table(SMALL):
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        own = groups.setdefault(c, [])
        if kind:
            row = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert found == {c: {"conv_id": c} | (brute(own) if own else empty) for c, own in groups.items()}


def test_damage(spark):
    rows = [(1, t, "assistant", "A. b!") for t in range(60)] + [(None, None, None, None)]
    got = sorted((str(r["conv_id"]), r["turn"], r["role"], r["text"]) for r in dialogue.damaged(frame(spark, rows)).collect())
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (str(c), t, "user" if kind == 4 else role or " ", {1: "", 2: re.sub("[.!?]", "", text or " ")}.get(kind, text or " "))
        want += [row] * (kind > 0) + [row] * (kind == 3)
    assert got == sorted(want)
