"""Conversation repair against an exhaustive search and against one that holds whole conversations."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import pytest

from lodestone.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """(cost, letters) by plain recursion from the front, over whole strings; rows: (initial, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        for r in "ua":
            if inserts and (state, r) in step:
                c, w = best(i, step[state, r], inserts - 1)
                found.append((c + 3, "I" + w))
        if i < len(rows):
            role, fault = rows[i]
            c, w = best(i + 1, state, 3)
            found.append((c + 4, "D" + w))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for r, letter, cost in [(role, "K", 0), ("u", "R", 3), ("a", "R", 3)]:
                    if (state, r) in step:
                        c, w = best(i + 1, step[state, r], 3)
                        found.append((c + cost + more, letter + w))
        return min(found, default=(10**9, ""))

    return best(0, "", 3)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit = cheapest(tuple(zip(initials, faults))) if mine else (0, "")
        kept, at, state = [], 0, ""
        for x in audit:
            give = "a" if state == "u" else "u"
            if x == "I":
                kept.append({"u": "user", "a": "assistant"}[give] + ":")
                state = give
                continue
            if x == "K":
                kept.append(f"{mine[at][2]}:{mine[at][3]}")
                state = initials[at]
            elif x == "R":
                kept.append({"u": "user", "a": "assistant"}[give] + ":" + mine[at][3])
                state = give
            at += 1
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def found(spark, rows, more=None):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d = d.selectExpr("*", *more) if more else d
    return {r[0]: tuple(r)[1:] for r in C.summary(C.repair(C.damage(d)), d).collect()}


ROLES = ["user", "assistant", "system", "tool", "", None]


def made(n, seed, convs):
    import random

    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t\n", None, "Ünder é", "so it is.\n", "x" * 30]
    return [(draw.choice(convs), draw.choice([None, *range(40)]), draw.choice(ROLES + ["user", "assistant"] * 4), draw.choice(texts)) for _ in range(n)]


def test_agenda_is_exhaustive_search():
    for n in range(6):
        for roles in itertools.product("suax", repeat=n):
            faults = tuple(("none", "truncated", "duplicate", "blank")[(i * 7 + len(roles) + ord(r)) % 4] for i, r in enumerate(roles))
            costs, audits, _ = C.lightest("".join(roles), "".join(f[0] for f in faults), C.FINAL)
            assert (costs[0], audits[0]) == cheapest(tuple(zip(roles, faults))), (roles, faults)


@pytest.mark.parametrize("bits", [10, 3])
def test_repair_with_and_without_blocks(spark, monkeypatch, bits):
    """Blocks of eight rows give what whole conversations give; nulls, repeats, unknown roles, odd turns among the rows."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rows = made(400, 5, [1, 2, 3, 4, 5, 6, None]) + made(150, 6, [7]) + [(8, 0, "user", None), (9, 3, "assistant", "Ok.")] * 2
    assert found(spark, rows) == expected(rows)


def test_digests_are_of_the_repaired_texts(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Hi."), ("user", "Hm?"), ("assistant", "Hello.")] * 30)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    e = sorted(C.repair(d).filter("edit <> 'D'").collect(), key=lambda r: (r["_block"], r["_seq"]))
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in e))
    digest = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in e).encode()).hexdigest()
    assert [r.repaired_sha256 for r in C.digests(C.repair(d)).collect()] == [digest]


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], ["1 AS cost", "2 AS _pos", "3 AS _block"]).keys() == {1}
