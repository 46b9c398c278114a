"""Conversation repair against a search over all edits, and the whole contract on the tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tideline.llm import conversations as own
from tideline.llm.common import table

GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Cost, letters and repaired initials by trying edits in order of cost, then letters.

    rows are (initial, must go, truncated).
    """
    heap, least = [(0, "", 0, "", "")], {}
    while heap:
        cost, letters, at, state, roles = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, letters, roles
        if cost > least.setdefault((at, state), cost):
            continue
        for x in "ua":
            if (state, x) in GRAMMAR:
                heapq.heappush(heap, (cost + 3, letters + "I", at, x, roles + x))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 4, letters + "D", at + 1, state, roles + "-"))
            if not gone:
                extra = 3 if cut else 0
                if (state, initial) in GRAMMAR:
                    heapq.heappush(heap, (cost + extra, letters + "K", at + 1, initial, roles + initial))
                for x in "ua":
                    if (state, x) in GRAMMAR:
                        heapq.heappush(heap, (cost + 3 + extra, letters + "R", at + 1, x, roles + x))
    raise AssertionError


def searched(rows):
    repair, out = own.Repair(), []
    for i, (initial, gone, cut) in enumerate(rows):
        out += repair.add(initial, gone, cut, i)
    out += repair.end()
    assert [m for _, m, _ in out if m is not None] == list(range(len(rows)))
    cost = sum(own.COST[e] + (3 if e in "KR" and rows[m][2] else 0) for e, m, _ in out)
    return cost, "".join(e for e, _, _ in out), repair.most


def test_search_equals_trying_all_edits():
    rng = random.Random(6)
    for _ in range(2500):
        rows = [(rng.choice("suuaax"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randint(0, 8))]
        assert searched(rows)[:2] == cheapest(rows)[:2], rows


def test_rows_held_stay_few_and_a_single_role_ends():
    rng = random.Random(7)
    rows = [(rng.choice("uas"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(20000)]
    assert searched(rows)[2] < 100
    assert searched([("ua"[i % 2], False, False) for i in range(10001)])[2] < 5
    cost, letters, _ = searched([("u", False, False)] * 2001)
    assert cost == 3 * 1001 and len(letters) >= 2001


def expected(given):
    """The contract by plain Python: conv_id -> columns."""
    parts = {}
    for conv, turn, role, text in given:
        rows = parts.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, rows in parts.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in rows:
            inner = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, letters, roles = cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, faults, strict=True)])
        left, lines = iter(rows), []
        for e, x in zip(letters, roles, strict=True):
            row = None if e == "I" else next(left)
            if e != "D":
                lines.append(f"{row[1] if e == 'K' else ROLES[x]}:{row[2] if row else ''}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_plain_python(spark, folder):
    given = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in own.op12_conversation_repair(spark, folder).collect()}
    assert got == expected(given)


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (None, 3, "assistant", "Yes."), (1, None, None, "x"), (2, 0, "user", None)]
    rows += [(3, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", "", " \n", None, "Why? ", "."])) for t in range(60)]
    rows += [(4, 0, "user", "word " * 40000 + "."), (4, 5, "assistant", "Fine."), (4, 5, "assistant", "Fine."), (4, 2**40, "user", "End.")]
    rows += [(100 + t % 9, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(80)]
    schema = "conv_id long, turn long, role string, text string, key string, place int, first long, audit string"
    frame = spark.createDataFrame([(*r, "k", 1, 2, "a") for r in rows], schema)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in own.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)
    edits = own.repair(frame)
    assert edits.columns == ["conv_id", "place", "edit", "turn", "was_role", "fault", "role", "text"]
    assert own.digests(own.repair(frame.where("false"))).count() == 0
    again = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in own.digests(own.repair(own.damage(frame.repartition(7)))).collect()}
    assert all(got[k] == v for k, v in again.items())


def test_a_dropped_conversation_is_returned_with_zeros(spark, tmp_path):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    row = own.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
