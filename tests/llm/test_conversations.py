import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from isospan.llm import conversations as C
from isospan.llm.conversations import audit_conversations, damaged, edits, repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind int, digest string"
WS = r"[^\x20\x09-\x0D]"


def cheapest(rows):
    """(cost, audit) over rows of (role, fault): best first over every edit, prefixes in order."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap = [(0, "", 0, 0, False)]
    while heap:
        cost, audit, i, state, done = heapq.heappop(heap)
        if done:
            return cost, audit
        if i == len(rows) and state in (0, 3):
            heapq.heappush(heap, (cost, audit, i, state, True))
        if not re.search("III$", audit):
            for role in "ua":
                if (state, role) in moves:
                    heapq.heappush(heap, (cost + 3, audit + "I", i, moves[state, role], False))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, False))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (state, role[:1]) in moves:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, moves[state, role[:1]], False))
            for to in "ua":
                if (state, to) in moves:
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, moves[state, to], False))
    raise AssertionError


def expected(rows, damage=True):
    """conv_id -> result, from the contract's words."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        own = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20 if damage else 19
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        own += [(turn, role, text)] * (1 + (code == 3))
    out = {}
    for conv, own in convs.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, faults = set(), []
        for _, role, text in own:
            last = re.findall(WS, text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(list(zip([r[1] for r in own], faults)))
        at, kept, roles = 0, [], ""
        for e in audit:
            if e != "I":
                _, role, text = own[at]
                at += 1
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if roles.endswith("u") else "user"
                text = "" if e == "I" else text
            roles += role[:1]
            kept.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_edits_of_every_short_signature():
    letters = [(r, f) for r in "suax" for f in C.FAULTS]
    rng = random.Random(1)
    cases = [list(c) for n in range(3) for c in itertools.product(letters, repeat=n)] + [[rng.choice(letters) for _ in range(rng.randint(3, 4))] for _ in range(300)]
    for rows in cases:
        sig = "".join(chr(65 + 4 * "suax".index(r) + C.FAULTS.index(f)) for r, f in rows)
        audit, end = edits(sig, C.START, C.END)
        audit += C.closing(end)
        assert (C.least_costs(sig, C.END)[0], audit) == cheapest(rows), rows
        assert C.cost_of(sig, audit) == C.least_costs(sig, C.END)[0]


def test_blocks_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(50):
        sig = "".join(chr(65 + rng.choice([0, 4, 4, 8, 8, 7, 5, 12])) for _ in range(40))
        parts = [sig[i : i + 7] for i in range(0, 40, 7)]
        after, state, out = C.tails([C.matrix(p) for p in parts]), C.START, ""
        for p, t in zip(parts, after):
            a, state = edits(p, state, t)
            out += a
        whole, end = edits(sig, C.START, C.END)
        assert (out, state) == (whole, end)


def conversation(rng, conv, n):
    texts = ["Yes.", "No", "Why?", "", " \t", "Ok!", "éé. ", "a.b", "x" * 50]
    return [(conv, rng.choice([None, t, t + 2, 2 * t]) if rng.random() < 0.2 else t, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "S"]), rng.choice([*texts, None]), "c", 1, "d") for t in range(n)]


@pytest.fixture(scope="module")
def messy():
    rng = random.Random(3)
    rows = [r for c in [None, -1, *range(60)] for r in conversation(rng, c, rng.randint(1, 5))]
    return rows + rows[:40]


@pytest.mark.parametrize("letters", [2, 4096])
def test_whole_result(spark, messy, letters):
    df = spark.createDataFrame(messy, SCHEMA).repartition(3)
    assert got(audit_conversations(df, damage=True, block_letters=letters)) == expected(messy)


def test_registered_query(spark, sf):
    from isospan.llm.queries import op13_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_conversation_repair(spark, sf)) == expected(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More"), (2, None, "assistant", "Yes."), (3, 5, "tool", " ")]
    out = sorted((r.conv_id, r.ord, r.edit, r.role, r.text) for r in repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert out == [(1, 1, "K", "user", "Hi."), (1, 2, "R", "assistant", "More"), (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "Yes.")]


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit_conversations(empty, damage=True).count() == 0
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "Hi.", "c", 1, "d")], SCHEMA)
    assert damaged(df).count() == 0
    assert got(audit_conversations(df, damage=True)) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_long_conversation(spark):
    """60,000 turns in blocks, against one recursion over the whole signature."""
    n = 60_000
    df = spark.range(n).selectExpr("7L conv_id", "id turn", "CASE WHEN id % 7 = 3 THEN 'user' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END role", "concat('turn ', id, CASE WHEN id % 5 = 0 THEN '' ELSE '.' END) text")
    row = audit_conversations(df).collect()[0]
    sig = "".join(chr(65 + 4 * (1 if i % 7 == 3 or i % 2 == 0 else 2) + (3 if i % 5 == 0 else 0)) for i in range(n))
    audit, end = edits(sig, C.START, C.END)
    assert row.audit == audit + C.closing(end) and row.cost == C.least_costs(sig, C.END)[0]
    assert row.illegal == C.fault_counts(sig)[3] and row.truncated == n // 5
