"""Repair of conversation structure by signatures.

A conversation's rows in turn order become a signature of one letter a row: the
initial of the role (s, u, a or another) and the row's fault. What repairing
costs, and which edits are cheapest, depends on the signature alone, so each
distinct one is solved once, by recursion on its halves with memory for halves
met before. Audits are joined back to the conversations and replayed over their
rows.

Signatures are cut into blocks, so that no task holds a long conversation: a
block's least costs from each state to each other are a 4 x 4 matrix, and the
matrices of a conversation's blocks, last to first, give each block the costs of
what follows it. Texts are shuffled once, for the replay.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_key, pieces_of, text_bytes

SPACE = " \t\n\x0b\x0c\r"
BLOCK_LETTERS = 4096
ORDER_TASK_ROWS = 500_000
REPLAY_TASK_BYTES = 32_000_000

# States of the roles kept so far: none, a system turn, ending in user, in assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of completing the roles when no rows are left.
END = (0, 6, 3, 0)
_INSERTED = (USER, USER, ASSISTANT, USER)  # where a user or assistant turn leads
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
INITIALS, FAULTS = "suax", (None, "blank", "duplicate", "truncated")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
_LEGAL = {"su", "ua", "au"}


def letter_parts(letter: str) -> tuple[str, str | None]:
    """(initial, fault) of a letter."""
    n = ord(letter) - ord("A")
    return INITIALS[n // 4], FAULTS[n % 4]


# -- one signature --------------------------------------------------------------


@lru_cache(100_000)
def _step(letter: str, tail: tuple) -> tuple:
    """Least costs by state before a row, given those after it."""
    initial, fault = letter_parts(letter)
    row = 0 if fault != "truncated" else TRUNCATED
    here = [DELETE + c for c in tail]
    if fault not in ("blank", "duplicate"):
        for s in range(4):
            here[s] = min(here[s], REROLE + row + tail[_INSERTED[s]])
            if s in _KEPT[initial]:
                here[s] = min(here[s], row + tail[_KEPT[initial][s]])
    for _ in range(2):  # turns inserted before the row; more than two lead nowhere new
        here = [min(here[s], INSERT + here[_INSERTED[s]]) for s in range(4)]
    return tuple(here)


def _halves(sig: str) -> tuple[str, str]:
    at = 1 << ((len(sig) - 1).bit_length() - 1)
    return sig[:at], sig[at:]


def _from_zero(costs: tuple) -> tuple:
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(200_000)
def least_costs(sig: str, tail: tuple) -> tuple:
    """Least costs by state before the rows of sig, given those after them."""
    if not sig:
        return tail
    if len(sig) == 1:
        return _step(sig, tail)
    left, right = _halves(sig)
    after = least_costs(right, tail)
    least = min(after)
    return tuple(c + least for c in least_costs(left, _from_zero(after)))


@lru_cache(200_000)
def edits(sig: str, state: int, tail: tuple) -> tuple[str, int]:
    """(initials of the cheapest edits, state after): the ASCII-least of equal cost."""
    if not sig:
        return "", state
    if len(sig) > 1:
        left, right = _halves(sig)
        a, middle = edits(left, state, _from_zero(least_costs(right, tail)))
        b, end = edits(right, middle, tail)
        return a + b, end
    initial, fault = letter_parts(sig)
    row = 0 if fault != "truncated" else TRUNCATED
    costs, out = _step(sig, tail), ""
    while True:
        if DELETE + tail[state] == costs[state]:
            return out + "D", state
        if INSERT + costs[_INSERTED[state]] == costs[state]:
            out, state = out + "I", _INSERTED[state]
            continue
        kept = _KEPT[initial].get(state)
        if kept is not None and row + tail[kept] == costs[state]:
            return out + "K", kept
        return out + "R", _INSERTED[state]


def closing(state: int) -> str:
    """Inserts that complete the roles after the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def cost_of(sig: str, audit: str) -> int:
    """What the edits of an audit cost on the rows of sig."""
    at = total = 0
    for e in audit:
        total += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[e]
        if e != "I":
            total += TRUNCATED * (e != "D" and letter_parts(sig[at])[1] == "truncated")
            at += 1
    return total


def fault_counts(sig: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal neighbours) of a signature."""
    parts = [letter_parts(c) for c in sig]
    faults = [f for _, f in parts]
    illegal = sum(a + b not in _LEGAL for (a, _), (b, _) in zip(parts, parts[1:]))
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal


_INF = 1 << 40


def matrix(sig: str) -> list[int]:
    """Least costs of sig's rows from each state (outer) to each state."""
    ends = [least_costs(sig, tuple(0 if s == e else _INF for s in range(4))) for e in range(4)]
    return [min(ends[e][s], _INF) for s in range(4) for e in range(4)]


def tails(matrices: list) -> list[tuple]:
    """For each of a conversation's blocks, the costs by state of what follows it."""
    out, tail = [], END
    for m in reversed(matrices):
        out.append(tail)
        tail = _from_zero(tuple(min(m[4 * s + e] + tail[e] for e in range(4)) for s in range(4)))
    return out[::-1]


# -- rows -----------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with one row in five damaged by crc32 of conv_id:turn.

    Nulls are one space. Of twenty remainders 0 drops the row, 1 empties its
    text, 2 removes `.!?`, 3 repeats the row, 4 sets its role to user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(code == 4, "user").otherwise(space("role"))
    times = F.when(code == 0, F.array().cast("array<int>")).when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select(F.col("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"), F.explode(times).alias("_copy"))
    return out.drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """conv (a key that is never null), conv_id, turn, role, text, digest."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(_conv().alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    return out.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _conv() -> Column:
    return F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))


def _letters(keyed: DataFrame) -> DataFrame:
    """(conv, turn, digest, nth, letter): no text, in the shared folder."""
    end = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    small = keyed.select("conv", "turn", "digest", initial.alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open"))
    seen = Window.partitionBy("conv", "digest").orderBy(F.col("turn").asc_nulls_first())
    nth = small.withColumn("nth", F.row_number().over(seen))
    fault = F.when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("open"), 3).otherwise(0)
    return cut(nth.select("conv", "turn", "digest", "nth", (F.col("initial") * 4 + fault).cast("byte").alias("letter")))


def _order():
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("nth")]


def _blocked(most: int):
    def blocked(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, conv, seq, held = TaskContext.get().partitionId(), None, 0, b""

        def frame(rows):
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["conv", "part", "seq", "sig"])

        for batch in batches:
            out = []
            convs, letters = batch.column(0).to_pylist(), (batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8) + ord("A")).tobytes()
            at = 0
            for i in range(1, len(convs) + 1):
                if i < len(convs) and convs[i] == convs[at]:
                    continue
                if convs[at] != conv:
                    if held:
                        out.append((conv, part, seq, held.decode()))
                    conv, seq, held = convs[at], 0, b""
                held += letters[at:i]
                while len(held) > most:
                    out.append((conv, part, seq, held[:most].decode()))
                    seq, held = seq + 1, held[most:]
                at = i
            yield frame(out)
        if held:
            yield frame([(conv, part, seq, held.decode())])

    return blocked


def signature_blocks(letters: DataFrame, most: int = BLOCK_LETTERS) -> DataFrame:
    """(conv, part, seq, sig): signatures in row order, cut where they are long
    or where the rows of a conversation are dealt to several tasks."""
    tasks = pieces_of(letters.count(), ORDER_TASK_ROWS)
    dealt = letters.repartitionByRange(tasks, *_order()).sortWithinPartitions(*_order())
    return cut(dealt.select("conv", "letter").mapInArrow(_blocked(most), "conv string, part int, seq int, sig string"))


def _matrices(batches):
    import pyarrow as pa

    for batch in batches:
        sigs = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array([matrix(s) for s in sigs], pa.list_(pa.int64()))], names=["sig", "costs"])


def _chained(pdf):
    import pandas as pd

    pdf = pdf.sort_values(["part", "seq"])
    got = tails([list(m) for m in pdf["costs"]])
    n = len(pdf)
    task = [f"{int(i == 0)}{int(i == n - 1)}|{','.join(map(str, t))}|" for i, t in enumerate(got)]
    return pd.DataFrame({"conv": pdf["conv"], "part": pdf["part"], "seq": pdf["seq"], "task": [t + s for t, s in zip(task, pdf["sig"])]})


_SOLVED = "task string, audits array<string>, exits array<int>, costs array<long>, blank long, duplicate long, truncated long, illegal long, edge string"


def _solved(batches):
    """task: flags (first block, last block), costs after it, signature."""
    import pyarrow as pa

    types = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string())
    names = [c.split()[0] for c in _SOLVED.split(", ")]
    for batch in batches:
        rows = []
        for task in batch.column(0).to_pylist():
            flags, tail, sig = task.split("|")
            after = tuple(map(int, tail.split(",")))
            got = [edits(sig, s, after) for s in ([START] if flags[0] == "1" else range(4))]
            audits = [a + (closing(e) if flags[1] == "1" else "") for a, e in got]
            rows.append((task, audits, [e for _, e in got], [cost_of(sig, a) for a in audits], *fault_counts(sig), letter_parts(sig[0])[0] + letter_parts(sig[-1])[0]))
        cols = list(zip(*rows)) if rows else [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def solved_blocks(blocks: DataFrame) -> DataFrame:
    """Each block with the cheapest edits of its signature; a signature is solved once.

    Conversations of one block, nearly all, only need its signature. For the
    others the matrices of distinct signatures are chained, a row a block.
    """
    counted = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    several = counted.where("n > 1").select("conv")
    end = ",".join(map(str, END))
    one = blocks.join(several, "conv", "left_anti").select("conv", "part", "seq", F.concat(F.lit(f"11|{end}|"), F.col("sig")).alias("task"))
    long = cut(blocks.join(several, "conv", "left_semi"))
    known = long.select("sig").distinct().mapInArrow(_matrices, "sig string, costs array<long>")
    chained = long.join(known, "sig").groupBy("conv").applyInPandas(_chained, "conv string, part int, seq int, task string")
    tasks = cut(one.unionByName(chained))
    distinct = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("_rows"))
    solved = cut(distinct.select("task", "_rows").join(distinct.select("task").mapInArrow(_solved, _SOLVED), "task"))
    return join_by_key(tasks, solved, "task", tasks.count()).drop("task")


_OUT = "conv_id long, ord long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _replayed(batches):
    """Heads, then blocks, then rows of each conversation -> its head with the
    audit (ord 0), then the repaired turns. Rows stream; a head and an audit are held."""
    import pyarrow as pa

    names = [c.split()[0] for c in _OUT.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 6, pa.string()]
    head, parts, audit, at, place, state, told = None, [], "", 0, 0, START, True
    out: list[tuple] = []

    def tell():
        """The head of the conversation, when all of its blocks are known."""
        nonlocal audit, told
        now, texts, sums, last = START, [], [0] * 5, ""
        for p in parts:
            k = 0 if len(p["audits"]) == 1 else now
            texts.append(p["audits"][k])
            now = p["exits"][k]
            for i, v in enumerate((p["blank"], p["duplicate"], p["truncated"], p["illegal"] + (bool(last) and last + p["edge"][0] not in _LEGAL), p["costs"][k])):
                sums[i] += v
            last = p["edge"][1]
        audit, told = "".join(texts), True
        out.append((head["conv_id"], 0, None, None, None, head["gaps"], *sums, audit))

    def turn(edit, role, text):
        nonlocal place
        place += 1
        out.append((head["conv_id"], place, edit, role, text, *[None] * 7))

    def step(edit, role=None, text=""):
        nonlocal state
        if edit == "K":
            state = _KEPT[role[0]][state]
        elif edit in "IR":
            state = _INSERTED[state]
            role = "user" if state == USER else "assistant"
        if edit != "D":
            turn(edit, role, text)

    def inserts():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            step("I")
            at += 1

    def close():
        if head is not None:
            if not told:
                tell()
            inserts()

    def frame():
        nonlocal out
        cols = list(zip(*out)) if out else [[]] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        out = []
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                close()
                head, parts, audit, at, place, state, told = row, [], "", 0, 0, START, False
            elif row["kind"] == 1:
                parts.append(row)
            else:
                if not told:
                    tell()
                inserts()
                step(audit[at], row["role"], row["text"])
                at += 1
        yield frame()
    close()
    yield frame()


def _replay(rows: DataFrame, spine: DataFrame | None, block_letters: int) -> DataFrame:
    keyed = _keyed(rows)
    letters = _letters(keyed)
    blocks = solved_blocks(signature_blocks(letters, block_letters))
    span = letters.groupBy("conv", "turn").agg(F.lit(1).alias("_")).groupBy("conv").agg(F.max("turn").alias("b"), F.min("turn").alias("a"), F.count("turn").alias("n"))
    width = F.col("b").cast("decimal(20,0)") - F.col("a").cast("decimal(20,0)") + 1 - F.col("n")
    heads = (rows if spine is None else spine).select(_conv().alias("conv"), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = heads.join(span.select("conv", width.try_cast("long").alias("gaps")), "conv", "left").select("conv", F.lit(0).alias("kind"), "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"))
    texts = keyed.select("conv", F.lit(2).alias("kind"), "turn", "digest", "role", "text")
    stream = heads.unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    tasks = pieces_of(text_bytes(rows)[1], REPLAY_TASK_BYTES)
    order = ["conv", "kind", "part", "seq", F.col("turn").asc_nulls_first(), "digest"]
    return stream.repartition(tasks, "conv").sortWithinPartitions(*order).mapInArrow(_replayed, _OUT)


def repair(rows: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Repaired turns of every conversation: conv_id, ord, edit, role, text.

    edit is K (kept), R (another role) or I (inserted, with an empty text).
    """
    return _replay(rows, None, block_letters).where("ord > 0").select("conv_id", "ord", "edit", "role", "text")


def _digested(batches):
    import pyarrow as pa

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [*[pa.int64()] * 7, pa.string(), pa.string()]
    head, sha, some = None, None, False
    out: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["ord"] == 0:
                if head is not None:
                    out.append((*head, sha.hexdigest()))
                head, sha, some = [row[n] for n in names[:-1]], hashlib.sha256(), False
            else:
                sha.update(("\n" * some + f"{row['role']}:{row['text']}").encode("utf-8", "surrogatepass"))
                some = True
        cols = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        out = []
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*head, sha.hexdigest()), types)], names=names)


def audit_conversations(rows: DataFrame, damage: bool = False, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns, a row for each conv_id.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. With damage=True the rows are damaged first. Null roles and
    texts are one space; a null conv_id is a conversation of its own; null turns
    come first and don't count as gaps; gaps beyond a long are 0. Rows of one turn are in the
    order of a digest of role and text, so rows repeated in full are adjacent.
    A conversation without rows after damage has zeros, an empty audit and the
    hash of nothing. An empty table gives no rows; other columns are ignored.
    A conversation's rows are put in order by ranges, in which it may span
    tasks; its replay is one task's, as one digest covers all of its texts, but
    texts stream through it and only the audit, a letter a row, is held.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    return _replay(damaged(rows) if damage else rows, rows, block_letters).mapInArrow(_digested, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
