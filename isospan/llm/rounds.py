"""Question-and-answer rounds between text groups and key buckets.

Both operators that look for repeated passages work alike. Documents are dealt
once, by hash, into groups of some megabytes. A group lists keys or pieces of
its texts, deduplicated, in a fixed order, and sends them packed by bucket; a
bucket, which sees all groups, answers each packet in its own order. So an
answer needs no key, only its place, and the texts are shuffled once: every
round reads the same exchange again. Tasks are as many as the bytes ask for, so
that none grows with the table. A group sends as many packets as it has keys at
most, however many buckets there are.

Deterministic on both sides: a lost executor's packets and answers come out the
same when they are made again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

GROUP_BYTES = 1_500_000
TASK_BYTES = 16_000_000  # of text in a task, by whose number all rounds are dealt
MOST_TASKS = 100_000  # beyond these tasks take more, a group at a time all the same
NOTE = -1
NO_ID = 2**63 - 1  # stands for a null id, which ranks after every other


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(docs: DataFrame, total_bytes: int, id_col: str, text_col: str, more: tuple = ()) -> DataFrame:
    """docs as (doc_group, doc_id, text, row_hash, ...): groups of even size by hash."""
    n = pieces_of(total_bytes, GROUP_BYTES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.cast("binary").alias("text"), *more)
    key = F.xxhash64("doc_id", "text")
    out = rows.select(F.pmod(key, F.lit(n)).cast("int").alias("doc_group"), "doc_id", "text", *[c for c in rows.columns if c not in ("doc_id", "text")])
    return _dealt(out, "doc_group", _tasks(docs.sparkSession, total_bytes))


def _tasks(spark, total_bytes: int) -> int:
    return min(MOST_TASKS, pieces_of(total_bytes, TASK_BYTES, spark.sparkContext.defaultParallelism))


def _dealt(df: DataFrame, number: str, tasks: int) -> DataFrame:
    """df dealt over tasks in turn by a number; by its hash some would get several times their share."""
    return df.withColumn("_slot", F.pmod(number, F.lit(tasks))).repartitionById(tasks, F.col("_slot"))


def ordered(pdf):
    """A group's rows in an order that does not depend on how they arrived."""
    return pdf.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)


def ids_of(pdf) -> np.ndarray:
    return pdf["doc_id"].to_numpy(np.int64)


def ask(groups: DataFrame, question: Callable, answer: Callable, buckets: int, total_bytes: int, told: DataFrame | None = None) -> DataFrame:
    """One round; returns (doc_group, answers), an array of (bucket, blob) per group.

    question(pdf, told) yields (bucket, blob); answer([(doc_group, blob)])
    yields (doc_group, blob). told: an earlier round's answers for the group.
    Buckets from `buckets` on only echo: what a group sends there with NOTE is
    at hand again in the next round.
    """
    def put(pdf, earlier=None):
        group = int(pdf["doc_group"].iloc[0])
        rows = [(buckets + group % buckets if b == NOTE else b, group, blob) for b, blob in question(ordered(pdf), earlier)]
        return _frame(rows, "bucket", "doc_group")

    schema = "bucket int, doc_group int, blob binary"
    packets = groups.groupBy("_slot", "doc_group").applyInPandas(lambda pdf: put(pdf), schema) if told is None else beside(groups, told, put, schema, total_bytes)
    tasks = min(buckets, MOST_TASKS)

    def reply(pdf):
        pdf = pdf.sort_values("doc_group")
        bucket, sent = int(pdf["bucket"].iloc[0]), list(zip(pdf["doc_group"].tolist(), pdf["blob"].tolist()))
        if bucket >= buckets:
            return _frame([(group, NOTE, blob) for group, blob in sent], "doc_group", "bucket")
        return _frame([(group, bucket, blob) for group, blob in answer(sent)], "doc_group", "bucket")

    return _dealt(packets, "bucket", tasks).groupBy("_slot", "bucket").applyInPandas(reply, "doc_group int, bucket int, blob binary")


def _frame(rows: list[tuple], first: str, second: str):
    import pandas as pd

    return pd.DataFrame({first: np.array([r[0] for r in rows], np.int32), second: np.array([r[1] for r in rows], np.int32), "blob": [r[2] for r in rows]})


def tell(groups: DataFrame, told: DataFrame, use: Callable, schema: str, total_bytes: int) -> DataFrame:
    """use(pdf, answers) for each group with its answers {bucket: blob}."""
    out = beside(groups, told, lambda pdf, earlier: use(ordered(pdf), earlier), schema, total_bytes)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def beside(groups: DataFrame, told: DataFrame, use: Callable, schema: str, total_bytes: int) -> DataFrame:
    def both(left, right):
        import pandas as pd

        if not len(left):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})  # no such group
        return use(left, dict(zip(right["bucket"].tolist(), right["blob"].tolist())))

    told = _dealt(told, "doc_group", _tasks(groups.sparkSession, total_bytes))
    return groups.groupBy("_slot", "doc_group").cogroup(told.groupBy("_slot", "doc_group")).applyInPandas(both, schema)


def shared_tags(packets: list[tuple[int, bytes]], hot: int) -> list[tuple[int, bytes]]:
    """Answers to packets of sorted, unique 32-bit tags (top bit: twice in its group).

    Per tag: 0 nowhere else, 1 repeated, 2 repeated in more than `hot` groups.
    """
    tags = [np.frombuffer(blob, "<u4") for _, blob in packets]
    every = np.concatenate(tags)
    low = every & np.uint32(0x7FFFFFFF)
    values, where, counts = np.unique(low, return_inverse=True, return_counts=True)
    twice = np.zeros(len(values), bool)
    twice[where[every != low]] = True
    code = ((counts > 1) | twice).astype(np.uint8) + (counts > hot)
    out, at = [], 0
    for (group, _), own in zip(packets, tags):
        out.append((group, code[where[at : at + len(own)]].tobytes()))
        at += len(own)
    return out


def tag_packets(tags: np.ndarray, docs: np.ndarray, buckets: int):
    """Keys of a group as packets, each (bucket, sorted unique 32-bit tags).

    tags: 64-bit keys; docs: the document each is in. Returns the packets and,
    for reading the answers, (bucket, place in its packet) of every key.
    """
    mixed = mix64(tags)
    bucket = (mixed >> np.uint64(32)) % np.uint64(buckets)
    short = mixed & np.uint64(0x7FFFFFFF)
    whole = (bucket << np.uint64(31)) | short
    values, where = np.unique(whole, return_inverse=True)
    first, last = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), -1)
    np.minimum.at(first, where, docs)
    np.maximum.at(last, where, docs)
    own = (values & np.uint64(0x7FFFFFFF)).astype("<u4") | ((first != last).astype("<u4") << np.uint32(31))
    of = (values >> np.uint64(31)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    ends = np.append(cuts[1:], len(of))
    packets = [(int(of[a]), own[a:b].tobytes()) for a, b in zip(cuts, ends)]
    return packets, values, where


def tag_codes(packets, answers: dict, where: np.ndarray) -> np.ndarray:
    """Each key's code from the answers to tag_packets."""
    if not packets:
        return np.zeros(len(where), np.uint8)
    codes = np.concatenate([np.frombuffer(answers[b], np.uint8) for b, _ in packets])
    return codes[where]
