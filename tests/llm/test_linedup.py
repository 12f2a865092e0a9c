import hashlib
import random

import xxhash

from isospan.llm.linedup import chunk_ends, deduplicated, remove_repeated_lines


def plain_ends(lines):
    """Boundaries by the stated rule, line by line."""
    own = [xxhash.xxh64_intdigest(line) for line in lines]
    rolled = [(own[i] + (own[i - 1] * 0x9E3779B97F4A7C15 if i else 0)) % 2**64 for i in range(len(own))]
    ends, held = [], 0
    for i in range(len(lines)):
        held += 1
        left = len(lines) - i - 1
        minimum = 0 < i and left > 0 and rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1]
        if left == 0 or held >= 2 and left >= 2 and (minimum or held >= 16):
            ends.append(i + 1)
            held = 0
    return ends


def plain_parts(raw):
    """(first line, lines, bytes) of the parts of several written lines that adjoin a boundary."""
    lines = raw.split(b"\n")
    ends = plain_ends(lines)
    bounds, out = [0, *ends], []
    for a in range(len(lines)):
        for b in range(a + 2, len(lines) + 1):
            inside = [x for x in bounds if a < x < b]
            beside = not inside and (a in bounds or b in bounds)
            across = b - a == 2 and inside == [a + 1]
            if (beside or across) and sum(1 for x in lines[a:b] if x.strip()) > 1:
                out.append((a, b - a, b"\n".join(lines[a:b])))
            if len(inside) > 1:
                break
    return out


def brute(rows):
    """(doc_id, lines, removed, runs, digest) with a set of what has been seen."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = set()
        for first, n, part in plain_parts(raw):
            if part in seen:
                gone |= set(range(first, first + n))
            seen.add(part)
        kept = b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in gone)
        runs = len([i for i in gone if i - 1 not in gone])
        out[d] = (raw.count(b"\n") + 1 if raw else 0, len(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in remove_repeated_lines(df, **options).collect()}
    assert got == brute(rows)
    return sum(v[1] for v in got.values())


def corpus(n=80, seed=2):
    rng = random.Random(seed)
    block = [f"shared line {i} of the notice" for i in range(24)]
    rows = []
    for d in range(n):
        own = [f"own line {d} {i} {rng.random()}" for i in range(rng.randint(0, 12))]
        at = rng.randint(0, len(own))
        rows.append((d, "\n".join(own[:at] + block * rng.randint(0, 2) + own[at:])))
    return rows


def test_brute_force(spark, odd_texts):
    rows = corpus() + list(enumerate(odd_texts, 200)) + [(300, "\n" * 50), (301, "a\n" * 500), (302, "a\r\nb\r\n" * 60)]
    assert check(spark, rows) > 100
    check(spark, rows, bucket_bytes=2000)


def test_small_groups_and_sample(spark, sample, monkeypatch):
    from isospan.llm import rounds

    monkeypatch.setattr(rounds, "GROUP_BYTES", 30_000)
    check(spark, [(r.doc_id, r.text) for r in sample.collect()])


def test_boundaries_resist_shifts():
    lines = [f"line {i}".encode() for i in range(400)]
    moved = [b"new"] + lines
    a, b = set(chunk_ends(lines)), {e - 1 for e in chunk_ends(moved)}
    assert len(a & b) > 0.9 * len(a)


def test_columns_nulls_and_repeats(spark, documents):
    block = "\n".join(f"row {i} of it" for i in range(30))
    df = documents([block, block, None, ""])
    out = deduplicated(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert rows[0].text == block and len(rows[1].text) < len(block) and rows[2].text is None and rows[3].text == ""
    assert rows[1].n_chars == len(rows[1].text) and rows[1].chunk == "clash"
    twice = spark.createDataFrame([(1, block), (1, block), (None, block)], "doc_id long, text string")
    assert sorted(r.n_removed == 0 for r in remove_repeated_lines(twice).collect()) == [False, False, True]
    assert remove_repeated_lines(documents([])).count() == 0


def recall(n, tries=400):
    """Shares of repeated passages of n lines that are hit, and of their lines that go."""
    rng = random.Random(5)

    def lines(n):
        return [str(rng.random()).encode() for _ in range(n)]

    hit = gone = 0
    for _ in range(tries):
        passage = lines(n)
        first, second = (b"\n".join(lines(rng.randint(1, 8)) + passage + lines(rng.randint(1, 8))) for _ in range(2))
        seen = {part for _, _, part in plain_parts(first)}
        removed = {i for a, m, part in plain_parts(second) if part in seen for i in range(a, a + m)}
        hit, gone = hit + bool(removed), gone + len(removed)
    return hit / tries, gone / tries / n


def test_passages_are_hit():
    hit, gone = recall(8)
    assert hit > 0.95 and gone > 0.9
    hit, gone = recall(5)
    assert hit > 0.6 and gone > 0.55


def test_a_removed_line_stays_in_an_earlier_place(spark):
    rows = corpus(60, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept.decode().split("\n") for r in remove_repeated_lines(df, with_text=True).collect()}
    left = {line for lines in kept.values() for line in lines}
    assert left >= {line for _, text in rows for line in text.split("\n")} - {""}


def test_single_lines_stay(spark, documents):
    df = documents([f"own {i}\n\nthe same line\n\nown {i} again" for i in range(40)])
    assert remove_repeated_lines(df).agg({"n_removed": "sum"}).first()[0] == 0


def test_no_line_is_left_single():
    rng = random.Random(6)
    for n in range(2, 200):
        lines = [str(rng.randint(0, 9)).encode() for _ in range(n)]
        ends = chunk_ends(lines)
        assert ends[-1] == n and all(b - a >= 2 for a, b in zip([0, *ends], ends))


def test_a_chunk_of_every_document(spark, monkeypatch):
    from isospan.llm import rounds

    monkeypatch.setattr(rounds, "GROUP_BYTES", 2_000)
    notice = "\n".join(f"notice {i}" for i in range(40))
    rows = [(d, f"own {d}\n{notice}\nlast {d}") for d in range(150)]
    assert check(spark, rows) > 149 * 20
    df = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string")  # repeated rows and ids
    assert remove_repeated_lines(df).count() == 170
