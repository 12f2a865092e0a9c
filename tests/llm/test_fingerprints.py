import hashlib

from pyspark.sql import functions as F

from isospan.llm import fingerprints as fp


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def like(a, b):
    a, b = grams(a), grams(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check(df, buckets):
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fp.fingerprint_edits(df, buckets).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, r in enumerate(rows):
        text, nxt = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + nxt[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(text)
        assert g.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert abs(g.near_edited - like(text, edit)) < 0.12
        assert abs(g.near_next - like(text, nxt)) < 0.12
        assert abs(g.n_shingles - len(grams(text))) <= 0.25 * len(grams(text))
        assert prints.setdefault(text, g.fingerprint) == g.fingerprint


def test_edits_over_buckets(documents, odd_texts):
    text = "the words of this document go on for a while and then stop at the end of it "
    df = documents(odd_texts + [text * 3, text * 3 + "tail", "short one"])
    for buckets in (1, 3, 50):
        check(df, buckets)


def test_on_sample(sample):
    check(sample, 8)


def test_merge_and_containment(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(2000))
    c = " ".join(f"w{i}" for i in range(1996, 4000))
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
    for name in "abc":
        df = fp.sketch_text(df, name, f"s{name}")
    r = df.select(
        (fp.merge(F.col("sb"), F.col("sc")) == F.col("sa")).alias("same"),
        fp.containment(F.col("sb"), F.col("sa")).alias("inside"),
        fp.resemblance(F.col("sb"), F.col("sa")).alias("near"),
        fp.distinct_shingles(F.col("sa")).alias("n"),
    ).first()
    assert r.same and abs(r.inside - 1) < 0.1 and abs(r.near - 0.5) < 0.1 and abs(r.n - 3996) < 600


def test_degenerate_tables(spark, documents):
    assert fp.fingerprint_edits(documents([]), 4).count() == 0
    one = fp.fingerprint_edits(documents(["a b c d e f"]), 4).first()
    assert one.near_next == 1.0
    df = spark.createDataFrame([(None, "x y"), (None, None), (5, "z"), (5, "z")], "doc_id long, text string")
    assert fp.fingerprint_edits(df, 4).count() == 4


def test_no_python_in_plan(sample):
    plan = fp.fingerprint_edits(sample, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
