import hashlib
import random
import re
import time

from isospan.llm.pii import find_personal_data, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def tricky():
    rng = random.Random(7)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "a@b.c", "%x@y.z", "@", ".", "1.2.3.4", "256.1.1.1", "0001.02.3.255.7.8.9.1", "+1 (743) 555-3824", "+49", "-", " ", "12", "é", "é𝄞 ", "a.b-c@d-e.f.g_h@i.jk", "+1.2.3.4.5.6.7.8", "x", "5500000000000004", "6011000990139424 1"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(600)]


def check(df):
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        want, g = brute(r.text), got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.text, want, g.spans)
        assert set(filter(None, want.split(","))) <= set(g.spans.split(","))
        assert g.n_card == want.count("card:") and g.n_email == want.count("email:")


def test_base_spans_equal_the_plain_patterns(documents, odd_texts):
    check(documents(odd_texts + tricky()))


def test_on_sample(sample):
    check(sample)


def test_added_kinds_and_context(documents):
    df = documents(["pay to DE89 3704 0044 0532 0130 00 today", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "part 123-45-6789"])
    got = [r.spans for r in find_personal_data(df).orderBy("doc_id").collect()]
    assert "iban:7:34" in got[0] and "iban" not in got[1]
    assert got[2] == "ssn:4:15" and got[3] == ""


def test_redact(documents):
    df = documents(["mail é a@b.cd now", None, "plain"])
    assert [r.text for r in redact(df).orderBy("doc_id").collect()] == ["mail é <EMAIL> now", None, "plain"]


def test_redact_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "é a@b.cd", "t", "s", "c", 5, 6)], "doc_id long, text string, _t string, _spans string, `a.b` string, spans int, row int")
    assert [tuple(r) for r in redact(df).collect()] == [(1, "é <EMAIL>", "t", "s", "c", 5, 6)] and redact(df).columns == df.columns


def test_redact_equals_plain_version(documents):
    texts = tricky() + [("é" * 900 + " a@b.cd " + "𝄞" * 1500 + "1.2.3.4 ") * 3]
    df = documents(texts)
    spans = {r.doc_id: r.spans for r in find_personal_data(df).collect()}
    for r in redact(df).collect():
        out, at, text = "", 0, texts[r.doc_id]
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[r.doc_id].split(",") if s)):
            if start >= at:
                out += text[at:start] + f"<{kind.upper()}>"
            at = max(at, end)
        assert r.text == out + text[at:], (text, spans[r.doc_id])


def test_many_matches_in_one_text_take_linear_time(documents):
    texts = ["".join(f"u{i}@h{i}.org " for i in range(32_000)), "".join(f"{i % 256}.2.3.4 +1 234 567 {i % 9000 + 1000}, " for i in range(16_000))]
    took = []
    for n in (8, 1):
        df = documents([t[: len(t) // n] for t in texts])
        find_personal_data(df).count()
        began = time.time()
        check(df)
        redact(df).collect()
        took.append(time.time() - began)
    assert took[1] < 16 * took[0] and took[1] < 60  # a quadratic fold took 100 s for the first text alone


def test_context_reaches_over_neighbouring_matches(documents):
    texts = ["ssn 123-45-6789 123-45-6780", "ssn " + "x" * 37 + "123-45-6789", "ssn " + "x" * 36 + " 123-45-6789", "123-45-6789 or ssn", "mail " + "a@b.c " * 9]
    rows = find_personal_data(documents(texts)).orderBy("doc_id").collect()
    assert [r.spans for r in rows[:4]] == ["ssn:4:15,ssn:16:27", "", "", "ssn:0:11"]
    assert rows[4].scores.split(",") == ["1.00"] * 6 + ["0.80"] * 3


def test_empty_table(documents):
    assert find_personal_data(documents([])).count() == 0


def test_words_after_an_iban(documents):
    texts = ["GB82WEST12345698765432 BIC", "DE89370400440532013000 EUR 50", "DE89 3704 0044 0532 0130 00 2024", "DE89370400440532013000EUR", "NO93 8601 1117 947 NOK"]
    got = [r.spans for r in find_personal_data(documents(texts)).orderBy("doc_id").collect()]
    assert [[s for s in g.split(",") if s.startswith("iban")] for g in got] == [["iban:0:22"], ["iban:0:22"], ["iban:0:27"], [], ["iban:0:18"]]
