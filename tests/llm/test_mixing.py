from isospan.llm.mixing import mix, mixed_documents, share_out


def test_share_out_caps_and_reshares():
    got = share_out([100, 10, 1000], [5.0, 2.0, 1.0])
    assert got[0] == 300 and got[1] == 30 and abs(sum(got) - 1110) < 1e-9
    assert share_out([0, 0], [1.0, 1.0]) == [0, 0] and share_out([], []) == []


def test_budgets_met(documents, sample, odd_texts):
    for df in (documents(odd_texts), sample):
        rows = mix(df).collect()
        assert len(rows) == df.count()
        by = {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            by.setdefault(r.source, []).append(r)
        for own in by.values():
            size = sum(r.size for r in own)
            assert all(r.source_size == size for r in own)
            assert abs(sum(r.taken for r in own) - min(int(own[0].target), 3 * size)) <= 2
        assert abs(sum(own[0].target for own in by.values()) - sum(r.size for r in rows)) < 1e-6
        again = mix(df).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))


def test_documents_carry_what_is_taken(sample):
    taken = {r.doc_id: r for r in mix(sample).collect()}
    got = {}
    out = mixed_documents(sample)
    assert out.columns == sample.columns
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").split())
    assert all(got.get(k, 0) == r.taken for k, r in taken.items())


def test_nulls(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a b", None), (1, "a b", None), (2, "c", "s")], "doc_id long, text string, source string")
    rows = mix(df).collect()
    assert len(rows) == 4 and all(r.taken <= 3 * r.size for r in rows)
    assert mix(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0
    assert mixed_documents(df).where("text is null").count() == 1
