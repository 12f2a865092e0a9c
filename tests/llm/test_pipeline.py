import corpus_pipeline


def test_stages_chain(spark, sample, sf):
    docs, sizes = sample, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == sample.columns and out.dtypes == sample.dtypes, name
        rows = out.collect()
        sizes.append((len(docs.collect()), len(rows)))
        docs = spark.createDataFrame(rows, sample.schema)
    assert sizes[0][1] >= 0.98 * sizes[0][0] and sizes[1][0] == sizes[1][1] and sizes[2][1] < sizes[2][0]
    packed = corpus_pipeline.packing(spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, part int, score string, fp long, u string, size string"


def test_stages_on_odd_tables(spark, sf, odd_texts):
    long = "words that make up a document of some length, all told in plain lines\n" * 40
    texts = [*odd_texts, long, long, long + "more", long.upper(), None]
    rows = [(None if i % 5 == 4 else i // 2, t, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], len(t or ""), "t", None if i % 2 else 1, "s", i, None, "z") for i, t in enumerate(texts)]
    for data in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(data, SCHEMA)
            out = stage(spark, docs, sf)
            n = out.count()
            if name == "packing":
                assert n >= len(data)
            else:
                assert out.dtypes == docs.dtypes, name
                assert n == len(data) if name == "line_dedup" else (n <= len(data) or name == "mixing"), name


def test_clean_documents_pass_the_filters(spark, sample, sf):
    assert corpus_pipeline.language_id(spark, sample, sf).count() >= sample.where("text rlike '[A-Za-z]'").count() - 1
