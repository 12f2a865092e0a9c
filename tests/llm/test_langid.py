import zlib

import numpy as np

from isospan.llm import langid


def test_held_out_accuracy_and_contract(sample):
    got = langid.identify(sample).collect()
    rows = {r.doc_id: r for r in sample.collect()}
    assert len(got) == len(rows)
    fold = [r for r in got if r.held_out]
    assert {r.doc_id for r in fold} == {d for d in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    right = sum(r.lang_pred == rows[r.doc_id].lang for r in fold)
    assert right >= 0.9 * len(fold)
    assert all(0 <= r.score <= 1 for r in got)


def test_und_and_nulls(spark, sample):
    odd = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "12 -- ١", "en"), (2, "12 -- ١", "en"), (3, "x" * 300000, None)], "doc_id long, text string, lang string")
    net = langid.train(sample)
    got = langid.identify(odd, net).collect()
    assert len(got) == 5
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id != 3)
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.where("doc_id is null")).collect()} == {"und"}


def test_same_text_same_answer_in_any_batch(sample):
    net = langid.train(sample)
    texts = [r.text for r in sample.limit(20).collect()]
    alone = [langid.predict_texts(net, [t])[0] for t in texts]
    together = langid.predict_texts(net, texts)
    assert [a[0] for a in alone] == [b[0] for b in together]
    assert all(abs(a[1] - b[1]) < 1e-4 for a, b in zip(alone, together))


def test_recognised_keeps_columns_and_texts(sample):
    kept = langid.recognised(sample)
    assert kept.columns == sample.columns and kept.count() >= 0.98 * sample.count()


def test_planted_noise_goes(spark):
    import random

    from isospan.llm.langid import recognised

    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    clean = docs.where("text rlike '[A-Za-z]'").count()
    size = [60, 300, 3000]
    noise = []
    for i in range(120):
        n = size[i % 3]
        kind = [
            lambda: "".join(rng.choice("qwertyuiopasdfghjklzxcvbnm ") for _ in range(n)),
            lambda: "".join(chr(rng.randint(33, 126)) for _ in range(n)),
            lambda: " ".join("%032x" % rng.getrandbits(128) for _ in range(n // 33 + 1)),
            lambda: "".join(chr(rng.randint(0x391, 0x44F)) for _ in range(n)),
        ][i // 3 % 4]
        noise.append((10**6 + i, kind(), "en" if i % 40 == 0 else None))
    got = [r.doc_id for r in recognised(docs.union(spark.createDataFrame(noise, docs.schema))).select("doc_id").collect()]
    assert sum(i < 10**6 for i in got) >= 0.998 * clean
    assert sum(i >= 10**6 for i in got) <= 2


def test_recognised_without_labels_keeps_all_texts_with_letters(spark):
    rows = [(1, "plain words", None, 1), (1, "plain words", None, 1), (None, "other", None, 2), (3, "123 -", None, 3), (4, None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")
    got = langid.recognised(docs)
    assert got.columns == docs.columns and sorted(r[1] for r in got.collect()) == ["other", "plain words", "plain words"]
    labelled = docs.union(spark.createDataFrame([(9, "labelled words in plain english text", "en", 5)], docs.schema))
    assert langid.recognised(labelled).columns == docs.columns


def test_every_language_is_learned(spark):
    rows = [(i, f"text of language {i % 1200} " + chr(0x4E00 + i % 1200) * 9, f"l{i % 1200}") for i in range(3600)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert net.languages == sorted(held) and len(held) > 1000


def net_and_windows(n=3):
    rng = np.random.default_rng(5)
    net = langid.ByteConvNet.fresh(["a", "b", "c"], seed=7)
    for w in langid.WIDTHS:
        net.bias[w] += rng.normal(0, 0.2, langid.FILTERS).astype(np.float32)
    return net, rng.integers(0, 256, (n, langid.WINDOW)).astype(np.uint8)


def plain_logp(net, window):
    """Embedding, convolution, rectifier, max pooling and softmax of one window, position by position."""
    pooled = []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            best = 0.0
            for at in range(len(window) - w + 1):
                z = float(net.bias[w][f])
                for j in range(w):
                    z += float(net.embed[window[at + j]] @ net.kernels[w][j * langid.EMBED : (j + 1) * langid.EMBED, f])
                best = max(best, z)
            pooled.append(best)
    logits = np.array(pooled) @ net.dense + net.dense_bias
    return logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()


def test_table_lookup_equals_plain_convolution():
    net, x = net_and_windows()
    got = net.predict(x, net.tables())
    assert np.abs(got - [plain_logp(net, window) for window in x]).max() < 1e-4


def test_gradient_equals_finite_differences():
    net, x = net_and_windows(4)
    for p in net._parameters():
        p[...] = p.astype(np.float32)
    net.embed, net.dense, net.dense_bias = (a.astype(np.float64) for a in (net.embed, net.dense, net.dense_bias))
    net.kernels, net.bias = ({w: a.astype(np.float64) for w, a in d.items()} for d in (net.kernels, net.bias))
    y = np.array([0, 1, 2, 1])

    def loss():
        return -net.predict(x, net.tables())[np.arange(len(x)), y].mean()

    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net._parameters()]
    net.step(x, y, state, 0.0, 1)  # with rate 0 only the gradient is taken: a tenth of it is in the state
    rng = np.random.default_rng(1)
    for p, (m, _) in zip(net._parameters(), state):
        places = [np.unravel_index(i, p.shape) for i in rng.choice(p.size, 6)] + [np.unravel_index(np.abs(m).argmax(), p.shape)]
        for at in places:
            held, h = p[at], 1e-5
            p[at] = held + h
            up = loss()
            p[at] = held - h
            down = loss()
            p[at] = held
            assert abs((up - down) / (2 * h) - 10 * m[at]) < 1e-5 + 1e-3 * abs(10 * m[at])
