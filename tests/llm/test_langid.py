import zlib

import numpy as np
from polyagg.llm.langid import STRIDE, WINDOW, ByteCNN, predict_languages, train, windows
from pyspark.sql import functions as F

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_windows_cover_whole_texts():
    texts = [bytes(range(1, 256)) * n for n in (1, 2, 9)] + [b"", b"x", b"y" * WINDOW, b"z" * (WINDOW + 1)]
    x, owner, used = windows(texts)
    for i, t in enumerate(texts):
        own = x[:, owner == i]
        back = own[:, 0][: used[owner == i][0]].tobytes() + b"".join(own[WINDOW - STRIDE :, k][: u - (WINDOW - STRIDE)].tobytes() for k, u in list(enumerate(used[owner == i]))[1:])
        assert back == t
        assert (own[:, -1][used[owner == i][-1] :] == 0).all()


def test_tables_equal_the_network():
    rng = np.random.default_rng(0)
    net = ByteCNN(["a", "b", "c"]).tables()
    x = rng.integers(0, 256, (WINDOW, 300), dtype=np.uint8)
    pooled, _ = net._pooled(x)
    z = np.maximum(pooled, 0) @ net.weights["out"] + net.weights["bias"]
    assert np.allclose(net.probabilities(x), net._softmax(z), atol=1e-5)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = ByteCNN(["a", "b", "c"], filters=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, weight = rng.integers(97, 103, (20, 12), dtype=np.uint8), rng.integers(0, 3, 12), rng.random(12)

    def loss():
        p = net._softmax(np.maximum(net._pooled(x)[0], 0) @ net.weights["out"] + net.weights["bias"])
        return -(weight * np.log(p[np.arange(12), y])).mean()

    for name, g in net.gradients(x, y, weight).items():
        w = net.weights[name]
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(5)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old = w[at]
            up, down = (w.__setitem__(at, old + d) or loss() for d in (1e-6, -1e-6))
            w[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5, (name, at)


def test_long_texts_by_parts():
    rng = np.random.default_rng(2)
    net = ByteCNN(["a", "b", "c"]).tables()
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (1, 255, 256, 257, 999 * STRIDE + WINDOW, 1000 * STRIDE + 3, 3_000_000)]
    best, score = net.predict(texts)
    for t, b, s in zip(texts, best, score, strict=True):
        x, _, used = windows([t])
        p = (net.probabilities(x) * used[:, None]).sum(0) / used.sum()
        assert p.argmax() == b and abs(p[b] - s) < 1e-6


def test_rare_languages_are_learned(spark):
    words = {f"l{i:03}": f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(120)}
    rows = [(i * 3, f"{w} {w}{w} {w}", k) for k, w in words.items() for i in range(2)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == sorted(words)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    out = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang == r.lang_pred for r in held) / len(held)
    assert right > 0.95, right


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    assert predict_languages(spark.createDataFrame([], schema)).collect() == []
    rows = [(0, None, "en", "?"), (2, "", "en", "?"), (3, "12 34 !!", "en", "?"), (4, "abc abc", None, "?"), (4, "abc abc", None, "?"), (None, "a" * 99_999, None, None)]
    out = predict_languages(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 6 and {r.lang_pred for r in out} == {"und"} and {r.score for r in out} == {0.0}
    rows += [(i, "the cat sat" if i % 2 else "der Hund lief", "en" if i % 2 else "de", None) for i in range(10, 40)]
    out = predict_languages(spark.createDataFrame(rows, schema)).collect()
    assert {r.lang_pred for r in out if r.doc_id in (0, 2, 3)} == {"und"}
    assert {r.lang_pred for r in out if r.doc_id in (4, None)} <= {"en", "de"}
