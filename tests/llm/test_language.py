import zlib

import numpy as np
from pyspark.sql import functions as F

from episcope.llm import language
from episcope.llm.queries import op9_language_id
from tests.llm.helpers import SCHEMA, documents, odd_documents, prose, rows


def test_gradients_agree_with_differences():
    p = language.Training(window=12, embedding=3, widths=(2, 3), filters=2)
    net = language.ByteConvNet(["a", "b", "c"], p)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    r = np.random.default_rng(1)
    windows, labels = r.integers(1, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    windows[0, 6:] = 0
    loss = lambda: -net.log_probabilities(windows)[np.arange(5), labels].mean()
    for name, gradient in net.gradients(windows, labels).items():
        values = net.params[name]
        for at in [tuple(r.integers(0, n) for n in values.shape) for _ in range(20)]:
            if name == "conv" and not net.mask[at] or name == "embed" and at[0] == 0:
                continue
            before = values[at]
            values[at] = before + 1e-6
            above = loss()
            values[at] = before - 1e-6
            below = loss()
            values[at] = before
            assert abs((above - below) / 2e-6 - gradient[at]) < 1e-4


def test_windows_cover_whole_texts():
    windows, owner, filled = language.cut_windows([b"abcdefgh", b"x", b"abcd"], 3)
    assert owner.tolist() == [0, 0, 0, 1, 2, 2] and filled.tolist() == [3, 3, 2, 1, 3, 1]
    assert b"".join(windows.tobytes().split(b"\0")) == b"abcdefghxabcd"


def test_held_out_accuracy_and_fields(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op9_language_id(spark, d).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(right) > 0.97


def test_learns_from_text_and_label_alone_whatever_the_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = language.Training(epochs=2)
    a = language.train_language_model(docs, p=p)
    other = docs.withColumn("doc_id", -F.col("doc_id")).withColumn("source", F.lit("x"))
    b = language.train_language_model(other.repartition(6).union(other.limit(3)), p=p)
    assert a.languages == b.languages and all((a.params[k] == b.params[k]).all() for k in a.params)


def test_a_hot_group_of_copies_takes_no_place_in_the_sample(spark, monkeypatch):
    """300 distinct texts and 3,000 copies of one: all 301 are learned, as are the 400 of a language without copies."""
    seen = []
    monkeypatch.setattr(language.ByteConvNet, "fit", lambda self, windows, labels, p: seen.append(np.bincount(labels).tolist()))
    hot = documents(spark, [prose(k, 30) for k in range(300)]).union(documents(spark, [prose(999, 30)] * 3000))
    language.train_language_model(hot.union(documents(spark, [prose(2000 + k, 30) for k in range(450)], lang="fr")))
    # A language whose texts all stand in many copies.
    language.train_language_model(documents(spark, [prose(k % 500, 30) for k in range(500 * 20)]))
    assert seen == [[301 * 4, 400 * 4], [400 * 4]]


def plain_predictions(model, texts):
    """Whole texts window by window, position by position and filter by filter."""
    embed, conv = model.params["embed"].astype(float), model.params["conv"].astype(float).reshape(model.span, model.size, -1)
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        data, total = text.encode(), np.zeros(len(model.languages))
        for lo in range(0, len(data), model.window):
            own = data[lo:lo + model.window]
            padded = own + b"\0" * (model.window - len(own) + model.span - 1)
            pooled = []
            for f in range(conv.shape[2]):
                best = max(sum(embed[padded[at + k]] @ conv[k, :, f] for k in range(model.span)) for at in range(model.window))
                pooled.append(max(best + float(model.params["conv_bias"][f]), 0.0))
            scores = np.array(pooled) @ model.params["out"].astype(float) + model.params["out_bias"].astype(float)
            total += (scores - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) * len(own)
        chances = np.exp(total / len(data))
        chances /= chances.sum()
        out.append((model.languages[int(chances.argmax())], float(chances.max())))
    return out


def test_predictions_against_plain_loops(spark):
    train = documents(spark, ["the house and the garden " * 5, "of these things"]).union(documents(spark, ["la maison et le jardin é " * 5, "ça va là"], lang="fr"))
    model = language.train_language_model(train, p=language.Training(window=32, epochs=4))
    texts = ["the house", "la maison é", "x", "the garden and things " * 4, "é " * 40 + "the", "12 ...", "", None, prose(4, 12), "日本 and"]
    langs, scores = language.classify(model, texts)
    for got, want in zip(zip(langs, scores, strict=True), plain_predictions(model, texts), strict=True):
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-3


def test_odd_rows(spark):
    train = documents(spark, ["the house and the garden " * 5] * 3).union(documents(spark, ["la maison et le jardin é " * 5] * 3, lang="fr"))
    train = train.union(documents(spark, [None, "", "unlabelled"], lang=None))
    model = language.train_language_model(train)
    assert model.languages == ["en", "fr"]
    docs = odd_documents(spark).withColumn("score", F.lit("mine"))
    out = language.predict_language(docs, model)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "lang_pred", "score"] and out.count() == docs.count()
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert [by_id[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and by_id[1]["score"] == 0
    plain = plain_predictions(model, [r["text"] for r in docs.where("doc_id is null").collect()])
    assert sorted(r["lang_pred"] for r in out.where("doc_id is null").collect()) == sorted(lang for lang, _ in plain)
    assert language.predict_language(documents(spark, ["12 34 ... ²½", "1é"]), model).orderBy("doc_id").collect()[0]["lang_pred"] == "und"
    assert language.predict_language(docs.limit(0), model).count() == 0
    # Nothing to learn from: everything is undetermined.
    assert language.train_language_model(spark.createDataFrame([], SCHEMA)) is None
    assert {r["lang_pred"] for r in language.predict_language(docs, None).collect()} == {"und"}


def test_end_of_a_long_text_counts(spark):
    train = documents(spark, ["the house and the garden " * 8, "of these things " * 9]).union(documents(spark, ["la maison et le jardin é " * 8, "à la plage " * 9], lang="fr"))
    model = language.train_language_model(train)
    half = "the house and the garden " * 40
    langs, scores = language.classify(model, [half, half + "la maison et le jardin é " * 400])
    assert langs == ["en", "fr"]
