import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapcat.llm import langid, queries

SYLLABLES = {"en": "the ing tion and ou wh er".split(), "de": "sch ung ein ver ß ü keit".split(), "fr": "eau le é que ment ç ai".split()}


def sentence(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n)).capitalize()


def corpus(n=400):
    rng = np.random.default_rng(0)
    return [(i, sentence(rng, lang, int(rng.integers(3, 60))), lang, f"src{i % 3}") for i, lang in enumerate(rng.choice(list(SYLLABLES), n).tolist())]


@pytest.fixture(scope="module")
def model():
    rows = corpus()
    return langid.fit([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy_and_calibration(spark, tmp_path, docs):
    rows = [*corpus(600), (9000, None, None, None), (9001, "123 %%", "en", None), (9002, sentence(np.random.default_rng(4), "de") * 400, None, "x")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op4_language_id(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows if r[0] < 9000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(out[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    right = [out[r[0]].lang_pred == r[2] for r in held]
    assert len(held) > 100 and np.mean(right) > 0.97
    assert abs(np.mean([out[r[0]].score for r in held]) - np.mean(right)) < 0.05
    assert [(out[k].lang_pred, out[k].score) for k in (9000, 9001)] == [("und", 0.0)] * 2
    assert out[9002].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())


def brute_features(text):
    """Feature numbers of one text in plain Python: n-grams of folded characters, hashed."""
    low = lambda c: c.lower() if len(c.lower()) == 1 and ord(c) < 1 << 16 else c
    points = [0, *[ord(low(c)) if c.isalpha() else 0 for c in text], 0]
    m32, out = (1 << 32) - 1, []
    for order in (1, 2, 3):
        for at in range(len(points) - 1):
            h = 0
            for p in (points + [0, 0])[at : at + order]:
                h = (h * 0x01000193 + (p + 1) * 0x9E3779B1) & m32
            h = ((h ^ h >> 15) * 0x85EBCA6B) & m32
            out.append((h ^ h >> 13) & ((1 << langid.BITS) - 1))
    return out


def brute_predict(model, text):
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    f = brute_features(text)
    z = [(sum(float(model.table[k][x]) for x in f) / len(f) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
    e = [math.exp(x - max(z)) for x in z]
    k = max(range(len(z)), key=lambda i: e[i])
    return model.languages[k], e[k] / sum(e)


def test_predictions_match_brute_force(model):
    rng = np.random.default_rng(7)
    texts = [*[sentence(rng, lang, int(rng.integers(1, 12))) for lang in SYLLABLES for _ in range(8)], "", "12 %", "Ünïted É 日本 ß", "a", "𝔘x\0y", "İstanbul"]
    for text, got in zip(texts, model.predict(texts), strict=True):
        lang, score = brute_predict(model, text)
        assert got[0] == lang and got[1] == pytest.approx(score, abs=1e-5)


def test_document_frequencies_match_brute_force(docs):
    rng = np.random.default_rng(8)
    texts = [sentence(rng, "de", int(rng.integers(1, 9))) for _ in range(40)] + [None, "", "x"]
    n, df = langid.document_frequencies(docs(texts), "text")
    expected = np.zeros(1 << langid.BITS)
    for t in texts:
        if t is not None:
            for f in set(brute_features(t)):
                expected[f] += 1
    assert n == 42 and (df == expected).all()


def test_rare_languages_and_long_documents_are_learned(docs):
    """A language of 1 in 300 documents, and one that stands in long documents only; ids that are null or repeated."""
    rng = np.random.default_rng(9)
    rows = [(7 if i % 3 else None, sentence(rng, "en"), "en", "s") for i in range(1500)]
    rows += [(4 * i, sentence(rng, "fr"), "fr", "s") for i in range(20)] + [(2000 + i, sentence(rng, "de", 4000), "de", "s") for i in range(8)]
    model = langid.train_langid(docs(rows), docs_per_language=100)
    assert set(model.languages) == {"en", "fr", "de"}
    again = langid.train_langid(docs(rows[::-1]), docs_per_language=100)
    assert (model.table == again.table).all()


def test_weights_are_sparse(model):
    assert 0 < (model.table != 0).mean() < 0.1
    assert model.temperature > 0


def test_prediction_depends_on_the_text_alone(model):
    texts = ["", "a", sentence(np.random.default_rng(1), "fr"), "日本語", "\0the\0", "𝔘𝔫𝔦"]
    alone = [model.predict([t])[0] for t in texts]
    for a, b in zip(alone, model.predict(texts), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-12)
    assert alone[0] == ("und", 0.0) and alone[2][0] == "fr"


def test_edge_cases(spark, docs, model):
    df = docs([None, "", "the thing", "the thing"]).withColumn("score", F.lit("clash")).withColumn("h", F.lit(1))
    out = langid.predict_languages(df, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out[:2]] == ["und", "und"] and out[2].score == out[3].score and {r.h for r in out} == {1}
    assert langid.predict_languages(df.limit(0), model).count() == 0
    none = langid.train_langid(docs([(1, "text", None, None)]))
    assert none.languages == [] and langid.predict_languages(df, none).filter("lang_pred <> 'und'").count() == 0
    assert langid.train_langid(df.limit(0).drop("score")).languages == []


def test_keep(spark, docs, model):
    rows = [*corpus(30), (100, None, None, None), (101, "1234", None, None)]
    kept = langid.keep_languages(docs(rows), model)
    assert kept.columns == docs(rows).columns
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in rows[:30]} - {1} and kept.filter("doc_id >= 100").count() == 0
