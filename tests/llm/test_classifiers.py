"""Quality classifier and language ID: held-out accuracy, plain versions, odd input."""
import itertools
import zlib

import numpy as np
import pytest

from churnlens.llm import language_id as lid
from churnlens.llm import quality_classifier as qc

from samples import ODD

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_on_the_held_out_fold(spark):
    out = {r.doc_id: r for r in qc.op4_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in out.items())
    fold = [d for d in labels if held_out(d)]
    assert sum(out[d].predicted == labels[d] for d in fold) / len(fold) > 0.95


def test_labels_of_the_held_out_fold_do_not_matter(spark, docs, prose):
    d = docs([(i, prose(40, seed=i) if i % 2 else "SHOUT!! " * 40) for i in range(80)])
    label = lambda i: (i, i % 2, 0)
    a = spark.createDataFrame([label(i) for i in range(80)], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([label(i) if not held_out(i) else (i, 1 - i % 2, 1) for i in range(80)], "doc_id long, quality int, toxic int")
    assert np.array_equal(qc.train(d, a), qc.train(d, b))


def test_quality_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 0), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    out = qc.quality_scores(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0.5 and r.predicted == 0 for r in qc.quality_scores(odd, labels.where("false")).collect())
    assert qc.quality_scores(empty, labels).count() == 0


def test_ftrl_follows_the_plain_rule():
    rnd = np.random.default_rng(0)
    rows = [(rnd.integers(0, 50, 12), 12 ** -0.5, int(rnd.integers(0, 2))) for _ in range(40)]
    size = (1 << qc.BITS) + 1
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        return 0.0 if abs(z[i]) <= qc.L1 else -(z[i] - np.sign(z[i]) * qc.L1) / ((qc.BETA + n[i] ** 0.5) / qc.ALPHA + qc.L2)
    for _ in range(2):
        for cols, value, y in rows:
            x = {int(c): list(cols).count(c) * value for c in cols} | {size - 1: 1.0}
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g, w = (p - y) * v, weight(i)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / qc.ALPHA * w
                n[i] += g * g
    got = qc.ftrl(rows, epochs=2)
    assert got[:50] == pytest.approx([weight(i) for i in range(50)], abs=1e-5)


def test_language_on_the_held_out_fold(spark):
    out = lid.op10_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    fold = [r for r in out if r.held_out]
    assert all(r.held_out == held_out(r.doc_id) for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in fold) / len(fold) > 0.97


def test_viterbi_equals_all_paths():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        langs, lengths = int(rnd.integers(1, 4)), rnd.integers(1, 8, int(rnd.integers(1, 5)))
        scores = rnd.normal(size=(int(lengths.sum()), langs)) * 3
        got, at = lid.viterbi(scores, lengths, 1.5), 0
        for n in lengths.tolist():
            part = scores[at:at + n]

            def value(path):
                return sum(part[i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
            best = max(itertools.product(range(langs), repeat=n), key=value)
            assert value(got[at:at + n]) == pytest.approx(value(best))
            at += n


def test_words_and_sums():
    raw = "Één word-pair, 12 ß!".encode()
    w = lid.Words(raw)
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end)] == ["Één", "word", "pair", "ß"]
    table = np.random.default_rng(1).normal(size=1 << lid.BITS).astype(np.float32)
    plain = [sum(float(table[w.gram[i]]) for i in range(a, b)) for a, b in zip(w.start, w.end)]
    assert w.sums(table).tolist() == pytest.approx(plain, abs=1e-4)
    assert np.array_equal(lid.Words("ÉÀ AB".encode()).gram, lid.Words("éà ab".encode()).gram)


def test_mixed_text_falls_into_spans(spark):
    model = lid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 600 and 900 and text not like '%!!%'")
             .orderBy("doc_id").collect()}
    text = texts["en"] + "\n" + texts["de"]
    lang, score, spans = lid.label_texts([text.encode()], model)[0]
    found = [(s["lang"], s["end"] - s["start"]) for s in spans if s["end"] - s["start"] > 150]
    assert [x for x, _ in found] == ["en", "de"] and 0.3 < score < 0.8
    edge = next(s["start"] for s in spans if s["lang"] == "de")
    assert abs(edge - len(texts["en"])) < 80


def test_script_ranges_narrow_the_languages(docs):
    rows = [(i, "это простой русский текст для примера", "ru") for i in range(20)] + [(100 + i, "a simple english text as example", "en") for i in range(20)]
    model = lid.learn(docs(rows))
    out = lid.label_texts(["слова, которых не было".encode(), b"words never seen before", "漢字だけ".encode()], model)
    assert [x[0] for x in out][:2] == ["ru", "en"] and out[2][0] in ("ru", "en")


def test_a_rare_language_is_learned(docs, monkeypatch):
    monkeypatch.setattr(lid, "SAMPLE", 10)
    rows = [(i, f"a simple english text as example {i}", "en") for i in range(600)]
    rows += [(1000 + i, "это простой русский текст для примера", "ru") for i in range(4)]
    got = {r.row.doc_id: r.lang_pred for r in lid.identify(docs(rows)).collect()}
    assert {got[1000 + i] for i in range(4)} == {"ru"} and {got[i] for i in range(600)} == {"en"}


def test_language_odd_and_empty(odd, empty):
    out = {(r.row.doc_id, r.row.text): r for r in lid.identify(odd).collect()}
    assert all(r.lang_pred == ("en" if t and any(c.isalpha() for c in t) else "und") for (_, t), r in out.items())
    assert all(r.score == 0 and r.spans == [] for r in out.values() if r.lang_pred == "und")
    assert lid.identify(empty).count() == 0
    none = lid.identify(odd.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
