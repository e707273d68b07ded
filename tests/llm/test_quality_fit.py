import random

import numpy as np
import pyarrow as pa
import pytest

from lithofig.llm import quality_crf

#: More labelled documents than any sample of a few thousand holds.
DOCS = 4000


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinsh") for _ in range(rnd.randrange(2, 8)))
    texts, quality = [], []
    for k in range(DOCS):
        good = k % 7 != 3
        lines = [" ".join(word() if rnd.random() < (0.9 if good else 0.3) else word().upper() + "!" for _ in range(6)) for _ in range(rnd.randrange(1, 5))]
        texts.append([None, "", "\n\n"][k % 3] if k % 500 == 1 else "\n".join(lines))
        quality.append(int(good))
    return texts, quality


@pytest.mark.parametrize("most", [0, 50_000])
def test_field_takes_all_labelled_documents(spark, monkeypatch, most):
    monkeypatch.setattr(quality_crf, "DRIVER_LINES", most, raising=False)
    monkeypatch.setattr(quality_crf, "STEPS", 30)
    texts, quality = corpus()
    wanted = quality_crf.LineField().fit(pa.array(texts, pa.string()), np.array(quality))
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (DOCS + 1, "unlabelled")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([*enumerate(quality), (0, None), (None, 1), (-5, 1)], "doc_id long, quality int")
    field = quality_crf.fit_line_field(docs, labels)
    assert field.prior == sum(quality) / DOCS
    assert np.abs(field.emit - wanted.emit).max() < 1e-6 and np.abs(field.move - wanted.move).max() < 1e-6
    assert abs(field.slope - wanted.slope) < 1e-6 and abs(field.level - wanted.level) < 1e-6


def test_pipeline_stage_fits_on_all_labels_at_hand(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    texts, quality = corpus()
    fitted, whole = [], corpus_pipeline.fit_line_field
    monkeypatch.setattr(corpus_pipeline, "fit_line_field", lambda *given: fitted.append(whole(*given)) or fitted[-1])
    spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).count()
    wanted = quality_crf.LineField().fit(pa.array(texts, pa.string()), np.array(quality))
    scores = wanted.score(pa.array(texts, pa.string()))
    assert fitted[0].prior == sum(quality) / DOCS and kept == (scores >= quality_crf.THRESHOLD).sum()


def test_packed_lines_come_back():
    texts = pa.array(["a b\nC D!!\n", None, "", "x" * 500, "one | two\n\n3"])
    features, whole, lines = quality_crf.line_table(texts)
    packed = quality_crf._packed(features[:, :quality_crf.OWN], whole, lines)
    for begin, end in ((0, 5), (1, 4)):
        got = quality_crf._unpacked(packed[begin:end])
        part = quality_crf.line_table(pa.array(texts.to_pylist()[begin:end], pa.string()))
        assert all(np.array_equal(a, b) for a, b in zip(got, part, strict=True))
