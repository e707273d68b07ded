import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lithofig.llm import decontaminate

#: More documents than any sample of a few thousand holds.
DOCS = 6000


def corpus():
    rnd = random.Random(21)
    words = [f"w{k}" for k in range(100)]
    bench = [(i, " ".join(words[i::10])) for i in range(10)]
    texts = []
    for _ in range(DOCS):
        text = [f"x{rnd.randrange(1000)}" for _ in range(40)]
        for _ in range(3):
            text[rnd.randrange(40)] = rnd.choice(words)
        text[7] = text[rnd.randrange(40)]
        texts.append(" ".join(text))
    return bench, texts


def off_by(items, bench, texts):
    """How far the basis is from eigenvectors of A'A over items and passages of all texts, as a share of A'A."""
    place = {w: i for i, w in enumerate(items.vocabulary.to_pylist())}
    weight = np.log((1 + len(texts)) / (1 + np.array([sum(w in t for t in map(set, map(str.split, texts))) for w in place]))) + 1
    rows = [t.split() for _, t in bench]
    rows += [t.split()[s:s + 24] for t in texts for s in range(0, max(1, len(t.split()) - 12), 12)]
    square = np.zeros((len(place), len(place)))
    for row in rows:
        held = Counter(place[w] for w in row if w in place)
        for a, n in held.items():
            for b, m in held.items():
                square[a, b] += n * m * weight[a] * weight[b]
    turned = square @ items.basis
    return np.linalg.norm(turned - items.basis * np.sum(items.basis * turned, axis=0)) / np.linalg.norm(square)


def test_basis_takes_passages_of_all_documents(spark):
    bench, texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = decontaminate.fit_items(docs, bench)
    assert items.basis.shape == (100, 100) and (items.weight > 0).all()
    assert off_by(items, bench, texts) < 1e-9
    assert off_by(decontaminate.fit_items(docs.union(docs), bench), bench, texts * 2) < 1e-9


def test_pairs_passed_on_early_sum_to_the_same():
    bench, texts = corpus()
    items = decontaminate.Items.of(bench)
    items.weight = np.arange(100) % 7 * 1.0
    slices = lambda: (pa.array([*texts[k:k + 50], None, ""]) for k in range(0, 500, 50))
    whole, = decontaminate.pair_sums(items, slices())
    parts = list(decontaminate.pair_sums(items, slices(), 300))
    assert len(parts) > 3
    summed = Counter()
    for pairs, counts in parts:
        summed.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
    assert summed == dict(zip(whole[0].tolist(), whole[1].tolist(), strict=True))
    assert all(p // 100 % 7 and p % 100 % 7 for p in summed)
    assert list(decontaminate.pair_sums(items, iter([pa.array([None, "", "x1 x2"])]))) == []


def test_pipeline_stage_fits_on_all_its_rows(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    bench, texts = corpus()
    texts[17] += " " + bench[4][1]
    fitted, whole = [], decontaminate.fit_items
    monkeypatch.setattr(decontaminate, "fit_items", lambda *given: fitted.append(whole(*given)) or fitted[-1])
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(DOCS) if i != 17]
    items, = fitted
    assert off_by(items, bench, texts) < 1e-9
