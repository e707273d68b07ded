import random

import pytest

from lithofig.llm.jaccard_join import jaccard_join


def brute(rows, words=5, percent=75):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if (text or "").isascii() else (text or "").split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def made(seed, groups=25, big=0, common=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(2, 7)))
    passage = [word() for _ in range(30)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rnd.randrange(1, 120))]
        for _ in range(big if big and g == 0 else rnd.randrange(1, 5)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    for _ in range(common):
        out.append(" ".join([word() for _ in range(rnd.randrange(10, 60))] + passage))
    rnd.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("rows", [
    made(1), made(2, groups=10, big=150), made(3, groups=6, common=160),
    [(5, None), (3, ""), (9, " \n"), (4, "One two"), (2, "one TWO"), (8, "one two three"), (7, "a b c d e"), (6, "A B C D E"), (6, "A B C D E")],
])
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for counted, frequent, depth, block in ((0.4, 8, 4, 400_000), (1.0, 2, 1, 1500), (0.0, 10**9, 0, 400_000)):
        got = sorted(tuple(r) for r in jaccard_join(df, counted=counted, frequent=frequent, depth=depth, block=block).collect())
        assert got == brute(rows)


def test_empty_nulls_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node string, n int")
    assert jaccard_join(df).count() == 0
    text = "p q r s t u v w x y z"
    df = spark.createDataFrame([(None, text, "x", 1), (4, text, "y", 2), (None, "other words", "z", 3)], df.schema)
    got = sorted((tuple(r) for r in jaccard_join(df).collect()), key=str)
    assert got == sorted([(None, 7, 4), (4, 7, 4), (None, 1, None)], key=str)


def test_rows_without_id_link(spark):
    words = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join([*words[:k], "other", *words[k + 1:]])
    alone = " ".join(f"v{i}" for i in range(40))
    rows = [(None, " ".join(words)), (None, " ".join(words)), (7, near(0)), (None, near(39)), (None, alone), (None, alone + " more")]
    got = sorted((tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 36, 7), (None, 36, 7), (7, 36, 7), (None, 36, 7), (None, 36, None), (None, 37, None)], key=str)


def test_very_long_text(spark):
    base = [f"w{i}" for i in range(40_000)]
    other = base[:30_000] + [f"v{i}" for i in range(4_000)] + base[34_000:]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "w0 " * 50_000)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join(df).collect()) == [(1, 39996, 1), (2, 39996, 1), (3, 1, 3)]
