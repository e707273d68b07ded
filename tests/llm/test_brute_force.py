"""Operators and stages held against plain versions that share no code with them, and held-out accuracy."""

import base64
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lithofig.llm import decontaminate, queries, token_counts, vector_dedup

P = pytest.importorskip("public_tokenizers")
SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sections_by_hand(text):
    """(start, stop, tokens) of each line: every token's characters one by one."""
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("by hand", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lines = re.findall(r"[^\n]*\n|[^\n]+", text) or [""]
    line_of = [k for k, line in enumerate(lines) for _ in line]
    owner = [(c, k) for c, char in enumerate(text) for k in range(len(char.encode()))]
    counts, at = [0] * len(lines), 0
    for token in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(token))
        held = owner[at:at + size]
        begun = [c for c, k in held if k == 0] or [held[0][0]]
        votes = Counter(line_of[c] for c in begun)
        counts[min(votes, key=lambda s: (-votes[s], s))] += 1
        at += size
    stops = np.cumsum([len(line) for line in lines]).tolist()
    return [(stop - len(line), stop, n) for stop, line, n in zip(stops, lines, counts, strict=True)]


def test_section_counts_equal_tokens_taken_by_hand(spark):
    rows = [(1, "é中🙂\n\n🙂🙂 one\r\n  two", 1), (2, None, 1), (3, "\n\n", 1), (1, "é中🙂\n\n🙂🙂 one\r\n  two", 1), (4, "a\n" * 50 + "tail", 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for df in (made, spark.read.parquet(f"{SMALL}/documents.parquet")):
        got = token_counts.section_token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        found = sorted((r.doc_id, r.section, r.start, r.stop, r.n_tokens) for r in got)
        wanted = [(r.doc_id, k, *s) for r in df.select("doc_id", "text").collect() for k, s in enumerate(sections_by_hand(r.text or ""))]
        assert found == sorted(wanted)
    assert token_counts.section_token_counts(made.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def kept_by_hand(rows):
    """Least ids of the groups that Jaccard 0.75 on five words links, over all pairs."""
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for b in ids:
        for a in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if find(i) == i)


def leaks_by_hand(items, text):
    """Whether any item's longest common subsequence with some stretch of the text makes a leak."""
    plain = lambda t: [w for w in (w.strip(decontaminate.MARKS) for w in (t or "").lower().split()) if w]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    words = plain(text)
    bag = Counter(words)
    for item in map(plain, items):
        # no stretch can share more than the whole text
        if not item or sum((Counter(item) & bag).values()) < 0.6 * len(item):
            continue
        reach = len(item) + len(item) // 4
        for s in range(0, max(1, len(words) - 12), 12):
            around = words[max(0, s - reach):s + 24 + reach]
            if common(item, around) >= 0.6 * len(item) and common(item[-8:], around) >= 0.5 * len(item[-8:]):
                return True
    return False


def test_stages_equal_plain_versions(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = [s for _, s in corpus_pipeline.STAGES]
    tables = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for k, stage in enumerate(stages[:-1]):
        stage(spark, tables[-1], SMALL).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()] for t in tables]
    quality = dict(tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect())
    stay = {i for i, _ in rows[1]}
    right = [(i in stay) == (q == 1) for i, q in quality.items() if q is not None and i in {i for i, _ in rows[0]}]
    assert np.mean(right) >= 0.95 and stay < {i for i, _ in rows[0]}
    assert sorted(i for i, _ in rows[2]) == kept_by_hand(rows[1])
    # each stage has something to do here
    assert all(len({i for i, _ in a}) > len({i for i, _ in b}) for a, b in zip(rows[:3], rows[1:4], strict=True))
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, t in rows[2] if not leaks_by_hand(items, t))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    mixed = con.sql(queries.MIX_SQL)
    place = [mixed.columns.index(c) for c in ("doc_id", "copies")]
    wanted = {r[place[0]]: r[place[1]] for r in mixed.fetchall() if r[place[1]]}
    assert Counter(i for i, _ in rows[4]) == wanted
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    out = stages[-1](spark, tables[-1], SMALL).collect()
    crc = sorted((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows[4])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == crc


def test_language_is_right_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op4_language_id(spark, LARGER).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def test_quality_is_right_on_held_out_documents(spark):
    quality = dict(tuple(r) for r in spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality").collect())
    held = [r for r in queries.op8_quality(spark, LARGER).collect() if r.held_out and quality.get(r.doc_id) is not None]
    for label in (0, 1):
        of = [r.predicted == label for r in held if quality[r.doc_id] == label]
        assert len(of) >= 5 and np.mean(of) >= 0.9


def test_vectors_of_any_size_in_small_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PAIRS", 50)
    rng = np.random.default_rng(9)
    rows = []
    for size in (1, 3, 3000):
        base = rng.standard_normal(size)
        for k in range(60):
            x = base + 0.01 * rng.standard_normal(size) if k < 40 else rng.standard_normal(size)
            rows.append((len(rows), x.tolist(), "a", 1, 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, codes int, block int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicate_vectors(df, block=16).collect()}
    unit = {i: (len(v), np.array(v) / np.linalg.norm(v)) for i, v, *_ in rows}
    links = {i: {j for j, (m, y) in unit.items() if j != i and m == n and x @ y >= 0.93} for i, (n, x) in unit.items()}
    for i in unit:
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        assert got[i] == (len(links[i]), min(seen))
