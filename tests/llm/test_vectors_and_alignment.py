"""Operators 11 to 13 against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives, near_vectors, queries, token_alignment

SF = "/root/testdata/sf0.001"
VECTOR = "vec_id long, embedding array<float>, label int"


def same_as_sql(df, sql):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = db.execute(sql).fetchdf()[df.columns]
    got = df.toPandas()
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


# ---- 11


def near_by_force(rows, least=0.9):
    """n_links and component of (id, vector) rows, pair by pair."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))

    units = [unit(v) for _, v in rows]
    links = [[j for j, w in enumerate(units) if j != i and u is not None and w is not None and len(u) == len(w) and u @ w >= least] for i, u in enumerate(units)]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_key = min(rows[j][0] for j in seen)
        out.append((key, len(links[i]), least_key, key == least_key))
    return sorted(out)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(int(i), (centres[i % 12] + (0.08 if i % 3 else 0.3) * rng.standard_normal(16)).astype(np.float32).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(60)] + [(2000, [1.0] * 8), (2001, [2.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR)
    want = near_by_force(rows)
    assert sum(w[1] for w in want) > 2000
    for block in (1024, 16):
        got = near_vectors.near_duplicates(df, block=block)
        assert sorted(map(tuple, got.collect())) == want


def test_near_duplicates_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [-1.0, 0.0]), (2, [0.0, 1.0]), (11, [3e38, 1e-30]), (12, [1e-40, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in [*rows, (None, [1.0, 0.0])]], VECTOR).withColumn("H1", F.lit(1)).withColumn("size", F.lit(2))
    got = sorted(map(tuple, near_vectors.near_duplicates(df).collect()))
    assert got == near_by_force(rows)
    assert near_vectors.near_duplicates(df.limit(0)).collect() == []


def test_pairs_at_the_threshold_meet(spark):
    """Pairs whose cosine is just over the threshold, the hardest to find: at least 0.95 of them, at both widths of tables of this size and larger ones."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    g = rng.standard_normal((2000, 64))
    g -= (g * a).sum(1)[:, None] * a
    b = 0.901 * a + math.sqrt(1 - 0.901**2) * g / np.linalg.norm(g, axis=1)[:, None]
    for width in (2, 3, 4):
        codes = [near_vectors.CrossPolytope(64, 6, width, 2 << width).codes(x) for x in (a, b)]
        met = (codes[0] == codes[1][:, :, :1]).any(axis=(1, 2)) | (codes[1] == codes[0][:, :, :1]).any(axis=(1, 2))
        assert met.mean() > 0.95, (width, met.mean())


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).standard_normal((5, 32))
    y = near_vectors.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(near_vectors.hadamard(y), x)


def test_registered_near_dedup(spark):
    same_as_sql(queries.op11_embedding_near_dedup(spark, SF), near_vectors.ORACLE_OP11)


# ---- 12


def align_by_force(rows, path_a, path_b):
    """Token by token, every pair of a document's tokens compared."""
    a_side, b_side = token_alignment.byte_level_table(path_a), token_alignment.piece_table(path_b)
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    ta.encode_special_tokens = True
    docs, corpus = [], {}
    for key, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        data = (" " + text).encode() if text else b""
        if b"".join(a_side[i] for i in a) != data or b"".join(b_side[i] for i in b) != data:
            a, b = [], []
        spans = []
        for ids, table in ((a, a_side), (b, b_side)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        for pair in links:
            corpus[pair] = corpus.get(pair, 0) + 1
        common = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        said, low = [], 0
        for end in common:
            said.append("|".join(",".join(str(x[2]) for x in own if low <= x[0] < end) for own in spans))
            low = end
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""
        docs.append((key, len(a), len(b), len(common), links, digest))
    top = {}
    for (_, b), n in corpus.items():
        top[b] = max(top.get(b, 0), n)
    return sorted((k, a, b, g, len(links), sum(corpus[p] == top[p[1]] for p in links), sum(corpus[p] for p in links), d) for k, a, b, g, links, d in docs)


@pytest.fixture(scope="module")
def tokenizers_at_hand():
    return queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


TEXTS = [
    None, "", " ", "  two  spaces ", "plain words here", "Grüße, naïve café", "数学 и язык 🙂🙂", "<|endoftext|> and <s> <unk> </s>", "a\tb\r\nc\n\n\n", "▁low line▁", "it's they'll 12345 --==", "\u0085 odd spaces", "x" * 3000,
    "plain words here", "é composed", "\u0000\u0001", "ﬁ ligature ① ½",
]


def test_alignment_matches_brute_force(spark, tokenizers_at_hand):
    random.seed(1)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(random.choice(TEXTS[4:]) for _ in range(6))[:400]) for i in range(20)] + [(100, "again"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted([(k if k is not None else -1, *r) for k, *r in align_by_force([(k if k is not None else -1, t) for k, t in rows], *tokenizers_at_hand)], key=key)
    for most in (token_alignment.MAX_BROADCAST_PAIRS, 10):
        got = token_alignment.align_tokens(df, *tokenizers_at_hand, max_broadcast=most)
        assert got.columns == ["doc_id", *token_alignment.OWN]
        assert sorted([(k if k is not None else -1, *r) for k, *r in map(tuple, got.collect())], key=key) == want


def test_alignment_of_clashing_columns_and_empty_tables(spark, tokenizers_at_hand):
    df = spark.createDataFrame([(1, "some text", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, N_A int, `a.b` string")
    got = token_alignment.align_tokens(df, *tokenizers_at_hand)
    assert got.columns == ["doc_id", "a.b", *token_alignment.OWN]
    assert [(r["doc_id"], r["a.b"], r["n_a"] > 0) for r in got.orderBy("doc_id").collect()] == [(1, "x", True), (2, "y", False)]
    assert token_alignment.align_tokens(df.limit(0), *tokenizers_at_hand).collect() == []


def test_batches_do_not_change_results(spark, tokenizers_at_hand, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r["doc_id"], r["text"][:600] if r["text"] else r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, token_alignment.align_tokens(df, *tokenizers_at_hand).collect())) == align_by_force(rows, *tokenizers_at_hand)
    aligner = token_alignment.Aligner(*tokenizers_at_hand)
    whole, alone = aligner.align([t for _, t in rows])[0], [aligner.align([t])[0][0] for _, t in rows]
    assert whole == alone


def test_rank_encoder_is_the_vocabulary(tokenizers_at_hand):
    aligner = token_alignment.Aligner(*tokenizers_at_hand)
    assert aligner.fast is not None
    random.seed(2)
    letters = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]]
    for _ in range(300):
        text = " " + "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        assert aligner.fast.encode_ordinary(text) == aligner.a.encode(text, add_special_tokens=False).ids


# ---- 13


def mine_by_force(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (id, whole vector, label)."""
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ca in good:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, c) for i, v, c in good if i != a and len(v) == len(va)]
        for sp, p, _ in sorted(x for x in scored if x[2] == ca)[:positives]:
            fit = sorted(x for x in scored if x[2] != ca and low * -sp <= 100 * -x[0] <= high * -sp)[:negatives]
            out += [(a, p, k + 1, n, -sp, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((9, 8))
    # Few values, so that scores tie.
    rows = [(i, [float(x) for x in np.round(centres[i % 9] + 0.4 * rng.standard_normal(8), 1 if i % 2 else 0)], int(rng.integers(0, 4))) for i in range(1500)]
    df = spark.createDataFrame(rows, VECTOR)
    want = mine_by_force([(i, np.array(v, np.float32).tolist(), c) for i, v, c in rows])
    assert len(want) > 300
    got = hard_negatives.mine_hard_negatives(df, F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 4)  # several slices of anchors
    assert sorted(map(tuple, hard_negatives.mine_hard_negatives(df, F.col("id") % 100 == 0).collect())) == want


def test_hard_negatives_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.6, 0.0], 2), (3, [0.6, 0.0], 2), (4, None, 2), (5, [nan, 0.5], 2), (6, [0.5, None], 2), (7, [0.5, 0.5], None), (8, [], 1), (9, [0.5], 2), (100, [-1.0, 0.0], 1), (200, [0.0, 0.0], 3), (None, [0.6, 0.1], 2)]
    df = spark.createDataFrame(rows, VECTOR).withColumn("CELL", F.lit(1)).withColumn("score", F.lit(2))
    got = sorted(map(tuple, hard_negatives.mine_hard_negatives(df, F.col("id") % 100 == 0).collect()))
    want = mine_by_force([(i, np.array([x if x is not None else nan for x in v], np.float32).tolist() if v else v, c) for i, v, c in rows])
    assert got == want and len(got) >= 2
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.col("id") % 100 == 0).collect() == []


def test_bounds_prune_and_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    points = np.floor(np.concatenate([rng.standard_normal((4000, 8)) * 20 + c for c in rng.standard_normal((16, 8)) * 2000]))
    tree, seen = hard_negatives.BallTree(points), []
    real = hard_negatives.whole_scores
    try:
        hard_negatives.whole_scores = lambda a, b: seen.append(len(a) * len(b)) or real(a, b)
        one = np.zeros(1, np.int64)
        top, who = tree.best(points, np.arange(len(points)), np.zeros(len(points), np.int64), points[:1], one, one, True, one + hard_negatives.NONE + 1, one + hard_negatives.FAR - 1, 5)
    finally:
        hard_negatives.whole_scores = real
    want = sorted(((-int(s), i) for i, s in enumerate(points @ points[0]) if i))[:5]
    assert list(zip((-top[0]).tolist(), who[0].tolist(), strict=True)) == want
    assert sum(seen) < len(points) / 4
    big = np.array([[2.0**29, 1.0], [2.0**29, -1.0]])
    assert hard_negatives.whole_scores(big, big).tolist() == [[2**58 + 1, 2**58 - 1], [2**58 - 1, 2**58 + 1]]


def test_registered_hard_negatives(spark):
    same_as_sql(queries.op13_hard_negatives(spark, SF), hard_negatives.ORACLE_OP13)
