"""Edge cases and brute-force comparisons of the training-data operators."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe_chunks, chat, decontaminate, id_coder, jaccard_join, language_id, license_scan, sharding, shingles, url_filter, winnow
from graphloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string"
WORDS = "alpha beta gamma delta the of and to naïve über été model data token shard stream règle größe ciudad".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "x"), (5, long), (6, long), (6, long), (None, "one two three"), (7, "日本語 テキスト"), (8, "…!!"), (9, words(rng, 60))]
    return spark.createDataFrame([(i, t, "mine", 1, 2) for i, t in rows], DOCS + ", Shard string, score int, `a.b` int")


def plain(df):
    return df.select("doc_id", "text")


# ---- op1


def test_coder_round_trips_and_detects_damage():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 47, 48, 49, 500, 9000):
        for ids in (rng.integers(0, 300, n), np.zeros(n, np.int64), rng.integers(0, 2, n) * 299):
            data = id_coder.pack_block([1, None], [n, 0], ids.astype(np.int64), 300)
            names, lengths, back = id_coder.unpack_block(data)
            assert names == [1, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    broken = bytearray(data)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        id_coder.unpack_block(bytes(broken))


def test_coder_compresses_repeated_contexts():
    ids = np.tile(np.random.default_rng(1).integers(0, 40_000, 50), 4000)
    assert len(id_coder.pack_block([1], [len(ids)], ids, 49_408)) < 0.6 * len(ids)


def test_word_encoder_equals_library():
    enc = id_coder.word_encoder(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(7)
    letters = [chr(i) for i in range(1, 0x180)] + ["'s", "'LL", "<|endoftext|>", "  ", "日", "Σ", "İ", "\u0301"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", "l'été d'or", "!'s", "don't"]
    assert [x.tolist() for x in enc.encode_batch(texts)] == [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]


def test_id_blocks(spark, odd):
    path = tokenizer_file("word_bpe_49k.json")
    blocks = id_coder.write_id_blocks(plain(odd), path, block_ids=500, files=3)
    got = sorted((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in id_coder.read_id_blocks(blocks, digest=True).collect())
    enc = id_coder.word_encoder(path).whole
    want, start = [], 0
    for r in sorted(plain(odd).collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None, r.text)):
        ids = enc.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id is not None, r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    empty = id_coder.write_id_blocks(spark.createDataFrame([], DOCS), path)
    assert id_coder.read_id_blocks(empty).count() == 0


# ---- op2


def test_chunk_reuse_equals_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    whole, v = Tokenizer.from_file(path), bpe_chunks.vocabulary(path)
    rng = random.Random(2)
    parts = list("ab c  \n\t'sré1٣ \u0085\x1c😀<|>_.,\u0301") + ["<|endoftext|>", " the", "don't", "\r\n", "日本語", "zz" * 30, "、", "語。", "한국", "カナ", "?", "it's,", ":'s", "\u3000", "\xa0"]
    for bits in (2, 5):
        enc = bpe_chunks.ChunkEncoder(v, bits=bits, cache_bytes=20_000)
        for _ in range(300):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))
            ids = whole.encode(text, add_special_tokens=False).ids
            assert enc.encode(text).tolist() == ids
            assert v.decode(ids) == whole.decode(ids, skip_special_tokens=False)


def test_chunks_are_reused_without_blanks():
    """Texts parted by tabs, line ends or ideographic marks alone have anchors too: a second copy sends the encoder next to nothing."""
    v = bpe_chunks.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(12)
    kanji = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    for part in (lambda: kanji(12) + "。", lambda: rng.choice(WORDS) + "\t", lambda: rng.choice(WORDS) + "\r\n"):
        text = "".join(part() for _ in range(3000))
        enc = bpe_chunks.ChunkEncoder(v)
        first, sent = enc.encode(text), []

        class Counting:
            anchored = True
            encode = staticmethod(lambda t: (sent.append(len(t)), v.encode(t))[1])

        enc.v = Counting
        assert enc.encode(text) == first and first.tolist() == v.encode(text)
        assert sum(sent) < len(text) / 5


def test_unsuited_vocabularies_encode_whole(tmp_path):
    """Special tokens that hold an anchor or take blanks: no chunks, the library's ids."""
    import json

    from tokenizers import Tokenizer

    raw = json.load(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8"))
    for i, change in enumerate(({"content": "<a, b>"}, {"lstrip": True}, {"rstrip": True})):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(raw | {"added_tokens": [raw["added_tokens"][0] | change]}))
        v, whole = bpe_chunks.ByteBpe(str(path)), Tokenizer.from_file(str(path))
        mark = change.get("content", "<|endoftext|>")
        text = f"some words {mark} and more , {mark}, " * 30
        assert not v.anchored
        assert bpe_chunks.ChunkEncoder(v, bits=2).encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_cut_points_follow_content():
    rng = random.Random(4)
    shared = words(rng, 3000).encode()
    a = bpe_chunks.cut_points(b"some start " + shared)
    b = bpe_chunks.cut_points(b"quite another beginning, longer " + shared)
    assert len({x - 11 for x in a} & {x - 32 for x in b}) > 10


def test_bpe_columns(spark, odd):
    path = tokenizer_file("byte_bpe_50k.json")
    out = bpe_chunks.decode_ids(bpe_chunks.encode_texts(odd, path), path)
    assert out.columns == ["doc_id", "text", "Shard", "score", "a.b", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == 11 and all((r["text"] or "") == r["decoded"] for r in rows)
    assert "text" not in bpe_chunks.encode_texts(odd, path, keep_text=False).columns
    assert bpe_chunks.encode_texts(spark.createDataFrame([], DOCS), path).count() == 0


# ---- op3


def test_leaks_found_and_clean_left_alone(spark):
    rng = random.Random(9)
    vocab = ["w%d" % i for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(8 if i < 20 else 30, 70))) for i in range(40)]
    rows, want = [], set()
    for d in range(200):
        body = text(rng.randint(0, 400))
        if d % 4 == 0:
            i = rng.randrange(20 if d % 8 == 0 else 0, 40)
            item = items[i][1].split()
            if d % 8 == 0:
                item[rng.randrange(len(item))] = "changed"
            body = f"{body}\n{' '.join(item).upper() if d % 12 == 0 else ' '.join(item)}, {text(30)}"
            want.add((d, i))
        rows.append((d, body))
    rows += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1])]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(items + [(77, None), (78, "too short")], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(902, 0)} and len([r for r in got if r.doc_id == 902]) == 2
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_leaks(docs, bench).count() == 204 - len(want) - 2


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(8)
    table = decontaminate.Items(list(range(20)), [" ".join(f"v{rng.integers(500)}" for _ in range(30)) for _ in range(20)])
    c = table.classes[0]
    prints = np.concatenate([c.prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 3, 7, 11, 12, 20)])
    at, to = table.candidates(c, prints)
    brute = {(i, j) for i in range(len(prints)) for j in range(len(c.prints)) if int(prints[i] ^ c.prints[j]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(at.tolist(), to.tolist())) == brute


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_edited_and_cut_items_against_every_place(least):
    rng = random.Random(31)
    vocab = ["w%d" % i for i in range(2000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(n) for n in (6, 7, 14, 20, 21, 40, 59, 120) for _ in range(3)]
    items[1] = items[0][:3] * 3
    table = decontaminate.Items(list(range(len(items))), [" ".join(i) for i in items], least=least)
    texts = []
    for i in items:
        for _ in range(12):
            n = len(i)
            some = rng.choice([0.1, 0.15, 0.2])
            edited = [rng.choice(vocab) if rng.random() < some else w for w in i]
            at = rng.randrange(n - (n * 55 // 100) + 1)
            split = i[: n // 2] + text(rng.randint(1, n // 2)) + i[n // 2 :]
            for own in (edited, i[at : at + n * 55 // 100 + rng.randint(0, 2)], split, i + i):
                texts.append(text(rng.randint(0, 60)) + own + text(rng.randint(0, 60)))
    texts += [[], text(1), items[2]]
    words, ends = decontaminate.words_of(pa.array([" ".join(t) for t in texts]))
    got = {k: v for k, v in table.find(words, ends).items() if v[0] >= least}
    want = {}
    for t in range(len(texts)):
        own = words[ends[t] : ends[t + 1]]
        for i in range(len(items)):
            if np.isin(table.parts[i][0], shingles.shingle_hashes(own, 3)).any():
                value = max(table.similarity(i, own, s) for s in range(max(1, len(own))))
                if value >= least:
                    want[t, i] = value
    assert len(want) > 300 and {k: v[0] for k, v in got.items()} == want
    assert sum(table.similarity(i, words[ends[t] : ends[t + 1]], -v[1]) == v[0] for (t, i), v in got.items()) == len(got)


def test_short_items_and_passes(spark, monkeypatch):
    items = [(1, "Alpha"), (2, "alpha, beta"), (3, "one two three four five"), (4, "..."), (5, " ".join(f"long{i}" for i in range(30))), (6, "alpha beta")]
    docs = [(1, "x ALPHA beta y"), (2, "beta alpha"), (None, "zero one two; three four five"), (4, "one two three four six five"), (5, f"a {items[4][1]} b"), (6, "")]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (1, 2), (1, 6), (2, 1), (None, 3), (5, 5)}
    found = lambda: {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(*frames).collect()}
    assert found() == want
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 20_000)
    assert found() == want


def test_passes_weigh_shared_words_alike(spark, monkeypatch):
    """Items that share most of their words: similarities near the threshold move with the weights, so every cut into passes must use those of all items."""
    rng = random.Random(12)
    shared, rare = [f"s{i}" for i in range(40)], [f"r{i}" for i in range(400)]
    items = [[rng.choice(shared) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(8, 30))] for _ in range(60)]
    docs = [[rng.choice(rare) for _ in range(5)] + [w if rng.random() > 0.2 else rng.choice(shared) for w in item] for item in items for _ in range(3)]
    frames = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], DOCS), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, r.similarity) for r in decontaminate.find_leaks(*frames).collect())
    one = found()
    assert len(one) > 30
    for size in (400_000, 60_000):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        assert found() == one


def test_dropping_leaks_from_clashing_columns(spark):
    items = spark.createDataFrame([(1, "some words that make an item of the benchmark")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x some words that make an item of the benchmark y", 1), (2, "clean", 2), (None, "clean too", 3)], DOCS + ", _bad long")
    assert sorted(r["_bad"] for r in decontaminate.drop_leaks(docs, items).collect()) == [2, 3]
    assert decontaminate.drop_leaks(docs.limit(0), items).columns == docs.columns


def test_recall_of_windows_alone(monkeypatch):
    """Of edited items that reach the similarity, how many the fingerprints find by themselves; with the shingles all are."""
    rng = random.Random(77)
    vocab = ["w%d" % i for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(n) for n in (14, 20, 30, 37, 45, 60) for _ in range(5)]
    whole = decontaminate.Items(list(range(len(items))), [" ".join(i) for i in items])
    alone = decontaminate.Items(list(range(len(items))), [" ".join(i) for i in items])
    monkeypatch.setattr(alone, "sharing", lambda words, ends: [])
    for share, least in ((0.05, 0.9), (0.1, 0.75), (0.2, 0.4), (0.3, 0.2)):
        texts = [text(rng.randint(5, 60)) + [rng.choice(vocab) if rng.random() < share else w for w in i] + text(rng.randint(5, 60)) for i in items for _ in range(8)]
        words, ends = decontaminate.words_of(pa.array([" ".join(t) for t in texts]))
        want, brute = {k for k, v in whole.find(words, ends).items() if v[0] >= 0.5}, set()
        for t in range(len(texts)):
            own = words[ends[t] : ends[t + 1]]
            brute |= {(t, t // 8)} if max(whole.similarity(t // 8, own, s) for s in range(len(own))) >= 0.5 else set()
        found = {k for k, v in alone.find(words, ends).items() if v[0] >= 0.5}
        assert want == brute and len(found & brute) >= least * len(brute)


# ---- op4


def test_url_filter_against_brute_force(spark):
    urls = ["http://A.Com/x", "http://www.example.com/en/1", "http://example.com/en/1", "http://example.com/en", "http://foo.net/es/", "http://foo.net/ES/", "http://net/fr/a?b#c", "http://x.org#y", "nothing", "", None,
            "ftp://ads.site.org/a.zip?q", "http://site.org/login", "http://xcom/", "http://u@b.com:80/", "a://b://c.com/", "http://com", "http://.com/", "http://casino.org/en/?sessionid=1"]
    rows = [(i, u) for i, u in enumerate(urls)] * 2
    out = url_filter.judge_urls(spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id long, url string, Verdict string")).collect()
    sites = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    assert len(out) == len(rows) and out[0].__fields__ == ["page_id", "url", "host", "path", "rule", "verdict", "fired"]
    for r in out:
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in sites if (host == h or host.endswith("." + h)) and path.startswith(p)]
        other = [u for u in url_filter.PATTERN_RULES if re.search(u.pattern, (r.url or "") if u.scope == "url" else host + path)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((max(fit)[1], max(fit)[2]) if fit else (None, "block" if other else "allow"))
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_places_end_where_the_query_begins(spark):
    urls = ["https://site.org/?u=http://ads.example.org/", "https://site.org/x?next=http://a.b/login", "https://site.org/login?x", "https://ads.site.org", "https://site.org/?q=casino", "https://casino.org"]
    out = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.fired for r in out] == ["", "", "login-page", "ad-host", "", "casino-site"]


def test_rare_languages_and_repeats_are_learned(spark):
    english = "the quick brown fox jumps over the lazy dog and runs away with number %d of them"
    german = "der schnelle braune Fuchs springt \u00fcber den faulen Hund und l\u00e4uft davon mit Nummer %d"
    rows = [(i, english % (i % 40), "en") for i in range(3000)] + [(9000 + i, german % i, "de") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df, sample_rows=30)
    asked = spark.createDataFrame([(1, english % 99), (2, german % 99)], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(asked, model).orderBy("doc_id").collect()] == ["en", "de"]


def test_negative_ids_are_errors(spark):
    df = spark.createDataFrame([(1, [5, -1])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="-1 is no id"):
        bpe_chunks.decode_ids(df, tokenizer_file("byte_bpe_50k.json")).collect()


def test_rules_of_alternatives_are_fetched_by_each(spark):
    urls = ["http://ad.doubleclick.net/x", "http://DoubleClick.net", "http://adserver.site.org/", "http://a.ads.b.doubleclick.adserver.org/login", "http://ads.com/x", "http://doubleclicks.org/ads.", "http://x.org/doubleclick.net", "http://x.org/?a=://ads.b"]
    out = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in out:
        host, path = re.search(r"://([^/?#]*)([^?#]*)", r.url).groups()
        names = [u.name for u in url_filter.SITE_RULES + url_filter.PATTERN_RULES if re.search(u.pattern, r.url if u.scope == "url" else host.lower() + path)]
        assert r.fired == ",".join(sorted(names))
    assert [(r.verdict, r.fired) for r in sorted(out, key=lambda r: r.page_id)][:4] == [("block", "ad-host"), ("block", "ad-host"), ("block", "ad-host,adserver-host"), ("block", "ad-host,adserver-host,login-page")]


# ---- op5


def test_sharding(spark, odd):
    keys = spark.range(5000).select(F.col("id").alias("doc_id"))
    out = sharding.assign_shards(keys, n_shards=8).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(8))
    assert 400 < sum(r.grown_shard == 8 for r in out) < 720
    heavy = sharding.assign_shards(keys, weights=[3.0, 1.0, 0.0]).groupBy("shard").count().collect()
    assert {r.shard for r in heavy} == {0, 1} and 2.6 < max(r["count"] for r in heavy) / min(r["count"] for r in heavy) < 3.4
    twice = sharding.assign_shards(odd, n_shards=3)
    assert twice.columns == ["doc_id", "text", "score", "a.b", "shard", "slot", "grown_shard"] and twice.count() == 11
    assert sharding.assign_shards(keys.limit(0)).count() == 0


# ---- op6


def test_license_scan(spark, odd):
    text = "Ü CC-BY cc by x. General Public License! all rights\nreserved " + "Permission is hereby granted, free of charge, to any person (really) obtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "cc"), (5, "cc by cc by"), (5, "cc by cc by")], DOCS)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()]
    assert got[0][:6] == (1, 33, 4, 1, 9, "cc-by,gpl,reserved") and got[0][6] == "cc-by,gpl,mit,reserved"
    assert got[1:] == [(2, 0, 0, None, None, "", ""), (3, 0, 0, None, None, "", ""), (4, 1, 0, None, None, "", ""), (5, 4, 2, 0, 2, "cc-by", "cc-by"), (5, 4, 2, 0, 2, "cc-by", "cc-by")]
    # Words of a template that repeat, stand in another order or far apart are no template.
    odd_ones = [(1, "spdx license spdx license"), (2, "license identifier license identifier"), (3, "license identifier spdx license"), (4, "this software " * 20), (5, "spdx license identifier"),
                (6, "licensed under the apache " + "x " * 30 + "license version 2 0"), (7, "licensed under the apache license version 2 0 " * 2)]
    found = {r.doc_id: (r.labels, r.score, len(r.spans or [])) for r in license_scan.scan_licenses(spark.createDataFrame(odd_ones, DOCS)).collect()}
    assert found == {1: ("", 0.0, 0), 2: ("", 0.0, 0), 3: ("", 0.0, 0), 4: ("", 0.0, 0), 5: ("spdx", 1.0, 1), 6: ("", 0.0, 0), 7: ("apache-2", 1.0, 2)}
    assert license_scan.scan_licenses(odd).count() == 11 and license_scan.scan_licenses(df.limit(0)).count() == 0


# ---- op7


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|", "<<|", "|>", "<", "a\nb", "", "<|im_start|>assistant\nx<\\\\|y", "é😀"]
    rows = [(1, i, ("user", "assistant", "sys%\ntem", None)[i % 4], t) for i, t in enumerate(texts)] + [(2, 0, "assistant", None), (None, 0, "user", "q"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, None, "assistant", "z")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(chat.fold_messages(log))
    back = {r.conv: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_chats(formatted).collect()}
    want = {}
    for c, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        want[c] = (turns, "".join(t for role, t in turns if role == "assistant"))
    assert back == want
    assert chat.chat_digest(chat.read_chats(chat.format_chats(chat.fold_messages(log.limit(0))))).count() == 0


def test_chat_events(spark):
    rows = [("c", 1, 0, "message", "user", "hi"), ("c", 2, 1, "message", "assistant", "He"), ("c", 3, 1, "delta", "assistant", "llo"), ("c", 4, 2, "message", "user", "more"), ("c", 5, 3, "message", "assistant", "x"),
            ("c", 6, 1, "regenerate", None, None), ("c", 7, 1, "delta", "", "Good day"), ("c", 8, 0, "edit", "", "hello"), ("c", 9, 4, "message", "user", "bye"), ("c", 10, 5, "message", "user", "gone"), ("c", 11, 5, "delete", "", "")]
    log = spark.createDataFrame(rows, "conv string, seq int, turn int, event string, role string, text string")
    got = [(r.turn, r.role, r.text) for r in chat.fold_messages(log, conv="conv", seq="seq", event="event").orderBy("turn").collect()]
    assert got == [(0, "user", "hello"), (1, "assistant", "Good day"), (4, "user", "bye")]


def test_chat_events_without_sequence(spark):
    rows = [(1, 0, "user", "hi", "message", 5), (1, 1, "assistant", " more", "delta", 7), (1, 1, "assistant", "base", "message", 7), (1, 2, "user", "x", None, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, event string, seq long")
    for options in ({"event": "event"}, {"event": "event", "seq": "seq"}):
        assert [r.text for r in chat.fold_messages(df, **options).orderBy("turn").collect()] == ["hi", "base more", "x"]


def test_inner_names_leave_the_input_alone(spark):
    """Columns that are called like the operators' own inner ones come back as they were."""
    inner = ["_url", "_host", "_path", "_fired", "_site", "_other", "_part", "_rank", "_start", "_shard", "_p", "_row", "k1", "k2", "key", "part", "rank", "start", "n", "c0", "s0", "of_shard", "of_part", "hit", "label"]
    df = spark.createDataFrame([("http://ads.x.org/", 1, *range(len(inner)))] * 2, "url string, doc_id long, " + ", ".join(f"`{c}` long" for c in inner))
    for out in (url_filter.judge_urls(df), sharding.assign_shards(df, order=("url",)), license_scan.scan_licenses(df, text="url")):
        assert [tuple(r) for r in out.select(*inner).collect()] == [tuple(range(len(inner)))] * 2


# ---- op8


def test_codewords_differ():
    for n in (2, 3, 4, 5, 12, 40):
        code = language_id.codewords(n)
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code.tolist() and code, 2))
        assert len(code) == n and apart >= (2 ** (n - 2) if n <= 5 else code.shape[1] // 4)


def test_language_id(spark, odd):
    own = {"aa": "ka lo mi ta ru".split(), "bb": "sch ung eit pfl erz".split(), "cc": "ñon óli ués cán áre".split()}
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices(own[g], k=2)) for _ in range(40)), g) for i, g in enumerate(list(own) * 100)]
    df = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("out", language_id.held_out(F.col("doc_id")))
    model = language_id.learn(df.where("NOT out"))
    got = language_id.identify(df.where("out").drop("out"), model).collect()
    assert len(got) > 40 and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    empties = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [empties[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and empties[7].lang_pred != "und"
    assert language_id.identify(odd, model).columns == ["doc_id", "text", "Shard", "a.b", "lang_pred", "score", "ambiguous"]
    none = language_id.learn(df.limit(0))
    assert none is None and {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}


def test_language_parts_agree(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "xy", words(rng, 300), "", words(rng, 500), "12 34", words(rng, 5)]
    data, ends = shingles.text_buffers(pa.array(texts))
    model = language_id.Model(["a", "b"], np.random.default_rng(1).random((2, language_id.NONE)), [])
    whole = model.predict(data, ends)[1]
    monkeypatch.setattr(language_id, "PART", 97)
    parts = model.predict(data, ends)[1]
    assert np.allclose(whole[[3, 5, 7]], parts[[3, 5, 7]])


# ---- op9


def brute_components(docs, k, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in docs:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(jaccard_join, "DIRECT", 3)
    monkeypatch.setattr(jaccard_join, "OUTSIDE", 2)
    rng = random.Random(11)
    vocab = ["v%d" % i for i in range(400)]
    docs, passage = [], [rng.choice(vocab) for _ in range(60)]
    for f in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 9, 40, 150]))]
        if f % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(own)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "Two words"), (504, "two WORDS"), (505, docs[0][1]), (505, docs[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS + ", node string")
    found = lambda **options: sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k=k, num=num, den=den, **options).collect())
    assert found() == brute_components(docs, k, num, den)
    # Names of 5 bits, so that most sets share theirs with others; another order of shingles.
    monkeypatch.setattr(jaccard_join, "RARE", 1)
    monkeypatch.setattr(jaccard_join, "LISTED", 40)
    assert found(name_bits=5) == brute_components(docs, k, num, den)


def test_jaccard_links_texts_under_null_ids(spark):
    rng = random.Random(2)
    base = ["v%d" % i for i in range(100)]
    change = lambda *at: " ".join("new%d" % rng.randrange(10**6) if i in at else w for i, w in enumerate(base))
    # 1 and 2 are linked only through the text under a null id; 7 has no near text.
    docs = [(1, change(0, 1, 2, 3)), (None, change()), (2, change(96, 97, 98, 99)), (7, words(rng, 50)), (None, "all of its own"), (None, None)]
    out = jaccard_join.jaccard_components(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (7, 7)]
    nameless = jaccard_join.jaccard_components(spark.createDataFrame([(None, t) for _, t in docs[:3]], DOCS)).collect()
    assert [(r.component_id, r.n_links > 0) for r in nameless] == [(None, True)] * 3


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r)[:3] for r in jaccard_join.jaccard_components(spark.createDataFrame([(4, None)], DOCS)).collect()] == [(4, 0, 4)]


def test_large_regions_are_divided(spark, monkeypatch):
    """Near copies around three texts that share a passage, all at several distances, in regions far beyond ``DIRECT``."""
    monkeypatch.setattr(jaccard_join, "DIRECT", 8)
    monkeypatch.setattr(jaccard_join, "OUTSIDE", 4)
    rng = random.Random(23)
    passage = ["p%d" % i for i in range(70)]
    docs = []
    for f in range(3):
        base = passage + ["b%d_%d" % (f, i) for i in range(30)]
        for j in range(20):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6, 12])):
                own[rng.randrange(len(own))] = "e%d" % rng.randrange(10**6)
            docs.append((len(docs), " ".join(own)))
    for k, num, den in ((3, 9, 10), (5, 4, 5)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, DOCS), k=k, num=num, den=den).collect())
        assert got == brute_components(docs, k, num, den)


def test_linked_sets_share_enough_of_their_prefixes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for num, den in ((9, 10), (4, 5), (1, 2)):
        t = jaccard_join.Threshold(num, den)
        for _ in range(400):
            x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 90), dtype=np.int64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.06], rng.integers(0, 1 << 62, rng.integers(0, 6))]))
            both = len(np.intersect1d(x, y))
            if t.linked(both, len(x), len(y)):
                assert t.prefix(len(x)) > 0 and (len(x) == len(y) == both or not t.alone(len(x)))
                rows.append((num, den, len(x), len(y), len(np.intersect1d(x[: t.prefix(len(x))], y[: t.prefix(len(y))]))))
    for num, den in ((9, 10), (4, 5), (1, 2)):
        t = jaccard_join.Threshold(num, den)
        own = spark.createDataFrame(rows, "num int, den int, x int, y int, shared int").where((F.col("num") == num) & (F.col("den") == den))
        least = own.select("shared", t.shared_prefix(F.col("x"), F.col("y")).alias("need"), t.sizes_fit(F.col("x"), F.col("y")).alias("fit"))
        assert least.count() > 50 and least.where("shared < need OR need < 1 OR NOT fit").count() == 0


def test_word_hashes_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = ["", "A b\tc", words(rng, 400), " ", words(rng, 50), "é É"]
    data, ends = shingles.text_buffers(pa.array(texts))
    whole = shingles.word_hashes(data, ends)
    monkeypatch.setattr(shingles, "PART", 13)
    part = shingles.word_hashes(data, ends)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()
    assert np.diff(whole[1]).tolist() == [len([w for w in re.split("[ \t-\r]+", t) if w]) for t in texts]


# ---- op10


def test_winnow_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, n)) for i, n in enumerate([0, 1, 4, 5, 6, 20, 21, 100, 300])]
    df = spark.createDataFrame(rows, DOCS)
    k, w = winnow.K, winnow.W
    hashed = df.select("doc_id", winnow.winnow(F.col("text")).alias("fp"), F.transform(F.filter(F.split(F.lower("text"), "[ \t-\r]+"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("h"))
    grams = hashed.select("doc_id", "fp", F.when(F.size("h") >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - k, F.lit(0))), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)]))).alias("g"), "h")
    for r in grams.collect():
        if not r.h:
            assert r.fp == []
            continue
        if r.g is None:
            assert len(r.fp) == 1
            continue
        g = [(x >> winnow.PLACE_BITS, -i) for i, x in enumerate(r.g)]
        windows = [g[i : i + w] for i in range(len(g) - w + 1)] or [g]
        want = []
        for win in windows:
            if min(win) not in want:
                want.append(min(win))
        assert [(p >> winnow.PLACE_BITS, (p & winnow.PLACES) - winnow.PLACES) for p in r.fp] == want


def test_fingerprint_edits(spark):
    rows = [(5, "five " * 30), (3, "Δelta 😀 three"), (9, None), (1, "one two"), (1, "one two"), (7, words(random.Random(0), 80))]
    got = {}
    for buckets in (1, 3, 50):
        docs = winnow.with_next(spark.createDataFrame(rows, DOCS).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", F.xxhash64("text"), {"text": "next"}, buckets).collect()
        got[buckets] = sorted((r.doc_id, r.text, r.next) for r in docs)
    texts = [(d, t or "") for d, t in sorted(rows, key=lambda r: -r[0])]
    want = sorted((d, t, texts[(i + 1) % len(texts)][1]) for i, (d, t) in enumerate(texts))
    assert got[1] == got[3] == got[50] == want
    rows_out = winnow.fingerprint_edits(spark.createDataFrame(rows, DOCS)).collect()
    edited = [(d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for d, t, n in want]
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows_out) == sorted(edited)
    out = {r.doc_id: r for r in rows_out}
    assert out[9].fingerprint == "" and len({r.fingerprint for r in rows_out if r.doc_id == 1}) == 1 and 0 <= out[7].near_edited <= 1
    assert winnow.fingerprint_edits(spark.createDataFrame([], DOCS)).count() == 0
    one = winnow.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f g")], DOCS)).first()
    assert one.near_next == 1.0
