"""Benchmark decontamination by SimHash of item-sized windows.

Items are grouped by length into classes of a ratio of 1.2. The windows of a
class have the length of its shortest item; documents and items are
fingerprinted at every place, from running sums. A window's 64-bit SimHash is
the sign of the sums of its words' bits, each word weighted by its rarity
among all items.

Fingerprints are cut into four blocks of 16 bits. Two fingerprints within
``radius`` differ by at most radius // 4 bits in some block, so tables of all
block values that near an item's block find every item fingerprint within the
radius. Candidates are verified exactly: the weighted share of the item's
word shingles that stand in the document around the aligned place.

Edited or cut passages may reach the similarity and yet leave the radius. So
items are looked up by their shingles as well: the rarest that together weigh
more than what an item may lack. A text without any of them cannot reach the
similarity, and for each that has one the greatest share is computed over all
places. Items of fewer than ``MIN_WORDS`` words, whose shingles chance would
find, count only where all their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_batches
from .shingles import U, fold_latin, shingle_hashes, text_buffers, word_hashes

RADIUS, BLOCKS = 11, 4
SHINGLE = 3
SIMILARITY = 0.5
MIN_WORDS = 6
PASS_BYTES = 128 << 20
NARROW = 8191  # words of weights up to 4 whose sums 16 bits hold
RATIO = 1.2
ROWS = 1 << 14
SIEVE = 1 << 18  # low bits of shingles that let most be passed over
# White space and ASCII punctuation part words.
SPLIT = np.zeros(256, bool)
SPLIT[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, ends = text_buffers(column)
    return word_hashes(fold_latin(data), ends, spaces=SPLIT)


def common_words(words: np.ndarray, counts: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, sorted, that weigh less than 4, and their weights: 4 if at most one item in 100 holds the word, down to 1."""
    share = counts / max(1, items)
    weight = np.where(share <= 0.01, 4, np.where(share <= 0.05, 3, np.where(share <= 0.2, 2, 1))).astype(np.int8)
    light = weight < 4
    order = np.argsort(words[light], kind="stable")
    return words[light][order], weight[light][order]


def count_common_words(items: DataFrame, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``common_words`` of all (text) items of ``min_words`` words or more, counted by Spark.

    Only words that more than one item in 100 holds come to the driver, so at
    most 100 times as many as an item has on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = words_of(batch.column(0))
            own = [np.unique(words[ends[i] : ends[i + 1]]) for i in range(len(batch)) if ends[i + 1] - ends[i] >= min_words]
            some = np.concatenate(own) if own else words[:0]
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(np.zeros(len(some), np.int64))], names=["word", "items"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(own)], pa.int64())], names=["word", "items"])

    counted = items.select("text").mapInArrow(run, "word long, items long").groupBy("word").agg(F.count("*").alias("n"), F.sum("items").alias("items"))
    total = counted.where("word IS NULL").agg(F.sum("items")).first()[0] or 0
    rows = counted.where("word IS NOT NULL").where(F.col("n") * 100 > total).collect()
    return common_words(np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64), total)


@dataclass
class LengthClass:
    """Items of about one length, the fingerprints of their windows, and for each block the table of near values."""

    window: int
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def near_masks(bits: int, most: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int64)


class Items:
    """Everything that executors need of one pass of items; ``item_bytes`` says how much an item takes."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = RADIUS, shingle: int = SHINGLE, min_words: int = MIN_WORDS, least: float = SIMILARITY, common: tuple[np.ndarray, np.ndarray] | None = None):
        self.radius, self.shingle, self.least = radius, shingle, least
        words, ends = words_of(pa.array(texts, pa.string()))
        own = {i: words[ends[i] : ends[i + 1]] for i in range(len(ids)) if ends[i + 1] - ends[i] >= min_words}
        self.ids = ids
        # Short items by their number of words: the hash of all words, sorted, and whose it is.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, min_words):
            those = np.flatnonzero(np.diff(ends) == n)
            if len(those):
                hashes = np.array([shingle_hashes(words[ends[i] : ends[i + 1]], n)[0] for i in those])
                order = np.argsort(hashes, kind="stable")
                self.short[n] = hashes[order], those[order]
        # Without a count over all items these are all there are.
        self.known, self.weight = common if common is not None else common_words(*np.unique(np.concatenate([np.unique(w) for w in own.values()]) if own else np.zeros(0, np.uint64), return_counts=True), len(own))
        self.words = own
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, w in own.items():
            self.parts[i] = self.weighted_shingles(w)
        self.sought, self.sought_at, self.sought_of = self.needed_shingles()
        self.sought_bits = np.zeros(SIEVE, bool)
        self.sought_bits[self.sought & U(SIEVE - 1)] = True
        self.classes: list[LengthClass] = []
        order = sorted(own, key=lambda i: (len(own[i]), i))
        at = 0
        while at < len(order):
            n = len(own[order[at]])
            window = n
            members = [i for i in order[at:] if len(own[i]) <= RATIO * n]
            at += len(members)
            c = LengthClass(window)
            rows = [(i, o) for i in members for o in range(len(own[i]) - window + 1)]
            c.owner, c.offset = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            joined = np.concatenate([own[i] for i in members])
            starts = np.cumsum([0] + [len(own[i]) for i in members[:-1]])
            first = dict(zip(members, starts.tolist(), strict=True))
            places = np.array([first[i] + o for i, o in rows])
            c.prints = fingerprints(self.bit_sums(joined), window)[places]
            for b in range(BLOCKS):
                value = ((c.prints >> U(16 * b)) & U(0xFFFF)).astype(np.int64)
                near = (value[:, None] ^ near_masks(16, radius // BLOCKS)[None, :]).ravel()
                order_of = np.argsort(near, kind="stable")
                owner = np.repeat(np.arange(len(value), dtype=np.int32), len(near) // max(1, len(value)))[order_of]
                starts = np.searchsorted(near[order_of], np.arange(65537)).astype(np.int32)
                c.tables.append((starts, owner, starts[1:] > starts[:-1]))
            self.classes.append(c)

    def weights(self, words: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(words), 4, np.int8)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.weight[at], 4).astype(np.int8)

    def weighted_shingles(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, sorted, and their weights: the sum of their words' weights."""
        weight = self.weights(words).astype(np.int64)
        k = min(self.shingle, len(words))
        total = np.convolve(weight, np.ones(k, np.int64), "valid") if len(words) else weight
        hashes, first = np.unique(shingle_hashes(words, self.shingle), return_index=True)
        return hashes, total[first]

    def needed_shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles, sorted, of which a text has one at least for each item that reaches ``least``; the owners of shingle i are from place i to i + 1."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        every, held = np.unique(np.concatenate([h for h, _ in self.parts.values()]), return_counts=True)
        taken, owners = [], []
        for i, (hashes, weight) in self.parts.items():
            order = np.lexsort((hashes, -weight, held[np.searchsorted(every, hashes)]))
            # Those before and the last one weigh more than 1 - least of all, with room for rounding.
            before = np.cumsum(weight[order]) - weight[order]
            own = hashes[order[before <= (1 - self.least) * weight.sum() + 1e-6]]
            taken.append(own)
            owners.append(np.full(len(own), i, np.int64))
        joined = np.concatenate(taken)
        order = np.argsort(joined, kind="stable")
        sought, first = np.unique(joined[order], return_index=True)
        return sought, np.append(first, len(joined)), np.concatenate(owners)[order]

    def bit_sums(self, words: np.ndarray) -> np.ndarray:
        """Running sums of the words' weighted bits; 16 bits where they hold all sums, so that they can be compared."""
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
        bits = (2 * bits - 1) * self.weights(words)[:, None]
        kind = np.int16 if len(words) <= NARROW else np.int32
        sums = np.zeros((len(words) + 1, 64), kind)
        np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
        return sums

    def candidates(self, c: LengthClass, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, item window) for all pairs within the radius."""
        at, to = [], []
        quarters = np.ascontiguousarray(prints.astype("<u8").view("<u2").reshape(-1, BLOCKS).T)
        for value, (starts, owner, any_) in zip(quarters, c.tables, strict=True):
            met = np.flatnonzero(any_[value])
            if not len(met):
                continue
            own = value[met].astype(np.int32)
            first = starts[own]
            n = starts[own + 1] - first
            total = int(n.sum())
            place = np.repeat(met, n)
            item = owner[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            close = np.bitwise_count(prints[place] ^ c.prints[item]) <= self.radius
            at.append(place[close])
            to.append(item[close])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(to)

    def similarity(self, item: int, words: np.ndarray, start: int) -> float:
        """Weighted share of the item's shingles that stand at ``start``, give or take a quarter of its length."""
        n = len(self.words[item])
        hashes, weight = self.parts[item]
        near = shingle_hashes(words[max(0, start - n // 4) : max(0, start) + n + n // 4], self.shingle)
        return float(weight[np.isin(hashes, near)].sum() / weight.sum())

    def sharing(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(text, item), sorted and distinct, where the text has a needed shingle of the item."""
        k, pairs = self.shingle, []
        if not len(self.sought):
            return []
        for lo in range(0, len(words), ROWS):
            own = words[lo : lo + ROWS + k - 1]
            if len(own) < k:
                break
            hashes = shingle_hashes(own, k)
            maybe = np.flatnonzero(self.sought_bits[hashes & U(SIEVE - 1)])
            at = np.minimum(np.searchsorted(self.sought, hashes[maybe]), len(self.sought) - 1)
            there = self.sought[at] == hashes[maybe]
            at, place = at[there], maybe[there] + lo
            text = np.searchsorted(ends, place, "right") - 1
            inside = place + k <= ends[text + 1]
            # A text meets a shingle once however often it has it.
            met = np.unique(text[inside] * len(self.sought) + at[inside])
            text, at = met // len(self.sought), met % len(self.sought)
            n = self.sought_at[at + 1] - self.sought_at[at]
            owner = self.sought_of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.sought_at[at], n)]
            pairs.append(np.unique(np.repeat(text, n) * len(self.ids) + owner))
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return [divmod(int(x), len(self.ids)) for x in found]

    def greatest(self, item: int, words: np.ndarray, grams: np.ndarray, known: float) -> tuple[float, int] | None:
        """The greatest similarity over all places of a text and where the item begins there, if it exceeds ``known`` and reaches ``least``."""
        n = len(self.words[item])
        hashes, weight = self.parts[item]
        total = weight.sum()
        at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        place = np.flatnonzero(hashes[at] == grams)
        which = at[place]
        there = np.bincount(which, minlength=len(hashes)) > 0
        if float(weight[there].sum() / total) < max(self.least, np.nextafter(known, 2)):
            return None
        # A shingle at p counts for the places from which p is seen but its last occurrence before p is not.
        seen = n + 2 * (n // 4) - self.shingle
        order = np.argsort(which, kind="stable")
        last = np.full(len(place), -1, np.int64)
        again = which[order[1:]] == which[order[:-1]]
        last[order[1:][again]] = place[order[:-1][again]]
        begin = np.maximum(np.maximum(last + 1, place - seen), 0)
        steps = np.bincount(begin, weight[which], len(grams) + 1) - np.bincount(place + 1, weight[which], len(grams) + 1)
        score = np.rint(np.cumsum(steps)).astype(np.int64)
        best = int(score.argmax())
        value = float(score[best] / total)
        if value < self.least or value <= known:
            return None
        inside = (place >= best) & (place <= best + seen)
        offset = np.searchsorted(hashes, shingle_hashes(self.words[item], self.shingle))
        first = np.zeros(len(hashes), np.int64)
        first[offset[::-1]] = np.arange(len(offset))[::-1]
        starts, counts = np.unique(np.maximum(0, place[inside] - first[which[inside]]), return_counts=True)
        for start in starts[np.argsort(-counts, kind="stable")].tolist():
            if self.similarity(item, words, start) == value:
                return value, start
        return value, best + n // 4

    def consecutive(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, place) of the short items' first occurrences."""
        found = {}
        for n, (hashes, owner) in self.short.items():
            for lo in range(0, len(words), ROWS):
                own = words[lo : lo + ROWS + n - 1]
                if len(own) < n:
                    break
                grams = shingle_hashes(own, n)
                at, to = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
                for place in np.flatnonzero(to > at).tolist():
                    text = int(np.searchsorted(ends, place + lo, "right")) - 1
                    if place + lo + n <= ends[text + 1]:
                        for item in owner[at[place] : to[place]].tolist():
                            found.setdefault((text, item), int(place + lo - ends[text]))
        return [(t, i, place) for (t, i), place in found.items()]

    def find(self, words: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item) to (greatest similarity, minus the word where the item begins) of all verified candidates."""
        tried: dict[tuple[int, int, int], float] = {}
        best: dict[tuple[int, int], tuple[float, int]] = {(t, i): (1.0, -place) for t, i, place in self.consecutive(words, ends)}
        widest = max((c.window for c in self.classes), default=0)
        step = NARROW - widest if widest <= NARROW // 2 else max(ROWS, widest)
        for lo in range(0, len(words) if self.classes else 0, step):
            # Windows that begin in this part of the words; none leaves its text.
            hi = min(len(words), lo + step)
            sums = self.bit_sums(words[lo : min(len(words), hi + widest)])
            text_of = np.searchsorted(ends, np.arange(lo, hi), "right") - 1
            for c in self.classes:
                prints = fingerprints(sums, c.window)[: hi - lo]
                place = np.flatnonzero(np.arange(lo, lo + len(prints)) + c.window <= ends[text_of[: len(prints)] + 1])
                at, to = self.candidates(c, prints[place])
                place = place[at]
                text = text_of[place]
                for t, item, start in sorted(set(zip(text.tolist(), c.owner[to].tolist(), (lo + place - ends[text] - c.offset[to]).tolist(), strict=True))):
                    if (t, item, start) not in tried:
                        tried[t, item, start] = value = self.similarity(item, words[ends[t] : ends[t + 1]], start)
                        best[t, item] = max(best.get((t, item), (0.0, 0)), (value, -max(0, start)))
        text, grams = -1, words[:0]
        for t, item in self.sharing(words, ends):
            if t != text:
                text, grams = t, shingle_hashes(words[ends[t] : ends[t + 1]], self.shingle)
            if more := self.greatest(item, words[ends[t] : ends[t + 1]], grams, best.get((t, item), (0.0, 0))[0]):
                best[t, item] = (more[0], -more[1])
        return best


def fingerprints(sums: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of the windows at all places of the running sums."""
    n = max(0, len(sums) - window)
    return np.packbits(sums[window:] > sums[:n], axis=1).view(np.uint64).ravel() if n else np.zeros(0, np.uint64)


def item_bytes(text: Column, radius: int) -> Column:
    """At most what an item takes in ``Items``: a word has two bytes of text, a class's items are a fifth longer than its windows at most."""
    words = F.octet_length(text) / 2 + 1
    near = len(near_masks(16, radius // BLOCKS)) * BLOCKS
    return (words * (RATIO - 1) / RATIO + 1) * (12 * near + 32) + 64 * words


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, item_id, similarity, start_word) for each text and each item that it holds.

    Words part at ASCII white space and punctuation; ASCII and Latin-1
    capitals count as small letters. similarity: the greatest weighted share of
    the item's 3-word shingles found in one place of the text, at least
    ``similarity``, and no place that reaches it is missed; start_word: where that
    is (ties: the first aligned one). Items of fewer than ``min_words`` words
    are held by texts in which all their words stand consecutively. Items
    without words and null items are held by none. Items pass in blocks of
    about ``PASS_BYTES`` in memory; a longer item is a block of its own size.
    ``key`` can be of any type and null. Null and empty texts hold nothing.
    Repeated rows give repeated results; other columns are dropped.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    listed = items.select(F.col(f"`{item_key}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL").distinct()
    own = docs.select(F.col(f"`{key}`").alias("c0"), F.col(f"`{text}`").alias("c1"))
    total = listed.agg(F.sum(item_bytes(F.col("text"), radius)).alias("n")).first()["n"] or 0
    passes = max(1, int(-(-total // PASS_BYTES)))
    # Every pass weighs words alike, so results do not depend on how items fall into passes.
    common = count_common_words(listed, min_words) if passes > 1 else None
    kind = own.schema["c0"].dataType
    shape = T.StructType([T.StructField("c0", kind), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType())])
    out = None
    for p in range(passes):
        block = listed if passes == 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        rows = sorted(block.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        known = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], radius, min_words=min_words, least=similarity, common=common))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            table = known.value
            for batch in batches:
                words, ends = words_of(batch.column("c1"))
                best: dict[tuple[int, int | None], tuple[float, int]] = {}
                for (t, item), value in table.find(words, ends).items():
                    if value[0] >= similarity:
                        name = (t, table.ids[item])
                        best[name] = max(best.get(name, (0.0, 0)), value)
                keys = list(best)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("c0").take(pa.array([t for t, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.int64()), pa.array([best[x][0] for x in keys], pa.float64()), pa.array([-best[x][1] for x in keys], pa.int64())],
                    names=["c0", "item_id", "similarity", "start_word"])

        found = own.mapInArrow(run, shape).withColumnRenamed("c0", key)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose key holds no item; rows with a null key stay unless a null-keyed row holds one. Columns can have any names; repeated rows share their fate, an empty table stays empty."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    bad = find_leaks(docs, items, key=key, **options).toDF("b0", "b1", "b2", "b3").select("b0").distinct()
    own = docs.select(F.col(f"`{key}`").alias("k0"), *[F.col(f"`{c}`") for c in docs.columns]).toDF("k0", *names)
    return own.join(bad, F.col("k0").eqNullSafe(F.col("b0")), "left_anti").select(*names).toDF(*docs.columns)
