"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the codewords has a binary
classifier on character n-grams, hashed trigrams of UTF-8 bytes with
everything that is no letter read as a blank. A bit's weights are the log
ratios of the trigram frequencies of the languages on either side; a
logistic curve turns its mean over a text into a margin. Decoding sums
logistic losses over the bits, each weighted by how well the bit's
classifier separated the sample, and picks the codeword of least loss; near
second codewords flag a text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, limit_batches, map_arrow, without
from .shingles import fold_latin, text_buffers

HASH_BITS = 16
NONE = 1 << HASH_BITS
SAMPLE_ROWS, CURVE_ROWS = 6000, 1500
AMBIGUOUS = 0.8
PART = 1 << 18

# 0: not a letter; 1 to 26: a to z; 27 on: bytes of other characters.
CLASS = np.zeros(256, np.uint32)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)


def trigram_places(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bucket for the trigram that begins at each byte; ``NONE`` where it leaves its text or has no letter in its middle."""
    c = CLASS[fold_latin(data)]
    if len(c) < 3:
        return np.full(len(c), NONE, np.int64)
    wide = np.concatenate([c, np.zeros(2, np.uint32)])
    code = (wide[:-2] * np.uint32(155) + wide[1:-1]) * np.uint32(155) + wide[2:]
    place = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
    place[wide[1:-1] == 0] = NONE
    for back in (1, 2):
        at = ends[1:] - back
        place[at[at >= ends[:-1]]] = NONE
    return place


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1 that differ in many bits.

    Up to 5 languages: the exhaustive code of 2**(n - 1) - 1 bits. Beyond:
    of 64 drawn codes of 8 log2 n bits that whose nearest words differ most.
    """
    if n <= 1:
        return np.ones((n, 1), np.int64)
    if n <= 5:
        bits = [[1] + [1 if (j >> i) & 1 else -1 for i in range(n - 1)] for j in range(2 ** (n - 1) - 1)]
        return np.array(bits).T
    width = int(np.ceil(8 * np.log2(n)))
    best, most = None, -1
    for seed in range(64):
        code = np.where(np.random.Generator(np.random.PCG64(seed)).random((n, width)) < 0.5, -1, 1)
        apart = (width - code @ code.T) // 2
        least = apart[~np.eye(n, dtype=bool)].min() if np.all(abs(code.sum(0)) < n) else -1
        if least > most:
            best, most = code, least
    return best


class Model:
    """languages, codewords (languages x bits), weights (buckets + 1 x bits), and each bit's slope, shift and worth."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: list[tuple[int, np.ndarray, np.ndarray]]):
        self.languages = languages
        self.code = codewords(len(languages))
        share = counts + 0.5
        share /= share.sum(axis=1, keepdims=True)
        bits = self.code.shape[1]
        self.weights = np.zeros((NONE + 1, bits), np.float32)
        for b in range(bits):
            yes, no = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if len(yes) and len(no):
                self.weights[:NONE, b] = np.log(yes.mean(axis=0) / no.mean(axis=0))
        self.slope, self.shift, self.worth = np.ones(bits), np.zeros(bits), np.ones(bits)
        if documents and len(languages) > 1:
            means = np.array([n @ self.weights[at] / n.sum() for _, at, n in documents])
            truth = self.code[[k for k, _, _ in documents]]
            for b in range(bits):
                self.slope[b], self.shift[b], self.worth[b] = self._fit(means[:, b], truth[:, b])

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
        """A logistic curve by damped Newton steps; worth: its accuracy over chance, squared."""
        scale = 1 / max(1e-9, float(np.abs(x).mean()))
        a, c, z = 1.0, 0.0, x * scale
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            g = p - (y > 0)
            h = p * (1 - p)
            haa, hac, hcc = (h * z * z).sum() + 1.0, (h * z).sum(), h.sum() + 1.0
            ga, gc = (g * z).sum() + (a - 1), g.sum() + c
            det = haa * hcc - hac * hac
            a, c = a - (hcc * ga - hac * gc) / det, c - (haa * gc - hac * ga) / det
        right = float(((a * z + c > 0) == (y > 0)).mean())
        return max(a, 0.1) * scale, c, max(0.05, 2 * right - 1) ** 2

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its language's number, score and whether it is ambiguous."""
        n, bits = len(ends) - 1, self.weights.shape[1]
        sums, seen = np.zeros((n, bits)), np.zeros(n)
        for lo in range(0, max(1, len(data)), PART):
            hi = min(len(data), lo + PART)
            # Two bytes on either side complete the trigrams that begin in this part.
            texts = np.arange(np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left"))
            texts = texts[(ends[texts + 1] > lo) & (ends[texts] < hi)]
            if not len(texts):
                continue
            wide = min(len(data), hi + 2)
            local = np.concatenate([np.clip(ends[texts], lo, wide), [np.clip(ends[texts[-1] + 1], lo, wide)]]) - lo
            place = trigram_places(data[lo:wide], local)[: hi - lo]
            starts = np.clip(ends[texts], lo, hi) - lo
            sums[texts] += np.add.reduceat(self.weights[place], starts, axis=0)
            seen[texts] += np.add.reduceat((place != NONE).astype(np.int64), starts)
        margin = (sums / np.maximum(1, seen)[:, None]) * self.slope + self.shift
        losses = (np.logaddexp(0, -self.code[None, :, :] * margin[:, None, :]) * self.worth).sum(axis=2)
        least = losses.argmin(axis=1)
        odds = np.exp(-(losses - losses.min(axis=1, keepdims=True)))
        score = 1 / odds.sum(axis=1)
        return least, score, (score < AMBIGUOUS) | (seen == 0)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, curve_rows: int = CURVE_ROWS) -> Model | None:
    """A model from a sample of about ``sample_rows`` rows (all, if there are fewer); None without labelled texts.

    Every language has the same share of the sample, or all its texts where
    they are fewer. Rows enter by a hash of their text, and rows alike in text
    and label count and enter once, so the sample is the same however the
    table is partitioned and however often a text is repeated. Whole texts are counted; sums by
    language and bucket are made in Spark, so at most languages x 65536
    numbers come to the driver, and for the bits' curves the counts of about
    ``curve_rows`` texts, again chosen by a hash of the text. Rows with a null
    text or label teach nothing.
    """
    limit_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # One row a language.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    share = -(-sample_rows // max(1, len(sizes)))
    total = sum(min(n, share) for n in sizes.values())
    if large := {k: n for k, n in sizes.items() if n > share}:
        most = F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, int(share / n * (1 << 30)))])
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(most, F.col("lang")), F.lit(1 << 30)))
    rows = rows.dropDuplicates(["text", "lang"])
    for_curve = F.pmod(F.xxhash64(F.lit(1), F.col("text")), F.lit(1 << 20)) < int(min(1.0, curve_rows / max(1, total)) * (1 << 20))
    rows = rows.withColumn("curve", for_curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, curve = batch.column("lang").to_pylist(), batch.column("curve").to_pylist()
            data, ends = text_buffers(batch.column("text"))
            langs, places, counts, shares, curves = [], [], [], [], []
            for i, name in enumerate(names):
                place = trigram_places(data[ends[i] : ends[i + 1]], np.array([0, ends[i + 1] - ends[i]]))
                own = np.bincount(place, minlength=NONE + 1)[:NONE]
                at = np.flatnonzero(own)
                if len(at):
                    langs.append(name)
                    places.append(at.astype(np.int32))
                    counts.append(own[at].astype(np.int32))
                    # A text counts once, whatever its length, up to a thousand trigrams' worth.
                    shares.append(min(1.0, 1000 / own.sum()))
                    curves.append(curve[i])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(shares, pa.float64()), pa.array(curves, pa.bool_())], names=["lang", "places", "counts", "share", "curve"])

    counted = cut(rows.mapInArrow(run, "lang string, places array<int>, counts array<int>, share double, curve boolean"), "trigrams")
    # Whole millionths add up alike in any order.
    each = counted.select("lang", "share", F.explode(F.arrays_zip("places", "counts")).alias("z"))
    sums = each.groupBy("lang", F.col("z.places").alias("place")).agg(F.sum(F.round(F.col("z.counts") * F.col("share") * 1e6).cast("long")).alias("n")).toArrow()
    names = sums.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return None
    counts = np.zeros((len(languages), NONE))
    np.add.at(counts, (np.searchsorted(languages, names), sums.column("place").to_numpy()), sums.column("n").to_numpy() / 1e6)
    documents = [(languages.index(r["lang"]), np.array(r["places"]), np.array(r["counts"])) for r in sorted(counted.where("curve").select("lang", "places", "counts").collect())]
    drop_cut(counted)
    return Model(languages, counts, documents)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(df: DataFrame, model: Model | None, text: str = "text", unknown: str = "und") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous.

    Texts that are null or hold no letter get ``unknown``, score 0,
    ambiguous. Without a model every text does. Only the text is read. Input
    columns of these names (in any case) are replaced; the others stay.
    """
    limit_batches(df.sparkSession)
    base = without(df, "lang_pred", "score", "ambiguous")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    at = [c.lower() for c in base.columns].index(text.lower())
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            column = batch.column(at)
            data, ends = text_buffers(column)
            letters = np.add.reduceat(np.concatenate([(CLASS[data] > 0) & (data < 128), [False]]), np.minimum(ends[:-1], len(data))) if len(ends) > 1 else np.zeros(0)
            letters = np.where(np.diff(ends) > 0, letters, 0) > 0
            for i in np.flatnonzero(~letters):
                letters[i] = any(c.isalpha() for c in (column[i].as_py() or ""))
            if m is None:
                letters[:] = False
                least, score, unsure = np.zeros(len(letters), int), np.zeros(len(letters)), np.ones(len(letters), bool)
            else:
                least, score, unsure = m.predict(data, ends)
            names = [m.languages[k] if ok else unknown for k, ok in zip(least.tolist(), letters.tolist(), strict=True)] if m else [unknown] * len(letters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(unsure | ~letters)], names=[f"c{i}" for i in range(len(schema))])

    return map_arrow(base, run, schema)
