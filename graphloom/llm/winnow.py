"""Document fingerprints by winnowing.

Words (runs between ASCII white space, lower-cased) are hashed, rolling
k-grams of their hashes are hashed, and of every window of w grams the
smallest hash is chosen, the rightmost of equal ones. Positions are kept. Any
passage of at least k + w - 1 = 20 words that two texts share makes them share
a fingerprint entry. Everything is built-in array expressions on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

K, W = 5, 16
PLACE_BITS = 27
PLACES = (1 << PLACE_BITS) - 1
MAX_BUCKETS = 4096


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """Chosen grams as longs: 37 bits of hash, then 27 bits that fall as the position rises.

    So the least long is the least hash, rightmost first. A text of fewer
    than k words is one gram; of fewer than w grams, one window. Null and
    wordless texts have none. Equal texts give equal arrays. w: a power of 2.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \t-\r]+"), lambda x: x != "")
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    pack = lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(F.lit(PLACES).cast("long") - i)

    def grams(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: pack(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))
        return F.when(F.size(h) >= k, many).when(F.size(h) > 0, F.array(pack(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def shrink(step: int):
        return lambda m: F.zip_with(F.slice(m, 1, F.size(m) - step), F.slice(m, 1 + step, F.size(m) - step), lambda a, b: F.least(a, b))

    def choose(g: Column) -> Column:
        mins, step = g, 1
        while step < w:
            mins, step = let(mins, shrink(step)), 2 * step
        return F.when(F.size(g) >= w, F.array_distinct(mins)).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)

    return let(let(hashes, grams), choose)


def fingerprint_string(chosen: Column) -> Column:
    """``hash@position`` in order of position, joined by blanks."""
    return F.array_join(F.transform(chosen, lambda p: F.concat(F.lower(F.hex(F.shiftrightunsigned(p, PLACE_BITS))), F.lit("@"), (F.lit(PLACES) - p.bitwiseAND(F.lit(PLACES))).cast("string"))), " ")


def hash_set(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda p: F.shiftright(p, PLACE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(df: DataFrame, key: str, tie: Column, columns: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Adds, from the next row by descending key (after the last: the first), ``columns`` under new names.

    Keys are cut at actual values into buckets of about equal counts; the row
    that begins a bucket is also handed to the bucket before, so that one
    shuffle by bucket suffices and no task sees all rows. Ties go by ``tie``;
    null keys come last. Rows that share one key stay in one bucket.
    """
    spark = df.sparkSession
    n = min(MAX_BUCKETS, buckets or 4 * shuffle_width(spark))
    place = F.coalesce(F.col(f"`{key}`"), F.lit(-(2**63)))
    marks = df.agg(F.max(place).alias("top"), F.percentile_approx(place, [i / n for i in range(1, n)] or [0.5], 10000).alias("cuts")).first()
    bounds = sorted({marks["top"], *(marks["cuts"] or [])} - {None}, reverse=True) or [0]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    last = len(bounds) - 1
    keyed = df.withColumn("_place", place).withColumn("_bucket", F.size(F.filter(array, lambda b: b >= F.col("_place"))) - 1)
    begins = F.get(array, F.col("_bucket")) == F.col("_place")
    to = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("s")))
    before = F.array(F.struct(F.when(F.col("_bucket") == 0, last).otherwise(F.col("_bucket") - 1).alias("b"), F.lit(1).alias("s")))
    dealt = keyed.withColumn("_to", F.explode(F.when(begins, F.concat(to, before)).otherwise(to)))
    # The marks of rows that begin a bucket come after the bucket's own rows.
    order = Window.partitionBy("_to.b").orderBy("_to.s", F.desc("_place"), tie)
    led = dealt.withColumns({new: F.lead(old).over(order) for old, new in columns.items()})
    return led.where(F.col("_to.s") == 0).drop("_place", "_bucket", "_to")


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and how like they are.

    Edit: the last floor(n/2) code points give way to the first as many (or
    all) of the next document by descending key. Null texts are empty. Two
    texts without words are wholly alike. Repeated rows each get a row.
    Other columns of the input are dropped. An empty table gives none.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("fp", winnow(F.col("text")))
    paired = with_next(docs, "doc_id", F.xxhash64("text"), {"text": "next_text", "fp": "next_fp"})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    out = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    out = out.withColumn("edited_fp", winnow(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_string(F.col("fp")).alias("fingerprint"), fingerprint_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(hash_set(F.col("fp")), hash_set(F.col("edited_fp"))).alias("near_edited"), likeness(hash_set(F.col("fp")), hash_set(F.col("next_fp"))).alias("near_next"))
