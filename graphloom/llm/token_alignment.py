"""Alignment of two tokenizers over the same bytes: overlaps of tokens, the groups between common ends, pair counts of the corpus.

Both tokenizers cut the bytes of a space and the text into intervals. In each
task DuckDB holds the intervals of a batch of documents as two tables on one
axis; as each table covers the axis without gaps, two ASOF joins give all
overlaps: every A token with the B token over its start, and every B token
that starts inside an A token with that token. Window sums over the starts
that both have number the groups. A batch's pair counts go to Spark, which
adds them up; documents keep their own pairs, packed, so nothing is encoded
twice.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, limit_batches, map_arrow, without

#: A batch of documents ends at so many bytes of text, or with its first document.
BATCH_BYTES = 4 << 20
#: Pair counts over the corpus are sent to all tasks up to so many pairs (24 bytes each); beyond, documents' pairs are joined with them.
MAX_BROADCAST_PAIRS = 4_000_000

OWN = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

#: The number of common starts up to an A token is the number of its group, and that of the B tokens that start inside it.
_OVERLAPS = """
CREATE OR REPLACE TEMP TABLE over_a AS SELECT a.d, a.s, a.id AS a, b.id AS b, a.s = b.s AS both_start FROM a ASOF JOIN b ON a.s >= b.s;
CREATE OR REPLACE TEMP TABLE numbered AS SELECT s, a, sum(both_start::INT) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING)::INT AS g FROM over_a;
CREATE OR REPLACE TEMP TABLE over_b AS SELECT b.d, b.s, n.a AS a, b.id AS b, n.s = b.s AS both_start, n.g AS g FROM b ASOF JOIN numbered n ON b.s >= n.s;
"""
#: Links by document; those of ``over_b`` whose tokens start together are in ``over_a`` already.
_PAIRS = """
CREATE OR REPLACE TEMP TABLE pairs AS
SELECT d, a::BIGINT * {wide} + b AS pair, count(*) AS n FROM (SELECT d, a, b FROM over_a UNION ALL SELECT d, a, b FROM over_b WHERE NOT both_start) GROUP BY ALL
"""

def byte_level_table(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; ids of special tokens stand for their own text."""
    from tokenizers import Tokenizer

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


def piece_table(path: str) -> list[bytes]:
    """Bytes of each id of a piece model: U+2581 is a space, ``<0xHH>`` a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


#: Characters whose classes no version of Unicode changed; two regular-expression engines cut texts of them alike.
_SETTLED = re.compile("[^\t\n\r -~\u00a1-\u024f]")
#: Fixed value: the pattern that cuts texts before byte-level merges.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(path: str, table: list[bytes]):
    """An encoder by ranks that gives what the vocabulary at ``path`` gives, three times as fast; None if its ids are not its merges' order or it cuts texts otherwise."""
    import tiktoken

    own = json.loads(Path(path).read_text())
    first, model = own.get("pre_tokenizer") or {}, own["model"]
    special = {t["id"] for t in own.get("added_tokens", [])}
    plain = own.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not model.get("ignore_merges")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [model["vocab"].get(x + y) for x, y in pairs]
    if not plain or None in made or made != sorted(made) or not set(range(len(table))) - special >= set(made):
        return None
    ranks = {b: i for i, b in enumerate(table) if i not in special}
    return tiktoken.Encoding("aligned", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Encoders and tables of one worker, kept between batches."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_table(path_a), piece_table(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.fast, self.wide = rank_encoder(path_a, self.bytes_a), len(self.bytes_b)
        # The text of an id by what follows it: the same side, the other side, or another group.
        self.said = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))] + [f"{i}{end}" for end in ",;" for i in range(self.wide)]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "preserve_insertion_order": True})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both; None where a side's bytes are not those of the space and the text."""
        whole = " " + text
        data = whole.encode()
        fast = self.fast is not None and len(text) < 1 << 20 and not _SETTLED.search(text)
        a = self.fast.encode_to_numpy(whole, disallowed_special=()) if fast else self.a.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        # Ranks cut every text into its own bytes; what the libraries give is compared with them.
        if not fast and b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        return np.asarray(a, np.int64), np.array(b, np.int64)

    def align(self, texts: list[str | None]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, packed pairs) of each text, and the pairs of all texts with their counts."""
        coded = [self.encode(t) if t else None for t in texts]
        known = [c for c in coded if c is not None]
        blank = (0, 0, 0, 0, "", b"")
        if not known:
            return [blank] * len(texts), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        a, b = (np.concatenate([c[i] for c in known]) for i in (0, 1))
        ends_a, ends_b = (np.cumsum([0] + [len(c[i]) for c in known]) for i in (0, 1))
        for name, ids, ends, length in (("a", a, ends_a, self.len_a), ("b", b, ends_b, self.len_b)):
            # The intervals of a document follow those of the one before, so both sides cover one axis.
            own = length[ids]
            start = np.cumsum(own) - own
            narrow = np.int32 if start[-1] < 1 << 31 else np.int64
            self.db.register(name, pa.table({"d": np.repeat(np.arange(len(known), dtype=np.int32), np.diff(ends)), "s": start.astype(narrow), "id": ids.astype(np.int32)}))
        self.db.execute(_OVERLAPS)
        self.db.execute(_PAIRS.format(wide=self.wide))
        group_a, group_b = (self._in_order(x) for x in ("numbered", "over_b"))
        d, pair, n = self.db.execute("SELECT d, pair, n FROM pairs ORDER BY d, pair").fetchnumpy().values()
        whole = tuple(self.db.execute("SELECT pair, sum(n)::BIGINT AS n FROM pairs GROUP BY pair ORDER BY pair").fetchnumpy().values())
        self.db.unregister("a")
        self.db.unregister("b")
        cuts = np.searchsorted(d, np.arange(len(known) + 1))
        said, order_end = self._render(a, b, group_a, group_b, ends_a, ends_b)
        rows, k = [], 0
        for c in coded:
            if c is None:
                rows.append(blank)
                continue
            at = slice(cuts[k], cuts[k + 1])
            groups = int(group_a[ends_a[k + 1] - 1] - group_a[ends_a[k]] + 1)
            text = "".join(map(self.said.__getitem__, said[order_end[k] : order_end[k + 1]].tolist()))[:-1]
            rows.append((len(c[0]), len(c[1]), groups, len(c[0]) + len(c[1]) - groups, hashlib.sha256(text.encode()).hexdigest(), pack(pair[at], n[at])))
            k += 1
        return rows, whole

    def _in_order(self, table: str) -> np.ndarray:
        """The groups of tokens in the order of the axis."""
        s, g = self.db.execute(f"SELECT s, g FROM {table}").fetchnumpy().values()
        return g[np.argsort(s, kind="stable")].astype(np.int64)

    def _render(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts in ``said`` in the order of the groups, A's tokens first in each, and the places where documents begin."""
        n = int(group_a[-1])
        before_a, before_b = (np.concatenate([[0, 0], np.cumsum(np.bincount(g, minlength=n + 1)[1:])]) for g in (group_a, group_b))
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        out[np.arange(len(a)) + before_b[group_a]] = a + last_a * len(self.bytes_a)
        out[np.arange(len(b)) + before_a[group_b + 1]] = b + last_b * self.wide + 2 * len(self.bytes_a)
        return out, ends_a + ends_b


def pack(pair: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs as differences, then their counts, 4 bytes each where that is enough."""
    step = np.diff(pair, prepend=0)
    kind = np.uint32 if not len(pair) or max(step.max(), n.max()) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + step.astype(kind).tobytes() + n.astype(kind).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(data, np.uint32 if data[0] == 4 else np.uint64, offset=1).astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut by bytes of text, so that what DuckDB holds does not follow the number of rows."""
    for batch in batches:
        sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text).cast(pa.large_string())])
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", max_broadcast: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (all bigint but the last).

    A is a byte-level vocabulary of the tokenizers library, B a piece model.
    Links are overlaps of A and B tokens; the count of an id pair is that of
    its links in all documents; n_best counts the links whose pair has the
    greatest count of its B id, ties included; count_sum adds the counts over
    the links. Null and empty texts, and texts that a side does not give back
    byte by byte, have zeros and an empty groups_sha256. Repeated rows each
    count and each stay; an empty table gives an empty table; columns named
    like the results give way to them.
    """
    spark = docs.sparkSession
    limit_batches(spark, 4096)
    rest = without(docs, text, *OWN)
    kept = docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(f"`{text}`").cast("string").alias(text))
    width = len(rest.columns)
    fields = [("row", T.LongType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()), ("packed", T.BinaryType()), ("batch", T.BooleanType())]
    schema = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(rest.schema.fields)] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in _batches(batches, width):
            rows, whole = aligner.align(batch.column(width).to_pylist())
            n = len(rows)
            own = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.binary())]
            names = [f"c{i}" for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(np.arange(row, row + n)), *own, pa.array([False] * n)], names=names)
            row += n
            empty = [pa.nulls(1, c.type) for c in batch.columns[:width]] + [pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.string())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([pack(*whole)], pa.binary()), pa.array([True])], names=names)

    aligned = cut(map_arrow(kept, run, schema), "aligned", compression="zstd")
    wide = len(piece_table(path_b))
    counts = _pair_counts(aligned.where("batch"), wide)
    found = aligned.where("NOT batch")
    small = counts.limit(max_broadcast + 1).count() <= max_broadcast
    scored = _score_sent(found, counts) if small else _score_joined(found, counts)
    own = [F.col(f"k{i}") for i in range(width)]
    out = scored.select(*own, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return out.toDF(*rest.columns, *OWN)


def _exploded(packed: DataFrame, *keys: str) -> DataFrame:
    """(keys, pair, n) of packed pairs."""
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(len(keys)).to_pylist()):
                pair, n = unpack(data)
                for at in range(0, len(pair), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    same = [batch.column(k).take(pa.array(np.full(len(pair[part]), i))) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(pair[part]), pa.array(n[part])], names=[f"c{j}" for j in range(len(keys) + 2)])

    return map_arrow(packed.select(*keys, "packed"), run, schema)


def _pair_counts(batches: DataFrame, wide: int) -> DataFrame:
    """(pair, count, best) over the corpus, from the batches' counts; best: no other pair of the B id has more."""
    counts = _exploded(batches).groupBy("pair").agg(F.sum("n").alias("count"))
    # A B id has as many pairs as A has ids at most.
    most = F.max("count").over(Window.partitionBy(F.col("pair") % wide))
    return cut(counts.withColumn("best", F.col("count") == most), "pair-counts")


def _score_sent(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds n_best and count_sum by looking pairs up in the counts, which every task gets."""
    table = counts.orderBy("pair").toArrow()
    sent = found.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "count", "best")))
    schema = T.StructType([f for f in found.schema.fields if f.name != "packed"] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = [f.name for f in found.schema.fields if f.name != "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = sent.value
        for batch in batches:
            sums = []
            for data in batch.column(len(names)).to_pylist():
                pair, n = unpack(data)
                at = np.searchsorted(pairs, pair)
                sums.append((int(n[best[at]].sum()), int((n * count[at]).sum())) if len(at) else (0, 0))
            own = [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *own], names=[f"c{i}" for i in range(len(names) + 2)])

    return map_arrow(found.select(*names, "packed"), run, schema)


def _score_joined(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of all documents' pairs with the counts."""
    linked = _exploded(found, "row").join(counts, "pair")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return found.drop("packed").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
