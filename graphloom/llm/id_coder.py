"""Token-ID output: a context-mixing range coder over independently reset, checksummed blocks.

A block holds whole documents in order: about 2**21 ids. Its ids are dealt to
up to 8192 lanes, consecutive runs of them, which are coded in step: step t
codes the t-th id of every lane. All lanes share one adaptive model, which
starts empty in each block and learns after each step:

* order 2: the id last confirmed after the two ids before, by a hash of them;
* order 1: the id last confirmed after the id before;
* order 0: counts of ids, brought into cumulative form ever less often.

Both guesses carry a confidence (0 to 7). How often guesses of such a pair
of confidences were right sets the weights of the mixture, in which each
guess has its weight and order 0 the rest. A lane's interval is narrowed to
the part of the mixture that has its id: one arithmetic-coding step an id. A step is a few dozen numpy operations over
the lanes, so no Python runs for each id. The decoder repeats the same steps.

Layout of a block (little-endian): magic ``GLI1``, ids in the vocabulary,
documents, ids, lanes (each 4 bytes); numbers of the documents (8 bytes
each) with a null mask (1 byte each); ids of each document (4 bytes each);
16-bit words of each lane (4 bytes each); the lanes' words; CRC-32 of all
that. Every block is a row of a Parquet table, so the cluster's committer
makes the files whole even when executors are lost.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, limit_batches, shuffle_width

MAGIC = b"GLI1"
BLOCK_IDS = 1 << 21
LANES, MIN_STEPS = 8192, 48
TOTAL_BITS, SLOT_BITS, HASH_BITS = 24, 20, 16
MAX_FILES_BROADCAST = 1_000_000


class Model:
    """The adaptive mixture; ``guess`` then ``learn``, step by step, alike when coding and decoding.

    An interval of 2**24 holds the order-2 guess, the order-1 guess and all
    ids by order 0, in this order; an id is coded in the first part that has
    it.
    """

    # The next confidence: row 0 after a miss, row 1 after a hit.
    NEXT = np.array([[k >> 1 for k in range(8)], [min(k + 1, 7) for k in range(8)]], np.uint8).ravel()

    def __init__(self, n_ids: int):
        self.n = n_ids
        self.guess1 = np.zeros(n_ids, np.int64)
        self.sure1 = np.zeros(n_ids, np.uint8)
        self.guess2 = np.zeros(1 << HASH_BITS, np.int64)
        self.sure2 = np.zeros(1 << HASH_BITS, np.uint8)
        self.seen = np.ones(64)
        self.right1 = np.full(64, 0.1)
        self.right2 = np.full(64, 0.1)
        self.counts = np.zeros(n_ids, np.int64)
        self.recent: list[tuple[np.ndarray, ...]] = []
        self.step, self.due = 0, 1
        self._settle()

    def _settle(self) -> None:
        """Counts what was seen since the last time; order 0 as cumulative slots, at least one an id; the guesses' weights."""
        if self.recent:
            ids, k, hit1, hit2 = (np.concatenate(x) for x in zip(*self.recent, strict=True))
            self.recent = []
            self.counts += np.bincount(ids, minlength=self.n)
            self.seen += np.bincount(k, minlength=64)
            self.right1 += np.bincount(k[hit1 & ~hit2], minlength=64)
            self.right2 += np.bincount(k[hit2], minlength=64)
        slots = (1 << SLOT_BITS) - self.n
        sums = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.counts, out=sums[1:])
        self.cum = (sums * slots // sums[-1] if sums[-1] else np.arange(self.n + 1) * slots // self.n) + np.arange(self.n + 1)
        self.owner = None
        most = (1 << TOTAL_BITS) * 0.85
        self.weight2 = np.minimum(most, most * self.right2 / self.seen).astype(np.int64) + 1
        self.weight1 = np.minimum(most - self.weight2, most * self.right1 / self.seen).astype(np.int64) + 1

    def owners(self) -> np.ndarray:
        if self.owner is None:
            self.owner = np.repeat(np.arange(self.n), np.diff(self.cum))
        return self.owner

    def guess(self, one: np.ndarray, two: np.ndarray) -> None:
        """For each lane the guesses after ``one`` (the id before) and ``two`` (that before it), and the parts of the interval."""
        self.at1, self.at2 = one, (two * 40503 + one) & ((1 << HASH_BITS) - 1)
        self.g1, self.g2 = self.guess1[one], self.guess2[self.at2]
        self.k1, self.k2 = self.sure1[one], self.sure2[self.at2]
        self.k = (self.k1 << 3) | self.k2
        self.w2 = self.weight2[self.k]
        self.guessed = self.w2 + self.weight1[self.k]
        self.w0 = (1 << TOTAL_BITS) - self.guessed

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.hit1, self.hit2 = ids == self.g1, ids == self.g2
        low = (self.cum[ids] * self.w0) >> SLOT_BITS
        width = ((self.cum[ids + 1] * self.w0) >> SLOT_BITS) - low
        low += self.guessed
        np.copyto(low, self.w2, where=self.hit1)
        np.copyto(width, self.guessed - self.w2, where=self.hit1)
        np.copyto(low, 0, where=self.hit2)
        np.copyto(width, self.w2, where=self.hit2)
        return low, width

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose parts hold ``value``."""
        slot = ((np.maximum(value - self.guessed, 0) + 1) << SLOT_BITS) - 1
        # Exact: the quotient is below 2**24 and its fraction is a multiple of 1 / w0.
        ids = self.owners()[np.minimum((slot / self.w0).astype(np.int64), (1 << SLOT_BITS) - 1)]
        np.copyto(ids, self.g1, where=value < self.guessed)
        np.copyto(ids, self.g2, where=value < self.w2)
        return ids

    def learn(self, ids: np.ndarray) -> None:
        """Takes in ``ids``, whose ``interval`` was asked for last."""
        hit1, hit2 = self.hit1, self.hit2
        self.guess1[self.at1] = np.where(hit1 | (self.k1 > 1), self.g1, ids)
        self.sure1[self.at1] = self.NEXT[(hit1.view(np.uint8) << 3) | self.k1]
        self.guess2[self.at2] = np.where(hit2 | (self.k2 > 1), self.g2, ids)
        self.sure2[self.at2] = self.NEXT[(hit2.view(np.uint8) << 3) | self.k2]
        self.recent.append((ids, self.k, hit1, hit2))
        self.step += 1
        if self.step >= self.due:
            self.due = self.step + min(64, max(1, self.step))
            self._settle()


def _lanes(n: int) -> tuple[int, int]:
    """Steps and lanes: lane i holds ids i * steps to (i + 1) * steps."""
    steps = max(1, min(n, MIN_STEPS), -(-n // LANES))
    return steps, -(-n // steps) if n else 0


def code_ids(ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, all words)."""
    n = len(ids)
    steps, lanes = _lanes(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(n_ids)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    words = np.zeros((lanes, 2 * steps + 2), np.uint32)
    flat, place = words.reshape(-1), np.arange(lanes) * (2 * steps + 2)
    begin = place.copy()
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    last = n - (lanes - 1) * steps
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        x = grid[t, :m]
        model.guess(one[:m], two[:m])
        start, width = model.interval(x)
        r = span[:m] >> TOTAL_BITS
        low[:m] += r * start
        span[:m] = r * width
        model.learn(x)
        two, one = one, grid[t]
        small = np.flatnonzero(span[:m] < 1 << 32)
        while len(small):
            at, own = place[small], low[small]
            flat[at] = own >> 32
            place[small] = at + 1
            low[small] = (own & 0xFFFFFFFF) << 16
            left = span[small] << 16
            span[small] = left
            small = small[left < 1 << 32]
    flat[place] = (low + 0xFFFFFFFF) >> 32
    used = place + 1 - begin
    # Carries run from the last word to the first.
    for j in range(int(used.max()) - 1, 0, -1):
        words[:, j - 1] += words[:, j] >> 16
        words[:, j] &= 0xFFFF
    taken = np.arange(words.shape[1])[None, :] < used[:, None]
    return used.astype(np.uint32), words[taken].astype("<u2")


def decode_lanes(n: int, n_ids: int, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    steps, lanes = _lanes(n)
    padded = np.concatenate([words, np.zeros(3, words.dtype)])
    ends = np.cumsum(sizes.astype(np.int64))
    at = ends - sizes
    nothing = len(words)

    def take(lane: np.ndarray, k: np.ndarray) -> np.ndarray:
        return padded[np.where(k < ends[lane], k, nothing)].astype(np.int64)

    every = np.arange(lanes)
    code = (take(every, at) << 32) | (take(every, at + 1) << 16) | take(every, at + 2)
    at = at + 3
    span = np.full(lanes, 1 << 48, np.int64)
    model = Model(n_ids)
    out = np.zeros((steps, lanes), np.int64)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    last = n - (lanes - 1) * steps
    top = (1 << TOTAL_BITS) - 1
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        model.guess(one[:m], two[:m])
        r = span[:m] >> TOTAL_BITS
        # Exact, as in ``find``: both are below 2**53 and the quotient is small.
        x = model.find(np.minimum((code[:m] / r).astype(np.int64), top))
        start, width = model.interval(x)
        code[:m] -= r * start
        span[:m] = r * width
        model.learn(x)
        out[t, :m] = x
        two, one = one, out[t]
        small = np.flatnonzero(span[:m] < 1 << 32)
        while len(small):
            k = at[small]
            code[small] = (code[small] << 16) | take(small, k)
            at[small] = k + 1
            left = span[small] << 16
            span[small] = left
            small = small[left < 1 << 32]
    return out.T.reshape(-1)[:n]


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, n_ids: int) -> bytes:
    sizes, words = code_ids(ids, n_ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, "<u2"))
    body = b"".join([
        MAGIC, struct.pack("<IIII", n_ids, len(doc_ids), len(ids), len(sizes)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array(lengths, "<u4").tobytes(), sizes.astype("<u4").tobytes(), words.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document numbers, ids of each, all ids); an error if the block is damaged."""
    if data[:4] != MAGIC or len(data) < 24 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block of token ids")
    n_ids, docs, n, lanes = struct.unpack_from("<IIII", data, 4)
    at = 20
    numbers = np.frombuffer(data, "<i8", docs, at).tolist()
    nulls = data[at + 8 * docs : at + 9 * docs]
    at += 9 * docs
    lengths = np.frombuffer(data, "<u4", docs, at)
    sizes = np.frombuffer(data, "<u4", lanes, at + 4 * docs)
    words = np.frombuffer(data[at + 4 * docs + 4 * lanes : -4], "<u2")
    ids = decode_lanes(n, n_ids, sizes, words) if n else np.zeros(0, np.int64)
    return [None if z else d for d, z in zip(numbers, nulls, strict=True)], lengths, ids


# The pieces of the word vocabulary's pre-tokenizer, with its letters, digits and white space spelled out below U+0180.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_PLAIN = re.compile("[\u0000-\u001b -įı-ſ]*")


class WordEncoder:
    """Ids as the tokenizers library gives them for a lower-casing vocabulary with word ends.

    The vocabulary encodes each piece of a text by itself. Plain texts, those
    below U+0180 without dotted I, the strings of special tokens and the
    separators FS to US, are split at white space; the ids of their words are
    kept, at most ``keep`` words and one batch more. New words are cut into
    pieces, each followed by a blank as its end, and go through the rank-based
    encoder as one string. Other texts, and vocabularies of another form, go to
    the library.
    """

    def __init__(self, path: str, keep: int = 1_200_000):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        self.n_ids = self.whole.get_vocab_size(with_added_tokens=True)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in raw.get("added_tokens", [])) or r"(?!)")
        known = raw["model"].get("end_of_word_suffix") == "</w>" and json.dumps(raw["pre_tokenizer"]).count("'s|'t|'re|'ve|'m|'ll|'d|") == 1
        self.ranks = self._ranked(raw) if known else None
        self.kept: dict[str, bytes] = {}
        self.keep = keep
        self.kind = "<u2" if self.n_ids <= 1 << 16 else "<u4"
        if self.ranks:
            self.is_end = np.array([b" " == self.ranks[0].decode_single_token_bytes(i)[-1:] for i in range(len(self.ranks[1]))])
            self.is_end[32] = False  # the byte itself

    @staticmethod
    def _ranked(raw: dict):
        """The vocabulary as ranks of byte strings, and the id of each rank; None if it has another form.

        A blank, which no piece has, stands for a word's end. It joins the
        byte before it ahead of all merges, as the library starts from such
        units. Ranks give the same ids as merges: two neighbours that make up a
        token can only be the pair that the token's own merge names.
        """
        import tiktoken

        from .bpe_chunks import _byte_of_char

        vocab, chars = raw["model"]["vocab"], _byte_of_char()

        def as_bytes(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(chars[c] for c in (token[:-4] if end else token)) + b" " * end

        merges = [m.split(" ") if isinstance(m, str) else m for m in raw["model"]["merges"]]
        one = {b: c for c, b in chars.items()}
        try:
            order = [one[b] for b in range(256)] + [one[b] + "</w>" for b in range(256)] + ["".join(m) for m in merges]
            ids = [vocab[t] for t in order]
            names = [as_bytes(t) for t in order]
        except KeyError:
            return None
        if len(set(names)) != len(names):
            return None
        return tiktoken._tiktoken.CoreBPE({b: i for i, b in enumerate(names)}, {}, "[^ ]+ "), np.array(ids, "<u4")

    def _encode_words(self, new: list[str]) -> None:
        """Encodes words (runs between white space) in one call and keeps their ids."""
        core, ids = self.ranks
        pieces = _PIECES.findall
        parted = [w if w.isalpha() else " ".join(pieces(w)) for w in new]
        flat = np.frombuffer(core.encode_to_tiktoken_buffer(" ".join(parted) + " ", set()), np.uint32)
        # A piece ends where a rank holds its blank; a word ends with its last piece.
        wide = np.dtype(self.kind).itemsize
        ends = (wide * (np.flatnonzero(self.is_end[flat]) + 1))[np.cumsum([p.count(" ") + 1 for p in parted]) - 1].tolist()
        raw = ids[flat].astype(self.kind).tobytes()
        self.kept.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        whole: list[int] = []
        plain: list[int] = []
        split: list[list[str]] = []
        for i, t in enumerate(texts):
            if self.ranks and _PLAIN.fullmatch(t) and not self.special.search(t):
                plain.append(i)
                split.append(t.lower().split())
            else:
                whole.append(i)
        if len(self.kept) > self.keep:
            self.kept = {}
        new = list(set().union(*split).difference(self.kept))
        if new:
            self._encode_words(new)
        get = self.kept.__getitem__
        for i, own in zip(plain, split, strict=True):
            out[i] = np.frombuffer(b"".join(map(get, own)), self.kind)
        if whole:
            for i, e in zip(whole, self.whole.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4")
        return out


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


BLOCKS = "file_no int, block_no int, start_in_file long, n_docs int, n_ids long, block binary"


def write_id_blocks(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, block_ids: int = BLOCK_IDS, files: int | None = None) -> DataFrame:
    """Encodes texts and writes blocks in ascending order of ``key``; returns the written table.

    ``path``: a vocabulary file of the tokenizers library, on every
    executor. Each text (null: empty) is followed by ``end_id``. Files hold
    ranges of keys: file_no, then block_no, then the order in the block is
    the order of keys; null keys come first, equal keys go by text. A
    document is never split, so a block can be larger than ``block_ids``.
    """
    spark = df.sparkSession
    limit_batches(spark)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    width = files or shuffle_width(spark)
    place = F.coalesce("doc_id", F.lit(-(2**63)))
    # Bounds come from the keys alone: a range exchange would read the texts twice to draw its own.
    cuts = docs.agg(F.percentile_approx(place, [i / width for i in range(1, width)] or [0.5], 10000)).first()[0] or []
    below = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))[: width - 1]]).cast("array<long>"), lambda c: c < place))
    ranged = docs.repartitionById(width, below).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no = TaskContext.get().partitionId()
        enc = word_encoder(path)
        names: list[int | None] = []
        lists: list[np.ndarray] = []
        held = block_no = start = 0
        end = np.array([end_id], enc.kind if end_id < 1 << 16 else "<u4")

        def block() -> pa.RecordBatch:
            lengths = [len(x) for x in lists]
            data = pack_block(names, lengths, np.concatenate(lists).astype(np.int64), max(enc.n_ids, end_id + 1))
            row = {"file_no": file_no, "block_no": block_no, "start_in_file": start, "n_docs": len(names), "n_ids": held, "block": data}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for d, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_batch(texts), strict=True):
                names.append(d)
                lists.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= block_ids:
                    yield block()
                    start, block_no, held, names, lists = start + held, block_no + 1, 0, [], []
        if names:
            yield block()

    return cut(ranged.mapInArrow(run, BLOCKS), "id-blocks")


def file_starts(blocks: DataFrame) -> DataFrame:
    """(file_no, file_start): ids in all files before; as many rows as there are files."""
    per_file = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select(F.col("file_no").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def read_id_blocks(blocks: DataFrame, digest: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, and ids (array of long) or their ids_crc32.

    Blocks are checked and decoded independently, in any order. A damaged
    block is an error. ids_crc32: of the ids as little-endian unsigned
    32-bit integers.
    """
    spark: SparkSession = blocks.sparkSession
    limit_batches(spark)
    placed = blocks.join(F.broadcast(file_starts(blocks)), F.col("file_no") == F.col("_file"))
    last, kind = ("ids_crc32 long", pa.int64()) if digest else ("ids array<long>", pa.list_(pa.int64()))
    narrow = placed.select((F.col("file_start") + F.col("start_in_file")).alias("start"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("block"), strict=True):
                names, lengths, ids = unpack_block(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    values = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                else:
                    values = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + start), pa.array(lengths.astype(np.int64)), pa.array(values, kind)], names=["doc_id", "start", "n_tokens", last.split()[0]])

    return narrow.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
