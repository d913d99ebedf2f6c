"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts texts where its high bits are zero, so
shared passages are cut into the same chunks wherever they stand. A chunk is
encoded once and its ids are reused in all documents that a worker sees.

Ids near a cut may differ from those of the whole text, so each join is
repaired: what stands around the cut is encoded again, and this window grows
on either side until both sides must agree with the whole text. That is
certain at an anchor: the end of a word before a blank, a tab or a line end,
or between a letter and a mark such as a comma or an ideographic full stop.
The vocabulary's pattern begins a piece at every anchor, whatever stands
before or after it, no piece that ends there looks further, and pieces are
encoded independently. A chunk without an anchor joins the window. So a
text's ids equal those of the text encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import limit_batches, map_arrow

WINDOW = 16
CUT_BITS = 10
CACHE_BYTES = 32 << 20
SEGMENT = 1 << 18

# Fixed value: the byte-level pre-tokenizer's pattern.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Not white space and white space, letters and marks, by every version of Unicode; a place that needs a later version's tables is no anchor.
SOLID = r"[^\s\x1c-\x1f\x85\xa0]"
LETTER = r"[A-Za-z\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
MARK = r"[,.;:!?\u3001\u3002\uff0c\uff1b\uff1a\uff01\uff1f]"
ANCHOR = re.compile(rf"(?<={SOLID})(?=[ \t\r\n])|(?<={LETTER})(?={MARK})")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers library.

    Where the file's merges are in the order of its ids (as ranks), ids come
    from the rank-based encoder, else from the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        vocab: dict[str, int] = raw["model"]["vocab"]
        special = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        chars = _byte_of_char()
        as_bytes = {i: bytes(chars[c] for c in s) for s, i in vocab.items() if s not in special}
        self.n = max([*as_bytes, *special.values()]) + 1
        self.table = [as_bytes.get(i, b"") for i in range(self.n)]
        for s, i in special.items():
            self.table[i] = s.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in raw["model"]["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        plain = raw["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        # The rank-based encoder takes no blanks beside special tokens. Chunks are sound only with this pattern, and with special tokens that hold no anchor.
        strips = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in raw.get("added_tokens", []))
        plain = plain and raw.get("normalizer") is None and not strips
        self.ranked = plain and ids == sorted(ids) and (not ids or ids[0] >= 256)
        self.anchored = plain and not any(ANCHOR.search(t) for t in special)
        self.path, self.special, self._rank, self._whole = path, special, None, None

    def _load(self) -> None:
        """The encoder itself; workers that only decode never need it."""
        if self.ranked:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.table) if b and i not in self.special.values()}
            self._rank, self._special = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=self.special), set(self.special)
        else:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.no_truncation()
            self._whole.no_padding()

    def encode(self, text: str) -> list[int]:
        if self._rank is None and self._whole is None:
            self._load()
        if self.ranked:
            return self._rank.encode(text, allowed_special=self._special, disallowed_special=())
        return self._whole.encode(text, add_special_tokens=False).ids

    def decode(self, ids) -> str:
        table = self.table
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    n = SEGMENT + WINDOW
    with np.errstate(over="ignore"):
        up = np.cumprod(np.array([1] + [base] * n, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.array([1] + [inverse] * n, np.uint64), dtype=np.uint64)
    return byte, up, down


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _tables()


def cut_points(data: bytes, bits: int = CUT_BITS) -> list[int]:
    """Ends of chunks inside ``data``: where the hash of the last 16 bytes has zeros on top, moved on to a character's first byte.

    Only these 16 bytes decide. A chunk has 2**bits bytes on average.
    """
    byte, up, down = tables()
    found: list[int] = []
    for at in range(0, len(data), SEGMENT):
        part = np.frombuffer(data, np.uint8, min(len(data), at + SEGMENT) - max(0, at - WINDOW), max(0, at - WINDOW))
        if len(part) < WINDOW:
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * up[: len(part)], out=sums[1:])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: len(sums) - WINDOW]
        ends = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + (WINDOW + max(0, at - WINDOW))
        found += ends.tolist()
    n, out, last = len(data), [], 0
    for e in found:
        while e < n and data[e] & 0xC0 == 0x80:
            e += 1
        if last < e < n:
            out.append(e)
            last = e
    return out


class ChunkEncoder:
    """Encodes texts from reused chunks; ``cache_bytes`` bounds what it keeps."""

    def __init__(self, vocabulary: ByteBpe, bits: int = CUT_BITS, cache_bytes: int = CACHE_BYTES):
        self.v, self.bits, self.limit = vocabulary, bits, cache_bytes
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.kept = self.hits = self.misses = 0

    def _chunk(self, data: bytes) -> tuple[str, array | None, str]:
        """(text before the first anchor, ids between first and last anchor, text after); ids None: no two anchors."""
        got = self.new.get(data)
        if got is not None:
            self.hits += 1
            return got
        got = self.old.get(data)
        if got is None:
            self.misses += 1
            text = data.decode()
            first = ANCHOR.search(text)
            last = _last_anchor(text)
            if first is None or last <= first.start():
                got = (text, None, "")
            else:
                got = (text[: first.start()], array("i", self.v.encode(text[first.start() : last])), text[last:])
        else:
            self.hits += 1
        self.new[data] = got
        self.kept += len(data) + 4 * len(got[1] or ()) + 600
        if self.kept > self.limit // 2:
            self.old, self.new, self.kept = self.new, {}, 0
        return got

    def encode(self, text: str) -> array:
        data = text.encode("utf-8", "replace")
        ends = cut_points(data, self.bits) if self.v.anchored else []
        if not ends:
            return array("i", self.v.encode(text))
        ids = array("i")
        window, at = "", 0
        for e in [*ends, len(data)]:
            head, body, tail = self._chunk(data[at:e])
            at = e
            window += head
            if body is not None:
                if window:
                    ids.fromlist(self.v.encode(window))
                ids.extend(body)
                window = tail
        if window:
            ids.fromlist(self.v.encode(window))
        return ids


def _last_anchor(text: str) -> int:
    """The last anchor's place, or -1; looks at twice as much of the end each time."""
    back = 64
    while True:
        found = [m.start() for m in ANCHOR.finditer(text, max(0, len(text) - back))]
        if found or back >= len(text):
            return found[-1] if found else -1
        back *= 2


_encoders: dict[tuple, ChunkEncoder] = {}
_vocabularies: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    if path not in _vocabularies:
        _vocabularies[path] = ByteBpe(path)
    return _vocabularies[path]


def encoder(path: str, bits: int, cache_bytes: int) -> ChunkEncoder:
    """One a Python worker, so that chunks are shared by all its tasks."""
    key = (path, bits, cache_bytes)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(vocabulary(path), bits, cache_bytes)
    return _encoders[key]


def _with_column(batch: pa.RecordBatch, values: pa.Array, place: int | None, drop: int | None = None) -> pa.RecordBatch:
    columns = list(batch.columns)
    if place is None:
        columns.append(values)
    else:
        columns[place] = values
    kept = [c for i, c in enumerate(columns) if i != drop]
    return pa.RecordBatch.from_arrays(kept, names=[f"c{i}" for i in range(len(kept))])


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> tuple[T.StructType, int | None]:
    """The schema with ``name`` set, and its place if the input has it (in any case) already."""
    place = next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)
    fields = list(df.schema.fields)
    field = T.StructField(name, kind)
    if place is None:
        fields.append(field)
    else:
        fields[place] = field
    return T.StructType(fields), place


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids", bits: int = CUT_BITS, cache_bytes: int = CACHE_BYTES, keep_text: bool = True) -> DataFrame:
    """Adds ``ids``, an array of int: what the tokenizers library gives for the whole text without special tokens added.

    ``path``: a byte-level BPE file of that library, present on every
    executor; with another pattern, or special tokens that could hide an
    anchor, texts are encoded whole. Null and empty texts have empty arrays. Lone surrogates cannot
    occur in a text column. A column called ``ids`` (in any case) is
    replaced; all others stay, ``text`` unless ``keep_text`` is false.
    Repeated rows and texts of any length are fine; a chunk's memory is
    bounded by its document.
    """
    limit_batches(df.sparkSession)
    source = [c.lower() for c in df.columns].index(text.lower())
    schema, place = _schema_with(df, ids, T.ArrayType(T.IntegerType()))
    drop = None if keep_text or place == source else source
    schema = T.StructType([f for i, f in enumerate(schema.fields) if i != drop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, bits, cache_bytes)
        for batch in batches:
            lists = [enc.encode(t) if t else array("i") for t in batch.column(source).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.frombuffer(b"".join(lists), np.int32)
            yield _with_column(batch, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), place, drop)

    return map_arrow(df, run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: the ids' bytes as UTF-8, special tokens included, malformed sequences replaced.

    Null or empty ids give an empty text; an id outside the vocabulary is an
    error. A column called ``text`` (in any case) is replaced.
    """
    limit_batches(df.sparkSession)
    schema, place = _schema_with(df, text, T.StringType())
    source = [c.lower() for c in df.columns].index(ids.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path).table
        for batch in batches:
            column = batch.column(source)
            out = []
            for i in range(len(column)):
                own = column[i].values
                if own is not None and len(own) and pc.min(own).as_py() < 0:
                    raise ValueError(f"{pc.min(own)} is no id")
                out.append("" if own is None else b"".join([table[k] for k in own.to_numpy(zero_copy_only=False).tolist()]).decode("utf-8", "replace"))
            yield _with_column(batch, pa.array(out, pa.string()), place)

    return map_arrow(df, run, schema)
