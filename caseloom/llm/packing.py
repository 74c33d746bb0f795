"""Packing documents into fixed-size training sequences by Karmarkar-Karp multiway differencing.

A document longer than a window first fills whole windows; what is left of it is cut into
pieces of at most ``grain`` tokens. Pieces are gathered in blocks. For a block of n pieces
and k windows, every piece starts as a k-way partial partition holding one load; the two
partial partitions of the widest spread are merged, the heaviest window of one with the
lightest of the other, until one partition is left. Its windows are nearly equal. k starts
at the total over ``capacity - slack`` and rises while any window exceeds the capacity.
What does not fill a block's last window is carried into the next block; the remainder of
a task becomes sequences whose lengths are powers of two, which need no padding.

The operator is a map over the scan's partitions: no shuffle, memory bounded by a block.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm import common

CAPACITY = 2048
#: Pieces that a task holds at most; tiny texts are packed in smaller blocks.
PIECES = 65_536
END_ID = 1
_SPLIT_AT = 1 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of a byte-level BPE file, as ``tokenizers`` gives them without adding special tokens.

    When the same vocabulary lies beside the file as ranks, the faster encoder over those
    ranks is used (same ids, see the tests), but for texts that hold the string of an added
    token: ``tokenizers`` reads these, whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self._slow, self._fast = path, None, None
        with open(path, encoding="utf-8") as f:
            self._added = [t["content"] for t in json.load(f).get("added_tokens", ()) if t["content"]]
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks != path and os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """Very long texts go in parts, cut before a lone space, where no token can span."""
        if any(t in text for t in self._added):
            return np.array(self.slow(text), dtype="<u4")
        parts, at = [], 0
        while len(text) - at > _SPLIT_AT:
            cut = at + _SPLIT_AT
            while (cut := text.find(" ", cut)) > 0 and text[cut - 1].isspace():
                cut += 1
            if cut < 0:
                break
            parts.append(text[at:cut])
            at = cut
        parts.append(text[at:])
        return np.concatenate([np.array(self._one(p), dtype="<u4") for p in parts])

    def _one(self, text: str) -> list[int]:
        if self._fast is None:
            return self.slow(text)
        try:
            return self._fast(text)
        except BaseException as e:  # the rank encoder panics on huge runs of white space
            if type(e).__name__ != "PanicException":
                raise
            return self.slow(text)


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder in a worker, whatever the number of its tasks."""
    return Encoder(path)


def karmarkar_karp(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size, by k-way largest differencing; ties by input order."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if k == 1:
        return np.zeros(n, dtype=np.int64)
    heap, nodes = [], []  # a node: (left, right, order); a leaf has no order
    for i, x in enumerate(sizes):
        loads = np.zeros(k, dtype=np.int64)
        loads[-1] = x
        heap.append((-int(x), i, loads))
        nodes.append((-1, -1, None))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, heavy = heapq.heappop(heap)
        _, b, light = heapq.heappop(heap)
        both = heavy[::-1] + light
        order = np.argsort(both, kind="stable")
        both = both[order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (int(both[0] - both[-1]), len(nodes) - 1, both))
    out = np.zeros(n, dtype=np.int64)
    labels: list = [None] * len(nodes)
    labels[-1] = np.arange(k)
    for i in range(len(nodes) - 1, -1, -1):
        a, b, order = nodes[i]
        if order is None:
            out[i] = labels[i][-1]
        else:
            own = np.empty(k, dtype=np.int64)
            own[order] = labels[i]
            labels[a], labels[b] = own[::-1], own
        labels[i] = None
    return out


def bundles(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of small pieces that together are at most so large, as one piece each for differencing: each piece's bundle, and the bundles' sizes."""
    place, out = [], []
    for x in sizes:
        if out and out[-1] + x <= most:
            out[-1] += x
        else:
            out.append(x)
        place.append(len(out) - 1)
    return np.array(place, dtype=np.int64), np.array(out, dtype=np.int64)


class _Packer:
    """Packs one task's pieces (document index, start, length); yields placed pieces."""

    def __init__(self, capacity: int, grain: int, windows: int, slack: int, first_id: int):
        self.capacity, self.grain, self.windows, self.slack, self.next_id = capacity, grain, windows, slack, first_id
        self.pieces: list[tuple] = []
        self.total = 0

    def add(self, doc, length: int) -> Iterator[tuple]:
        at = 0
        while length - at >= self.capacity:
            yield doc, at, self.capacity, self._new(), 0
            at += self.capacity
        while at < length:
            size = min(self.grain, length - at)
            self.pieces.append((doc, at, size))
            self.total += size
            at += size
        if self.total >= self.windows * self.capacity or (len(self.pieces) >= PIECES and self.total >= self.capacity):
            yield from self.flush(last=False)

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def flush(self, last: bool) -> Iterator[tuple]:
        fill = self.capacity - self.slack
        k = self.total // fill
        rest, spare = [], self.total - k * fill
        while spare > 0:  # the newest pieces wait, so that the others fill k windows
            doc, at, size = self.pieces.pop()
            if size > spare:
                self.pieces.append((doc, at, size - spare))
                at, size = at + size - spare, spare
            rest.append((doc, at, size))
            spare -= size
        rest.reverse()
        if self.pieces:
            bundle, sizes = bundles([p[2] for p in self.pieces], max(1, self.grain // 4))
            while True:
                window = karmarkar_karp(sizes, k)
                if np.bincount(window, weights=sizes, minlength=k).max() <= self.capacity:
                    break
                k += 1
            window = window[bundle]
            ids, filled = [self._new() for _ in range(k)], [0] * k
            for (doc, at, size), w in zip(self.pieces, window.tolist(), strict=True):
                yield doc, at, size, ids[w], filled[w]
                filled[w] += size
        self.pieces, self.total = rest, sum(p[2] for p in rest)
        if last:
            yield from self._powers()

    def _powers(self) -> Iterator[tuple]:
        room, seq, used = 0, 0, 0
        for doc, at, size in self.pieces:
            while size:
                if room == used:
                    room, used, seq = 1 << (self.total.bit_length() - 1), 0, self._new()
                take = min(size, room - used)
                yield doc, at, take, seq, used
                at, size, used, self.total = at + take, size - take, used + take, self.total - take
                if used < room:
                    continue
        self.pieces = []


def pack_documents(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    capacity: int = CAPACITY, grain: int = 512, block_windows: int = 256, slack: int = 8,
) -> DataFrame:
    """Pack all documents; returns one row per piece.

    Columns: doc_id, start and length (in the document's ids), ids (the piece's ids, binary,
    little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset (in the
    sequence), padded_length (the sequence's length after padding: the capacity, or the
    length itself where that is a power of two and the sequence is one of a task's last).

    A null text is empty, and so one end id. Null and repeated ids pass through; each row is
    packed by itself. Other columns are not read, whatever their names. An empty table gives
    no rows. A text of any length is cut into as many windows as it needs. ``grain`` bounds
    the pieces that differencing moves: smaller gives less padding, larger fewer cuts.
    """
    path = tokenizer or tokenizer_path()
    grain = min(grain, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path)
        packer = _Packer(capacity, grain, block_windows, slack, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4")
        lengths: dict[int, int] = {}
        rows: list[tuple] = []

        def put(doc, at, size, seq, offset):
            lengths[seq] = lengths.get(seq, 0) + size
            rows.append((doc[0], at, size, doc[1][at : at + size].tobytes(), len(doc[1]), seq, offset))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            width = {s: n if s in tail and n & (n - 1) == 0 else capacity for s, n in lengths.items()}
            cols.append([width[s] for s in cols[5]])
            rows.clear()
            lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=names)

        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        tail: set[int] = set()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc = (key, np.concatenate([encoder.ids(text.as_py() or ""), end]))
                before = packer.next_id
                for x in packer.add(doc, len(doc[1])):
                    put(*x)
                if packer.next_id > before and len(rows) > 2000:
                    yield batch()
            common.give_back()
        before = packer.next_id
        for x in packer.flush(last=True):
            put(*x)
        tail.update(s for s in lengths if s >= before)
        if rows:
            yield batch()
        common.give_back()

    names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"]
    key = docs.schema[id_column]
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(key.dataType)
    long = T.LongType()
    schema = T.StructType([T.StructField(id_column, key.dataType), *[T.StructField(n, T.BinaryType() if n == "ids" else long) for n in names[1:]]])
    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, its ids as a checksum."""
    packed = pack_documents(common.table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")
