"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A piece (a match of the split pattern) is halved down to short leaves; leaves are merged by rank, and two encoded
neighbours A and B are joined by encoding anew the bytes of a window around their boundary. A token sequence is the
encoding of its bytes exactly when every two neighbours encode to themselves: merges inside tokens don't see each
other's choices until one crosses a border, and the first that would cross one would do so for those two tokens
alone. So a window is right, and nothing outside can change, once the pair at each of its ends stays a pair; until
then the window grows on that side. Decoding concatenates bytes up the same kind of tree.

Defined results: null texts count as empty; empty texts have no tokens. Repeated rows give repeated results. Texts of any
length are taken whole; the work for a piece of n bytes is n log² n at most. An empty table gives an empty result.
Other columns are ignored, whatever their names. Ranks must hold every single byte.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import spread_table, whole

#: Bytes of a leaf of the tree, which is merged directly.
LEAF = 8
#: Bytes up to which merging scans all neighbours instead of keeping a heap.
SHORT = 96
#: Encoded pieces, pairs and leaves that a task remembers, each, in two generations of which the older one goes when the
#: younger one is full. At 131,072 of at most 64 bytes each they took 65 MB.
REMEMBERED = 131_072
#: Tokens of a leaf of the decoding tree.
DECODE_LEAF = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged_short(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """As merged(), by a plain scan, which is faster for short input."""
    parts = [data[i : i + 1] for i in range(len(data))]
    none = len(ranks) + 1 << 32
    best = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
    while best and (low := min(best)) != none:
        i = best.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del best[i]
        if i < len(best):
            best[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            best[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return parts


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the lowest-ranked neighbours first, the leftmost of equals, until none is in ranks."""
    n = len(data)
    if n <= SHORT:
        return merged_short(data, ranks)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has merged since
        alive[j], end[i], after[i] = 0, stop, after[j]
        if after[i] < n:
            k = after[i]
            before[k] = i
            if (rank := ranks.get(data[i : end[k]])) is not None:
                heapq.heappush(heap, (rank, i, end[k]))
        if before[i] >= 0 and (rank := ranks.get(data[before[i] : stop])) is not None:
            heapq.heappush(heap, (rank, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(data[i : end[i]])
        i = after[i]
    return out


class Memory:
    """What was found for recent keys: what is asked for again moves to the younger generation and so stays."""

    def __init__(self):
        self.young, self.old = {}, {}

    def find(self, key):
        if (found := self.young.get(key)) is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, found) -> None:
        if 2 * len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[key] = found

    def clear(self) -> None:
        self.young, self.old = {}, {}


class Encoder:
    """Encodes and decodes with given ranks. What it remembers (pieces, leaves, pairs) only saves time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pairs, self.leaves, self.known = Memory(), Memory(), Memory()
        self.id_of = {token: str(rank) for token, rank in ranks.items()}
        self.bytes_of = {i: token for token, i in self.id_of.items()}

    def pair(self, a: bytes, b: bytes) -> tuple[bytes, ...]:
        """The encoding of two neighbours; (a, b) if they stay as they are."""
        if (found := self.pairs.find((a, b))) is None:
            found = tuple(merged(a + b, self.ranks))
            if len(a) + len(b) <= 64:
                self.pairs.keep((a, b), found)
        return found

    def join(self, a: tuple[bytes, ...], b: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of the bytes of a and b, themselves encodings of one token at least."""
        window, left, right = self.pair(a[-1], b[0]), 1, 1
        if len(window) == 2 and window[0] == a[-1]:
            return a + b
        while True:
            firm_left = left >= len(a) or self.pair(a[-left - 1], window[0]) == (a[-left - 1], window[0])
            firm_right = right >= len(b) or self.pair(window[-1], b[right]) == (window[-1], b[right])
            if firm_left and firm_right:
                return a[:-left] + window + b[right:]
            left = left if firm_left else min(2 * left, len(a))
            right = right if firm_right else min(2 * right, len(b))
            window = tuple(merged(b"".join(a[-left:] + b[:right]), self.ranks))

    def tree(self, data: bytes) -> tuple[bytes, ...]:
        """The encoding of one byte at least."""
        if len(data) > LEAF:
            half = len(data) + 1 >> 1
            return self.join(self.tree(data[:half]), self.tree(data[half:]))
        if (found := self.leaves.find(data)) is None:
            found = tuple(merged(data, self.ranks))
            self.leaves.keep(data, found)
        return found

    def piece(self, text: str) -> str:
        """The ids of one match of the pattern, joined by commas."""
        data = text.encode()
        # a piece that is a token stays whole
        out = self.id_of.get(data) or ",".join([self.id_of[t] for t in self.tree(data)])
        if len(data) <= 64:
            self.known.keep(text, out)
        return out

    def encode(self, text: str) -> list[str]:
        """The ids of a whole text. Pieces concatenate: nothing merges across them."""
        known, piece = self.known.find, self.piece
        ids = ",".join([known(p) or piece(p) for p in self.split(text)])
        return ids.split(",") if ids else []

    def decode(self, ids: list[str]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


    def forget(self) -> None:
        """Drop what is remembered; the ranks stay."""
        for memory in (self.pairs, self.leaves, self.known):
            memory.clear()


_encoders: dict[tuple[str, str], Encoder] = {}


@contextmanager
def encoder_for(ranks_path: str, pattern: str) -> Iterator[Encoder]:
    """This process's encoder. Spark reuses its Python workers: the ranks serve the next task, what a task remembers goes with it."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders.clear()  # one table of ranks a worker
        _encoders[key] = Encoder(load_ranks(ranks_path), pattern)
    try:
        yield _encoders[key]
    finally:
        _encoders[key].forget()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, and ids (an array of ints) or, with digests, ids_sha256 and decoded_sha256.

    Every executor reads the ranks from ranks_path, which must exist there (a package or a distributed file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder_for(ranks_path, pattern) as encoder:
            for batch in batches:
                n, first, second = [], [], []
                for cell in batch.column(1):
                    ids = encoder.encode(cell.as_py())
                    n.append(len(ids))
                    if digests:
                        first.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                        second.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    else:
                        first.append([int(i) for i in ids])
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32()))]
                names = ["id", "n_tokens", "ids_sha256" if digests else "ids"]
                if digests:
                    columns, names = [*columns, pa.array(second, pa.string())], [*names, "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, data (binary): the bytes of each row's ids. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder_for(ranks_path, r"\X") as encoder:
            for batch in batches:
                data = [encoder.decode([str(i) for i in cell.as_py() or []]) for cell in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, data binary")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread_table(spark, sf_dir, "documents")
    done = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return done.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
