"""Packing by minimum bin slack: documents into sequences of a fixed number of tokens.

Each task packs the rows of its own partition, so nothing is shuffled and no histogram leaves the task. Whole
windows are cut off the front of long documents; what remains of every document is shorter than a window.
For each window a bitset subset-sum dynamic program over the remaining lengths finds the multiset that
comes closest to the capacity; backtracking gives how many of each length it takes, and the same choice is
repeated for as many windows as its counts allow. Where slack is left, one more document is cut to fill it.
Rows are worked through in blocks of bounded size; what a block leaves over goes into the next, so a
task ends with one window at most that is not full.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rxloom.llm.common import query, table

CAPACITY = 2048
END_ID = 1
#: Tokens held by a task before it packs what it has.
BLOCK_TOKENS = 4_000_000

class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    The tokenizer file's own library encodes texts with special tokens in them. All others go through the same
    vocabulary as ranks, which gives the same ids at a quarter of the time.
    """

    def __init__(self, vocabulary: str):
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.plain.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of available lengths that fills a window closest to `capacity`, and its sum.

    The longest remaining document opens the window, so that long ones are not left for the end. `reach` is a
    bitset of attainable sums; copies of a length enter in powers of two. Each item's bitset is kept, and walking them
    back from the best sum says how many copies were taken.
    """
    longest = max(counts)
    mask = (1 << (capacity + 1)) - 1
    reach = 1 << longest
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), (capacity - longest) // length)
        copies = 1
        while left > 0:
            take = min(copies, left)
            grown = reach | (reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            copies *= 2
        if reach >> capacity:
            break
    best = total = reach.bit_length() - 1
    taken = defaultdict(int, {longest: 1})
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += take
            total -= take * length
    return dict(taken), best


class Packer:
    """Packs documents given one after another; `flush` returns finished pieces."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity = capacity
        self.sequence = first_sequence
        self.open: dict[int, deque] = defaultdict(deque)  # remaining length -> (document, start in it)
        self.tokens = 0
        self.pieces: list[tuple[object, int, int, int, int]] = []  # document, start, length, sequence, offset

    def add(self, document: object, n: int) -> None:
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            self.pieces.append((document, start, self.capacity, self.sequence, 0))
            self.sequence += 1
        if n > whole:
            self.open[n - whole].append((document, whole))
            self.tokens += n - whole

    def _put(self, length: int, offset: int, used: int | None = None) -> int:
        """Place one document of `length` at `offset`, or its first `used` tokens, and return the new offset."""
        document, start = self.open[length].popleft()
        if not self.open[length]:
            del self.open[length]
        size = length if used is None else used
        self.pieces.append((document, start, size, self.sequence, offset))
        self.tokens -= size
        if size < length:
            self.open[length - size].append((document, start + size))
        return offset + size

    def flush(self, last: bool) -> list[tuple[object, int, int, int, int]]:
        while self.tokens >= self.capacity or (last and self.tokens):
            choice, total = fill({k: len(v) for k, v in self.open.items()}, self.capacity)
            repeats = min(len(self.open[k]) // n for k, n in choice.items()) if total == self.capacity else 1
            for _ in range(repeats):
                offset = 0
                for length, n in choice.items():
                    for _ in range(n):
                        offset = self._put(length, offset)
                slack = self.capacity - offset
                if slack and self.open:
                    longer = [k for k in self.open if k > slack]
                    if longer:
                        offset = self._put(max(longer), offset, slack)
                self.sequence += 1
        done, self.pieces = self.pieces, []
        return done


def pack(df: DataFrame, key: str, text: str, vocabulary: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: key, ids (little-endian 32-bit), start, length, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they occur and a
    null key is kept. Sequence ids are unique: the partition's number in the upper bits, a counter below, as
    a retried task gives again. An empty table gives no pieces.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = df.select(key, text)
    kind = rows.schema[0].dataType
    longs = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.BinaryType())] + [
        T.StructField(c, T.LongType()) for c in longs])
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        held: dict[int, tuple[object, memoryview, int]] = {}
        serial = waiting = 0

        def ready(last: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            done = packer.flush(last)
            for at in range(0, len(done), 5000):
                part = done[at:at + 5000]
                docs = [held[d] for d, *_ in part]
                numbers = np.array([(s, n, d[2], q, o) for (_, s, n, q, o), d in zip(part, docs, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[0] for d in docs], kind),
                     pa.array([d[1][4 * s:4 * (s + n)] for (_, s, n, _, _), d in zip(part, docs, strict=True)], pa.binary()),
                     *[pa.array(numbers[:, i]) for i in range(len(longs))]], [key, "ids", *longs])
            waits = {d for queue in packer.open.values() for d, _ in queue}
            for d in [d for d in held if d not in waits]:
                del held[d]

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(value or "") + end
                held[serial] = (name, memoryview(ids), len(ids) // 4)
                packer.add(serial, len(ids) // 4)
                serial += 1
                waiting += len(ids) // 4
                if waiting >= block_tokens:
                    yield from ready(False, key_type)
                    waiting = 0
        if serial:
            yield from ready(True, key_type)

    return rows.mapInArrow(run, schema)


def digests(pieces: DataFrame, key: str) -> DataFrame:
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op1_pack_min_slack")
def op1_pack_min_slack(spark, sf_dir):
    return digests(pack(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
