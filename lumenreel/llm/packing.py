"""Vector bin packing of token sequences.

An example is a vector (tokens, segments, loss-bearing tokens); a sequence has a limit on each. Within a task, open
sequences are filled by the dot-product heuristic (Panigrahy et al. 2011): of the waiting examples that fit the
open sequence's remaining room, the one whose size vector has the largest dot product with that room, both scaled by the
limits, is placed next. Examples may be cut freely where `cut` is set: full sequences are cut off long examples
first, and when nothing waiting fits, the best candidate is cut to fill the room exactly.

Tokenisation: the vocabulary of byte_bpe_50k.json is applied from its rank file by tiktoken; ids
are the same as those of tokenizers' encode_batch(add_special_tokens=False) over that file (tested), at a fifth of the
time. A text with a run of over RUN white-space characters, which tiktoken can't take, goes to tokenizers and that file. They are held as little-endian uint32 bytes.

Documents are packed with every token loss-bearing. Conversations give an example an assistant turn, the turn before it as its
prompt, whose loss-bearing tokens are the reply's, so that tokens, segments and loss bind on their own.

Cases: a null text is empty and packs as its end id 0 alone; empty input gives no rows; repeated rows and rows that share an
id are packed each on its own; rows without an id are packed with a null doc_id; a text longer than a sequence is cut into
full sequences and a rest; of examples of one size the first to arrive is placed first; extra columns are not read.
"""

from __future__ import annotations

import array
import base64
import heapq
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LENGTH = 1024
SEGMENTS = 64
#: Examples that wait in a task for a place.
WAITING = 2048
END = b"\0\0\0\0"
#: White space in a row from which tokenizers encodes a text; tiktoken ends with a stack overflow between 500,000 and a million.
RUN = 100_000
_LONG = re.compile(rf"\s{{{RUN},}}")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class ByteBpe:
    """Ids of a text as little-endian uint32 bytes."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self.whole = None

    def _whole(self, text: str) -> list[int]:
        if self.whole is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        return self.whole.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        a = array.array("I", self._whole(text) if len(text) >= RUN and _LONG.search(text) else self.encode(text))
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()


@dataclass(frozen=True)
class Limits:
    tokens: int = LENGTH
    segments: int = SEGMENTS
    loss: int = LENGTH


def pack(examples: Iterator[tuple[object, int, int]], limits: Limits = Limits(), cut: bool = True, waiting: int = WAITING) -> Iterator[tuple[object, int, int, int, int]]:
    """(key, tokens, loss-bearing tokens at the example's end) -> (key, start, length, sequence, offset).

    Examples with more tokens or loss than a whole sequence allows are cut into full pieces first (with cut=False they
    are an error). At most `waiting` remainders wait at a time, in a size-ordered table, so memory is bounded. The one
    last sequence of a task is cut to descending powers of two, which need no padding; so are others that have too many segments to be
    full, where loss can't bind.
    """
    seq = count = order = 0
    none = limits.tokens + limits.loss + 1  # the size of a slot that holds nothing
    pool: dict[tuple[int, int], tuple[int, list]] = {}  # size -> its slot, and a heap of waiting (order, key, start)
    ts, ls, free = np.full(64, none), np.full(64, none), list(range(63, -1, -1))  # sizes by slot

    def put(key: object, start: int, tokens: int, loss: int) -> None:
        nonlocal count, order, ts, ls
        if (tokens, loss) not in pool:
            if not free:
                free.extend(range(2 * len(ts) - 1, len(ts) - 1, -1))
                ts, ls = (np.concatenate([x, np.full(len(x), none)]) for x in (ts, ls))
            slot = free.pop()
            ts[slot], ls[slot] = tokens, loss
            pool[tokens, loss] = slot, []
        heapq.heappush(pool[tokens, loss][1], (order, key, start))
        order += 1
        count += 1

    def take(size: tuple[int, int]) -> tuple[object, int]:
        nonlocal count
        slot, heap = pool[size]
        _, key, start = heapq.heappop(heap)
        if not heap:
            del pool[size]
            ts[slot] = ls[slot] = none
            free.append(slot)
        count -= 1
        return key, start

    def one_sequence() -> list[tuple[object, int, int, int]]:
        """The pieces of the next sequence: (key, start, length, loss)."""
        room_t, room_s, room_l, got = limits.tokens, limits.segments, limits.loss, []
        while room_t and room_s and pool:
            # every example is one segment, so that coordinate adds the same to each product
            dot = ts * (room_t / limits.tokens**2) + ls * (room_l / max(1, limits.loss) ** 2)
            fit = (ts <= room_t) & (ls <= room_l)
            if fit.any():
                best = int(np.where(fit, dot, -1).argmax())
                t, l = int(ts[best]), int(ls[best])  # noqa: E741
                key, start = take((t, l))
            else:
                best = int(np.where(ts < none, dot, -1).argmax())
                t, l = int(ts[best]), int(ls[best])  # noqa: E741
                n = min(room_t, t - l + room_l)  # loss-bearing tokens stand at the end
                if not cut or n <= 0:
                    break
                key, start = take((t, l))
                left = min(l, t - n)
                put(key, start + n, t - n, left)
                t, l = n, l - left  # noqa: E741
            got.append((key, start, t, l))
            room_t, room_s, room_l = room_t - t, room_s - 1, room_l - l
        return got

    def emit(got: list, used: int) -> Iterator[tuple[object, int, int, int, int]]:
        at = 0
        for key, start, n, _ in got:
            yield key, start, n, used, at
            at += n

    for key, tokens, loss in examples:
        start = 0
        if not cut and (tokens > limits.tokens or loss > limits.loss):
            raise ValueError("an example is larger than a sequence and may not be cut")
        while tokens and (tokens >= limits.tokens or loss > limits.loss):
            n = max(1, min(limits.tokens, tokens - loss + limits.loss))
            yield key, start, n, seq, 0
            seq, start, tokens, loss = seq + 1, start + n, tokens - n, min(loss, tokens - n)
        if tokens:
            put(key, start, tokens, loss)
        while count > waiting:
            yield from emit(one_sequence(), seq)
            seq += 1
    while pool:
        got = one_sequence()
        total = sum(x[2] for x in got)
        # where the loss can't bind, whatever isn't full is cut to powers of two; else only the last sequence
        if total == limits.tokens or not cut or limits.loss < limits.tokens and pool:
            yield from emit(got, seq)
            seq += 1
            continue
        power = 1 << (total.bit_length() - 1)
        while got:  # cut the last sequence to powers of two
            now, at = [], 0
            while got and at < power:
                key, start, n, l = got.pop(0)  # noqa: E741
                if n > power - at:
                    got.insert(0, (key, start + power - at, n - power + at, l))
                    n = power - at
                now.append((key, start, n, l))
                at += n
            yield from emit(now, seq)
            seq += 1
            total -= at
            power = 1 << (total.bit_length() - 1) if total else 0


def pack_documents(docs: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """Packs whole texts, every token loss-bearing; one row a piece. Sequences hold pieces of one input partition;
    sequence_id is the partition's number times 2^40 plus the sequence's number in it, the same when a task runs again."""
    cached: list[ByteBpe] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            cached.append(ByteBpe(path))
        bpe, base = cached[0], TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # number -> [doc_id, ids, tokens not yet placed, tokens]
        examples = enumerate((d, t.as_py()) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))

        def sizes() -> Iterator[tuple[int, int, int]]:
            for i, (doc, text) in examples:
                ids = (bpe.ids(text) if text else b"") + END
                held[i] = [doc, ids, len(ids) // 4, len(ids) // 4]
                yield i, len(ids) // 4, len(ids) // 4

        rows: list[tuple] = []
        for i, start, n, seq, at in pack(sizes(), limits):
            h = held[i]
            rows.append((h[0], start, n, zlib.crc32(memoryview(h[1])[4 * start : 4 * (start + n)]), h[3], base + seq, at))
            h[2] -= n
            if not h[2]:
                del held[i]
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


PACKED = "conv_id long, turn long, start long, length long, tokens long, loss long, sequence_id long, offset long"


def pack_conversations(turns: DataFrame, limits: Limits = Limits(segments=16, loss=768), path: str | None = None) -> DataFrame:
    """PACKED: a row a piece of an assistant turn (conv_id, turn), of turns(conv_id, turn, role, text). An example is the text of the turn before, if
    that is no assistant's, and the reply with its end id; the reply's tokens bear loss. Of several rows for one turn before, the first by text counts.
    Turns find the one before by an equi-join on (conv_id, turn), so a long conversation isn't gathered in one task. Null texts are
    empty; rows without a conversation, turn or role are left out."""
    known = turns.where("conv_id is not null and turn is not null and role is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    before = known.where("role != 'assistant'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    examples = known.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("text").alias("reply"))
    cached: list[ByteBpe] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            cached.append(ByteBpe(path))
        bpe, base = cached[0], TaskContext.get().partitionId() << 40

        def sizes() -> Iterator[tuple[tuple, int, int]]:
            for b in batches:
                for conv, turn, prompt, reply in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    loss = len(bpe.ids(reply)) // 4 + 1
                    tokens = len(bpe.ids(prompt)) // 4 + loss
                    yield (conv, turn, tokens, loss), tokens, loss

        rows: list[tuple] = []
        for (conv, turn, tokens, loss), start, n, seq, at in pack(sizes(), limits):
            rows.append((conv, turn, start, n, tokens, loss, base + seq, at))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

    return examples.mapInArrow(run, PACKED)


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_conversations(read(spark, sf_dir, "conversations"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
