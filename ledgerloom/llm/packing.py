"""Mixture-controlled packing by deficit round-robin (operator 6).

Every source is a queue of tokens. In each window every queue is served its quantum,
window length times its share; what the whole-number service leaves over is the
queue's deficit and is carried into the next window. With C(s) tokens in the queues
up to s of N in all, the service up to token x is floor(x C(s) / N) minus the same of
the queue before: the deficits of any window follow from its number, so tasks fill
windows independently and the carry crosses partitions without a pass over them."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import shared, tokens
from ledgerloom.llm.kernels import pieces
from ledgerloom.llm.token_files import END_ID, with_end

LENGTH = 4096


@dataclass
class Phase:
    """Windows served with one set of shares. ``counts``: tokens of each queue."""

    first: int  # number of its first window
    before: list[int]  # tokens each queue gave to earlier phases
    counts: list[int]
    length: int
    drain: bool = False  # queues one after the other

    def __post_init__(self):
        self.up = [0]
        for c in self.counts:
            self.up.append(self.up[-1] + c)
        self.total = self.up[-1]
        full, rest = divmod(self.total, self.length)
        # the last whole window and what is left over are served together, so no region is too short for its shares
        self.regions = 1 if self.drain else max(full - 1 + (rest == 0), 1)
        self.tail = full * self.length
        self.tails, at = [], self.tail
        while at < self.total:
            self.tails.append(at)
            at += 1 << (self.total - at).bit_length() - 1

    def edge(self, region: int) -> int:
        return self.total if region >= self.regions else region * self.length

    def served(self, queue: int, region: int) -> int:
        """Tokens of the queue placed before this region."""
        x = self.edge(region)
        return x * self.up[queue + 1] // self.total - x * self.up[queue] // self.total

    def offset(self, queue: int, region: int) -> int:
        """Where the queue's tokens begin, from the start of the region."""
        return (self.edge(region + 1) * self.up[queue] // self.total) - (self.edge(region) * self.up[queue] // self.total)

    def region_of(self, queue: int, token: int) -> int:
        lo = min(max(token * self.total // (self.counts[queue] * self.length) - 2, 0), self.regions - 1) if not self.drain else 0
        while self.served(queue, lo) > token:
            lo -= 1
        while self.served(queue, lo + 1) <= token:
            lo += 1
        return lo

    def sequence_at(self, x: int) -> tuple[int, int, int]:
        """(sequence, place in it, its end) of place x; what does not fill a window
        becomes sequences of powers of two."""
        if x < self.tail:
            k = x // self.length
            return self.first + k, x - k * self.length, (k + 1) * self.length
        i = bisect_right(self.tails, x) - 1
        end = self.tails[i + 1] if i + 1 < len(self.tails) else self.total
        return self.first + self.tail // self.length + i, x - self.tails[i], end

    def cut(self, queue: int, token: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, offset, first token, count) for tokens of one queue."""
        while token < stop:
            region = self.region_of(queue, token)
            begin = self.served(queue, region)
            end = min(self.served(queue, region + 1), stop)
            x = self.edge(region) + self.offset(queue, region) + token - begin
            while token < end:
                sequence, offset, until = self.sequence_at(x)
                n = min(end - token, until - x)
                yield sequence, offset, token, n
                token, x = token + n, x + n


def phases(totals: list[int], shares: list[float] | None, length: int = LENGTH) -> list[Phase]:
    """Windows at the target shares while every queue can pay; a queue that cannot pay for
    one window more leaves, and the others go on at their shares to each other; what the
    queues that left still hold is drained in turn at the end. Without shares the corpus'
    own proportions are the target and all end together."""
    out, left, done, window = [], list(totals), [0] * len(totals), 0

    def add(counts: list[int], drain: bool = False) -> None:
        nonlocal window
        out.append(Phase(window, list(done), counts, length, drain))
        for i, c in enumerate(counts):
            done[i] += c
            left[i] -= c
        window += sum(counts) // length

    def served(windows: int, live: list[int], weight: float) -> list[int]:
        counts, up, given = [0] * len(totals), 0.0, 0
        for i in live:
            up += shares[i] / weight
            counts[i] = (windows * length if i == live[-1] else round(windows * length * up)) - given
            given += counts[i]
        return counts

    live = [i for i, n in enumerate(left) if shares is not None and shares[i] > 0 and n > 0]
    while live:
        weight = sum(shares[i] for i in live)
        windows = {i: int(left[i] * weight / shares[i]) // length if shares[i] / weight * length >= 2 else 0 for i in live}
        some = min(windows.values())
        while some and any(c > n for c, n in zip(served(some, live, weight), left, strict=True)):
            some -= 1  # whole ids: the shares of the last window may not divide
        if some:
            add(served(some, live, weight))
        first = min(live, key=lambda i: (windows[i], i))
        live = [i for i in live if windows[i] > some] if some else [i for i in live if i != first]
    rest = sum(left)
    if rest:
        add(list(left), drain=any(0 < n * length < 2 * rest for n in left))
    return out


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """Stored rows (part, doc_id, source, source_start, n_tokens, ids): each task
    counts the tokens it saw of every source, so a queue's order is (part, start)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = tokens.bpe(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for texts in pieces(batch.column(1)):
                ids, counts = with_end(*encoder.encode(texts), end_id)
                body, at, starts = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(counts))).tolist(), []
                for s, n in zip(sources[texts.rows], counts.tolist(), strict=True):
                    starts.append(seen.get(s, 0))
                    seen[s] = starts[-1] + n
                n = len(texts)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(n, part, np.int64)), "doc_id": batch.column(0).slice(texts.rows.start, n),
                    "source": pa.array(sources[texts.rows], pa.string()), "source_start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(counts), "ids": pa.array([body[4 * a:4 * b] for a, b in zip(at, at[1:])], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    return shared.stored(rows.mapInArrow(encode, "part BIGINT, doc_id BIGINT, source STRING, source_start BIGINT, "
                                                 "n_tokens BIGINT, ids BINARY"), "packing-ids")


def pack(docs: DataFrame, vocabulary: str, shares: dict[str, float] | None = None, length: int = LENGTH,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces (doc_id, start, n, ids_crc32, doc_tokens, sequence_id, offset, source).

    ``shares``: target token proportion per source; a source not named is drained at
    the end; None takes the corpus' own proportions. Every id of every document lies
    in exactly one piece. Sequences hold ``length`` ids; what is left at the end of the
    corpus becomes sequences of powers of two, so nothing is padded. Null and empty
    texts are the end id alone, a null source is the source ''; repeated rows are
    packed each by itself; a null id stays null. The driver holds one total per source
    (sources are the entries of a mixture); sources too small for two ids a window
    share one queue. Other columns are ignored; an empty table gives no rows."""
    ids = tokenised(docs, vocabulary, end_id, id_col, text_col, source_col)
    runs = ids.groupBy("part", "source").agg(F.sum("n_tokens").alias("run"))
    totals = {r["source"]: r["total"] for r in runs.groupBy("source").agg(F.sum("run").alias("total")).collect()}
    whole, order = sum(totals.values()), sorted(totals, key=lambda s: (totals[s], s))
    pool, pooled = [], 0
    while order and shares is None and (totals[order[0]] * length < 2 * whole or pool and pooled * length < 2 * whole):
        pooled += totals[order[0]]
        pool.append(order.pop(0))
    queues = [pool] * bool(pool) + [[s] for s in sorted(order)]
    queue_of = {s: q for q, members in enumerate(queues) for s in members}
    weights = None if shares is None else [float(sum(shares.get(s, 0) for s in members)) for members in queues]
    plan = phases([sum(totals[s] for s in members) for members in queues], weights, length)

    queue = F.create_map(*[F.lit(x) for pair in queue_of.items() for x in pair]) if queue_of else None
    runs = runs.withColumn("queue", queue[F.col("source")] if queue is not None else F.lit(0))
    earlier = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("part", "source", "queue", F.coalesce(F.sum("run").over(earlier), F.lit(0)).alias("base"))
    bases = shared.stored(bases, "packing-bases")  # one row per task and source, of known size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            doc, start, n, body, source, q = (batch.column(i) for i in range(6))
            for d, a, count, blob, s, k in zip(doc.to_pylist(), start.to_pylist(), n.to_pylist(), body, source.to_pylist(),
                                               q.to_pylist(), strict=True):
                view = memoryview(blob.as_buffer())
                for phase in plan:
                    lo = phase.before[k]
                    first, stop = max(a, lo), min(a + count, lo + phase.counts[k])
                    for sequence, offset, token, size in phase.cut(k, first - lo, stop - lo) if first < stop else ():
                        at = token + lo - a
                        row = (d, at, size, zlib.crc32(view[4 * at:4 * (at + size)]), count, sequence, offset, s)
                        for values, value in zip(out, row, strict=True):
                            values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out[:7]] + [pa.array(out[7], pa.string())], names)

    names = ["doc_id", "start", "n", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    rows = ids.join(bases, ["part", "source"]).select(
        "doc_id", (F.col("base") + F.col("source_start")).alias("at"), "n_tokens", "ids", "source", "queue")
    schema = ", ".join(f"{c} BIGINT" for c in names[:7]) + ", source STRING"
    return rows.mapInArrow(cut, schema)
