"""Packing of tokenised documents into sequences by linear grouping.

Documents become pieces of at most ``CAPACITY`` tokens in one pass, which also
numbers the pieces of each length within its partition.  The histogram of
lengths (at most ``CAPACITY`` rows, whatever the corpus) is all that the plan
needs:

1.  Large lengths, in falling order, form groups of equal cardinality, and each
    is rounded up to the largest of its group; where no more lengths occur than
    groups are allowed, each length is a group and nothing is rounded.
2.  Configurations of the few rounded sizes are chosen one after another, each
    for the largest size left, and used as often as the remaining counts allow.
    A configuration takes the largest sizes that fit, and the last places of it
    by the fullest sum; after how many places that begins is tried for several
    numbers, and the plan with the fewest sequences is kept.
3.  The documents of a group take the places of its size, which leaves gaps.
4.  Small lengths go, in falling order, to the smallest gap that holds them.

The plan is a list of intervals: the documents of one length with ranks in an
interval go to consecutive sequences at one offset.  A second pass looks each
piece up by its length and rank; the pieces meet the small table of their
partition's first ranks in a join.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import in_batches, materialise, table

CAPACITY = 1024
END_ID = 2
#: Groups of equal cardinality at most.
GROUPS = 1024
#: Places of a configuration that are filled by the largest size that fits; the rest by the fullest sum.
LARGEST_FIRST = (1, 2, 3, CAPACITY)
#: Lengths up to this are small.
SMALL = CAPACITY // 8


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of one of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, object] = {}
#: A run of white space from which on tiktoken's pattern needs more stack than it has (a few million characters).
_WHITE_RUN = 400_000
_white_run = re.compile(rf"\s{{{_WHITE_RUN}}}")


def encoder(path: str):
    """A function from a list of texts to their ids, made once in a worker.

    ``path`` is a ``tokenizers`` JSON file; the ids are those of ``tokenizers``
    with ``add_special_tokens=False``, so the strings of special tokens in a text
    become their ids.  Where the same vocabulary lies beside it as ranks,
    tiktoken encodes what stands between these, several times as fast (a test
    compares the two); texts with very long runs of white space go to
    ``tokenizers``, which is loaded when the first of them comes.
    """
    if path not in _encoders:

        @functools.cache
        def tokenizer():
            from tokenizers import Tokenizer

            return Tokenizer.from_file(path)

        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            special = {x["content"]: x["id"] for x in json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]}
            pairs = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, ranks.read_bytes().splitlines()))
            of = tiktoken.Encoding(ranks.name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
            around = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

            def encode(text: str) -> list[int]:
                if len(text) >= _WHITE_RUN and _white_run.search(text):
                    return tokenizer().encode(text, add_special_tokens=False).ids
                if not any(x in text for x in special):
                    return of.encode_ordinary(text)
                return [i for part in around.split(text) if part for i in ([special[part]] if part in special else of.encode_ordinary(part))]

            _encoders[path] = lambda texts: [encode(x) for x in texts]
        else:
            _encoders[path] = lambda texts: [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, its partition ``part`` and number ``nth`` among the partition's pieces of its length."""
    path = path or vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                rows = []
                for i, ids in enumerate(encode(texts)):
                    raw = np.array([*ids, END_ID], dtype="<u4").tobytes()
                    for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        rows.append((i, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), seen[length]))
                        seen[length] += 1
                r = np.array(rows, dtype=np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256).take(pa.array(r[:, 0])), pa.array(r[:, 1].astype(np.int32)), pa.array(r[:, 2]), pa.array(r[:, 3]), pa.array(r[:, 4]), pa.array(np.full(len(r), part, np.int32)), pa.array(r[:, 5])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, schema)


@dataclass
class _Run:
    """``count`` consecutive sequences from ``first`` with equal contents."""

    first: int
    count: int
    used: int


@dataclass(frozen=True)
class Plan:
    """Intervals: the ``count`` documents of ``length`` from rank ``rank`` go to the sequences from ``first`` on, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of documents given by length and rank."""
        # intervals are sorted by length and rank; ranks are below 2**44
        key, at = (self.length << np.int64(44)) + self.rank, (length << np.int64(44)) + rank
        i = np.searchsorted(key, at, side="right") - 1
        return self.first[i] + rank - self.rank[i], self.offset[i]


def _fullest(sizes: list[int], left: list[int], head: int, room: int) -> list[int]:
    """Groups from ``head`` on, with ``left`` documents each, whose sizes (they fall) come nearest to ``room``."""
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    came = np.full(room + 1, -1, dtype=np.int64)  # the group whose size was added last
    for g in range(head, len(sizes)):
        size = sizes[g]
        new = reach
        for _ in range(min(left[g], room // size)):
            shifted = np.zeros_like(reach)
            shifted[size:] = new[: room + 1 - size]
            new = shifted & ~reach
            if not new.any():
                break
            came[new] = g
            reach = reach | new
        if reach[room]:
            break
    total = int(np.flatnonzero(reach)[-1])
    out = []
    while total:
        out.append(int(came[total]))
        total -= sizes[out[-1]]
    return out


def _configuration(sizes: list[int], left: list[int], head: int, capacity: int, largest_first: int) -> list[int]:
    """Groups of one sequence that holds one of group ``head`` (earlier groups are used up)."""
    out, room, rest = [], capacity, list(left)
    g = head
    while g < len(sizes) and len(out) < largest_first:
        if rest[g] and sizes[g] <= room:
            out.append(g)
            rest[g] -= 1
            room -= sizes[g]
        else:
            g += 1
    return out + (_fullest(sizes, rest, g, room) if g < len(sizes) else [])


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> Plan:
    """Plan for ``counts[length]`` documents of each length from 1 to the capacity: that of the fewest sequences over LARGEST_FIRST."""
    return min((_plan(counts, capacity, groups, small, n) for n in LARGEST_FIRST), key=lambda p: p.sequences)


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int, largest_first: int) -> Plan:
    rows: list[tuple[int, int, int, int, int]] = []
    runs: list[_Run] = []
    sequences = 0
    taken = dict.fromkeys(counts, 0)

    # 1. large documents by falling length: equal shares of the ranks, each rounded up to its largest length
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if n > small and counts[n]]
    ends = np.cumsum([c for _, c in large])
    total = int(ends[-1]) if large else 0
    share = max(1, -(-total // groups))
    starts = [0, *map(int, ends[:-1])] if 0 < len(large) <= groups else list(range(0, total, share))
    sizes = [large[int(np.searchsorted(ends, s, side="right"))][0] for s in starts]
    left = np.diff([*starts, total]).tolist()
    cursor = list(starts)

    # 2. configurations, and 3. the documents that take their places
    for head in range(len(sizes)):
        while left[head]:
            config = _configuration(sizes, left, head, capacity, largest_first)
            uses = {g: config.count(g) for g in config}
            times = min(left[g] // k for g, k in uses.items())
            slots = []
            for g in config:
                slots.append(cursor[g])
                cursor[g] += times
                left[g] -= times
            done = 0
            while done < times:
                # sequences in a row whose places are taken by documents of the same lengths
                at = [int(np.searchsorted(ends, s + done, side="right")) for s in slots]
                step = min(times - done, *(int(ends[i]) - s - done for i, s in zip(at, slots, strict=True)))
                used = 0
                for i in at:
                    n = large[i][0]
                    # documents of one length are interchangeable, so ranks are dealt as they come
                    rows.append((n, taken[n], step, sequences, used))
                    taken[n] += step
                    used += n
                runs.append(_Run(sequences, step, used))
                sequences += step
                done += step

    # 4. small documents: best fit into the gaps, then into new sequences
    gaps: dict[int, list[_Run]] = {}
    order: list[int] = []

    def free(run: _Run) -> None:
        gap = capacity - run.used
        if gap and run.count:
            if gap not in gaps:
                gaps[gap] = []
                heapq.heappush(order, gap)
            gaps[gap].append(run)

    for run in runs:
        free(run)
    for n in sorted((n for n in counts if n <= small and counts[n]), reverse=True):
        rest = counts[n]
        while rest:
            fit = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if fit is None:
                run = _Run(sequences, -(-rest // (capacity // n)), 0)
                sequences += run.count
            else:
                run = gaps[fit].pop()
            some = min(rest, run.count)
            rows.append((n, taken[n], some, run.first, run.used))
            taken[n] += some
            rest -= some
            free(_Run(run.first + some, run.count - some, run.used))
            free(_Run(run.first, some, run.used + n))
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequences)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document is its ids and ``END_ID``; null and empty texts are ``END_ID``
    alone.  Longer documents, however long, are cut into pieces of the capacity, the
    first of which may be shorter.  Every row is packed: repeated rows and null
    ids too.  An empty table has no sequences.  Other columns of ``docs`` are
    not returned, whatever their names.
    """
    cutted = materialise(pieces(docs, path, capacity))
    by_part = cutted.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, capacity, groups, capacity // 8))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cutted.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return in_batches(ranked).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
