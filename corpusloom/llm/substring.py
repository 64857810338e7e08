"""Substring dedup: a count-min prefilter of merged partition sketches, then exact groups of estimated repeats only."""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textscan as ts
from corpusloom.session import Table, ship

U64 = np.uint64
_P = "__corpusloom_"
#: Cells of each of the two sketch rows: a quarter to an eighth of them used, within these powers of two.
LEAST_BITS, MOST_BITS = 16, 28
_SHARD_BITS = 6
#: Windows that a partition gathers before it writes out a partial sketch.
FLUSH = 1 << 21
#: Characters of text whose partial sketches one task per shard merges; so many such merges then meet in one task.
GROUP_CHARS, FAN = 1 << 31, 64


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each window in each of the two rows: disjoint bits of a mixed hash."""
    return (h >> U64(64 - bits)).astype(np.uint32), (h & U64((1 << bits) - 1)).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cells as differences, low bytes and high bytes apart: about a byte a window once compressed."""
    step = np.diff(cells, prepend=np.uint32(0)).astype(np.uint32)
    planes = step.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint64).astype(np.uint32)


def _partial(windows: list[np.ndarray], bits: int, part: int) -> pa.RecordBatch:
    h = np.concatenate(windows)
    shards, packed = [], []
    span = bits - _SHARD_BITS
    for row, cells in enumerate(_cells(h, bits)):
        cells = np.sort(cells)
        cuts = np.searchsorted(cells, np.arange(1, 1 << _SHARD_BITS, dtype=np.uint64) << U64(span))
        for shard, own in enumerate(np.split(cells, cuts)):
            if len(own):
                shards.append(row << _SHARD_BITS | shard)
                packed.append(_pack(own & np.uint32((1 << span) - 1)))
    parts = pa.array(np.full(len(shards), part, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), parts, pa.array(packed, pa.binary())], ["shard", "part", "packed"])


_BITMAPS = "shard int, part long, once binary, twice binary"


def _by_group(rows: Iterator[pa.RecordBatch], size: int, add) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the cells met and of those met again, for each run of equal (shard, part); `add` brings in a row."""
    now, once, twice = None, np.zeros(size, np.uint8), np.zeros(size, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), *(pa.array([m.tobytes()], pa.binary()) for m in (once, twice))],
            ["shard", "part", "once", "twice"],
        )

    for batch in rows:
        for k, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if own != now:
                if now is not None:
                    yield done()
                now = own
                once[:], twice[:] = 0, 0
            met, again = add(batch, k)
            twice |= again | (once & met)
            once |= met
    if now is not None:
        yield done()


def repeated_cells(docs: DataFrame, width: int, bits: int, groups: int, key: int) -> list[np.ndarray]:
    """For each sketch row a bitmap of the cells whose merged count is 2 or more.

    Partial sketches are dealt over shards of the cell range and `groups` groups of partitions, and streamed one by one
    into bitmaps (met once, met again); bitmaps of FAN groups then meet, until one of each shard is left. A task's
    input is bounded whatever the table's size. Only the fixed-size result, 2**bits bits a row, reaches the driver.
    """
    size = 1 << (bits - _SHARD_BITS - 3)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for _, _, texts in ts.text_steps(batch.column(0)):
                pieces = ts.words(texts, key=key)
                h = pieces.hashes(width, pieces.windows(width))
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    yield _partial(held, bits, part % groups)
                    held, n, part = [], 0, part + 1
        if n:
            yield _partial(held, bits, part % groups)

    def counted(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        cells = _unpack(batch.column(2)[k].as_py())  # sorted
        again = np.zeros(8 * size, bool)
        again[cells[1:][cells[1:] == cells[:-1]]] = True
        met = np.zeros(8 * size, bool)
        met[cells] = True
        return np.packbits(met, bitorder="little"), np.packbits(again, bitorder="little")

    def joined(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(batch.column(c)[k].as_py(), np.uint8) for c in (2, 3))

    now = docs.select("text").mapInArrow(sketch, "shard int, part long, packed binary")
    add = counted
    while True:
        # Bound here, since the functions below run when the loop has moved on.
        def merge(batches: Iterator[pa.RecordBatch], add=add) -> Iterator[pa.RecordBatch]:
            return _by_group(batches, size, add)

        now = now.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(merge, _BITMAPS)
        if groups == 1:
            break
        groups, add = math.ceil(groups / FAN), joined
        now = now.withColumn("part", F.floor(F.col("part") / FAN))
    maps = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(2)]
    for shard, bitmap in Table(now.select("shard", "twice")).df.toLocalIterator():
        row, at = shard >> _SHARD_BITS, (shard & ((1 << _SHARD_BITS) - 1)) * size
        maps[row][at : at + size] = np.frombuffer(bitmap, np.uint8)
    return maps


def _hit(maps: list[np.ndarray], h: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for bitmap, cells in zip(maps, _cells(h, bits)):
        out &= (bitmap[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """docs' id with the kept words: (doc_id, n_words, n_removed, kept), kept words joined by one space.

    A window is `width` consecutive words of one document, words being runs of bytes other than \\x20 and \\x09-\\x0D.
    Each word covered by a window whose words also start in a document of a smaller id goes; windows are judged on the
    input. Repeats inside one document stay. Null, empty and short texts have no windows. A null id neither loses nor
    claims words. Rows of one id count as one document. Other columns are ignored; empty tables give an empty table.

    The sketch is sized from the number of characters, up to 2**28 cells a row (64 MB in all): beyond that it lets
    more windows through to the exact groups, and still loses none. Windows are grouped by 128 bits:
    two 64-bit hashes, each of its own half of the words' 128-bit names, under a key drawn for the run.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(chars / 2 + 2))))
    known = docs.filter("doc_id is not null")
    key = secrets.randbits(128)  # of this run alone, so that no text can be made to collide; results do not depend on it
    shared = spark.sparkContext.broadcast(repeated_cells(known, width, bits, max(1, math.ceil(chars / GROUP_CHARS)), key))

    def found(pieces: ts.Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin that the sketch takes for repeated, and their first 64 bits."""
        at = pieces.windows(width)
        h = pieces.hashes(width, at)
        hit = _hit(shared.value, h, bits)
        return at[hit], h[hit]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, _, texts in ts.text_steps(batch.column(1)):
                pieces = ts.words(texts, key=key)
                at, h = found(pieces)
                if len(at):
                    g = pieces.hashes(width, at, half=1)
                    owner = ids[begin + pieces.owner[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(owner, pa.int64())], ["h", "g", "doc_id"])

    met = known.mapInArrow(candidates, "h long, g long, doc_id long")
    # Pre-aggregated map-side, then an equi-join whose hot passages AQE splits.
    owners = Table(met.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "g", "first"))
    later = Table(met.join(owners.df, ["h", "g"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("h").alias("later")))
    owners.drop()
    joined = docs.join(later.df, "doc_id", "left").select("doc_id", "text", "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in ts.text_steps(batch.column(1)):
                own = batch.column(2).slice(begin, end - begin)
                sizes = np.asarray(own.value_lengths().fill_null(0))
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                want = own.flatten().to_numpy(zero_copy_only=False)
                kept, n_words, removed = [], [], np.zeros(len(texts), np.int64)
                for t, text in enumerate(texts):
                    gone = np.zeros(0, bool)
                    if sizes[t]:
                        pieces = ts.words([text], key=key)
                        at, h = found(pieces)
                        at = at[np.isin(h.view(np.int64), want[bounds[t] : bounds[t + 1]])]
                        gone = ts.covered(len(pieces), at, width)
                        removed[t] = gone.sum()
                    if removed[t]:
                        n_words.append(len(gone))
                        kept.append(ts.kept_words(text, gone))
                    else:
                        n, parts = 0, []
                        for part in ts.word_parts(text):
                            n += len(part)
                            parts.append(b" ".join(part))
                        n_words.append(n)
                        kept.append(b" ".join([p for p in parts if p]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(n_words, pa.int64()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")

