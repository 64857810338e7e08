"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components, local_stars
from corpusloom.llm.vectors import dimension, matrix, takes_part, unit
from corpusloom.session import Table, ship

#: Bits of a code; the error of an estimate falls with their square root.
CODE_BITS = 512
#: Standard errors between an estimate and a bound that decides without the vectors.
EPSILON = 5.5
#: Rows of a bucket compared in one block; larger buckets are dealt over pairs of chunks.
CHUNK = 512
#: Rows that a task gathers, in whole blocks, before it compares them.
FLUSH = 16_384


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """(dim, bits): a random rotation of the zero-padded space, restricted to the first dim axes."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits, correction factors <code, vector>) of unit vectors."""
    y = x @ turn
    return y >= 0, np.abs(y).sum(axis=1) / math.sqrt(turn.shape[1])


def estimates(a: np.ndarray, b: np.ndarray, factor_a: np.ndarray, factor_b: np.ndarray, bits: int) -> np.ndarray:
    """Estimated inner products of unit vectors from packed codes and factors alone.

    The product of two codes is 1 - 2 * differing bits / all bits; over both factors it has, over random rotations, the
    arcsine of the inner product as its mean.
    """
    product = 1 - 2 * differing(a, b) / bits
    return np.sin(np.clip(product / (factor_a * factor_b), -math.pi / 2, math.pi / 2))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def open_bound(threshold: float, bits: int) -> int:
    """Pairs with more differing bits than this are EPSILON standard errors below the threshold: a bit differs with a
    chance of angle / pi, bits of a rotation being no more alike than independent ones."""
    share = math.acos(threshold) / math.pi
    return math.floor(bits * share + EPSILON * math.sqrt(bits * share * (1 - share)))


def band_plan(n: int, threshold: float, bits: int, missed: float, seed: int) -> np.ndarray:
    """(bands, positions) of code bits. A band has log2(n) + 2 bits, so that strangers seldom meet; there are as many
    bands as leave a pair at the threshold out of all of them with a chance of `missed`, averaged over the numbers of
    bits in which such a pair differs."""
    width = max(4, min(48, math.ceil(math.log2(max(n, 2))) + 2))
    share = math.acos(threshold) / math.pi
    m = np.arange(bits + 1)
    log_factorial = np.array([math.lgamma(k + 1) for k in range(bits + 1)])
    chance = np.exp(log_factorial[bits] - log_factorial - log_factorial[::-1] + m * math.log(share) + (bits - m) * math.log1p(-share))
    agree = np.prod([np.maximum(bits - m - j, 0) / (bits - j) for j in range(width)], axis=0)
    bands = 1
    while (chance * (1 - agree) ** bands).sum() > missed:
        bands += 1
    rng = np.random.default_rng(seed + 1)
    return np.stack([np.sort(rng.choice(bits, width, replace=False)) for _ in range(bands)])


def embedding_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    missed: float = 1e-5,
    seed: int = 5,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Two rows are linked if the cosine of their vectors, in double precision, is at least the threshold. Vectors that
    are null, zero, empty or hold null or non-finite components are linked with nothing; shorter ones count as padded
    with zeros. Rows of equal vectors are linked; a repeated row counts as one more, and rows of one id are judged each
    by its own vector. A null id has a null component and is kept. Other columns are ignored; empty tables give an empty table.

    Equal vectors are collapsed. Rows meet where bands of their code bits agree; a pair at the threshold meets nowhere
    with a chance of `missed`. Buckets are dealt over pairs of chunks, and only codes are sent to them: the estimates of
    codes and factors, with their bounds, rule pairs out, and a pair that meets in several buckets is judged in the
    first. Rows that are left with an undecided pair get their vectors, which decide exactly. Blocks give counts and
    spanning edges, never their pairs.
    """
    spark = ship(vectors.sparkSession)
    # Single precision stays so until vectors are compared: half the bytes, and the same numbers.
    kind = vectors.schema[vector_col].dataType.simpleString()
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    valid = given.filter(takes_part(F.col("v")) & F.col("vec_id").isNotNull())
    dim = dimension(valid, "v")
    empty = F.lit(None).cast("long")
    if not dim:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("vec_id", empty).alias("component_id"), F.lit(True).alias("kept"))
    # Distinct vectors are the vertices, numbered as they are written.
    reps = Table(valid.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("m")).withColumn("rep", F.monotonically_increasing_id()))
    n = reps.df.count()
    turn = rotation(dim, CODE_BITS, seed)
    plan = band_plan(n, threshold, CODE_BITS, missed, seed)
    bands, width = plan.shape
    plan_bytes = spark.sparkContext.broadcast((turn, plan))  # fixed by dim and log2(n)
    key_weights = np.uint64(1) << np.arange(width, dtype=np.uint64)

    def keys_of(bits: np.ndarray) -> np.ndarray:
        band_bits = bits[:, plan_bytes.value[1]]  # rows, bands, width
        return (band_bits * key_weights).sum(axis=2, dtype=np.uint64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = plan_bytes.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                bits, factor = encode(unit(matrix(batch.column(1), dim)), turn)
                mixed = keys_of(bits) * np.uint64(bands) + np.arange(bands, dtype=np.uint64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, mixed.size + 1, bands), pa.int32()), pa.array(mixed.view(np.int64).ravel())
                )
                packed = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, packed, pa.array(factor, pa.float32())], ["rep", "keys", "code", "factor"])

    coded = Table(reps.df.select("rep", "v").mapInArrow(code, "rep long, keys array<long>, code binary, factor float"))
    keyed = coded.df.select("rep", F.explode("keys").alias("key"))
    shared = Table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / CHUNK).alias("chunks")))
    members = keyed.join(shared.df.select("key", "chunks"), "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    blocks = (
        members.select("rep", "key", "chunk", other)
        .select("rep", "key", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    )
    limit = open_bound(threshold, CODE_BITS)
    names = ("key", "low", "high")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*names).sortWithinPartitions(*names)

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole blocks, of about FLUSH rows."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= FLUSH:
                table = pa.Table.from_batches(held).combine_chunks()
                name = np.stack([table.column(c).to_numpy() for c in names])
                differs = np.flatnonzero((name[:, :-1] != name[:, -1:]).any(axis=0))
                cut = int(differs[-1]) + 1 if len(differs) else 0
                if cut:
                    yield table.slice(0, cut).combine_chunks()
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def undecided(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one block that estimates do not rule out, in the first bucket in which they meet."""
        col = {c: table.column(c).to_numpy() for c in ("key", "chunk", "low", "high", "factor")}
        packed = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        code, every = packed.view(np.uint64), keys_of(np.unpackbits(packed, axis=1))
        band = (col["key"].view(np.uint64) % np.uint64(bands)).astype(np.int64)
        i = np.arange(table.num_rows - 1)
        step = 1
        while len(i):
            i = i[i + step < table.num_rows]
            same = np.ones(len(i), bool)
            for c in names:
                same &= col[c][i] == col[c][i + step]
            i = i[same]
            across = (col["low"][i] == col["high"][i]) | (col["chunk"][i] != col["chunk"][i + step])
            p = i[across]
            for at in range(0, len(p), 16_384):
                a = p[at : at + 16_384]
                b = a + step
                near = differing(code[a], code[b]) <= limit
                near |= estimates(code[a], code[b], col["factor"][a], col["factor"][b], CODE_BITS) >= threshold
                a, b = a[near], b[near]
                first = (every[a] == every[b]).argmax(axis=1) == band[a]
                if first.any():
                    yield a[first], b[first]
            step += 1

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each block that have an undecided pair."""
        for table in whole_blocks(batches):
            open_ = np.zeros(table.num_rows, bool)
            for a, b in undecided(table):
                open_[a] = open_[b] = True
            if open_.any():
                yield from table.select([*names, "chunk", "rep", "code", "factor"]).filter(pa.array(open_)).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            x = unit(matrix(table.column("v").chunk(0), dim))
            rep, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in undecided(table):
                exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                links.append((a[exact], b[exact]))
            a = np.concatenate([k[0] for k in links]) if links else np.empty(0, np.int64)
            b = np.concatenate([k[1] for k in links]) if links else np.empty(0, np.int64)
            if not len(a):
                continue
            ids, at = np.unique(np.concatenate((rep[a], rep[b])), return_inverse=True)
            counts = np.zeros(len(ids), np.int64)
            np.add.at(counts, at, np.concatenate((m[b], m[a])))
            node, root = local_stars(rep[a], rep[b])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.nulls(len(ids), pa.int64())], ["rep", "n", "root"])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.zeros(len(node), np.int64)), pa.array(root)], ["rep", "n", "root"])

    coded_rows = dealt(blocks.join(coded.df.select("rep", "code", "factor"), "rep"))
    left = Table(coded_rows.mapInArrow(rule_out, "key long, low long, high long, chunk long, rep long, code binary, factor float"))
    shared.drop()
    full = dealt(left.df.join(reps.df.select("rep", "v", "m"), "rep"))
    found = Table(full.mapInArrow(compare, "rep long, n long, root long").groupBy("rep", "root").agg(F.sum("n").alias("n")))
    left.drop()
    coded.drop()
    counted = found.df.filter("root is null").select("rep", "n")
    components = connected_components(found.df.filter("root is not null"), "rep", "root").withColumnRenamed("node", "rep")
    of_rep = Table(
        reps.df.join(counted, "rep", "left")
        .join(components, "rep", "left")
        .select("v", "low", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    lowest = of_rep.df.groupBy("component").agg(F.min("low").alias("component_id"))
    of_rep = Table(of_rep.df.join(lowest, "component").select("v", "n_links", "component_id"))
    # Vectors that take no part never meet a key, whatever Spark makes of NaN in equalities.
    key = F.when(takes_part(F.col("v")) & F.col("vec_id").isNotNull(), F.col("v"))
    return (
        given.select("vec_id", key.alias("v"))
        .join(of_rep.df, "v", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
        )
    )
