"""MinHash near-duplicates: universal hash minima, banding, signature check, exact confirmation, large/small-star."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textscan as ts
from corpusloom.llm.components import connected_components, local_stars
from corpusloom.session import Table, ship

U64 = np.uint64
_P = "__corpusloom_"
SIGNED = "doc_id long, n_shingles long, set_key binary, text_key binary, signature array<int>"
#: A chunk of a cluster holds about so many sets, and so many shingles, at most.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Members of a band key that meet one copy of the key's smallest member.
STAR_ROWS = 256


def shingle_sets(texts: list[bytes], width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle names, sorted and distinct within each text, their bounds by text)."""
    pieces = ts.words(texts, lower)
    at = pieces.windows(width)
    value, owner = pieces.hashes(width, at), pieces.owner[at]
    short = np.flatnonzero((pieces.counts > 0) & (pieces.counts < width))
    if len(short):
        names = [hashlib.blake2b(pieces.names[16 * pieces.first[t] : 16 * pieces.first[t + 1]], digest_size=8, person=b"short").digest() for t in short]
        owner = np.concatenate((owner, short))
        value = np.concatenate((value, np.frombuffer(b"".join(names), "<u8").astype(U64)))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(value: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each whole set."""
    raw = value.tobytes()
    cuts = (8 * bounds).tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:])]


def minima(value: np.ndarray, bounds: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """(texts, hashes) int32 minima of `hashes` multiply-shift functions of a universal family; 0 for empty sets."""
    texts = len(bounds) - 1
    out = np.zeros((texts, hashes), np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        begins = bounds[full]
        add = np.random.default_rng(seed + 1).integers(0, 1 << 63, hashes, dtype=np.uint64)
        for k, c in enumerate(ts.odd_constants(hashes, seed)):
            out[full, k] = np.minimum.reduceat(((value * c + add[k]) >> U64(32)).astype(np.uint32), begins)
    return out.view(np.int32)


def signatures(docs: DataFrame, width: int, hashes: int, seed: int, lower: bool = True) -> DataFrame:
    """One row a document: set size, digests of the set and of the text, and the signature."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in ts.text_steps(batch.column(1)):
                value, bounds = shingle_sets(texts, width, lower)
                sig = minima(value, bounds, hashes, seed)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, sig.size + 1, hashes), pa.int32()), pa.array(sig.ravel(), pa.int32())
                )
                keys = [hashlib.sha256(t).digest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(set_keys(value, bounds), pa.binary()),
                        pa.array(keys, pa.binary()),
                        lists,
                    ],
                    ["doc_id", "n_shingles", "set_key", "text_key", "signature"],
                )

    return docs.mapInArrow(scan, SIGNED)


def _sets(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in ts.text_steps(batch.column(1)):
                value, bounds = shingle_sets(texts, width, lower)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(value, bounds), pa.binary()), lists], ["set_key", "shingles"])

    return docs.mapInArrow(scan, "set_key binary, shingles array<long>")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    seed: int = 7,
    lower: bool = True,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) for each row of docs.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct `width`-word
    shingles; words are runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z folded. A text of fewer words has the
    whole sequence as its one shingle; null, empty and blank texts have none and are linked with nothing. A component
    is named by its smallest id; kept marks that one. Rows of one id and text repeat their result; rows of one id with
    different texts are judged each by its own text. A null id is linked with nothing: component null, kept true.
    text_key is the SHA-256 of the text, that of no bytes for null. Other columns are ignored, empty tables give an
    empty table.

    Nodes of the graph are distinct sets, so equal sets are one node whatever their ids are. A pair at
    the threshold shares none of 32 bands of 4 minima with a chance of 5e-8. Below a band key, the smallest member is
    compared with all others; members of keys that then hold more than one component meet in blocks that count exactly.
    No cap, no lost links, and no emission of all pairs of a group.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A key that no batch of the scan can fill by itself: rows are small (about 600 bytes), texts stay where they are.
    signed = Table(signatures(docs, width, bands * rows, seed, lower))
    full = signed.df.filter("doc_id is not null and n_shingles > 0")
    # Distinct sets are the nodes of the graph, numbered as they are written. An id tells where to find a set's text.
    least = full.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "signature"), "doc_id").alias("r"), F.count("*").alias("n"))
    reps = Table(least.select("set_key", "r.doc_id", "r.signature", "n").withColumn("node", F.monotonically_increasing_id()))
    links = Table(_links(docs, reps.df, width, percent, bands, rows, lower))
    components = Table(connected_components(links.df))
    links.drop()
    # A component is called by the smallest id of all its documents. Sets of one row and no link need no name.
    met = reps.df.join(components.df, "node", "left").filter("component is not null or n > 1")
    nodes = Table(met.select("set_key", F.coalesce("component", "node").alias("component"), "doc_id"))
    components.drop()
    reps.drop()
    named = nodes.df.join(nodes.df.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("set_key", "component_id")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key"))
    return (
        signed.df.select("doc_id", "n_shingles", "text_key", own.alias("set_key"))
        .join(Table(named).df, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
            "text_key",
        )
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of linked documents: that of the smallest id and, among rows of that id with
    different texts, of the smallest digest; a repeated row of it stays once.

    Rows of null id and texts without words are in no group and all stay. Columns of any name pass through.
    """
    found = Table(near_duplicates(docs, id_col, text_col, **how))
    grouped = found.df.filter("doc_id is not null and n_shingles > 0")
    # Within a component that has rows of its smallest id, those of the first text stay.
    first = grouped.filter("kept").groupBy("component_id").agg(F.min("text_key").alias("first"), F.max("text_key").alias("last"), F.count("*").alias("n"))
    several = Table(first.filter("n > 1"))
    gone = grouped.filter("not kept").select("doc_id", "text_key")
    later = grouped.filter("kept").join(several.df.filter("first < last").select("component_id", "first"), "component_id").filter("text_key <> first")
    gone = Table(gone.union(later.select("doc_id", "text_key")).distinct()).df
    repeated = Table(grouped.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")).df
    key, at = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)), F.col(id_col).cast("long")
    marked = docs.withColumns({f"{_P}key": key, f"{_P}id": at})

    def rows_of(table: DataFrame, how: str) -> DataFrame:
        named = table.select(F.col("doc_id").alias(f"{_P}id"), F.col("text_key").alias(f"{_P}key"))
        return marked.join(named, [f"{_P}id", f"{_P}key"], how)

    marked = rows_of(gone, "left_anti")
    once = rows_of(repeated, "left_anti").unionByName(rows_of(repeated, "left_semi").dropDuplicates([f"{_P}id", f"{_P}key"]))
    return once.select(*docs.columns)


def _links(docs, reps, width, percent, bands, rows, lower) -> DataFrame:
    """(a, b) confirmed links that connect the nodes of reps as all links would."""
    keyed = reps.select(
        "node",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(j, F.slice("signature", j * rows + 1, rows)))
        ).alias("key"),
    )
    shared = Table(
        keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
        .select("key", "pivot", F.ceil(F.col("n") / STAR_ROWS).cast("int").alias("parts"))
    )
    # Text-heavy work below touches only documents that share a band key with another.
    members = Table(keyed.join(shared.df, "key"))
    shared.drop()
    nodes = members.df.select("node").distinct()
    seen = Table(reps.join(nodes, "node", "left_semi").select("set_key", "node", "doc_id", "signature"))
    ids = seen.df.select("doc_id").distinct()
    # An id may have other texts besides; of equal sets one is enough.
    sets = _sets(docs.join(ids, "doc_id", "left_semi"), width, lower).join(seen.df.select("set_key", "node"), "set_key")
    sets = Table(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    # The smallest member of a key is compared with every other one.
    stars = Table(
        members.df.filter("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("parts").alias("parts"))
    )
    confirmed = Table(_confirm(stars.df, seen.df, sets.df, percent))
    stars.drop()
    seen.drop()
    found = Table(connected_components(confirmed.df))
    named = Table(
        members.df.join(found.df, "node", "left").select("key", "node", "pivot", F.coalesce("component", "node").alias("component"))
    )
    members.drop()
    found.drop()
    # Keys that still hold several components: their members meet all others that such keys tie them to, directly or
    # through one another, in blocks.
    split = named.df.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = Table(named.df.join(split.filter("low < high").select("key"), "key").select("node", "pivot", "component").distinct())
    named.drop()
    if rest.df.isEmpty():
        return confirmed.df
    tied = Table(connected_components(rest.df, "pivot", "node"))
    placed = Table(
        rest.df.select("node", "component").distinct()
        .join(tied.df.select("node", F.col("component").alias("cluster")), "node")
        .join(sets.df.select("node", F.size("shingles").alias("size")), "node")
    )
    rest.drop()
    tied.drop()
    return confirmed.df.union(_block_links(placed.df, sets.df, percent))


def _block_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each cluster of placed, links that tie its components together as all links between them would.

    Clusters are dealt over pairs of chunks, so that a block never holds more than about two times BLOCK_DOCS sets or
    BLOCK_SHINGLES shingles. A block counts all intersections at once, as products of 0/1 matrices, and gives a
    spanning star for each set of linked members: no pairs leave it.
    """
    chunks = placed.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("size") / BLOCK_SHINGLES)).alias("chunks")
    )
    blocks = (
        placed.join(Table(chunks).df, "cluster")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("cluster", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "component")
    )
    full = blocks.join(sets, "node").select(
        "cluster", "low", "high", "chunk", "node", "component", "shingles"
    )
    dealt = full.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    names = ("cluster", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                own = tuple(key[:, begin].tolist())
                if own != now and held:
                    yield from links(held)
                    held = []
                now = own
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from links(held)

    def links(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(parts).combine_chunks()
        node, component, chunk = (block.column(c).to_numpy() for c in ("node", "component", "chunk"))
        if len(np.unique(component)) < 2:
            return
        lists = block.column("shingles").chunk(0)
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        owner = np.repeat(np.arange(len(node)), sizes)
        _, at, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = np.cumsum(count > 1) - 1  # shingles of one set alone cannot be in an intersection
        met = count[at] > 1
        owner, at = owner[met], common[at[met]]
        by = np.argsort(at, kind="stable")
        owner, at = owner[by], at[by]
        shared = np.zeros((len(node), len(node)), np.float32)
        width = max(1, (4 << 20) // len(node))
        for begin in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            lo, hi = np.searchsorted(at, (begin, begin + width))
            ones = np.zeros((len(node), width), np.float32)
            ones[owner[lo:hi], at[lo:hi] - begin] = 1
            shared += ones @ ones.T
        union = sizes[:, None] + sizes[None, :] - shared
        linked = np.triu((100 * shared >= percent * union) & (component[:, None] != component[None, :]), 1)
        a, b = np.nonzero(linked)
        if len(a):
            of, root = local_stars(node[a], node[b])
            yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(of)], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").filter("a <> b")


def _confirm(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Signature check with a margin of eight standard deviations, then the full sets decide.

    A pivot that meets many members is copied once for each STAR_ROWS of them, so that none of them share a task only
    because they share a pivot.
    """
    floor = max(0.0, percent / 100 - 0.3)
    alike = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("part")
    pivots = Table(pairs.select("a", "parts").distinct().select("a", "parts", copies))
    at = ["a", "parts", "part"]
    close = (
        pairs.join(signed.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        .join(pivots.df.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a"), at)
        .filter(alike >= F.size("sa") * F.lit(floor))
        .select(*at, "b")
    )
    both = close.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b").join(
        pivots.df.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a"), at
    )
    common = F.size(F.array_intersect("xa", "xb"))
    return (
        both.withColumn("i", common)
        .filter(100 * F.col("i") >= percent * (F.size("xa") + F.size("xb") - F.col("i")))
        .select("a", "b")
    )
