"""Line dedup: windows of three consecutive lines, repeated ones found globally, later occurrences cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textscan as ts
from corpusloom.session import Table, ship

_P = "__corpusloom_"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with the text cut, and three columns more, prefixed: n_lines, n_removed and kept (false for null texts).

    A text is split at \\n. A window is `width` consecutive lines of one document; windows are equal if 128-bit
    cryptographic digests of their lines are. The first occurrence of a window, by id and then by position, stays; of
    each later one, in another document or the same, every line goes. Kept lines are joined by \\n; a text that loses
    all lines is empty. Texts of fewer lines, null texts and rows of null id stay as they are. Rows of one id and text
    are cut alike; of one id and different texts, the smallest position among them all has a window first. Columns of
    any name pass through. Empty tables stay empty.
    """
    ship(docs.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, _, texts in ts.text_steps(batch.column(1)):
                pieces = ts.lines(texts)
                at = pieces.windows(width)
                if len(at):
                    name = pieces.digests(width, at)
                    owner = pieces.owner[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(ids[begin + owner], pa.int64()), pa.array(at - pieces.first[owner])],
                        ["h", "g", "doc_id", "pos"],
                    )

    met = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .filter("doc_id is not null and text is not null")
        .mapInArrow(windows, "h long, g long, doc_id long, pos long")
    )
    place = F.struct("doc_id", "pos")
    firsts = Table(
        met.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h", "g", "first")
    )
    later = Table(
        met.join(firsts.df, ["h", "g"])
        .filter(place > F.col("first"))
        .groupBy(F.col("doc_id").alias(f"{_P}id"))
        .agg(F.collect_set(F.struct("pos", "h")).alias(f"{_P}later")),
    )
    firsts.drop()
    joined = docs.join(later.df, F.col(id_col).cast("long") == F.col(f"{_P}id"), "left").drop(f"{_P}id")
    place_of_text = docs.columns.index(text_col)
    schema = T.StructType(
        [*docs.schema.fields, *(T.StructField(_P + c, t) for c, t in (("n_lines", T.LongType()), ("n_removed", T.LongType()), ("kept", T.BooleanType())))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place_of_text)
            marks = batch.column(batch.num_columns - 1)
            for begin, end, texts in ts.text_steps(column):
                own = marks.slice(begin, end - begin)
                sizes = np.asarray(own.value_lengths().fill_null(0))
                # A null text has no lines; texts without marks are counted and pass as they are.
                counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
                removed = np.zeros(end - begin, np.int64)
                new = column.slice(begin, end - begin)
                met = np.flatnonzero(sizes)
                if len(met):
                    flat = own.flatten()
                    pos, want = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "h"))
                    bounds = np.concatenate(([0], np.cumsum(sizes)))
                    pieces = ts.lines([texts[t] for t in met.tolist()])
                    out = new.to_pylist()
                    for k, t in enumerate(met.tolist()):
                        mine = slice(bounds[t], bounds[t + 1])
                        # Another text of the same id may have marks that are none of this one.
                        fits = pos[mine] + width <= counts[t]
                        at = pos[mine][fits]
                        at = at[pieces.digests(width, pieces.first[k] + at)[:, 0] == want[mine][fits]]
                        gone = ts.covered(counts[t], at, width)
                        removed[t] = gone.sum()
                        if removed[t]:
                            out[t] = ts.kept_lines(texts[t], gone).decode()
                    new = pa.array(out, column.type)
                null = np.asarray(column.slice(begin, end - begin).is_null())
                columns = [c.slice(begin, end - begin) for c in batch.columns[:-1]]
                columns[place_of_text] = new
                columns += [pa.array(np.where(null, 0, counts)), pa.array(removed), pa.array(~null)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(cut, schema)
