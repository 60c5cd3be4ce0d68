"""Compresses vectors to short codes: a small codebook per part, learnt by ball k-means.

Components become integers floor(scale * x); every vector is cut into ``PARTS`` equal parts, and each
part position has a codebook of ``ENTRIES`` entries. Rounds assign every part to its nearest entry
(squared Euclidean distance in whole numbers, ties to the lower index) and move each entry to the
floored mean of its parts; an unused entry stays.

The parts that held an entry in the last round are its ball: the entry at its centre, the radius
the largest distance of a part. By the triangle inequality another entry can only be as near as the
own one if half its distance from it is within the part's distance, so
 * an entry is a neighbour of a ball only if half their distance is within the radius,
 * parts nearer to their entry than half the way to its nearest neighbour, the stable core, are done,
 * neighbours by distance cut the rest into annular rings; a part in ring k compares its first k only.
All conditions are on whole numbers (4 d^2 >= c^2), so assignments are those of a full search. Each
batch of rows forms its own balls, whose radii are within those of all rows: no ball is collected.

A round is one map-only pass that writes the codes beside the integers, and sums per (part, entry),
at most ``PARTS * ENTRIES`` rows a task; the driver holds only codebooks. The table of the round
before last is removed. Errors are summed in 64 bits, per label in decimals.

Defined results: a row whose vector is null, empty, or holds a null, a NaN, an infinity or a component of
an absolute value above ``LIMIT`` (so that sums stay within 64 bits) is dropped. Vectors must have the length of the first kept
vector and it must be a multiple of ``parts``; an error says so otherwise. Fewer than ``ENTRIES`` kept
rows give as many entries; rows of equal ids start the codebook in the order of their components, null ids last.
Repeated rows count as often as they stand. No kept row gives no rows. Other columns are ignored; null labels
are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import cut, drop_cut, ship
from estratia.operators.joins import join_unique

ship(__name__)

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 4_096.0


def nearest(points: np.ndarray, entries: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry and the squared distance; ``held`` is any first guess."""
    gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    best, least = held.copy(), np.empty(len(points), np.int64)
    order = np.argsort(held, kind="stable")
    edges = np.searchsorted(held[order], np.arange(len(entries) + 1))
    for own in range(len(entries)):
        ball = order[edges[own] : edges[own + 1]]
        if not len(ball):
            continue
        apart = points[ball] - entries[own]
        d = np.einsum("ij,ij->i", apart, apart)
        least[ball] = d
        # Neighbours of the ball, by distance; an entry equal to the own one counts for ties
        others = np.delete(np.argsort(gap[own], kind="stable"), np.flatnonzero(np.argsort(gap[own], kind="stable") == own))
        others = others[gap[own][others] <= 4 * d.max()]
        # Ring of each part: how many neighbours can be as near as its own entry; 0 is the stable core
        ring = np.searchsorted(gap[own][others], 4 * d, side="right")
        outward = np.argsort(-ring, kind="stable")
        reach = np.searchsorted(-ring[outward], -np.arange(1, len(others) + 1), side="right")
        for other, n in zip(others, reach):
            some = ball[outward[:n]]
            apart = points[some] - entries[other]
            d2 = np.einsum("ij,ij->i", apart, apart)
            better = (d2 < least[some]) | ((d2 == least[some]) & (other < best[some]))
            best[some[better]], least[some[better]] = other, d2[better]
    return best, least


def _matrix(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    lists = batch[name]
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(lists), -1)


def _assigner(books: np.ndarray, final: bool):
    """Writes each row's codes under these codebooks (part, entry, component); the last pass also its error."""
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch, "ints", np.int64)
            held = _matrix(batch, "codes", np.int64)
            codes, error = np.empty_like(held), np.zeros(len(points), np.int64)
            for p in range(parts):
                codes[:, p], d = nearest(points[:, p * width : (p + 1) * width], books[p], held[:, p])
                error += d
            flat = pa.array(codes.astype(np.int32).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * parts), flat)
            last = pa.array(error) if final else batch["ints"]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], last, listed], names=["vec_id", "label", "last", "codes"])

    return assign


def _summer(parts: int, entries: int, width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            points, codes = _matrix(batch, "ints", np.int64), _matrix(batch, "codes", np.int64)
            for p in range(parts if len(points) else 0):
                own = codes[:, p]
                order = np.argsort(own, kind="stable")
                used, first = np.unique(own[order], return_index=True)
                total[p, used] += np.add.reduceat(points[order, p * width : (p + 1) * width], first, axis=0)
                count[p] += np.bincount(own, minlength=entries)
        p, e = np.nonzero(count)
        flat = pa.array(total[p, e].ravel(), pa.int64())
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), flat)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), sums, pa.array(count[p, e])], names=["part", "entry", "sums", "n"])

    return add


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floored mean of its parts."""
    parts, entries, width = books.shape
    sums = rows.select("ints", "codes").mapInArrow(_summer(parts, entries, width), "part long, entry long, sums array<long>, n long")
    each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts * entries rows
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    vec_id: str | Column = "vec_id",
    vector: str | Column = "embedding",
    label: str | Column = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, label, codes (entry per part), error and label_error, the error summed over equal labels."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    x = as_column(vector).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: F.coalesce(F.abs(v) <= LIMIT, F.lit(False))), F.lit(False)) & (F.size(x) > 0)
    ints = F.transform(x, lambda v: F.floor(v * scale).cast("int"))
    rows = vectors.where(sound).select(as_column(vec_id).alias("vec_id"), as_column(label).alias("label"), ints.alias("ints"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    zero = F.array_repeat(F.lit(0), parts).alias("codes")
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, last array<int>, codes array<int>"
    now = cut(rows.select("vec_id", "label", "ints", zero))
    first = now.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    if not first:
        none = now.select("vec_id", "label", "codes", F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, np.empty((parts, 0, 0), np.int64)
    dims = len(first[0]["ints"])
    if dims % parts or not now.where(F.size("ints") != dims).isEmpty():
        raise ValueError(f"vectors must all have one length, a multiple of {parts}; the first has {dims}")
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        coded = now.mapInArrow(_assigner(books, False), schema).withColumnRenamed("last", "ints")
        last, now = now, cut(coded)
        drop_cut(last)
        books = moved(now, books)
    final = schema.replace("last array<int>", "last long")
    done = cut(now.mapInArrow(_assigner(books, True), final).withColumnRenamed("last", "error"))
    drop_cut(now)
    sums = cut(done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("members")))
    # Null labels are one label of their own
    key = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key_"), F.col("label").isNull().alias("none_")]
    keyed = done.select("*", *key)
    whole = join_unique(keyed, sums.select(*key, "label_error", "members"), ["key_", "none_"], how="inner", members="members")
    return whole.select("vec_id", "label", "codes", "error", "label_error"), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that its codes stand for, each component the middle of its whole number."""
    table = F.array(*(F.array(*(F.array(*(F.lit((int(v) + 0.5) / scale) for v in e)) for e in part)) for part in books))
    vector = F.flatten(F.transform("codes", lambda c, i: F.get(F.get(table, i), c)))
    return codes.select("vec_id", vector.alias("vector"))
