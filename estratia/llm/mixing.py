"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents stand in a seeded order and are cut into blocks of ``BLOCK`` words, those of a
source under 64 such blocks into smaller ones; sources of equal blocks are apportioned together. The
blocks of the mix are awarded one by one to the source of the highest quotient target / (2k + 1)
(k: blocks it has; ties to the earlier source); the blocks of shard s are those awarded between
s / n and (s + 1) / n of all, so every shard has whole quotas. A source's takings are numbered in the
seeded order of its blocks, every block once before any is taken again; those of shard s are the
numbers between its sums of awarded blocks up to s - 1 and up to s. A source of quota q and n blocks
gives every block floor(q / n) times and q mod n of them once more: those whose multiple of the
quota, from a seeded start, wraps, which is an even spread over the seeded order.

Defined results: a null text has no words; documents without words are never taken; a null source is
a source of its own, after all others; sources are in order of code points; repeated rows are
documents of their own, told apart by their text; a source without words has target 0; very long texts
are cut into blocks like any other; other columns are not read; empty tables give no rows. Per-source sums, one
row per source, are the only rows that reach the driver.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import NOT_SPACE, ROWS_PER_SLICE, SEED_RANGE, SPACE, cut, rejoined, running, seeded, whole, words

BLOCK = 256
WEIGHTS = (5, 2, 1)
COPIES = 3
SHARDS = 16
SEED = 11


def targets(sizes: list[int], weights: list[int], copies: int = COPIES) -> list[Fraction]:
    """Share of all sizes by weight; no source above ``copies`` times its size, the excess reshared."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > copies * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            return out
        for i in full:
            out[i] = Fraction(copies * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def quotas(wanted: list[Fraction], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients wanted / (2k + 1), at most the caps; ties to the earlier source."""
    seats = min(seats, sum(c for c, w in zip(caps, wanted) if w))

    def held(unit: Fraction) -> list[int]:
        """Seats of quotient at least 1 / (2 unit)."""
        return [min(c, max(0, int((2 * w * unit + 1) // 2))) for w, c in zip(wanted, caps)]

    low, high = Fraction(0), Fraction(1)
    while sum(held(high)) < seats:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        mid = mid.limit_denominator(10**30)
        if not low < mid < high or sum(held(mid)) == seats:
            high = mid if low < mid < high else high
            break
        low, high = (mid, high) if sum(held(mid)) < seats else (low, mid)
    out = held(low)
    if sum(held(high)) == seats:
        return held(high)
    order = sorted((i for i in range(len(out)) if wanted[i] and out[i] < caps[i]), key=lambda i: (-wanted[i] / (2 * out[i] + 1), i))
    while sum(out) < seats:
        for i in order:
            if sum(out) < seats:
                out[i] += 1
        order = sorted((i for i in range(len(out)) if wanted[i] and out[i] < caps[i]), key=lambda i: (-wanted[i] / (2 * out[i] + 1), i))
    return out


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words), tie (digest of the text)."""
    t = whole(text)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(t)).cast("long").alias("size"), F.md5(t).alias("tie"))


def fitting(size: int, block: int) -> int:
    """The block of a source: ``block``, or a 4th, 16th ... of it as long as the source has not 64 of them."""
    while block > 1 and size < 64 * block:
        block = max(1, block // 4)
    return block


def plan(rows: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> list[dict]:
    """One record per source: source, size, rows, weight, target, block, blocks, quota, ends (blocks up to each shard).

    Sources of equal blocks share out the seats of their targets; each comes within a block of its target or so.
    """
    got = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    got = sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes, weights = [r["size"] for r in got], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(got))]
    wanted = targets(sizes, weights)
    own = [fitting(s, block) for s in sizes]
    blocks = [-(-s // b) for s, b in zip(sizes, own)]
    ends = [[0] * len(got) for _ in range(shards)]
    for each in sorted(set(own)):
        at = [i for i, b in enumerate(own) if b == each]
        shares, caps = [wanted[i] for i in at], [COPIES * blocks[i] for i in at]
        seats = round(sum(shares) / each)
        for s in range(shards):
            for i, q in zip(at, quotas(shares, caps, (s + 1) * seats // shards)):
                ends[s][i] = q
    return [
        {"source": r["source"], "source_size": r["size"], "rows": r["rows"], "target": float(wanted[i]), "block": own[i], "blocks": blocks[i], "quota": ends[-1][i] if ends else 0, "ends": [e[i] for e in ends]}
        for i, r in enumerate(got)
    ]


def _start(rows: DataFrame, records: list[dict], seed: int) -> DataFrame:
    schema = "src string, source_size long, n_rows long, target double, block long, blocks long, quota long, ends array<long>"
    data = [tuple(r[c] for c in ("source", "source_size", "rows", "target", "block", "blocks", "quota", "ends")) for r in records]
    table = rows.sparkSession.createDataFrame(data, schema)
    joined = rows.join(table, rows["source"].eqNullSafe(table["src"]), "left").drop("src")
    joined = joined.withColumn("draw", seeded(seed, F.col("doc_id"), F.col("tie")))
    slices = F.ceil(F.col("n_rows") / ROWS_PER_SLICE).cast("long")
    slot = F.floor(F.col("draw") / (SEED_RANGE / slices)).cast("long")
    return running(joined, ["source"], slot, ["draw", "doc_id", "tie"], F.col("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words), pieces.

    pieces (block, begin, n_words, times, shards) are the document's words by block, how often the mix
    takes them, and the shard of each time.
    """
    rows = cut(sized(docs, doc_id, text, source))
    records = plan(rows, block, shards)
    if not records:
        empty = "doc_id long, source string, tie string, size long, source_size long, target double, taken long, pieces array<struct<block:long,begin:long,n_words:long,times:long,shards:array<long>>>"
        return rows.sparkSession.createDataFrame([], empty)
    df = _start(rows, records, seed)
    # A source without words has no block; its rows have no spots either
    df = df.withColumn("blocks", F.greatest("blocks", F.lit(1).cast("long")))
    df = df.withColumn("full", F.floor(F.col("quota") / F.col("blocks"))).withColumn("rest", F.col("quota") % F.col("blocks"))
    df = df.withColumn("phase", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("~"))), F.col("blocks")))
    last = F.floor((F.col("before") + F.col("size") - 1) / F.col("block"))
    spots = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("before") / F.col("block")), last)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("spots", spots)
    # Takings of the last, partial pass before block b: multiples of the quota that wrapped before it
    wrapped = "cast(floor(((b - 1) * rest + phase) / blocks) - floor((phase - rest) / blocks) as bigint)"
    once = "pmod(b * rest + phase, blocks) < rest"
    nth = f"concat(transform(if(full > 0, sequence(0L, full - 1), cast(array() as array<bigint>)), k -> k * blocks + b), if({once}, array(full * blocks + {wrapped}), cast(array() as array<bigint>)))"
    piece = """transform(spots, b -> struct(
        b as block,
        greatest(b * block, before) - before as begin,
        least((b + 1) * block, before + size) - greatest(b * block, before) as n_words,
        full + if({once}, 1L, 0L) as times,
        transform({nth}, t -> cast(size(filter(ends, e -> e <= t)) as bigint)) as shards))""".format(once=once, nth=nth)
    df = df.withColumn("pieces", F.expr(piece))
    taken = F.expr("aggregate(pieces, 0L, (a, p) -> a + p.n_words * p.times)")
    return df.withColumn("taken", taken).select("doc_id", "source", "tie", "size", "source_size", "target", "taken", "pieces")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``.

    A document stands in it once for each time that any of its blocks is taken. Where only some of
    its blocks are, the row's text is the words of these with the white space after each.
    """
    slim = mix(docs, doc_id, text, source, **options).where("taken > 0")
    keys = {"doc_id": F.col(doc_id), "source": F.col(source), "tie": F.md5(whole(text))}
    df = rejoined(docs, slim.withColumnRenamed("pieces", "pieces_"), keys, ["pieces_"])
    df = df.withColumn("time_", F.explode(F.expr("sequence(1L, array_max(transform(pieces_, p -> p.times)))")))
    spaced = F.regexp_extract_all(text, F.lit(rf"{NOT_SPACE}+{SPACE}*"), F.lit(0))
    some = F.exists("pieces_", lambda p: p["times"] < F.col("time_"))
    df = df.withColumn("spaced_", F.when(some, spaced))
    parts = "flatten(transform(filter(pieces_, p -> p.times >= time_), p -> slice(spaced_, int(p.begin) + 1, int(p.n_words))))"
    df = df.withColumn(text, F.when(some, F.array_join(F.expr(parts), "")).otherwise(F.col(text)))
    return df.select(*docs.columns)
