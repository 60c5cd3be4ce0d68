"""Draws documents that look like a target, by importance weights of hashed word runs.

Features are the words of a text and its pairs of neighbouring words, each hashed by CRC-32 into a
bucket. A bucket's gain is the log ratio of its share among target texts to its share among all
documents; a document's weight is the floored mean of its features' gains. Seeded Gumbel noise on the
weights and a cut at the highest scores draw without replacement in proportion to the weights.

CRC-32 is linear in the bytes up to a constant of the length: a byte contributes a value that depends
only on itself and on its distance from the end of the span. ``_AT`` holds these for distances under
``BLOCK``; a span's digest is the XOR of its bytes' entries (``bitwise_xor.reduceat`` over all spans at
once) and the constant of its length. Longer spans are cut into blocks, each reduced likewise, and
folded: the register so far is moved on by a block of zero bytes, again by table, and XORed.

Counts and weights are two map-only scans; only bucket counts (``buckets`` rows a task at most) and
the slim scores are shuffled. Ranks are positions in range partitions, so no task sorts all scores.

Defined results: a null or empty text has no features and weight 0. Rows of equal or null ids are rows of
their own with the same noise; null ids rank last among equal scores, equal rows in any order. A very
long text is hashed in bounded parts. No documents give no rows; no target texts give even target shares.
Other columns are ignored unless named in ``carry``, which returns them unchanged whatever their
names. All drawn rows are ranked, no limit but the share drawn is set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import numbered, ship
from estratia.llm.spans import ALNUM, Words, cut_words, runs

ship(__name__)

BUCKETS = 10_000
SHARE_PERCENT = 25
MIN_WORDS = 20
SEED = 7
BLOCK = 64
SPAN_BYTES = 1 << 20


def _table() -> np.ndarray:
    """Contribution of each byte (column) at each distance from the end (row) of a message."""
    zeros = [zlib.crc32(bytes(d + 1)) for d in range(BLOCK)]
    return np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ zeros[d] for b in range(256)] for d in range(BLOCK)], np.uint32)


_AT = _table().ravel()


def _zeros_crc(most: int) -> np.ndarray:
    """CRC-32 of 0 to ``most`` zero bytes."""
    out, now = np.empty(most + 1, np.uint32), 0
    for k in range(most + 1):
        out[k] = now
        now = zlib.crc32(b"\0", now)
    return out


_LENGTH = _zeros_crc(BLOCK)


def _linear(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span's bytes; spans of 1 to BLOCK bytes."""
    size = end - start
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(first[-1] + size[-1])
    entry = (np.repeat(end - 1, size) - at) * 256 + data[at]
    return np.bitwise_xor.reduceat(_AT[entry], first)


def _moved_on(register: np.ndarray) -> np.ndarray:
    """The register after BLOCK zero bytes: its four bytes stand at the block's far end."""
    out = np.zeros_like(register)
    for k in range(4):
        out ^= _AT[(BLOCK - 1 - k) * 256 + (register >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64)]
    return out


def _folded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of more than BLOCK bytes: a first part, then whole blocks."""
    size = end - start
    head = (size - 1) % BLOCK + 1
    blocks = (size - head) // BLOCK
    out = _linear(data, start, start + head)
    zero = _LENGTH[head]
    at = start + head
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        out[on] = _moved_on(out[on]) ^ _linear(data, at[on], at[on] + BLOCK)
        # CRC of so many zero bytes moves on as any other, up to the constant of a block
        zero[on] = _moved_on(zero[on]) ^ _LENGTH[BLOCK]
        at[on] += BLOCK
    return out ^ zero


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each span; spans may overlap and are not empty."""
    out = np.empty(len(start), np.uint32)
    size = end - start
    short = np.flatnonzero(size <= BLOCK)
    group = np.cumsum(size[short]) // SPAN_BYTES
    for part in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else ():
        out[part] = _linear(data, start[part], end[part]) ^ _LENGTH[size[part]]
    long_ = np.flatnonzero(size > BLOCK)
    if len(long_):
        out[long_] = _folded(data, start[long_], end[long_])
    return out


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and of every pair of neighbours in a text."""
    pair = np.flatnonzero(words.text[1:] == words.text[:-1])
    start = np.concatenate([words.start, words.start[pair]])
    end = np.concatenate([words.end, words.end[pair + 1]])
    return crc32_spans(words.data, start, end) % np.uint32(buckets), np.concatenate([words.text, words.text[pair]])


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in runs(batch[0]):
                found, _ = features(cut_words(batch[0].slice(a, b - a), ALNUM), buckets)
                total += np.bincount(found, minlength=buckets)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], names=["bucket", "n"])

    return count


def counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any."""
    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_counter(buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; ``buckets`` numbers, whatever the tables hold."""
    both = counts(docs, text, buckets).withColumn("kind", F.lit("s")).union(counts(target, target_text, buckets).withColumn("kind", F.lit("t")))
    have = {"s": np.zeros(buckets), "t": np.zeros(buckets)}
    for row in both.collect():  # at most two rows a bucket
        have[row["kind"]][row["bucket"]] = row["n"]
    s, t = have["s"], have["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigher(gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            n_words, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b in runs(texts):
                words = cut_words(texts.slice(a, b - a), ALNUM)
                found, text = features(words, len(gain))
                n_words[a:b] = np.diff(words.bounds())
                np.add.at(total, a + text, gain[found])
            n = n_words + np.maximum(n_words - 1, 0)
            weight = total // np.maximum(n, 1)
            more = [pa.array(x) for x in (n_words, n, weight)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["carried"], *more], names=["doc_id", "carried", "n_words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    carry: Sequence[str] = (),
    share_percent: int = SHARE_PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank and the columns of ``carry`` as struct ``carried``, a row for each of ``docs``.

    rank counts the drawn documents from the highest score; it is null for the rest.
    """
    gain = gains(docs, target, text, target_text, buckets)
    kept = F.struct(F.lit(True).alias("row"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("carried")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), kept)
    kind = rows.schema["carried"].dataType.simpleString()
    rows = rows.mapInArrow(_weigher(gain), f"doc_id long, carried {kind}, n_words long, n_features long, weight long")
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    eligible = F.col("n_words") >= min_words
    ranked = numbered(rows, [(~eligible).cast("int"), *order], count_if=eligible)
    drawn = F.expr(f"{share_percent} * total div 100")
    rank = F.when(eligible & (F.col("position") <= drawn), F.col("position"))
    carried = F.struct(*(F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry))) if carry else F.lit(None).cast("string")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"), carried.alias("carried"))
