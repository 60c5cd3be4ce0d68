"""Substring dedup: runs of lines or sentences that stand earlier too are removed.

A unit is a sentence with the white space after it, a line with its line break, or a paragraph with the blank
lines after it. Units are normalised (lower case, runs of white space one space, trimmed); those
without words are passed over. What is hashed and grouped over all documents are neighbours: the digest of a
unit and the next one. Of equal pairs those in the document of the least id stay; those in later documents
are marked. What a document repeats in itself is not looked at. A maximal run of units joined by marked pairs is removed if it has ``MIN_WORDS``
words, and so is a single unit of that length that stands in an earlier document. So a list of short lines
or a passage inside a line is found, while a short line that many documents share stays everywhere.
Removed spans keep their offsets in the original text, in code points, end exclusive.

Pairs are told apart by 64-bit digests. A frequent pair is one row in the table of first places,
and Spark splits its rows on the other side of that join.

What stays: the parts of a passage that share a sentence (or line) with other text at either end, and copies whose edits
leave no run of ``MIN_WORDS`` words.

Defined results: a null text has no units and stays null; an empty text is kept as it is; rows that
repeat a document id are told apart by their text, rows equal in both count as one when units are
ranked and are cleaned alike; a null id ranks first. Very long texts are read whole. An empty table gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import cut, ship

ship(__name__)

MIN_WORDS = 50
UNIT = {
    "sentence": re.compile(r"[^\n.!?]*[.!?]+[\x20\x09-\x0D]*|[^\n.!?]*\n|[^\n.!?]+"),
    "line": re.compile(r"[^\n]*\n|[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t]*\n))*(?:\n[ \t]*(?=\n)|\n)+|(?:[^\n]|\n(?![ \t]*\n))+"),
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _units(text: str, unit: str) -> list[tuple[int, int, int, str]]:
    """(begin, end, words, normalised) of the units with words, in order."""
    out = []
    for found in UNIT[unit].finditer(text):
        parts = WORD.findall(found[0].lower())
        if parts:
            out.append((found.start(), found.end(), len(parts), " ".join(parts)))
    return out


def tie_of(text: str) -> int:
    """Number that tells the texts of one id apart."""
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)


def _digests(unit: str, min_words: int):
    """at: place of a pair's first unit; -1 - place for a single unit of at least ``min_words`` words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties, places, digests = [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["t_"]):
                text = text.as_py()
                found = _units(text, unit)
                rows = [(i, a[3] + "\n" + b[3]) for i, (a, b) in enumerate(zip(found, found[1:])) if a[2] + b[2] >= 2]
                rows += [(-1 - i, u[3]) for i, u in enumerate(found) if u[2] >= min_words]
                tie = tie_of(text)
                docs += [doc] * len(rows)
                ties += [tie] * len(rows)
                places += [r[0] for r in rows]
                digests += [xxhash.xxh64_intdigest(r[1]) - (1 << 63) for r in rows]
            columns = [pa.array(c, pa.int64()) for c in (docs, ties, places, digests)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "at", "digest"])

    return each


def marks(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tie, marked: the places in each document whose pair, or long unit, stands in an earlier document.

    First places are partial minima before the shuffle and are written; a digest that a third of all rows
    share then joins its one first place as a skewed key that Spark splits.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t_")).where("t_ is not null")
    found = cut(rows.mapInArrow(_digests(unit, min_words), "doc_id long, tie long, at long, digest long"))
    rank = F.struct("doc_id", "tie")
    firsts = cut(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
    again = found.join(firsts, "digest").where(~rank.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "tie").agg(F.collect_set("at").alias("marked"))


def spans(text: str, marked: list[int], unit: str, min_words: int) -> list[tuple[int, int]]:
    """The runs to remove, as (begin, end), in order."""
    found = _units(text, unit)
    pairs = {m for m in marked if m >= 0}
    gone = {-1 - m for m in marked if m < 0}
    i = 0
    while i < len(found):
        end = i
        while end in pairs:
            end += 1
        if end > i and sum(u[2] for u in found[i : end + 1]) >= min_words:
            gone.update(range(i, end + 1))
        i = end + 1
    out: list[tuple[int, int]] = []
    for i in sorted(gone):
        begin, end = found[i][:2]
        if out and i - 1 in gone:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def _cleaner(unit: str, min_words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, marked in zip(batch["t_"].to_pylist(), batch["marked"].to_pylist()):
                gone = spans(text, marked, unit, min_words) if text is not None and marked else []
                if gone:
                    kept, at = [], 0
                    for begin, end in gone:
                        kept.append(text[at:begin])
                        at = end
                    text = "".join(kept) + text[at:]
                texts.append(text)
                removed.append([{"begin": b, "end": e} for b, e in gone])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(removed, kind), pa.array(texts, pa.string())], names=["doc_id", "removed", "cleaned"])

    return each


def _tie(text: Column) -> Column:
    """``tie_of`` as a column: the first half of the MD5 as a signed number."""
    high, low = (F.conv(F.substring(F.md5(text), a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def clean(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, removed (spans of the original text), cleaned (the text without them), one row for each row."""
    found = marks(docs, unit, min_words, doc_id, text)
    found = found.select(F.col("doc_id").alias("d_"), F.col("tie").alias("e_"), "marked")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t_"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d_")) & (_tie(F.col("t_")) == F.col("e_")), "left")
    joined = joined.select("doc_id", "t_", F.coalesce("marked", F.array().cast("array<bigint>")).alias("marked"))
    return joined.mapInArrow(_cleaner(unit, min_words), "doc_id long, removed array<struct<begin:long,end:long>>, cleaned string")
