"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of ``WINDOW`` words that overlap by half; a passage is a TF-IDF vector
over hashed words, whose document frequencies are counted over all documents. A randomised SVD of
the passages of all documents and of the benchmark gives the latent space, without the
first directions, which only tell languages apart: a random test matrix, one power step and a Rayleigh-Ritz step, each a sum of
per-task products that meet by blocks of features. The features of the texts are written once for these steps.
Every passage of every document is then projected
and compared with every benchmark item (the query set, in blocks); passages of cosine
``MIN_COSINE`` and more are candidates.

A candidate is verified on the words around it: the longest common subsequence with the item must
hold ``MIN_LCS`` of the item's words, and that with its answer (its last quarter, the last five words
at least) ``MIN_ANSWER`` of the answer's.

Defined results: words are runs of letters and digits in lower case; a null or empty text holds no
item; an item of fewer than ``MIN_ITEM`` words finds nothing; repeated rows are hits of their own,
listed once for each document id and item with the best span (ties: the later span); empty tables give no rows.
Very long texts are read whole, in passages. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estratia.llm.common import cut, drop_cut, ship

ship(__name__)

FEATURES = 1 << 14
#: Singular vectors taken, of which the first, which tell languages and common words, are left out.
RANK, COMMON = 192, 16
OVERSAMPLE = 16
WINDOW = 32
MIN_COSINE = 0.5
MIN_LCS = 0.7
MIN_ANSWER = 0.6
MIN_ITEM = 6
ITEMS_PER_PASS = 4_000
BLOCK = 512
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Texts read at a time, and half passages projected at a time, in a task.
TEXTS, HALVES = 2_048, 256
#: Half passages that meet the basis, and that are added to its rows, at a time; texts whose products one task sums up.
MET, ADDED, TEXTS_PER_SUM = 64, 16, 40_000


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the place among them of each word of all texts in order, and the words of each text."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_WORD)
    owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    flat = split.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    held = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    return flat.dictionary, codes[held], np.bincount(owner[held], minlength=len(split))


def tokens(text: str | None) -> list[str]:
    distinct, codes, _ = coded(pa.array([text], pa.string()))
    return distinct.take(pa.array(codes)).to_pylist()


def hashed(distinct: pa.Array) -> np.ndarray:
    """The feature of each word."""
    return np.fromiter(map(zlib.crc32, distinct.cast(pa.binary()).to_pylist()), np.int64, len(distinct)) % FEATURES


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text's words in order, as 16-bit numbers, beside the columns read."""
    for batch in _slices(batches):
        distinct, codes, sizes = coded(batch["text"])
        words = hashed(distinct)[codes].astype(np.int16).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes) * 2]).tolist()
        column = pa.array([words[s:e] for s, e in zip(ends, ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "features"])


def featured(docs: DataFrame) -> DataFrame:
    """``docs`` with the features of the words of each text."""
    return docs.mapInArrow(_features, docs.withColumn("features", F.lit(b"")).schema)


def _of_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of the words of all texts in order, and the words of each text."""
    held = batch["features"].to_pylist()
    return np.frombuffer(b"".join(held), np.int16).astype(np.int64), np.fromiter(map(len, held), np.int64, len(held)) // 2


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(FEATURES + 1, np.int64)
    for batch in _slices(batches):
        features, sizes = _of_words(batch)
        seen = np.zeros((len(sizes), FEATURES), bool)
        seen[np.repeat(np.arange(len(sizes)), sizes), features] = True
        counts[:FEATURES] += seen.sum(axis=0)
        counts[FEATURES] += batch.num_rows
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["feature", "n"])


def inverse_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """One weight for each feature of ``featured`` texts, and the number of texts; at most FEATURES + 1 rows come back."""
    rows = texts.select("features").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(FEATURES + 1)
    for row in rows:
        counts[row["feature"]] = row["n"]
    n = int(counts[FEATURES])
    return np.log((1 + n) / (1 + counts[:FEATURES])).astype(np.float32), n


def _halves(features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half passages of all texts, a row of features each; the text of each; the first of each text.

    ``FEATURES`` stands for words past a text's end.
    """
    half = WINDOW // 2
    n_halves = -(-sizes // half)
    first = np.cumsum(n_halves) - n_halves
    padded = np.full(int(n_halves.sum()) * half, FEATURES)
    padded[np.arange(len(features)) + np.repeat(first * half - (np.cumsum(sizes) - sizes), sizes)] = features
    return padded.reshape(-1, half), np.repeat(np.arange(len(sizes)), n_halves), first


def _with_zero(vectors: np.ndarray) -> np.ndarray:
    """The vectors of the features, and one of zeros for words past a text's end."""
    return np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])


def _sums(halves: np.ndarray, vectors: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each half passage; ``held`` is scratch space with a row for each word."""
    part = np.take(vectors, halves.ravel(), axis=0, out=held[: halves.size], mode="clip")
    return np.matmul(np.ones((1, halves.shape[1]), np.float32), part.reshape(*halves.shape, -1))[:, 0]


def _lengths(passages: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The length of each passage as a TF-IDF vector, of its words' features."""
    x = np.sort(passages.astype(np.int16), axis=1)
    squares = np.square(weights)[x]
    out = squares.sum(axis=1)
    # A feature of count c adds its square c * c times: c for its words, two for each pair of equal ones
    row, at = np.nonzero((x[:, 1:] == x[:, :-1]) & (squares[:, 1:] > 0))
    at += 1
    lag = 1
    while len(row):
        out += 2 * np.bincount(row, squares[row, at], minlength=len(x)).astype(np.float32)
        lag += 1
        row, at = row[at >= lag], at[at >= lag]
        same = x[row, at] == x[row, at - lag]
        row, at = row[same], at[same]
    return np.sqrt(out)


def _passages(batch: pa.RecordBatch, weights: np.ndarray, vectors: np.ndarray) -> Iterator[tuple]:
    """By ``MET`` half passages: their features, the unit passages that begin there times the basis, what made these unit, and which go on in the next half.

    ``weights`` and ``vectors`` (the weighted basis) have zeros for words past a text's end. A text's last half begins no
    passage unless it is its only one.
    """
    halves, owner, first = _halves(*_of_words(batch))
    total = len(halves)
    two = np.append(owner[1:] == owner[:-1], np.zeros(min(total, 1), bool))
    lone = np.zeros(total, bool)
    lone[first[first < total]] = True
    lone &= ~two
    held = np.empty(((MET + 1) * halves.shape[1], vectors.shape[1]), np.float32)
    for s in range(0, total, MET):
        e, z = min(s + MET, total), min(s + MET + 1, total)
        sums = _sums(halves[s:z], vectors, held)
        on = np.flatnonzero(two[s:e])
        words = np.full((e - s, WINDOW), FEATURES)
        words[:, : halves.shape[1]] = halves[s:e]
        words[on, halves.shape[1] :] = halves[s + on + 1]
        met = sums[: e - s].copy()
        met[on] += sums[on + 1]
        scale = ((two | lone)[s:e] / np.maximum(_lengths(words, weights), 1e-9)).astype(np.float32)[:, None]
        met *= scale
        yield halves[s:e], met, scale, two[s:e]


def _product(basis: np.ndarray, weights: np.ndarray):
    """Per task: A'A basis for the task's passages A, in blocks of features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, padded = _with_zero(weights[:, None] * basis), np.append(weights, np.float32(0))
        width, half = basis.shape[1], WINDOW // 2
        total, last = np.zeros((FEATURES + 1, width), np.float32), np.empty(FEATURES + 1, np.int64)
        places = np.arange(ADDED * half)
        made, old = np.empty((2, ADDED * half, width), np.float32)
        for batch in _slices(batches):
            before = np.zeros(width, np.float32)
            for halves, met, scale, two in _passages(batch, padded, vectors):
                met *= scale
                # A half passage is part of the passage that begins there and of the one before
                onward = met * two[:, None]
                met[1:] += onward[:-1]
                met[0] += before
                before = onward[-1]
                for s in range(0, len(met), ADDED):
                    part = halves[s : s + ADDED].ravel()
                    at = places[: len(part)]
                    # Each word's column is that of the last place that holds its feature
                    last[part] = at
                    spot = last[part]
                    own = spot == at
                    features = part[own]
                    n = len(features)
                    columns = (np.cumsum(own) - 1)[spot]
                    rows = len(part) // half
                    counts = np.bincount(at // half * n + columns, minlength=rows * n).reshape(rows, n).astype(np.float32)
                    sums = np.take(total, features, axis=0, out=old[:n], mode="clip")
                    sums += np.matmul(counts.T, met[s : s + ADDED], out=made[:n])
                    total[features] = sums
        total = total[:FEATURES] * weights[:, None]
        for b in range(0, len(total), BLOCK):
            part = total[b : b + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([part.tobytes()], pa.binary())], names=["block", "part"])

    return each


def _square(basis: np.ndarray, weights: np.ndarray):
    """Per task: basis'A'A basis for the task's passages A, as one block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, padded = _with_zero(weights[:, None] * basis), np.append(weights, np.float32(0))
        total = np.zeros((basis.shape[1], basis.shape[1]), np.float32)
        for batch in _slices(batches):
            for _, met, *_ in _passages(batch, padded, vectors):
                total += met.T @ met
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    return each


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for part in frame["part"]:
        part = np.frombuffer(part, np.float32)
        total = part.copy() if total is None else total + part
    return pd.DataFrame({"block": frame["block"].iloc[:1], "part": [total.tobytes()]})


def _summed(texts: DataFrame, task, shape: tuple[int, int]) -> np.ndarray:
    """Sum of what the tasks make of all ``texts``; blocks of fixed size come back."""
    parts = texts.select("features").mapInArrow(task, "block long, part binary")
    out = np.zeros(shape, np.float32)
    for row in parts.groupBy("block").applyInPandas(_add, "block long, part binary").toLocalIterator():
        part = np.frombuffer(row["part"], np.float32).reshape(-1, shape[1])
        out[row["block"] : row["block"] + len(part)] = part
    return out


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b in double precision, of single precision blocks of rows."""
    out = np.zeros((a.shape[1], b.shape[1]))
    for at in range(0, len(a), BLOCK):
        out += a[at : at + BLOCK].astype(np.float64).T @ b[at : at + BLOCK].astype(np.float64)
    return out


def _turned(a: np.ndarray, by: np.ndarray) -> np.ndarray:
    """a @ by in single precision, by blocks of rows."""
    out = np.empty((len(a), by.shape[1]), np.float32)
    for at in range(0, len(a), BLOCK):
        out[at : at + BLOCK] = a[at : at + BLOCK] @ by
    return out


def orthonormal(a: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' span, from the eigenvectors of a'a, taken twice for precision.

    Only matrices of rank size are factored, so no second copy of the tall matrix is held in doubles.
    """
    for _ in range(2):
        values, vectors = np.linalg.eigh(_crossed(a, a))
        held = values > 1e-10 * max(values.max(), 1e-300)
        # Directions of no length (fewer passages than columns) become zero
        a = _turned(a, vectors * np.where(held, 1 / np.sqrt(np.where(held, values, 1)), 0))
    return a


def latent_space(texts: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors COMMON .. rank of the passages of ``texts`` (``featured``), a row for each feature."""
    basis = np.random.default_rng(3).standard_normal((FEATURES, rank + OVERSAMPLE), np.float32)
    for _ in range(2):
        basis = orthonormal(_summed(texts, _product(basis, weights), basis.shape))
    small = _summed(texts, _square(basis, weights), (basis.shape[1],) * 2).astype(np.float64)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return _turned(basis, vectors[:, np.argsort(-values)[COMMON:rank]])


def lcs(item: dict, size: int, region: list) -> int:
    """Length of the longest common subsequence; ``item`` has a bit mask of positions for each word."""
    row = full = (1 << size) - 1
    for word in region:
        mask = item.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - bin(row).count("1")


def masks(words: list) -> dict:
    out: dict = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | (1 << i)
    return out


def answer_of(words: list) -> list:
    return words[-max(5, len(words) // 4) :]


def _cosines(features: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, least: float) -> Iterator[tuple]:
    """(text, half passage, item, cosine) of the passages whose cosine is the least or more, text by text.

    ``features`` are the words' of all texts; the last row of ``vectors`` is zero, for words past a text's end.
    """
    halves, owner, first = _halves(features, sizes)
    total = len(halves)
    held = np.empty(((HALVES + 1) * halves.shape[1], vectors.shape[1]), np.float32)
    for s in range(0, total, HALVES):
        e, z = min(s + HALVES, total), min(s + HALVES + 1, total)
        sums = _sums(halves[s:z], vectors, held)
        # Passages overlap by half: sums of half passages and, in one text, their neighbours
        passages = sums[: e - s].copy()
        passages[: z - s - 1] += sums[1:] * (owner[s + 1 : z] == owner[s : z - 1])[:, None]
        cosines = (passages @ wanted.T) / np.maximum(np.linalg.norm(passages, axis=1), 1e-9)[:, None]
        spots, found = np.nonzero(cosines >= least)
        texts = owner[s + spots]
        yield from zip(texts.tolist(), (s + spots - first[texts]).tolist(), found.tolist(), cosines[spots, found].tolist())


def _search(items: list[tuple[int, str]], vectors: np.ndarray, min_cosine: float, checked: bool):
    """Per document: verified hits of the items. ``vectors`` are the weighted latent word vectors."""
    known_items = [(i, tokens(t)) for i, t in items]
    known_items = [(i, w) for i, w in known_items if len(w) >= MIN_ITEM]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in known_items for w in words}))}
    parts = []
    for i, text_words in known_items:
        w = [vocabulary[x] for x in text_words]
        parts.append((i, w, masks(w), answer_of(w), masks(answer_of(w))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(vocabulary), pa.string())
        of_words = vectors[hashed(names)]
        wanted = np.zeros((len(parts), vectors.shape[1]), np.float32)
        for k, (_, words, *_) in enumerate(parts):
            v = of_words[words].sum(axis=0)
            wanted[k] = v / (np.linalg.norm(v) or 1)
        padded, half = _with_zero(vectors), WINDOW // 2
        for batch in _slices(batches):
            features, sizes = _of_words(batch)
            if not len(features) or not parts:
                continue
            found = list(_cosines(features, sizes, padded, wanted, min_cosine))
            if not found:
                continue
            # Only the texts of candidates are read as words
            docs, texts = batch["doc_id"].to_pylist(), sorted({t for t, *_ in found})
            distinct, codes, read = coded(batch["text"].take(pa.array(texts)))
            ends = dict(zip(texts, np.cumsum(read).tolist()))
            same = pc.fill_null(pc.index_in(distinct, value_set=names.cast(distinct.type)), -1).to_numpy()[codes]
            best: dict[tuple, tuple] = {}
            for t, s, k, cosine in found:
                item, w, mask, answer, answer_mask = parts[k]
                size = int(sizes[t])
                low, high = max(0, s * half - len(w)), min(size, s * half + WINDOW + len(w))
                begin = ends[t] - size
                region = same[begin + low : begin + high].tolist()
                # Words in common bound the subsequence
                common = checked and len(mask.keys() & set(region)) >= MIN_LCS * len(mask) - (1 - MIN_LCS) * (len(w) - len(mask))
                n = lcs(mask, len(w), region) if common else 0
                a = lcs(answer_mask, len(answer), region) if checked and n >= MIN_LCS * len(w) else 0
                if not checked or (n >= MIN_LCS * len(w) and a >= MIN_ANSWER * len(answer)):
                    if (t, k) not in best or (n, cosine) > (best[t, k][3], best[t, k][2]):
                        best[t, k] = (docs[t], item, cosine, n, len(w), a, low, high)
            kinds = (pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 5)
            columns = zip(*best.values()) if best else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=HIT)

    return each


HIT = ["doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_words", "begin_word", "end_word"]
HITS = "doc_id long, item_id long, cosine double, lcs_words long, item_words long, answer_words long, begin_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_cosine: float = MIN_COSINE, checked: bool = True) -> DataFrame:
    """One row for each document and item it holds; with ``checked`` False every candidate of the cosine search."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    rows = cut(featured(rows))
    weights, n = inverse_frequencies(rows)
    # A task's sums are as large as the basis whatever it reads, so that small tasks are taken together
    texts = rows.select("features").coalesce(max(8, n // TEXTS_PER_SUM)).union(featured(items).select("features"))
    vectors = latent_space(texts, weights) * weights[:, None]
    query = sorted((r["item_id"], r["text"]) for r in items.where("item_id is not null").distinct().toLocalIterator())
    out = spark.createDataFrame([], HITS)
    for at in range(0, len(query), ITEMS_PER_PASS):
        out = out.union(rows.mapInArrow(_search(query[at : at + ITEMS_PER_PASS], vectors, min_cosine, checked), HITS))
    best = F.max_by(F.struct(*HIT[2:]), F.struct("lcs_words", "cosine", "begin_word")).alias("h")
    hits = cut(out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "h.*"))
    drop_cut(rows)
    return hits
