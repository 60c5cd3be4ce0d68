"""LM scoring by masked pseudo-likelihood.

Every token of a text is predicted from the two before and the two after it. A network with one
hidden layer (a learned vector for each context place and word, summed, rectified) gives three
probabilities: of the token's class, where each of the most frequent words is a class and all others
are one; in that class, of its group of words; in the group, of the word. All three depend on the
context. The ``KNOWN`` most frequent words are words to the network, the rest fall in ``RARE`` hashed
buckets; inside its bucket a rare word has its share of the bucket's counts in the whole corpus,
which does not depend on the context. The sum of the log-probabilities scores the document.

Counts are taken over all documents, and training reads every position of every document, so it
grows with the corpus. Each task trains its rows from the common weights in numpy, in a seeded order
within chunks of ``GROUP`` tokens; the weights are averaged by rows, in blocks that meet by key, for
``ROUNDS`` rounds. Outputs start from the counts of the words, so the network starts from unigrams.

Defined results: tokens are runs of letters and digits in lower case and single other marks; a null
or empty text has 0 tokens, sum 0 and no mean; places beyond the text have a word of their own;
repeated rows are scored alike; without any token every score is empty. Words of equal frequency are ordered by
themselves. Very long texts are read whole, in chunks. Other columns are not read, whatever their names. Weights
are averages over tasks, so scores depend on how the rows are partitioned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estratia.llm.common import cut, ship

ship(__name__)

CLASSES = 64
KNOWN = 2048
RARE = 256
PAD = KNOWN + RARE
BUCKETS = 1 << 16
HIDDEN = 32
#: Words beyond the classes: groups of equal size, by frequency.
GROUPS = 48
MEMBERS = -(-(PAD - CLASSES + 1) // GROUPS)
PLACES = (-2, -1, 1, 2)
ROUNDS = 2
RATE = 0.08
BATCH = 512
BLOCK = 1 << 16
GROUP = 1 << 16
#: Positions scored at a time. Exponentials beyond these bounds go by the largest of their row.
SCORED, SAFE, TINY = 1 << 10, 80.0, 1e-30
#: Texts split at a time; words a task counts before it sums them up.
TEXTS, MOST_WORDS = 512, 1_000_000
#: Rows of one group of words in a batch that are laid side by side with those of all groups; the rest follows.
SIDE = 8
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


#: Kinds of bytes: between tokens, in a word, a mark (a token of its own), the rest of a mark of several bytes.
GAP, LETTER, MARK, REST = range(4)
_ASCII = np.array([LETTER if chr(i).isalnum() else GAP if chr(i).isspace() else MARK for i in range(128)], np.uint8)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of a text in UTF-8."""
    kinds = _ASCII[np.minimum(data, 127)]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        lead = data[wide].astype(np.int32)
        n = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & (0xFF >> (n + 1))
        for k in range(1, 4):
            more = np.flatnonzero(n > k)
            code[more] = code[more] << 6 | data[wide[more] + k] & 0x3F
        each, at = np.unique(code, return_inverse=True)
        of = np.array([_kind(chr(c)) for c in each], np.uint8)[at]
        kinds[wide] = of
        for k in range(1, 4):
            more = np.flatnonzero(n > k)
            kinds[wide[more] + k] = np.where(of[more] == MARK, REST, of[more])
    return kinds


def _kind(c: str) -> int:
    return LETTER if c.isalnum() else GAP if c.isspace() else MARK


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens, the place among them of each token of all texts in order, and the tokens of each text.

    The tokens are those of ``tokens``, found in the bytes of all texts at once.
    """
    low = [(text or "").lower().encode() for text in texts.to_pylist()]
    data = np.frombuffer(b"\n".join(low), np.uint8)
    kinds = _kinds(data)
    begins = kinds == LETTER
    begins[1:] &= kinds[:-1] != LETTER
    begins |= kinds == MARK
    first = np.flatnonzero(begins)
    held = kinds != GAP
    ends = np.cumsum(held, dtype=np.int32)
    offsets = np.append(ends[first] - 1, ends[-1:]).astype(np.int32)
    if not len(first):
        return pa.array([], pa.string()), first, np.zeros(len(low), np.int64)
    found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[held])).dictionary_encode()
    bounds = np.cumsum([0, *(len(x) + 1 for x in low)])
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(first, bounds))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in _slices(batches):
        words, codes, _ = split(batch["text"])
        held.append(pa.table({"word": words, "n": np.bincount(codes, minlength=len(words)).astype(np.int64)}))
        rows += len(words)
        if rows > MOST_WORDS:
            held, rows = [summed()], 0
            if held[0].num_rows > MOST_WORDS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()


class Words:
    """Ids of words: the known by frequency, then buckets of rare ones; the count of each id; the log share of rare words in their bucket."""

    def __init__(self, known: list[str], shares: np.ndarray, counts: np.ndarray):
        self.ids = {w: i for i, w in enumerate(known)}
        self.shares = shares
        self.counts = counts

    def read(self, found: list[str], seen: dict[str, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        for word in set(found).difference(seen):
            code = zlib.crc32(word.encode())
            at = self.ids.get(word, KNOWN + code % RARE)
            seen[word] = at, 0.0 if at < KNOWN else float(self.shares[code % BUCKETS])
        both = [seen[w] for w in found]
        return np.array([b[0] for b in both], np.int64), np.array([b[1] for b in both])

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``read`` for an array of words."""
        codes = np.fromiter(map(zlib.crc32, distinct.cast(pa.binary()).to_pylist()), np.int64, len(distinct))
        known = pa.array(list(self.ids), pa.string())
        at = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy()
        return np.where(at < 0, KNOWN + codes % RARE, at), np.where(at < 0, self.shares[codes % BUCKETS], 0.0)


def vocabulary(docs: DataFrame) -> Words:
    """Counts over all documents; at most KNOWN words and BUCKETS sums come back."""
    counts = cut(docs.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    known = [r["word"] for r in top]
    rare = counts.where(~F.col("word").isin(known)) if known else counts
    sums = np.full(BUCKETS, 0.5)
    for r in rare.groupBy((F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("b")).agg(F.sum("n").alias("n")).collect():
        sums[r["b"]] += r["n"]
    # BUCKETS is a multiple of RARE, so each of the finer buckets lies in one of the coarser
    of_rare = sums.reshape(-1, RARE).sum(axis=0)
    each = np.full(PAD, 0.5)
    each[: len(top)] += [r["n"] for r in top]
    each[KNOWN:] = of_rare
    return Words(known, np.log(sums / np.tile(of_rare, BUCKETS // RARE)), each)


def contexts(ids: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Ids around each spot, PAD beyond the ends."""
    padded = np.concatenate([[PAD, PAD], ids, [PAD, PAD]])
    return np.stack([padded[spots + 2 + p] for p in PLACES], axis=1)


def start_weights(counts: np.ndarray | None = None) -> np.ndarray:
    """Small random weights; biases of the outputs from the counts of the ids."""
    rng = np.random.default_rng(17)
    counts = np.ones(PAD) if counts is None else counts
    table = rng.standard_normal((len(PLACES), PAD + 1, HIDDEN)) * 0.1
    other = np.zeros(GROUPS * MEMBERS)
    other[: PAD - CLASSES + 1] = counts[CLASSES - 1 :]
    other = other.reshape(GROUPS, MEMBERS)
    of_group = other.sum(axis=1)
    # Places of the last group without a word have no probability
    inside = np.where(other > 0, np.log(np.maximum(other, 1e-9) / of_group[:, None]), -1e4)
    classes = np.append(counts[: CLASSES - 1], of_group.sum())
    parts = [table, np.full(HIDDEN, 0.1), rng.standard_normal((HIDDEN, CLASSES)) * 0.1, np.log(classes / classes.sum())]
    parts += [rng.standard_normal((HIDDEN, GROUPS)) * 0.1, np.log(of_group / of_group.sum()), rng.standard_normal((GROUPS, HIDDEN, MEMBERS)) * 0.1, inside]
    return np.concatenate([x.ravel() for x in parts]).astype(np.float32)


def unpacked(weights: np.ndarray) -> list[np.ndarray]:
    """Views: the context table and hidden bias; matrix and bias of the classes, of the groups, of the words in each group."""
    shapes = [(len(PLACES) * (PAD + 1), HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, MEMBERS), (GROUPS, MEMBERS)]
    ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
    return [weights[a:b].reshape(x) for a, b, x in zip(ends, ends[1:], shapes)]


_SHIFT = np.arange(len(PLACES)) * (PAD + 1)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _hidden(weights: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    table, bias = weights[:2]
    out = table[context[:, 0] + _SHIFT[0]]
    for p in range(1, len(PLACES)):
        out += np.take(table, context[:, p] + _SHIFT[p], axis=0)
    out += bias
    return np.maximum(out, 0, out=out)


def log_probabilities(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Log-probabilities of the classes."""
    parts = unpacked(weights)
    return _log_softmax(_hidden(parts, context) @ parts[2] + parts[3])


def _by_group(rest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Group, places of its words in ``rest`` (ids beyond the classes, from 0)."""
    order = np.argsort(rest, kind="stable")
    edges = np.searchsorted(rest[order], np.arange(GROUPS + 1) * MEMBERS)
    for g in np.flatnonzero(np.diff(edges)):
        yield int(g), order[edges[g] : edges[g + 1]]


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax at one place of each row."""
    n = np.arange(len(at))
    if len(at) and logits.max() < SAFE:
        sums = np.exp(logits) @ np.ones(logits.shape[1], np.float32)
        if sums.min() > TINY:
            return logits[n, at] - np.log(sums)
    return _log_softmax(logits)[n, at] if len(at) else np.empty(0, np.float32)


def word_log_probabilities(weights: np.ndarray, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each id at its context: class, group in the class, word in the group."""
    parts = unpacked(weights)
    others = np.flatnonzero(ids >= CLASSES - 1)
    rest, done = ids[others] - (CLASSES - 1), 0
    out, more = np.empty(len(ids), np.float32), np.empty(len(others), np.float32)
    kept = np.empty((len(others), HIDDEN), np.float32)
    for s in range(0, len(ids), SCORED):
        want = ids[s : s + SCORED]
        hidden = _hidden(parts, context[s : s + SCORED])
        out[s : s + SCORED] = _log_share(hidden @ parts[2] + parts[3], np.minimum(want, CLASSES - 1))
        held = hidden[want >= CLASSES - 1]
        kept[done : done + len(held)] = held
        more[done : done + len(held)] = _log_share(held @ parts[4] + parts[5], rest[done : done + len(held)] // MEMBERS)
        done += len(held)
    for g, at in _by_group(rest):
        more[at] += _log_share(kept[at] @ parts[6][g] + parts[7][g], rest[at] % MEMBERS)
    out[others] += more
    return out


def _error(logits: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Gradient of the log loss by the logits."""
    p = np.exp(logits)
    sums = p @ np.ones(p.shape[1], np.float32)
    if not (sums.min() > TINY and sums.max() < 1 / TINY):
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        sums = p.sum(axis=1)
    p *= (1 / sums)[:, None]
    p[np.arange(len(want)), want] -= 1
    return p


class _Laid:
    """Where the rows of each batch stand, which no weight changes: those of groups of words, and those of context words.

    Rows of a batch are in order of their groups. Of each group the first ``SIDE`` rows are laid side by side with
    those of all groups, and the rest follows, for the groups that have more, in the width of the largest.
    """

    def __init__(self, sizes: np.ndarray, want: np.ndarray, places: np.ndarray):
        n, n_batches = len(want), len(sizes)
        flat = sizes.ravel()
        rank = np.arange(n) - np.repeat(np.cumsum(flat) - flat, flat)
        batch = np.arange(n) // BATCH
        rest = np.maximum(want - (CLASSES - 1), 0)
        self.group, self.member = rest // MEMBERS, rest % MEMBERS
        self.big = sizes[:, 1:] > SIDE
        self.width = np.maximum(sizes[:, 1:].max(axis=1, initial=0) - SIDE, 0)
        beyond = GROUPS * SIDE + (np.cumsum(self.big, axis=1) - 1)[batch, self.group] * self.width[batch] + rank - SIDE
        self.spot = np.where(rank < SIDE, self.group * SIDE + rank, beyond)
        # Places of 16 bits sort by radix
        short, order, rows = places.astype(np.uint16), [], []
        for s in range(0, n, BATCH):
            part = short[:, s : s + BATCH].ravel()
            at = np.argsort(part, kind="stable")
            order.append(part[at])
            rows.append(at % min(BATCH, n - s))
        ranked, rows = np.concatenate(order), np.concatenate(rows)
        ends = np.minimum(np.arange(1, n_batches + 1) * BATCH, n) * len(PLACES)
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        new[ends[:-1]] = True
        first = np.flatnonzero(new)
        each = np.diff(np.append(first, len(ranked)))
        lone = each == 1
        at = ranked[first].astype(np.int64)
        self.lone_rows, self.lone_at = rows[first[lone]], at[lone]
        self.lone_ends = np.searchsorted(first[lone], np.append(0, ends))
        self.many_at, self.many_rows = at[~lone], rows[np.repeat(~lone, each)]
        sums = np.append(0, np.cumsum(each[~lone]))
        self.many_ends = np.searchsorted(first[~lone], np.append(0, ends))
        self.row_ends = sums[self.many_ends]
        self.many_first = sums[:-1]

    def word_step(self, b: int, words: np.ndarray, held: np.ndarray, s: int, e: int, rate: float) -> np.ndarray:
        """One step of the outputs in each group, ``words`` (group, hidden and bias, member); the gradient by the hidden values."""
        spot, big, width, edge = self.spot[s:e], np.flatnonzero(self.big[b]), int(self.width[b]), GROUPS * SIDE
        laid = np.zeros((edge + len(big) * width, HIDDEN + 1), np.float32)
        laid[spot] = held
        logits = np.empty((len(laid), MEMBERS), np.float32)
        near, far = laid[:edge].reshape(GROUPS, SIDE, -1), laid[edge:].reshape(len(big), width, HIDDEN + 1)
        np.matmul(near, words, out=logits[:edge].reshape(GROUPS, SIDE, -1))
        if len(big):
            own = words[big]
            np.matmul(far, own, out=logits[edge:].reshape(len(big), width, -1))
        wrong = np.zeros_like(logits)
        wrong[spot] = _error(np.take(logits, spot, axis=0), self.member[s:e])
        by_side, beyond = wrong[:edge].reshape(GROUPS, SIDE, -1), wrong[edge:].reshape(len(big), width, MEMBERS)
        back = np.empty((len(laid), HIDDEN), np.float32)
        np.matmul(by_side, words[:, :HIDDEN].transpose(0, 2, 1), out=back[:edge].reshape(GROUPS, SIDE, -1))
        if len(big):
            np.matmul(beyond, own[:, :HIDDEN].transpose(0, 2, 1), out=back[edge:].reshape(len(big), width, -1))
        laid *= rate
        words -= np.matmul(near.transpose(0, 2, 1), by_side)
        if len(big):
            words[big] -= np.matmul(far.transpose(0, 2, 1), beyond)
        return np.take(back, spot, axis=0)

    def table_step(self, b: int, table: np.ndarray, step: np.ndarray) -> None:
        """Subtracts from each place of the table the steps of its rows."""
        s, e = self.lone_ends[b : b + 2]
        at = self.lone_at[s:e]
        table[at] = np.take(table, at, axis=0) - np.take(step, self.lone_rows[s:e], axis=0)
        s, e = self.many_ends[b : b + 2]
        if s < e:
            at, (low, high) = self.many_at[s:e], self.row_ends[b : b + 2]
            # Sums of two floats at a time, as complex numbers
            many = np.take(step, self.many_rows[low:high], axis=0).view(np.complex64)
            table[at] = np.take(table, at, axis=0) - np.add.reduceat(many, self.many_first[s:e] - low, axis=0).view(np.float32)


def train(weights: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """One pass of stochastic gradient descent over the rows; ``target`` are ids.

    The rows of a batch, whose order does not matter, stand by class and group. Matrices and biases are one
    matrix each, as they lie beside each other in the weights; the hidden values end with a one.
    """
    weights = weights.copy()
    if not len(target):
        return weights
    table, bias, out, base, group_out, group_base, word_out, word_base = unpacked(weights)
    at = table.size + bias.size
    classes = weights[at : at + out.size + base.size].reshape(HIDDEN + 1, CLASSES)
    at += classes.size
    groups = weights[at : at + group_out.size + group_base.size].reshape(HIDDEN + 1, GROUPS)
    words = np.concatenate([word_out, word_base[:, None]], axis=1)
    # The step of one row; rarer outputs and context words, which few rows of a batch have, take larger ones
    rate = RATE / 256
    n_batches = -(-len(target) // BATCH)
    key = np.arange(len(target)) // BATCH * (GROUPS + 1) + np.where(target < CLASSES - 1, 0, 1 + (target - (CLASSES - 1)) // MEMBERS)
    sizes = np.bincount(key, minlength=n_batches * (GROUPS + 1)).reshape(-1, GROUPS + 1)
    order = np.argsort(key.astype(np.uint16) if sizes.size < 1 << 16 else key, kind="stable")
    want, places = target[order], np.ascontiguousarray((context[order] + _SHIFT).T)
    laid, wanted = _Laid(sizes, want, places), np.minimum(want, CLASSES - 1)
    met, hidden = np.empty((len(PLACES), BATCH, HIDDEN), np.float32), np.ones((BATCH, HIDDEN + 1), np.float32)
    for b, s in enumerate(range(0, len(target), BATCH)):
        e = min(s + BATCH, len(target))
        held, before = hidden[: e - s], met[0, : e - s]
        for k in range(len(PLACES)):
            np.take(table, places[k, s:e], axis=0, out=met[k, : e - s], mode="clip")
        for k in range(1, len(PLACES)):
            before += met[k, : e - s]
        before += bias
        np.maximum(before, 0, out=held[:, :HIDDEN])
        p = _error(held @ classes, wanted[s:e])
        back = p @ classes[:HIDDEN].T
        known = int(sizes[b, 0])
        if known < e - s:
            others = held[known:]
            q = _error(others @ groups, laid.group[s + known : e])
            back[known:] += q @ groups[:HIDDEN].T
            groups -= rate * 2 * (others.T @ q)
            back[known:] += laid.word_step(b, words, others, s + known, e, rate * 8)
        back *= before > 0
        classes -= rate * (held.T @ p)
        bias -= rate * back.sum(axis=0)
        back *= rate * 8
        laid.table_step(b, table, back)
    word_out[:], word_base[:] = words[:, :HIDDEN], words[:, HIDDEN]
    return weights


def _chunks(rows: Iterator[tuple[np.ndarray, bool]]) -> Iterator[np.ndarray]:
    """``GROUP`` ids at a time, and the two before and after them, of rows that go on up to one that is the last."""
    held = np.empty(0, np.int16)
    for ids, last in rows:
        # One pair of PADs stands between the texts of two rows
        held = np.concatenate([held, ids[2:] if len(held) else ids])
        while len(held) - 4 > GROUP:
            yield held[: GROUP + 4]
            held = held[GROUP:]
        if last:
            if len(held) > 4:
                yield held
            held = held[:0]
    if len(held) > 4:
        yield held


def _examples(words: Words, documents: bool = False):
    """Chunks of ids with two PADs before and after each text; a text may go on in the next chunk.

    With ``documents`` the ids of some whole texts at a time, whether these are the last read together, and the doc_id, the
    number of tokens and the sum of the shares of rare words of each text.
    """

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bool, dict]]:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            distinct, codes, sizes = split(part["text"])
            ids, shares = words.of(distinct)
            some = sizes > 0
            rows = np.full(2 + len(codes) + 2 * int(some.sum()), PAD, np.int16)
            rows[2 + np.arange(len(codes)) + 2 * np.repeat(np.cumsum(some) - 1, sizes)] = ids[codes]
            texts = {}
            if documents:
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = np.bincount(owner, shares[codes], minlength=len(sizes))
                lists = {"doc_ids": (part["doc_id"].to_pylist(), pa.int64()), "sizes": (sizes, pa.int64()), "shares": (sums, pa.float64())}
                texts = {name: pa.array([x], pa.list_(kind)) for name, (x, kind) in lists.items()}
            yield rows, at + TEXTS >= batch.num_rows, texts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if documents:
                for rows, last, texts in read(batch):
                    yield pa.RecordBatch.from_pydict({"rows": pa.array([rows.tobytes()], pa.binary()), "last": pa.array([last]), **texts})
            else:
                for rows in _chunks((rows, last) for rows, last, _ in read(batch)):
                    yield pa.RecordBatch.from_pydict({"rows": pa.array([rows.tobytes()], pa.binary())})

    return each


def _trained(weights: np.ndarray):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bool]]:
        for batch in batches:
            for rows, last in zip(batch["rows"], batch["last"].to_pylist()):
                yield np.frombuffer(rows.as_buffer(), np.int16), last

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = weights, 0
        for chunk in _chunks(read(batches)):
            ids = chunk.astype(np.int64)
            spots = np.flatnonzero(ids[2:-2] != PAD) + 2
            spots = np.random.default_rng(len(ids)).permutation(spots)
            now = train(now, np.stack([ids[spots + p] for p in PLACES], axis=1), ids[spots])
            n += len(spots)
        if n:
            for b in range(0, len(now), BLOCK):
                part = now[b : b + BLOCK].astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([n]), pa.array([part.tobytes()], pa.binary())], names=["block", "n", "part"])

    return each


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, np.float64) for p in frame["part"])
    return pd.DataFrame({"block": frame["block"].iloc[:1], "n": [frame["n"].sum()], "part": [total.tobytes()]})


def fit(docs: DataFrame, words: Words, rounds: int = ROUNDS) -> np.ndarray:
    """The averaged weights; blocks of fixed size come back each round."""
    chunks = cut(docs.select("text").mapInArrow(_examples(words), "rows binary"))
    return fitted(chunks.withColumn("last", F.lit(True)), words, rounds)


def fitted(rows: DataFrame, words: Words, rounds: int = ROUNDS) -> np.ndarray:
    """``fit`` on the written ids of the texts."""
    schema = "block long, n long, part binary"
    weights = start_weights(words.counts)
    for _ in range(rounds):
        parts = rows.select("rows", "last").mapInArrow(_trained(weights), schema)
        # Half sums first, so that no task adds up the parts of all others
        halves = parts.withColumn("h", (F.rand(1) * 16).cast("int")).groupBy("block", "h").applyInPandas(_add, schema)
        weights = weights.copy()
        for r in halves.groupBy("block").applyInPandas(_add, schema).collect():
            weights[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["part"], np.float64) / r["n"]
    return weights


def _scored(weights: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, doc_ids, sizes, shares in zip(batch["rows"], batch["doc_ids"], batch["sizes"], batch["shares"]):
                ids = np.frombuffer(rows.as_buffer(), np.int16).astype(np.int64)
                spots = np.flatnonzero(ids != PAD)
                each = np.empty(len(spots))
                for s in range(0, len(spots), GROUP):
                    at = spots[s : s + GROUP]
                    each[s : s + GROUP] = word_log_probabilities(weights, np.stack([ids[at + p] for p in PLACES], axis=1), ids[at])
                size = sizes.values.to_numpy()
                sums = np.bincount(np.repeat(np.arange(len(size)), size), each, minlength=len(size)) + shares.values.to_numpy()
                yield pa.RecordBatch.from_arrays([doc_ids.values, sizes.values, pa.array(sums)], names=["doc_id", "n_tokens", "log_likelihood"])

    return each


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens), mean_log_likelihood; one row for each row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = vocabulary(docs)
    # Texts are split once for training and scoring
    rows = cut(docs.mapInArrow(_examples(words, True), "rows binary, last boolean, doc_ids array<long>, sizes array<long>, shares array<double>"))
    out = rows.mapInArrow(_scored(fitted(rows, words)), "doc_id long, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn("mean_log_likelihood", mean)
