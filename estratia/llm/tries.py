"""Documents whose sets of word n-grams reach a Jaccard similarity, by a prefix-tree join.

A document's set are its distinct five-word shingles; equal sets are one set from the start. Sets
link when 100 * shared >= 80 * united. The n-grams are ordered once for the whole corpus, rare ones
first, and sets stored in that order in a trie: sets with equal beginnings share its nodes. A probe
walks down with the number of n-grams it shares with the path so far, computed once for all sets
below, and leaves a subtree when even all remaining n-grams could not reach the overlap that the
smallest set below needs, or when all sets below are already of the probe's component.

Which sets meet in a trie is decided in three exact steps, each shuffling n-grams or ids only:
 1. Of n-grams by digest, a pair at 0.8 shares the first l common ones within the first
    n - ceil(0.8 n) + l of both sets. Sets with too few n-grams in that prefix that another set's
    prefix has are linked with nothing. A batch says once which n-grams two of its sets share.
 2. Of the rest, n-grams are numbered by frequency; those of one set only are no path of a trie, and a set
    needs 0.8 n others.
 3. Sets that have an n-gram in common within their first n - ceil(0.8 n) + 1 form a group (stars, then
    connected components); linked sets are always of one group.
A group of up to ``CELL`` n-grams is one trie. A larger one is dealt into cells of that size: first a
few leaders probe every cell, so that most copies of one text become one component, then the sets
outside the largest component probe every cell, and no pair inside it is looked at. So no group is
ever in one task, and memory is bounded by ``CELL`` and the longest text.

n-grams are told apart by 64-bit digests and sets by the MD5 of theirs.

Defined results: words are runs of anything but the six blanks, A-Z lower-cased. A text of one to four
words has one n-gram, all its words. A null, empty or blank text has none, no link, and is its own component.
component_id is the least id of the component, null ids aside; without any it is null. Rows of equal ids are
documents of their own; repeated rows are copies. Very long texts are read in full. An empty table gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estratia.llm.common import cut, numbered, ship
from estratia.llm.near import classes
from estratia.llm.spans import BLANKS, Words, cut_words, runs
from estratia.operators.joins import join_unique

ship(__name__)

SHINGLE = 5
PERCENT = 80
CELL = 2_000_000
LEADERS = 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0xD1342543DE82EF95)
_BYTES = np.random.default_rng(20250611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[0x20] = 0  # stands between words


def _blend(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _SPREAD
    return x ^ (x >> np.uint64(31))


def digests(words: Words) -> np.ndarray:
    """A 64-bit digest of every word: its bytes' numbers weighted by powers of their places."""
    if not len(words.start):
        return np.empty(0, np.uint64)
    size = words.end - words.start
    place = np.arange(len(words.data)) - np.repeat(words.start, size + 1)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _STEP)]), dtype=np.uint64)
    return _blend(np.add.reduceat(_BYTES[words.data] * power[place], words.start) + size.astype(np.uint64))


def gram_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct n-grams as ascending digests."""
    for a, b in runs(texts):
        words = cut_words(texts.slice(a, b - a), BLANKS)
        word, bounds = digests(words), words.bounds()
        count = np.diff(bounds)
        wide = np.maximum(len(word) - SHINGLE + 1, 0)
        gram = np.full(wide, np.uint64(SHINGLE))
        for k in range(SHINGLE):
            gram = _blend(gram * _ODD + word[k : k + wide])
        of = words.text[:wide]
        inside = of == words.text[SHINGLE - 1 : SHINGLE - 1 + wide]
        gram, of = gram[inside], of[inside]
        order = np.lexsort((gram, of))
        gram, of = gram[order], of[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
        gram, of = gram[new], of[new]
        edges = np.searchsorted(of, np.arange(b - a + 1))
        for t in range(b - a):
            if 0 < count[t] < SHINGLE:
                one = np.full(1, np.uint64(count[t]))
                for w in word[bounds[t] : bounds[t + 1]]:
                    one = _blend(one * _ODD + w)
                yield one
            else:
                yield gram[edges[t] : edges[t + 1]]


def least(n):
    """The n-grams that a set of n must share with any set it links with."""
    return -(-PERCENT * n // 100)


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys = [], []
        for grams in gram_sets(batch["text"]):
            n.append(len(grams))
            keys.append(hashlib.md5(grams.tobytes()).digest() if len(grams) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n", "key"])


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, key, credit: prefix n-grams of a set; those that two sets of the batch have only once, without key.

    The rows with a credit say how many n-grams of the set that covers, less those it needs.
    """
    for batch in batches:
        sets: dict[int, np.ndarray] = {}
        for grams in gram_sets(batch["text"]):
            if len(grams):
                sets.setdefault(_short(hashlib.md5(grams.tobytes()).digest()), grams)
        if not sets:
            continue
        n = np.array([len(g) for g in sets.values()])
        more = np.maximum(n // 10, 1)
        need = np.maximum(least(n) // 10, 1)
        parts = [g[: s - least(s) + m] for g, s, m in zip(sets.values(), n, more)]
        gram = np.concatenate(parts).view(np.int64)
        own = np.repeat(np.arange(len(n)), [len(p) for p in parts])
        keys = np.fromiter(sets, np.int64, len(n))
        distinct, at, often = np.unique(gram, return_inverse=True, return_counts=True)
        here = often[at] > 1
        credit = np.bincount(own[here], minlength=len(n)) - need
        common = distinct[often > 1]
        out_gram = np.concatenate([gram[~here], common, keys])
        out_key = pa.concat_arrays([pa.array(keys[own[~here]]), pa.nulls(len(common), pa.int64()), pa.array(keys)])
        out_credit = pa.concat_arrays([pa.nulls(len(out_gram) - len(keys), pa.int64()), pa.array(credit)])
        yield pa.RecordBatch.from_arrays([pa.array(out_gram), out_key, out_credit], names=["gram", "key", "credit"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[bytes, np.ndarray] = {}
        for grams in gram_sets(batch["text"]):
            if len(grams):
                found.setdefault(hashlib.md5(grams.tobytes()).digest(), grams)
        size = np.array([len(g) for g in found.values()], np.int64)
        flat = np.concatenate([np.empty(0, np.uint64), *found.values()]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
        short = pa.array([_short(k) for k in found], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), short, pa.array(size), lists], names=["key", "short", "n", "grams"])


class Trie:
    """Sets as paths of ascending n-gram numbers; a node holds a run of them.

    ``group`` finds the present component of a set.
    """

    class Node:
        __slots__ = ("run", "next", "ends", "smallest", "deep", "one")

        def __init__(self, run, smallest, deep, one):
            self.run, self.next, self.ends = run, {}, []
            self.smallest, self.deep, self.one = smallest, deep, one

    def __init__(self, universe: int, group):
        self.top = self.Node(np.empty(0, np.int64), 1 << 62, 0, None)
        self.mark = np.zeros(universe, np.int64)
        self.group = group
        self.held = 0
        self.fresh = 1

    def _pass(self, node, left: int, n: int, who: int) -> None:
        """The set ``who`` of n n-grams goes through this node, ``left`` of its path from here on."""
        node.smallest, node.deep = min(node.smallest, n), max(node.deep, left)
        if node.one is None and not self.held:
            node.one = who
        elif node.one is not None and self.group(node.one) != self.group(who):
            node.one = None

    def add(self, path: np.ndarray, n: int, who: int) -> None:
        node, at = self.top, 0
        self._pass(node, len(path), n, who)
        self.held += 1
        while at < len(path):
            child = node.next.get(path[at])
            if child is None:
                child = node.next[path[at]] = self.Node(path[at:], n, len(path) - at, who)
                node, at = child, len(path)
                break
            size = min(len(child.run), len(path) - at)
            other = np.flatnonzero(child.run[:size] != path[at : at + size])
            same = int(other[0]) if len(other) else size
            if same < len(child.run):
                fork = self.Node(child.run[:same], child.smallest, child.deep, child.one)
                child.run, child.deep = child.run[same:], child.deep - same
                fork.next[child.run[0]] = child
                node.next[path[at]] = fork
                child = fork
            self._pass(child, len(path) - at, n, who)
            node, at = child, at + same
        node.ends.append((who, n))
        if self.held >= 2 * self.fresh:
            self.fresh = self.held
            self._refresh()

    def _refresh(self) -> None:
        """Marks anew the nodes below which all sets are of one component by now."""
        order, stack = [], [self.top]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.next.values())
        for node in reversed(order):
            below = [c.one for c in node.next.values()] + [w for w, _ in node.ends]
            if None not in below and len({self.group(w) for w in below}) == 1:
                node.one = below[0]

    def linked(self, path: np.ndarray, n: int, who: int) -> Iterator[int]:
        """Stored sets that link with this one, leaving out any that became of its component meanwhile."""
        self.mark[path] = 1
        stack = [(self.top, 0, 0)]
        while stack:
            node, shared, used = stack.pop()
            if node.one is not None and self.group(node.one) == self.group(who):
                continue
            if 9 * (shared + min(len(path) - used, node.deep)) < 4 * (n + node.smallest):
                continue
            if len(node.run):
                shared += int(self.mark[node.run].sum())
                used = int(np.searchsorted(path, node.run[-1], side="right"))
            for other, m in node.ends:
                if 9 * shared >= 4 * (n + m) and self.group(other) != self.group(who):
                    yield other
            if node.next and 9 * (shared + min(len(path) - used, node.deep - len(node.run))) >= 4 * (n + node.smallest):
                stack.extend((c, shared, used) for c in node.next.values())
        self.mark[path] = 0


def joined(label: list, size: list, path: list, stored: list, probes: list) -> list[tuple[int, int]]:
    """Links (positions of two sets) that connect what is linked in this cell and not of one label yet."""
    first: dict[int, int] = {}
    parent = [first.setdefault(x, i) for i, x in enumerate(label)]

    def group(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    flat = np.concatenate(path)
    names, local = np.unique(flat, return_inverse=True)
    paths = np.split(local, np.cumsum([len(p) for p in path])[:-1])
    trie, out = Trie(len(names), group), []
    # Sets that are only stored come first, those that only probe last
    for i in sorted(range(len(label)), key=lambda i: (probes[i], not stored[i])):
        if probes[i]:
            for j in trie.linked(paths[i], size[i], i):
                parent[group(j)] = group(i)
                out.append((i, j))
        if stored[i]:
            trie.add(paths[i], size[i], i)
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their cells; a cell is worked on when its last row has come."""
    held: list[tuple] = []
    at = None

    def links() -> pa.RecordBatch:
        ids, rest = [r[0] for r in held], list(zip(*(r[1:] for r in held)))
        pairs = joined(*rest) if len(held) > 1 else []
        ends = [pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("grp", "cell", "id", "label", "n", "stored", "probes")]
        for row, tokens in zip(zip(*columns), batch["tokens"]):
            if at is not None and at != row[:2]:
                yield links()
                held.clear()
            at = row[:2]
            held.append((row[2], row[3], row[4], tokens.values.to_numpy(zero_copy_only=False), row[5], row[6]))
    if held:
        yield links()


def meet(rows: DataFrame) -> DataFrame:
    """Links (a, b) found in the cells (grp, cell) of the rows id, label, n, tokens, stored, probes."""
    wanted = rows.select("grp", "cell", "id", "label", "n", "tokens", "stored", "probes")
    laid = wanted.repartition("grp", "cell").sortWithinPartitions("grp", "cell")
    return cut(laid.mapInArrow(_cells, "a long, b long"))


def trie_links(sets: DataFrame, cell: int = CELL, leaders: int = LEADERS) -> DataFrame:
    """Links (a, b) that connect what is linked among the sets id, n, tokens, grp (n-gram numbers ascending)."""
    yes, no = F.lit(True), F.lit(False)
    totals = sets.groupBy("grp").agg(F.sum(F.size("tokens")).alias("total"), F.count(F.lit(1)).alias("sets_")).where("sets_ > 1")
    totals = totals.withColumn("cells", F.ceil(F.col("total") / cell).cast("int"))
    rows = sets.join(totals.select("grp", "cells"), "grp").withColumn("label", F.col("id"))
    rows = cut(rows.withColumn("cell", F.pmod(F.xxhash64("id"), "cells").cast("int")))
    found = meet(rows.where("cells = 1").withColumn("stored", yes).withColumn("probes", yes))
    large = rows.where("cells > 1")
    if large.isEmpty():
        return found
    everywhere = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    first = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id"))
    lead = large.withColumn("nth", first).where(F.col("nth") <= leaders).drop("nth").withColumn("cell", everywhere)
    lead = lead.withColumn("stored", no).withColumn("probes", yes)
    stars = meet(large.withColumn("stored", yes).withColumn("probes", no).unionByName(lead)).where("a <> b")
    label = classes(stars).select("id", F.col("cls").alias("new"))
    large = cut(large.join(label, "id", "left").withColumn("label", F.coalesce("new", "label")).drop("new"))
    per = large.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    large = large.join(main, "grp").withColumn("stored", yes).withColumn("probes", F.col("label") != F.col("main"))
    away = large.where("probes").withColumn("own", F.col("cell")).withColumn("cell", everywhere).where("own <> cell").drop("own")
    rest = meet(large.unionByName(away.withColumn("stored", no)))
    return found.union(stars).union(rest)


def candidate_sets(docs: DataFrame) -> DataFrame:
    """id, key, n, grams of the distinct sets that may link with another one; ``docs`` has text."""
    texts = docs.select("text")
    prefix = texts.mapInArrow(_prefix_rows, "gram long, key long, credit long")
    whole = Window.partitionBy("gram")
    plain = F.col("credit").isNull()
    several = (F.min(F.when(plain, F.col("key"))).over(whole) < F.max(F.when(plain, F.col("key"))).over(whole)) | F.max(plain & F.col("key").isNull()).over(whole)
    marked = prefix.withColumn("several", F.coalesce(several, F.lit(False)))
    sums = marked.groupBy("key").agg(F.sum(F.coalesce("credit", F.col("several").cast("long"))).alias("credit"))
    left = cut(sums.where("key is not null and credit >= 0").select(F.col("key").alias("short")))
    sets = join_unique(texts.mapInArrow(_set_rows, "key binary, short long, n long, grams array<long>"), left, ["short"], how="left_semi")
    sets = sets.groupBy("key").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    return cut(sets.withColumn("id", F.monotonically_increasing_id()))


def ordered_sets(sets: DataFrame) -> DataFrame:
    """id, n, tokens: the n-grams that other sets have too, by number; only of sets that share enough of them."""
    each = sets.select("id", "n", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    number = numbered(often, ["df", "gram"], F.lit(True)).select("gram", F.col("position").alias("token"))
    tokens = each.join(cut(number), "gram").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("token")).alias("tokens"))
    return cut(tokens.where(F.size("tokens") * 100 >= F.col("n") * PERCENT))


def groups(sets: DataFrame) -> DataFrame:
    """The sets with ``grp``, equal for all that are connected by n-grams in their prefixes."""
    need = F.expr(f"({PERCENT} * n + 99) div 100")
    prefix = F.slice("tokens", F.lit(1), (F.size("tokens") - need + 1).cast("int"))
    first = cut(sets.select("id", F.explode(prefix).alias("token")))
    heads = first.groupBy("token").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = first.join(cut(heads), "token").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    return cut(sets.join(classes(edges).select("id", F.col("cls").alias("grp")), "id"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cell: int = CELL, leaders: int = LEADERS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (documents of the same set), a row for each of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    members = cut(rows.mapInArrow(_member_rows, f"doc_id {kind}, n long, key binary"))
    sets = candidate_sets(rows)
    links = trie_links(groups(ordered_sets(sets)), cell, leaders)
    found = classes(links).join(sets.select("id", "key"), "id").select("key", "cls")
    keys = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    keys = cut(keys.join(found, "key", "left"))
    by_class = keys.where("cls is not null").groupBy("cls").agg(F.min("first").alias("class_first"))
    known = keys.join(by_class, "cls", "left").select("key", "n_copies", F.coalesce("class_first", F.when(F.col("cls").isNull(), F.col("first"))).alias("component"))
    out = join_unique(members, cut(known), ["key"], members="n_copies")
    lone = F.col("key").isNull()
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
