"""Near duplicates by Order MinHash.

A text's k-mers are its five-word shingles, each labelled with its occurrence number. A sketch draws
the ``PICKS`` labelled k-mers of least digest and keeps them in text order, so two texts agree in a
sketch only if they share these k-mers in the same order. Texts that agree in any of ``SKETCHES``
sketches are candidates; a candidate pair is verified by a banded alignment of its labelled k-mers.

Labelled k-mers are unique in a text, so the alignment is the longest chain of common k-mers that
rises in both texts. Its similarity is chain / (n + m - chain), at least ``SIMILARITY``. Such a pair
leaves at most (n + m) / 9 k-mers unmatched, so the band of that width about the diagonal loses nothing.

Equal texts meet first and go on as one. In a bucket of up to ``ALL_PAIRS`` texts each meets each. In
a larger one all meet one lead; those that are linked to it are of its class whatever links they have with
each other, the others go on with a lead of their own, for ``ROUNDS`` rounds. The rest is exact by what sets
a text apart from its lead, the k-mers that only one of the two has: similar texts of which one is not linked to the
lead share some of these, so they meet by the rarest of them (``differences``). Texts that hold the lead's
k-mers in another order have no such differences; they meet the members of their buckets. No link
between classes is lost, and pairs inside a class are not listed.

Defined results: words are runs of letters and digits in lower case. A text of one to four words has
one k-mer, all its words. A text without words (empty, blank) only matches an equal text. A null text
matches nothing. A document is a doc_id with a text: different texts under one doc_id, or under none,
are documents of their own, told apart by the SHA-256 of the text; rows equal in both are one. Very long texts
are sketched and aligned whole. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estratia.llm.common import Cuts, cut, drop_cut, ship

ship(__name__)

SHINGLE = 5
SIMILARITY = 0.8  # the conditions below write it as 4/5, its largest unmatched share as 1/9
SKETCHES = 12
PICKS = 2
ALL_PAIRS = 16
ROUNDS = 2  # leads of a bucket, one after another
PER_TASK = 1_000  # texts of one lead that a task aligns with it
WORD = re.compile(r"[^\W_]+")

_MIX = np.random.default_rng(20240607).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(31)


def _blend(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _SPREAD
    return x ^ (x >> _STEP)


def _digests(text: str, known: dict[str, int]) -> np.ndarray:
    """A digest of each word."""
    found = WORD.findall(text.lower())
    for word in set(found).difference(known):
        known[word] = xxhash.xxh32_intdigest(word)
    return np.fromiter(map(known.__getitem__, found), np.uint32, len(found))


def kmers(words: np.ndarray) -> np.ndarray:
    """Digests of the occurrence-labelled k-mers, in text order; none for a text without words."""
    size = min(SHINGLE, len(words))
    if not size:
        return np.empty(0, np.uint64)
    count = len(words) - size + 1
    grams = np.zeros(count, np.uint64)
    for k in range(size):
        grams = _blend(grams * _ODD + words[k : k + count].astype(np.uint64) + np.uint64(k + 1))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    if len(first) == count:
        return grams
    label = np.empty(count, np.uint64)
    label[order] = np.arange(count) - np.repeat(first, np.diff(np.append(first, count)))
    return _blend(grams + label * _ODD)


def sketches(grams: np.ndarray) -> np.ndarray:
    """One digest per sketch of its least k-mers in text order."""
    drawn = _blend(grams[None, :] * _MIX[:, None])
    picks = min(PICKS, len(grams))
    spots = np.argpartition(drawn, picks - 1, axis=1)[:, :picks] if len(grams) > picks else np.tile(np.arange(picks), (SKETCHES, 1))
    spots = np.sort(spots, axis=1)
    out = np.zeros(SKETCHES, np.uint64)
    for p in range(picks):
        out = _blend(out * _ODD + grams[spots[:, p]])
    return out


def chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest rising chain of common k-mers within the band."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) * 9 <= len(a) + len(b)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    ends = np.empty(len(j), j.dtype)
    n = 0
    for x in j:
        at = int(np.searchsorted(ends[:n], x))
        ends[at] = x
        n = max(n, at + 1)
    return n


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    small, large = sorted((len(a), len(b)))
    if not small or small < SIMILARITY * large:
        return 0.0
    c = chain(a, b)
    return c / (len(a) + len(b) - c)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, int] = {}
        ids, sizes, found, digests = [], [], [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            words = _digests(text.as_py(), known)
            if not len(words):
                continue
            grams = kmers(words)
            ids.append(doc)
            sizes.append(len(grams))
            found.append(sketches(grams).view(np.int64))
            digests.append(words.view(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.int32()))],
            names=["id", "n", "sketch", "words"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, left, good = None, None, []
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        for x, wa, wb in zip(a, batch["wa"], batch["wb"]):
            if x != last:
                last, left = x, kmers(wa.values.to_numpy().view(np.uint32))
            good.append(similarity(left, kmers(wb.values.to_numpy().view(np.uint32))) >= SIMILARITY)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, words in zip(batch["id"].to_pylist(), batch["words"]):
            grams = kmers(words.values.to_numpy().view(np.uint32)).view(np.int64)
            same = np.full(len(grams), doc), np.full(len(grams), len(grams))
            yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(grams)], names=["id", "n", "gram"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each text stands to its lead: linked, and the k-mers that only one of the two has."""
    for batch in batches:
        last, head, linked, apart = None, None, [], []
        leads = batch["lead"].to_pylist()
        for lead, theirs, own in zip(leads, batch["lead_words"], batch["words"]):
            if lead != last:
                last, head = lead, kmers(theirs.values.to_numpy().view(np.uint32))
            grams = kmers(own.values.to_numpy().view(np.uint32))
            linked.append(similarity(grams, head) >= SIMILARITY)
            apart.append(np.setxor1d(grams, head, assume_unique=True).view(np.int64))
        kept = batch.select(["lead", "id", "n", "ln"]).to_pydict()
        types = [pa.int64()] * 4
        columns = [pa.array(v, t) for v, t in zip(kept.values(), types)]
        d = pa.array(map(len, apart), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*columns, d, pa.array(linked, pa.bool_()), pa.array(apart, pa.list_(pa.int64()))],
            names=["lead", "id", "n", "ln", "d", "linked", "apart"],
        )


def held_together(members: DataFrame, texts: DataFrame) -> DataFrame:
    """id, n, shared: the members of whose k-mers four fifths are in other members too, and how many are.

    A chain holds shared k-mers only, so that the other members are near to none.
    """
    grams = texts.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "words")
    grams = cut(grams.mapInArrow(_spread, "id long, n long, gram long"))
    many = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1").select("gram")
    shared = cut(grams.join(many, "gram", "left_semi").groupBy("id", "n").agg(F.count("*").alias("shared")).where("shared * 5 >= n * 4"))
    drop_cut(grams)
    return shared


def stands(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """lead, id, n, ln, d, linked, apart for each pair (lead, id); a lead of many texts is dealt over several tasks."""
    parts = stars.groupBy("lead").agg(F.floor(F.count("*") / PER_TASK).alias("parts"))
    own = stars.join(parts, "lead").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts") + 1)).drop("parts")
    heads = parts.join(texts.select(F.col("id").alias("lead"), F.col("n").alias("ln"), F.col("words").alias("lead_words")), "lead")
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "parts"))).drop("parts")
    met = own.join(texts.select("id", "n", "words"), "id").join(heads, ["lead", "part"])
    slim = met.select("lead", "id", "n", "ln", "words", "lead_words")
    return slim.mapInArrow(_apart, "lead long, id long, n long, ln long, d long, linked boolean, apart array<long>")


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), which are a written table, those whose alignment reaches the similarity.

    Texts without a pair are left out on either side, before their words move where the pairs are few.
    """
    wa = texts.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("words").alias("wa"))
    wb = texts.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(wb, "b").join(wa, "a").select("a", "b", "wa", "wb").mapInArrow(_verify, "a long, b long")


def classes(edges: DataFrame) -> DataFrame:
    """id, cls: the least id that each end of the edges (a, b) is connected with.

    Each round points every vertex at the least neighbour of its neighbourhood, then joins the
    neighbours to that vertex, so that chains shorten by a factor each round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = last = cut(both.where("a <> b").distinct())
    while True:
        least = now.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        near = now.join(least, "a")
        # Larger neighbours hang on the least one; so does the vertex itself
        moved = near.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        moved = moved.union(least.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x <> y").distinct()
        low = moved.groupBy("x").agg(F.min("y").alias("m"))
        back = moved.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        kept = cut(back.union(low.select("x", F.col("m").alias("y"))).where("x > y").distinct())
        drop_cut(last)
        last = kept
        # Stars only: no head of an edge is the tail of another
        open_ = kept.select(F.col("x").alias("y")).join(kept.select("y").distinct(), "y", "left_semi").limit(1).count()
        split = kept.groupBy("x").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
        if not open_ and not split:
            heads = kept.select(F.col("y").alias("id"), F.col("y").alias("cls")).distinct()
            return kept.select(F.col("x").alias("id"), F.col("y").alias("cls")).union(heads)
        now = kept.select(F.col("x").alias("a"), F.col("y").alias("b"))
        now = now.union(kept.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()


def _with_classes(members: DataFrame, edges: DataFrame) -> DataFrame:
    joined = members.drop("cls").join(classes(edges), "id", "left")
    return joined.withColumn("cls", F.coalesce("cls", "id"))


def _fits(n: str, m: str) -> Column:
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def differences(stood: DataFrame) -> DataFrame:
    """lead, gram, id, n, d, linked, p, at: the k-mers by which a text can meet similar texts of its lead.

    Similar texts of n and m k-mers differ in at most (n + m) / 9 of them, and the k-mers that only one
    of them has are those in which their differences d and e from the lead differ. So the differences
    share at least (d + e - (n + m) / 9) / 2 k-mers, at least one if a text is farther from the lead than a
    similar one. Differences are ordered by how many texts of the lead have a k-mer in theirs, rarest
    first; ``at`` is the place among the p that some other text has in its differences, too.
    """
    flat = stood.where(~F.col("turned") & F.col("apart").isNotNull()).select("lead", "id", "n", "ln", "d", "linked", F.explode("apart").alias("gram"))
    often = stood.select("lead", F.explode("apart").alias("gram")).groupBy("lead", "gram").agg(F.count("*").alias("df")).where("df > 1")
    each = Window.partitionBy("lead", "id")
    flat = flat.join(often, ["lead", "gram"]).withColumn("p", F.count("*").over(each))
    # K-mers in no other difference are differences from every text
    flat = flat.where((F.col("d") - F.col("p")) * 4 <= F.col("n")).withColumn("at", F.row_number().over(each.orderBy("df", "gram")))
    # The fewest that a similar pair shares: a linked text is paired with one farther from the lead only
    fewest = F.when(F.col("linked"), F.ceil((F.col("d") * 9 + F.col("ln") - F.col("n")) / 18)).otherwise(F.ceil(F.col("d") - F.col("n") / 4))
    reach = F.col("at") <= F.col("p") - F.greatest(fewest, F.lit(1)) + 1
    return flat.where(reach).select("lead", "gram", "id", "n", "d", "linked", "p", "at")


def _meet(far: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a difference, if enough of both can still follow it and not too many stand before."""
    other = other.select("lead", "gram", *(F.col(c).alias(f"o_{c}") for c in other.columns if c not in ("lead", "gram")))
    least = F.greatest(F.ceil(((F.col("d") + F.col("o_d")) * 9 - F.col("n") - F.col("o_n")) / 18), F.lit(1))
    follow = F.least(F.col("p") - F.col("at"), F.col("o_p") - F.col("o_at")) + 1 >= least
    before = F.col("at") + F.col("o_at") - 2 <= F.col("p") + F.col("o_p") - least * 2
    new = F.col("cls") != F.col("o_cls") if "cls" in far.columns else F.col("id") != F.col("o_id")
    once = F.col("o_linked") | (F.col("id") < F.col("o_id")) if "o_linked" in other.columns else F.lit(True)
    met = far.join(other, ["lead", "gram"]).where(_fits("n", "o_n") & new & once & follow & before)
    return met.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))


def near_links(texts: DataFrame) -> DataFrame:
    """Verified pairs (a, b), a < b, whose classes are those of all similar pairs that share a sketch.

    ``texts`` has id, n (k-mers), sketch and words.
    """
    held = Cuts()
    rows = texts.select("id", "n", F.posexplode("sketch").alias("k", "v")).withColumn("bucket", F.xxhash64("k", "v")).drop("k", "v")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("s")).where("s > 1")
    rows = held(rows.join(sizes, "bucket"))
    other = lambda df: df.select("bucket", F.col("id").alias("o"), F.col("n").alias("on"))
    few = rows.where(F.col("s") <= ALL_PAIRS)
    pairs = few.join(other(few), "bucket").where(_fits("n", "on") & (F.col("id") < F.col("o")))
    pairs = pairs.select(F.col("id").alias("a"), F.col("o").alias("b"))

    many = rows.where(F.col("s") > ALL_PAIRS).select("bucket", "id")
    fame = rows.groupBy("id").agg(F.sum("s").alias("fame"))
    many = held(many.join(held_together(many, texts), "id").join(fame, "id").select("bucket", "id", "fame"))
    stars, met, kept = links(held(pairs.distinct()), texts), None, []
    for turn in range(ROUNDS):
        last = turn == ROUNDS - 1
        # The member of the most and largest buckets leads: of copies of one text that is near the original
        lead = many.groupBy("bucket").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("lead"))
        members = held(many.join(lead, "bucket").where("id <> lead"))
        stood = stands(members.select("lead", "id").distinct(), texts)
        stood = stood.withColumn("turned", ~F.col("linked") & (F.col("d") * 9 <= F.col("n") + F.col("ln")))
        # Farther than two links from the lead no text is similar to a linked one
        if not last:
            stood = stood.withColumn("apart", F.when(F.col("d") * 36 <= F.col("n") * 14 + F.col("ln") * 4, F.col("apart")))
        stood = held(stood)
        stars = stars.union(stood.where("linked").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")))
        placed = members.join(stood.select("lead", "id", "n", "d", "linked", "turned"), ["lead", "id"])
        # Texts with the lead's k-mers in another order meet those of their buckets with about as many differences
        beside = placed.select("bucket", *(F.col(c).alias(f"o_{c}") for c in ("id", "n", "d")))
        close = F.abs(F.col("d") - F.col("o_d")) * 9 <= F.col("n") + F.col("o_n")
        turned = placed.where("turned").join(beside, "bucket").where(_fits("n", "o_n") & (F.col("id") != F.col("o_id")) & close)
        turned = turned.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))
        met = turned if met is None else met.union(turned)
        flat = held(differences(stood))
        kept.append(flat)
        many = held(placed.where(~F.col("linked") & ~F.col("turned")).select("bucket", "id", "fame"))
        if many.isEmpty():
            break
    # Texts that no lead is near to first meet the one of fewest k-mers of its own among those of a difference
    for flat in kept:
        fewest = F.struct(F.col("p") - F.col("d"), -F.col("id"))
        head = flat.groupBy("lead", "gram").agg(F.max_by(F.struct("id", "n", "d", "p", "at"), fewest).alias("h"))
        stars = stars.union(links(held(_meet(flat.where(~F.col("linked")).drop("linked"), head.select("lead", "gram", "h.*")).distinct()), texts))
    found = held(stars)
    # Pairs inside a class need no link
    known = held(classes(found))
    for i, flat in enumerate(kept):
        flat = flat.join(known, "id", "left").withColumn("cls", F.coalesce("cls", "id"))
        # What is linked to no lead meets its like in the last round
        other = flat if i == len(kept) - 1 else flat.where("linked")
        met = met.union(_meet(flat.where(~F.col("linked")).drop("linked"), other))
    every = cut(found.union(links(held(met.distinct()), texts)).distinct())
    held.drop()
    return every


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy_id, class_id, n_links, n_class, digest, class_digest; one row for each doc_id and text.

    copy_id is the least id of equal texts, class_id that of the class's first text (least id, null
    last, then least digest), n_links the number of verified links of the text that were listed,
    n_class the number of documents in the class. digest is the SHA-256 of the text, class_digest
    that of the class's first text; where ids are null or repeat, class_id and class_digest together name the class.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.sha2("text", 256))
    held = Cuts()
    ids = held(rows.select("doc_id", "digest").distinct())
    copies = ids.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("copy_id"))
    # Numbers of the texts in this order, so that the least of a class is its first text
    own = held(copies.orderBy(F.col("copy_id").asc_nulls_last(), "digest").withColumn("id", F.monotonically_increasing_id()))
    # Texts move once, by the digest that both sides of the join are dealt by
    one = rows.where("digest is not null").select("digest", "text").dropDuplicates(["digest"])
    one = one.join(own.select("digest", "id"), "digest").select(F.col("id").alias("doc_id"), "text")
    texts = held(one.mapInArrow(_sketch_batches, "id long, n long, sketch array<long>, words array<int>"))
    found = near_links(texts)
    held.made.append(found)
    ends = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    each = _with_classes(own.withColumn("cls", F.col("id")), found).join(degree, "id", "left")
    heads = own.select(F.col("id").alias("cls"), F.col("copy_id").alias("class_id"), F.col("digest").alias("class_digest"))
    each = each.join(heads, "cls").select(F.col("digest").alias("own"), "copy_id", "cls", "class_id", "class_digest", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    joined = cut(ids.join(each, F.col("digest") == F.col("own"), "left").drop("own"))
    held.drop()
    sizes = joined.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n_class"))
    out = joined.join(sizes, "cls", "left")
    # A null text has no class but its own
    lone = F.col("cls").isNull()
    own_id = lambda c: F.when(lone, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    zero, single = F.lit(0).cast("long"), F.lit(1).cast("long")
    return out.select("doc_id", own_id("copy_id"), own_id("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_class", single).alias("n_class"), "digest", "class_digest")
