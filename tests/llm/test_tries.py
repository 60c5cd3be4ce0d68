"""Prefix-tree join against all pairs, on small odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest

from estratia.llm import tries

SCHEMA = "doc_id long, text string, key string, n string, id int, gram int, cls int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(docs):
    """(doc_id, n, component_id) of each row by comparing all sets."""
    sets = [frozenset(shingles(t)) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = {}
    for i, s in enumerate(sets):
        if s:
            parent[i] = distinct.setdefault(s, i)
    each = list(distinct.items())
    for x, (a, i) in enumerate(each):
        for b, j in each[:x]:
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 100 * len(a & b) >= 80 * len(a | b):
                parent[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(((d, len(s), low.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def copies(rng, base, many, edits, tag):
    out = []
    for k in range(many):
        words = list(base)
        for at in rng.integers(0, len(base), int(rng.integers(1, edits + 1))):
            words[at] = f"{tag}{k}x{at}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    texts = copies(rng, base, 60, 5, "e") + [" ".join(base)] * 3
    # Copies of copies: chains that leave the neighbourhood of the first text
    now = list(base)
    for k in range(40):
        now[(k * 7) % 120] = f"c{k}"
        texts.append(" ".join(now))
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"q{k}w{i}" for i in range(int(rng.integers(3, 60)))]) for k in range(40)]
    texts += copies(rng, [f"s{i}" for i in range(12)], 12, 2, "t")
    texts += ["", None, "  \n", "one two", "One two", "two one", "a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "É b c d e"]
    texts += [" ".join(f"l{i % 9_001}" for i in range(20_000)), " ".join(f"l{i % 9_001}" for i in range(20_000)) + " end", "z" * 100_000]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, None), (None, "lone null"), (5, texts[5]), (7, "another text of this id")]
    return [rows[i] for i in rng.permutation(len(rows))]


def run(spark, docs, **more):
    frame = spark.createDataFrame([(i, t, "k", "n", 1, 2, 3) for i, t in docs], SCHEMA).repartition(6)
    out = tries.components(frame, **more).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


@pytest.mark.parametrize("cell", [2_000_000, 1_500])
def test_equals_all_pairs(spark, docs, cell):
    assert run(spark, docs, cell=cell, leaders=2) == plain(docs)


def test_small_tables(spark):
    assert run(spark, [(1, None), (None, "")]) == plain([(1, None), (None, "")])
    assert tries.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_finds_every_link_of_a_cell():
    rng = np.random.default_rng(4)
    for _ in range(20):
        core = np.sort(rng.choice(60, 30, replace=False))
        sets = [np.sort(np.unique(np.concatenate([core[rng.random(30) < 0.93], rng.choice(80, 2)]))) for _ in range(25)]
        size = [len(s) + int(rng.integers(0, 3)) for s in sets]
        parent = list(range(25))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(25):
            for j in range(i):
                if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (size[i] + size[j]):
                    parent[top(i)] = top(j)
        want = [top(i) for i in range(25)]
        links = tries.joined(list(range(25)), size, sets, [True] * 25, [True] * 25)
        parent = list(range(25))
        for i, j in links:
            parent[top(i)] = top(j)
        got = [top(i) for i in range(25)]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_sets_have_the_sizes_of_the_shingles():
    texts = ["", None, "a b c d e f", "A b c d E F", "a b", "x y z x y z x y z x y z", " ".join(["r"] * 50)]
    found = list(tries.gram_sets(pa.array(texts, pa.string())))
    assert [len(g) for g in found] == [len(shingles(t)) for t in texts] and (found[2] == found[3]).all()
