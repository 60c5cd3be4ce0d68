"""Importance resampling against a plain recomputation with zlib, on small odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from estratia.llm import importance, spans

SCHEMA = "doc_id long, text string, carried string, at_ int, position int, part_ string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def runs_of(text):
    words = WORD.findall(lowered(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target, buckets=10_000, share=25, min_words=20, seed=7):
    """(doc_id, n_features, weight, score, rank) of each row, by loops."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs_of(t)[1])
    t = Counter(bucket(f) for x in target for f in runs_of(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for doc, text in docs:
        words, found = runs_of(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None, len(words)])
    eligible = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(eligible[: share * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_span_digests_are_crc32():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5_000, dtype=np.uint8)
    start = rng.integers(0, 4_000, 400)
    end = start + np.concatenate([rng.integers(1, 70, 200), rng.integers(60, 1_000, 196), [63, 64, 65, 128]])
    got = importance.crc32_spans(data, start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert len(importance.crc32_spans(data, start[:0], end[:0])) == 0


def test_words_are_those_of_the_pattern():
    texts = ["", None, "One two,three", "é  Ünder_score x1 y", "  ", "a" * 5_000, "x\x00y\x7fz"]
    for table, pattern in ((spans.ALNUM, WORD), (spans.BLANKS, re.compile(r"[^\x20\x09-\x0D]+"))):
        words = spans.cut_words(pa.array(texts, pa.string()), table)
        got = [[] for _ in texts]
        for a, b, t in zip(words.start, words.end, words.text):
            got[t].append(words.data[a:b].tobytes().decode())
        assert got == [pattern.findall(lowered(t)) for t in texts]
    assert len(spans.cut_words(pa.array([], pa.string()), spans.ALNUM).start) == 0


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    word = [f"W{i}" for i in range(300)] + ["É", "naïve", "x" * 200]
    some = [" ".join(rng.choice(word, int(n))) for n in rng.integers(1, 80, 150)]
    return some + ["", None, "  ", "one", some[0], some[0], " ".join(rng.choice(word, 20_000)), "y" * 100_000 + " end" * 30]


def test_equals_plain_recomputation(spark, texts):
    docs = list(enumerate(texts)) + [(None, texts[0]), (None, texts[0]), (None, texts[1]), (3, texts[9]), (3, texts[9])]
    target = [" ".join(f"w{i}" for i in range(0, 300, 3)), None, "", "É w1 W2"]
    frame = spark.createDataFrame([(i, t, "c", 1, 2, "p") for i, t in docs], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(frame, goal, carry=["text", "at_", "carried"])
    rows = out.collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows), key=str) == plain(docs, target)
    assert all(r["carried"]["at_"] == 1 and r["carried"]["carried"] == "c" for r in rows)
    assert sorted((r["carried"]["text"] for r in rows), key=str) == sorted((t for _, t in docs), key=str)
    assert sum(r["rank"] is not None for r in rows) == 25 * sum(len(runs_of(t)[0]) >= 20 for _, t in docs) // 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b", "c", 1, 2, "p"), (2, None, None, None, None, None)], SCHEMA)
    assert importance.resample(none, some).count() == 0
    assert sorted(r["n_features"] for r in importance.resample(some, none).collect()) == [0, 3]
