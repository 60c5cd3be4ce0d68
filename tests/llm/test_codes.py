"""Ball k-means codes against a full search, on small odd rows."""

import math

import numpy as np
import pytest

from estratia.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, error string, ints int, members int"


def full(points, entries):
    d = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_rings_equal_a_full_search():
    rng = np.random.default_rng(2)
    for n, k, width, wide in ((400, 16, 2, 6), (300, 16, 4, 40), (50, 3, 1, 3), (5, 1, 2, 9), (200, 16, 1, 2)):
        entries = rng.integers(-wide, wide + 1, (k, width))
        points = rng.integers(-wide, wide + 1, (n, width))
        for held in (np.zeros(n, np.int64), rng.integers(0, k, n), full(points, entries)[0]):
            best, least = codes.nearest(points, entries, held)
            want = full(points, entries)
            assert (best == want[0]).all() and (least == want[1]).all()


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    books = points[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        found = [full(points[:, p], books[p]) for p in range(parts)]
        if step < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = points[found[p][0] == e, p]
                    if len(own):
                        books[p, e] = own.sum(axis=0) // len(own)
    code = np.array([f[0] for f in found]).T
    error = np.array([f[1] for f in found]).sum(axis=0)
    of = {}
    for (_, _, lab), e in zip(kept, error):
        of[lab] = of.get(lab, 0) + int(e)
    return sorted(((i, tuple(c), int(e), of[lab]) for (i, _, lab), c, e in zip(kept, code.tolist(), error)), key=str), books


@pytest.mark.parametrize("n", [3, 16, 700])
def test_equals_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(5, 16))
    rows = [(int(i), [float(x) for x in centre[i % 5] + 0.3 * rng.normal(size=16)], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (None, None, None), (900, None, 1), (901, [math.nan] * 16, 1), (902, [None] + [0.0] * 15, 1), (903, [math.inf] * 16, 2)]
    frame = spark.createDataFrame([(i, v, lab, "x", "y", 1, 2) for i, v, lab in rows], SCHEMA).repartition(4)
    out, books = codes.compress(frame)
    want, want_books = plain(rows)
    assert sorted(((r["vec_id"], tuple(r["codes"]), r["error"], r["label_error"]) for r in out.collect()), key=str) == want
    assert (books == want_books).all()
    back = codes.decoded(out, books).collect()
    assert len(back) == len(want) and all(len(r["vector"]) == 16 for r in back)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codes.compress(none)[0].count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1, "", "", 1, 1), (2, [], 1, "", "", 1, 1)], SCHEMA))[0].count() == 0
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1, "", "", 1, 1), (2, [1.0] * 16, 1, "", "", 1, 1)], SCHEMA))
