"""Every row takes part in the steps that once read a sample, and the steps made cheaper give what plain loops give."""

import numpy as np

from estratia.llm import leaks, scoring

SMALL = "/root/testdata/sf0.001"


def test_every_document_fits_the_latent_space(spark, monkeypatch):
    docs = spark.range(9_000).selectExpr("id as doc_id", "concat('w', id, ' v', id % 7, ' u', id % 31) as text")
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "w1 w2 w3 w4 w5 w6 w7 w8")], "item_id long, text string")
    fitted, space = [], leaks.latent_space

    def watched(texts, weights, *rest):
        fitted.append(texts.count())
        return space(texts, weights, *rest)

    monkeypatch.setattr(leaks, "latent_space", watched)
    leaks.leaks(docs, bench).collect()
    assert fitted == [9_002]


def test_every_document_of_the_pipeline_fits_the_latent_space(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.range(6_000).selectExpr("id as doc_id", "concat('w', id, ' v', id % 7, ' u', id % 31) as text")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text is not null").count()
    fitted, space = [], leaks.latent_space

    def watched(texts, weights, *rest):
        fitted.append(texts.count())
        return space(texts, weights, *rest)

    monkeypatch.setattr(leaks, "latent_space", watched)
    assert corpus_pipeline.without_benchmark(spark, docs, SMALL).count() == 6_000
    assert fitted == [6_000 + items]


def test_products_are_those_of_all_passages(spark):
    rng = np.random.default_rng(4)
    sizes = [0, 1, 15, 16, 17, 32, 33, 48, 49, 700, 2_500, 31]
    words = [[f"w{int(x)}" for x in rng.integers(0, 60, n) ** 2 // 20] for n in sizes]
    texts = leaks.featured(spark.createDataFrame([(" ".join(x),) for x in words] + [(None,)], "text string").coalesce(1))
    weights, n = leaks.inverse_frequencies(texts)
    weights[leaks.FEATURES // 2 :] *= 3
    assert n == len(sizes) + 1
    basis = rng.standard_normal((leaks.FEATURES, 7)).astype(np.float32)
    want = np.zeros(basis.shape)
    for x in words:
        ids = leaks.hashed(leaks.pa.array(x, leaks.pa.string()))
        for s in range(0, max(1, len(ids) - leaks.WINDOW // 2), leaks.WINDOW // 2):
            features, counts = np.unique(ids[s : s + leaks.WINDOW], return_counts=True)
            row = weights[features].astype(float) * counts
            if (row > 0).any():
                row /= np.linalg.norm(row)
                want[features] += np.outer(row, row @ basis[features])
    got = leaks._summed(texts, leaks._product(basis, weights), basis.shape)
    assert np.allclose(got, want, atol=1e-3 * np.abs(want).max())
    assert np.allclose(leaks._summed(texts, leaks._square(basis, weights), (7, 7)), basis.T @ want, rtol=1e-3, atol=1e-2)


def plain_train(weights, context, target):
    """Stochastic gradient descent one group of words at a time."""
    weights = weights.copy()
    table, bias, out, base, group_out, group_base, word_out, word_base = scoring.unpacked(weights)
    rate, first = scoring.RATE / 256, scoring.CLASSES - 1

    def wrong(logits, want):
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(want)), want] -= 1
        return p

    for s in range(0, len(target), scoring.BATCH):
        at, want = context[s : s + scoring.BATCH] + scoring._SHIFT, target[s : s + scoring.BATCH]
        before = table[at].sum(axis=1) + bias
        hidden = np.maximum(before, 0)
        p = wrong(hidden @ out + base, np.minimum(want, first))
        back = p @ out.T
        others = np.flatnonzero(want >= first)
        if len(others):
            rest, held = want[others] - first, hidden[others]
            q = wrong(held @ group_out + group_base, rest // scoring.MEMBERS)
            more = q @ group_out.T
            group_out -= rate * 2 * held.T @ q
            group_base -= rate * 2 * q.sum(axis=0)
            for g in np.unique(rest // scoring.MEMBERS):
                k = rest // scoring.MEMBERS == g
                r = wrong(held[k] @ word_out[g] + word_base[g], rest[k] % scoring.MEMBERS)
                more[k] += r @ word_out[g].T
                word_out[g] -= rate * 8 * held[k].T @ r
                word_base[g] -= rate * 8 * r.sum(axis=0)
            back[others] += more
        back *= before > 0
        out -= rate * hidden.T @ p
        base -= rate * p.sum(axis=0)
        bias -= rate * back.sum(axis=0)
        np.subtract.at(table, at, rate * 8 * back[:, None])
    return weights


def test_training_step_is_that_of_plain_loops():
    rng = np.random.default_rng(6)
    start = scoring.start_weights(np.arange(scoring.PAD, 0, -1) ** 1.5)
    for n, words in ((1, 5), (700, 2304), (1_500, 90), (600, 62), (512, 2304)):
        ids = np.minimum(rng.integers(0, words, n) * rng.integers(1, 4, n), scoring.PAD - 1)
        around = rng.integers(0, scoring.PAD + 1, (n, 4)) // rng.integers(1, 200, (n, 1))
        want = plain_train(start, around, ids)
        assert np.abs(scoring.train(start, around, ids) - want).max() < 1e-4 < np.abs(want - start).max() * 10
        # Logits beyond the range of single exponentials
        far = start * 400
        got = scoring.word_log_probabilities(far, around, ids)
        assert np.isfinite(got).all() and np.isfinite(scoring.train(far, around, ids)).all()
    assert (scoring.train(start, around[:0], ids[:0]) == start).all()


def test_tokens_are_split_alike_and_once(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(chr(c) for c in rng.integers(0, top, 60) if not 0xD800 <= c < 0xE000) for top in (128, 0x250, 0x3000, 0x110000) for _ in range(150)]
    texts += ["", None, "ΑΣ Σ", "İx_y__ ½²\t  \x85\x1c„a“", "\n", "日本\U0001d4b3!"] + ["one, two"] * 3
    words, codes, sizes = scoring.split(scoring.pa.array(texts))
    want = [scoring.tokens(t) for t in texts]
    assert [words[int(c)].as_py() for c in codes] == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = scoring.vocabulary(docs)
    row = scoring.score(docs.where("doc_id >= 600")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in row} == {i: len(x) for i, x in enumerate(want) if i >= 600}
    ids, shares = known.of(words)
    assert all((i, x) == tuple(float(y[0]) for y in known.read([w], {})) for w, i, x in zip(words.to_pylist(), ids, shares))
    counts = np.bincount(known.read([w for x in want for w in x], {})[0], minlength=scoring.PAD)
    assert np.allclose(known.counts - 0.5, counts[: scoring.PAD], atol=0.5 * scoring.BUCKETS / scoring.RARE)


def test_scores_are_sums_over_the_positions(spark, monkeypatch):
    texts = ["a b, c a b", None, "", "b " * 700 + "rare1 rare2", "c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b")], "doc_id long, text string").coalesce(1)
    words = scoring.vocabulary(docs)
    weights = scoring.fit(docs, words)
    monkeypatch.setattr(scoring, "fitted", lambda rows, words: weights)
    got = {r["doc_id"]: r["log_likelihood"] for r in scoring.score(docs).collect()}
    for i, t in [*enumerate(texts), (None, "a b")]:
        ids, shares = words.read(scoring.tokens(t), {})
        each = scoring.word_log_probabilities(weights, scoring.contexts(ids, np.arange(len(ids))), ids) if len(ids) else np.zeros(0)
        assert abs(got[i] - each.astype(float).sum() - shares.sum()) < 1e-3


def test_chunks_do_not_depend_on_how_texts_are_taken_together(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in rng.integers(0, 40, 60)]
    batch = scoring.pa.record_batch({"text": scoring.pa.array(texts), "doc_id": scoring.pa.array(range(60))})
    known = scoring.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    monkeypatch.setattr(scoring, "GROUP", 100)
    whole = [scoring.PAD, scoring.PAD]
    for t in texts:
        ids = known.read(scoring.tokens(t), {})[0].tolist()
        whole += [*ids, scoring.PAD, scoring.PAD] if ids else []
    want = [whole[i : i + 104] for i in range(0, len(whole) - 4, 100)]
    for taken in (1, 7, 512):
        monkeypatch.setattr(scoring, "TEXTS", taken)
        got = [np.frombuffer(r["rows"][0].as_py(), np.int16).tolist() for r in scoring._examples(known)(iter([batch]))]
        assert got == want
        rows = [(np.frombuffer(r["rows"][0].as_py(), np.int16), r["last"][0].as_py()) for r in scoring._examples(known, True)(iter([batch, batch]))]
        assert [c.tolist() for c in scoring._chunks(iter(rows))] == want * 2
