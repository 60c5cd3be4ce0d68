"""What runs inside Python tasks of a multilevel fit: numpy on the school rows of one partition.

Task functions travel to the executors by value, so these need no installed copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 32_768


def dense(part: pd.DataFrame, n_columns: int, slope: bool, scale: float):
    """Schools of a batch as dense sums by column, own weights and own responses."""
    sizes = part["j"].map(len).to_numpy()
    at = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["j"].to_numpy()).astype(int)
    a = np.zeros((len(part), n_columns))
    a[at] = np.concatenate(part["a"].to_numpy()) * scale
    d, r = part["d"].to_numpy() * scale, part["r"].to_numpy() * scale
    if not slope:
        return [a], [d], [r]
    b = np.zeros_like(a)
    b[at] = np.concatenate(part["b"].to_numpy()) * scale
    return [a, b], [d, part["d1"].to_numpy() * scale], [r, part["r1"].to_numpy() * scale]


def own_inverse(d: list, ratios: np.ndarray):
    """Inverse of each school's own block (upper part) and the log of its determinant."""
    if len(d) == 1:
        own = d[0] + ratios[0]
        return {(0, 0): 1 / own}, np.log(own)
    d0, d1 = d
    det = (d0 + ratios[0]) * (d1 + ratios[1]) - d1 * d1
    return {(0, 0): (d1 + ratios[1]) / det, (1, 1): (d0 + ratios[0]) / det, (0, 1): -d1 / det}, np.log(det)


def absorb(n_columns: int, slope: bool, nodes: Mapping[int, np.ndarray], scales: Mapping[int, float]):
    """Adds up the absorbed sums of a partition's schools at every node of their edition.

    A sum is one vector: the upper triangle of the cross-products, then the response sums, the
    squared response and the log determinant. It leaves in chunks, so that the next step can add
    the chunks of many partitions apart from one another.
    """
    upper = np.triu_indices(n_columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            for year, part in batch.groupby("year"):
                if year not in nodes:
                    continue
                if year not in totals:
                    k = len(nodes[year])
                    totals[year] = np.zeros((k, n_columns, n_columns)), np.zeros((k, n_columns + 2))
                big, small = totals[year]
                a, d, r = dense(part, n_columns, slope, scales[year])
                for i, x in enumerate(nodes[year]):
                    h, log_det = own_inverse(d, np.exp(x))
                    for (e, f), weight in h.items():
                        cross = (a[e] * weight[:, None]).T @ a[f]
                        big[i] += cross
                        small[i, :n_columns] += a[e].T @ (weight * r[f])
                        small[i, n_columns] += np.sum(r[e] * weight * r[f])
                        if e != f:
                            big[i] += cross.T
                            small[i, :n_columns] += a[f].T @ (weight * r[e])
                            small[i, n_columns] += np.sum(r[e] * weight * r[f])
                    small[i, n_columns + 1] += log_det.sum()
        for year, (big, small) in totals.items():
            rows: list = []
            for i in range(len(big)):
                vector = np.concatenate([big[i][upper], small[i]])
                for c in range(0, len(vector), CHUNK):
                    rows.append((year, i, c // CHUNK, vector[c : c + CHUNK].tobytes()))
            yield pd.DataFrame(rows, columns=["year", "node", "chunk", "payload"])

    return run


def add_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(p) for p in pdf["payload"]], axis=0)
    first = pdf[["year", "node", "chunk"]].iloc[:1]
    return first.assign(payload=[total.tobytes()])


def solve_schools(shared, n_columns: int, slope: bool):
    """Mean and sd of each school's own effects, given the solution of the model's columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for year, part in batch.groupby("year"):
                if year not in shared.value:
                    continue
                theta, inverse, ratios, s2, scale, combos = shared.value[year]
                a, d, r = dense(part, n_columns, slope, scale)
                upper, _ = own_inverse(d, ratios)
                m = len(a)
                h = {(e, g): upper[min(e, g), max(e, g)] for e in range(m) for g in range(m)}
                left = [r[e] - a[e] @ theta for e in range(m)]
                out = {"year": part["year"].to_numpy(), "global_school_id": part["global_school_id"].to_numpy()}
                for name in ("slope", "total"):
                    out[f"{name}_mean"], out[f"{name}_sd"] = np.full(len(part), np.nan), np.full(len(part), np.nan)
                for k, name in enumerate(("effect", "slope")[:m]):
                    load = sum(h[k, e][:, None] * a[e] for e in range(m))
                    spread = h[k, k] + np.einsum("si,si->s", load @ inverse, load)
                    out[f"{name}_mean"] = sum(h[k, e] * left[e] for e in range(m))
                    out[f"{name}_sd"] = np.sqrt(s2 * spread)
                # Own slope and fixed terms move together: the own part given the terms is -load @ terms
                kinds = part["kind"].to_numpy()
                for level, combo in combos.items():
                    at = kinds == level
                    joint = combo - load[at]
                    out["total_mean"][at] = out["slope_mean"][at] + combo @ theta
                    out["total_sd"][at] = np.sqrt(s2 * (h[1, 1][at] + np.einsum("si,si->s", joint @ inverse, joint)))
                yield pd.DataFrame(out)

    return run


def absorbed_product(solved: Mapping[int, tuple], n_columns: int, slope: bool):
    """Sum over the partition's schools of their absorbed cross-products times given columns, by pairs of fixed terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for year, part in batch.groupby("year"):
                if year not in solved:
                    continue
                columns, ratios, scale, fixed, _ = solved[year]
                a, d, _ = dense(part, n_columns, slope, scale)
                upper, _ = own_inverse(d, ratios)
                m = range(len(a))
                for e in m:
                    for g in m:
                        weight = upper[min(e, g), max(e, g)]
                        add = (a[e][:, fixed] * weight[:, None]).T @ (a[g] @ columns)
                        totals[year] = totals[year] + add if year in totals else add
        for year, total in totals.items():
            terms = solved[year][-1]
            i, k = np.indices(total.shape)
            names = np.array(terms, dtype=object)
            yield pd.DataFrame({"year": year, "term_i": names[i.ravel()], "term_j": names[k.ravel()], "value": total.ravel()})

    return run


def draw_components(parts: Mapping[int, tuple], n_draws: int, block: int, seed: list, domains: tuple):
    """Normal draws around each edition's mode, turned into variances and covariances."""
    years, size = sorted(parts), len(domains)
    lower = [(i, j) for i in range(size) for j in range(i + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit in batch["id"]:
                year, first = years[unit % len(years)], int(unit // len(years)) * block
                t, root, m, regions = parts[year]
                rng = np.random.default_rng([*seed, year, first])
                n = min(block, n_draws - first)
                z = t + rng.standard_normal((n, len(t))) @ root.T
                chol = z[:, 1 + m + (1 if regions else 0) :]
                low = np.zeros((n, size, size))
                for k, (i, j) in enumerate(lower):
                    low[:, i, j] = np.exp(chol[:, k]) if i == j else chol[:, k]
                omega = low @ low.transpose(0, 2, 1)
                out = {"year": year, "draw": np.arange(first, first + n)}
                out.update({d: omega[:, i, i] for i, d in enumerate(domains)})
                for i in range(size):
                    for j in range(i + 1, size):
                        out[f"cov_{domains[i]}_{domains[j]}"] = omega[:, i, j]
                out["school"] = np.exp(2 * z[:, 1])
                out["region"] = np.exp(2 * z[:, 1 + m]) if regions else np.full(n, np.nan)
                out["residual"] = np.exp(2 * z[:, 0])
                yield pd.DataFrame(out)

    return run
