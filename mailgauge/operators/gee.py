"""Logistic GEE with exchangeable correlation over clusters of categorical rows.

Spark reduces the clusters to patterns (covariates and outcomes of a whole cluster, sorted)
with counts: one shuffle, whatever the number of observations. With few patterns the driver
solves the estimating equations in numpy; above ``LOCAL_PATTERNS`` each iteration sums them
in the executors and only p x p sums travel.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.functions.stats import adjusted
from mailgauge.operators.clean import FACTORS
from mailgauge.session import saved

LOCAL_PATTERNS = 50_000
Z95 = 1.959963984540054
# The level other levels are compared with.
REFERENCES = {"model": "Llama", "prompt": "evidence", "parser": "P1", "year_num": "2023", "dataset_clean": "nazario", "obfuscation_clean": "no"}
SHORT = {"year_num": "year", "dataset_clean": "dataset", "obfuscation_clean": "obfuscation"}
COMBINED = (("model", "prompt"), ("model", "parser"), ("prompt", "parser"), ("parser", "obfuscation_clean"), ("parser", "dataset_clean"), ("year_num", "dataset_clean"), ("prompt", "year_num"))


def specifications() -> dict[str, list[tuple[str, ...]]]:
    """Main effects; each single interaction; seven of them together. A term is a tuple of factors."""
    main = [(f,) for f in FACTORS]
    out = {"main_effects": main}
    for a, b in combinations(FACTORS, 2):
        out[f"screen_{SHORT.get(a, a)}_X_{SHORT.get(b, b)}"] = [*main, (a, b)]
    out["combined_key_interactions"] = [*main, *COMBINED]
    return out


@dataclass
class Design:
    """Treatment-coded columns of a model; levels are strings."""

    terms: list[tuple[str, ...]]
    levels: dict[str, list[str]]
    names: list[str] = field(default_factory=list)
    columns: list[tuple[tuple[str, str], ...]] = field(default_factory=list)

    def __post_init__(self):
        self.names, self.columns = ["Intercept"], [()]
        for term in self.terms:
            parts = [[]]
            for f in reversed(term):  # the first factor varies fastest
                parts = [[(f, v), *p] for p in parts for v in self.levels[f] if v != self.reference(f)]
            for p in parts:
                self.columns.append(tuple(p))
                self.names.append(":".join(f"{self.label(f)}[T.{v}]" for f, v in p))

    def reference(self, f: str) -> str:
        return REFERENCES[f] if REFERENCES.get(f) in self.levels[f] else self.levels[f][0]

    def label(self, f: str) -> str:
        ref = REFERENCES.get(f)
        return f"C({f}, Treatment(reference={ref if f == 'year_num' else repr(ref)}))" if ref in self.levels[f] else f"C({f})"

    @property
    def formula(self) -> str:
        return "detected ~ " + " + ".join(":".join(self.label(f) for f in t) for t in self.terms)

    def matrix(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        """Rows of levels in the order of FACTORS."""
        at = {f: i for i, f in enumerate(FACTORS)}
        return np.array([[float(all(r[at[f]] == v for f, v in c)) for c in self.columns] for r in rows]).reshape(len(rows), len(self.columns))


def cluster_patterns(df: DataFrame, outcome: str = "detected_end_to_end", cluster: str = "base_email_id") -> DataFrame:
    """(pattern, n): clusters with equal sorted rows (levels and outcome), counted."""
    row = F.struct(*(F.col(f).cast("string").alias(f) for f in FACTORS), F.col(outcome).cast("int").alias("y"))
    own = df.groupBy(cluster).agg(F.sort_array(F.collect_list(row)).alias("pattern"))  # one row per cell of the design
    return own.groupBy("pattern").agg(F.count("*").alias("n"))


#: Clusters that are summed at once.
BLOCK = 4_096


class Clusters:
    """Patterns as design rows: of each cluster size the rows' numbers in a table of distinct design rows, outcomes and counts."""

    def __init__(self, patterns, design: Design):
        cells: dict[tuple, int] = {}
        sizes: dict[int, tuple[list, list, list]] = {}
        for pattern, n in patterns:
            at, y, counts = sizes.setdefault(len(pattern), ([], [], []))
            at.append([cells.setdefault(tuple(r[:-1]), len(cells)) for r in pattern])
            y.append([r[-1] for r in pattern])
            counts.append(n)
        self.table = design.matrix(list(cells))
        self.blocks = [tuple(np.array(v[k : k + BLOCK]) for v in own) for own in sizes.values() for k in range(0, len(own[0]), BLOCK)]

    def __iter__(self):
        for at, y, n in self.blocks:
            yield self.table[at], y.astype(float), n.astype(float)


def _sums(clusters, beta: np.ndarray, alpha: float) -> dict[str, np.ndarray | float]:
    """Sums over clusters: score, bread, meat, independence information, residual products, quasi-likelihood."""
    p = len(beta)
    out = {"score": np.zeros(p), "bread": np.zeros((p, p)), "meat": np.zeros((p, p)), "naive": np.zeros((p, p)), "squares": 0.0, "pairs": 0.0, "rows": 0.0, "n_pairs": 0.0, "clusters": 0.0, "quasi": 0.0}
    for x, y, n in clusters:  # clusters x rows x columns, clusters x rows, clusters
        m = y.shape[1]
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        sd = np.sqrt(mu * (1 - mu))
        r = (y - mu) / sd
        d = x * sd[:, :, None]  # D = A X, standardised by A^-1/2
        shrink = alpha / (1 + (m - 1) * alpha)
        inverse = lambda v: (v - shrink * v.sum(axis=1, keepdims=True)) / (1 - alpha)  # noqa: E731, B023
        u = np.einsum("kmp,km->kp", d, inverse(r))
        flat, weighted = d.reshape(-1, p), (d * n[:, None, None]).reshape(-1, p)
        squares = (r * r).sum(axis=1)
        out["score"] += n @ u
        out["bread"] += weighted.T @ inverse(d).reshape(-1, p)
        out["meat"] += (u * n[:, None]).T @ u
        out["naive"] += weighted.T @ flat
        out["squares"] += float(n @ squares)
        out["pairs"] += float(n @ (r.sum(axis=1) ** 2 - squares)) / 2
        out["rows"] += float(n.sum()) * m
        out["n_pairs"] += float(n.sum()) * m * (m - 1) / 2
        out["clusters"] += float(n.sum())
        out["quasi"] += float(n @ (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum(axis=1))
    return out


class LocalClusters:
    def __init__(self, patterns, design: Design):
        self.clusters = Clusters(patterns, design)

    def sums(self, beta, alpha):
        return _sums(self.clusters, beta, alpha)


class SparkClusters:
    """The same sums, per batch in the executors."""

    def __init__(self, patterns: DataFrame, design: Design):
        self.patterns, self.design = patterns, design

    def sums(self, beta, alpha):
        design = self.design

        def run(batches):
            import pandas as pd

            for batch in batches:
                own = Clusters([([tuple(r.values()) for r in p], n) for p, n in zip(batch["pattern"], batch["n"], strict=True)], design)
                flat = np.concatenate([np.ravel(v) for v in _sums(own, beta, alpha).values()])
                yield pd.DataFrame({"at": range(len(flat)), "v": flat})

        total = {r["at"]: r["v"] for r in self.patterns.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
        out, at = {}, 0
        for k, v in _sums([], beta, alpha).items():
            size = np.size(v)
            part = np.array([total.get(at + i, 0.0) for i in range(size)])
            out[k], at = (part.reshape(np.shape(v)) if np.ndim(v) else float(part[0])), at + size
        return out


def _alpha(s, p: int) -> float:
    scale = s["squares"] / max(s["rows"] - p, 1)
    return s["pairs"] / scale / (s["n_pairs"] - p) if s["n_pairs"] > p else 0.0


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    robust: np.ndarray
    alpha: float
    converged: bool
    n_rows: int
    n_clusters: int
    qic: float
    qicu: float


def fit(clusters, names: list[str], most: int = 300, tolerance: float = 1e-8, exchangeable: bool = True) -> Fit:
    p, alpha, converged = len(names), 0.0, False
    beta = np.zeros(p)
    for _ in range(most):
        s = clusters.sums(beta, alpha)
        step = np.linalg.solve(s["bread"], s["score"])
        beta = beta + step
        now = _alpha(clusters.sums(beta, 0.0), p) if exchangeable else 0.0
        converged = np.abs(step).max() < tolerance and abs(now - alpha) < tolerance
        alpha = now
        if converged:
            break
    s = clusters.sums(beta, alpha)
    bread = np.linalg.inv(s["bread"])
    robust = bread @ s["meat"] @ bread
    trace = float(np.trace(s["naive"] @ robust))
    return Fit(names, beta, robust, alpha, converged, int(s["rows"]), int(s["clusters"]), -2 * s["quasi"] + 2 * trace, -2 * s["quasi"] + 2 * p)


def run_models(df: DataFrame, outcome: str = "detected_end_to_end", specs: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Coefficients (with corrections per model) and one metadata row per model; a failed fit has its error there."""
    spark: SparkSession = df.sparkSession
    patterns = saved(cluster_patterns(df, outcome), "gee-patterns")
    levels = {f: sorted(r[0] for r in df.select(F.col(f).cast("string")).distinct().collect()) for f in FACTORS}  # a few each
    few = patterns.count() <= LOCAL_PATTERNS
    local = [([tuple(r) for r in row["pattern"]], row["n"]) for row in patterns.collect()] if few else None
    coefficients, metadata = [], []
    for name, terms in (specs or specifications()).items():
        design = Design(terms, levels)
        try:
            result = fit(LocalClusters(local, design) if few else SparkClusters(patterns, design), design.names)
        except np.linalg.LinAlgError as e:
            metadata.append((name, design.formula, False, None, None, None, None, str(e)))
            continue
        metadata.append((name, design.formula, result.converged, result.n_rows, result.n_clusters, result.qic, result.qicu, None))
        for term, b, se in zip(result.names, result.beta.tolist(), np.sqrt(np.diag(result.robust)).tolist(), strict=True):
            z = b / se if se else float("inf")
            low, high = b - Z95 * se, b + Z95 * se
            coefficients.append((name, design.formula, term, b, se, z, math.erfc(abs(z) / math.sqrt(2)), math.exp(b), low, high, math.exp(low), math.exp(high)))
    table = spark.createDataFrame(
        coefficients,
        "model_specification string, formula string, term string, coefficient_log_odds double, standard_error double, z_statistic double, p_value double, odds_ratio double, ci_low_log_odds double, ci_high_log_odds double, ci_low_or double, ci_high_or double",
    )
    meta = spark.createDataFrame(metadata, "model_specification string, formula string, converged boolean, n_rows long, n_clusters long, qic double, qicu double, error string")
    return adjusted(table, ["model_specification"]), meta


def formulas_json(levels: dict[str, list[str]]) -> str:
    return json.dumps({name: Design(terms, levels).formula for name, terms in specifications().items()}, indent=2)


def notable_interactions(coefficients: DataFrame, alpha: float = 0.05) -> DataFrame:
    small = F.least("p_value", "p_holm", "p_fdr_bh") < alpha
    return coefficients.where(F.col("term").contains(":") & small)
