"""Motif scans and factor assignment.

Motifs are motif(motif_id, tf_names, pwm): log-odds rows of A, C, G, T. Scans score whole sequences with arrays;
all else is joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import root_name


def log_odds(counts: Column, pseudocount: float = 0.01) -> Column:
    """log2((c + pc) / (N + 4 pc) / 0.25) of each row of counts."""

    def row(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
        return F.transform(r, lambda x: F.log2((x + pseudocount) / (total + 4 * pseudocount) / 0.25))

    return F.transform(counts, row)


def information(counts: Column) -> Column:
    """Sum over rows of 2 + sum(p log2 p)."""

    def row(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
        return F.aggregate(r, F.lit(2.0), lambda a, x: a + F.when(x > 0, x / total * F.log2(F.when(x > 0, x / total))).otherwise(0.0))

    return F.aggregate(counts, F.lit(0.0), lambda a, r: a + row(r))


def codes(seq: str | None) -> np.ndarray:
    """0 to 3 for A, C, G, T of either case, 4 for all other letters."""
    code = np.full(256, 4)
    for k, letter in enumerate("ACGT"):
        code[[ord(letter), ord(letter.lower())]] = k
    return code[np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8)]


def best_window(s: np.ndarray, pwm: np.ndarray) -> tuple[float, float, float, float] | None:
    """Best score, mean, deviation and Gumbel p of all windows of a coded sequence, by one array sum a motif row whose fifth value is nan; None without windows that differ."""
    n = len(s) - len(pwm) + 1
    if n < 1:
        return None
    w = sum(pwm[j][s[j : j + n]] for j in range(len(pwm)))
    w = w[~np.isnan(w)]
    sd = w.std() if len(w) else 0.0
    if sd <= 1e-9:
        return None
    beta = sd * 6**0.5 / np.pi
    p = min(max(1 - np.exp(-np.exp(-(w.max() - w.mean() + 0.5772156649015329 * beta) / beta)), 0.0), 1.0)
    return float(w.max()), float(w.mean()), float(sd), float(p)


def _scan(motifs: list[tuple[str, np.ndarray]], threshold: float):
    """mapInArrow function: (peak_id, seq) to hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for peak, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = codes(seq)
                for name, pwm in motifs:
                    tail = best_window(s, pwm)
                    if tail is not None and tail[3] < threshold:
                        out.append((peak, name, *tail))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.string(), *[pa.float64()] * 4))], ["peak_id", "motif_id", "best", "mean", "sd", "p_value"])

    return run


def scan(sequences: DataFrame, motifs: DataFrame, threshold: float) -> DataFrame:
    """Motif hits of sequences(peak_id, seq): best window score and its Gumbel p below the threshold.

    Windows with a letter other than A, C, G, T do not count; a sequence without a whole window has no row. The motif
    library is small (thousands of short matrices) and held by every task.
    """
    library = [(r["motif_id"], np.array([[*row, np.nan] for row in r["pwm"]])) for r in motifs.select("motif_id", "pwm").orderBy("motif_id").collect()]
    return sequences.select("peak_id", "seq").mapInArrow(_scan(library, threshold), "peak_id long, motif_id string, best double, mean double, sd double, p_value double")


def assign_factors(hits: DataFrame, motifs: DataFrame, most: int = 5) -> DataFrame:
    """The `most` factors of least p of each peak; a motif names several factors by ::, equal p keep motif and factor order."""
    named = motifs.select("motif_id", F.posexplode(F.split("tf_names", "::")).alias("_o", "tf"))
    best = hits.join(F.broadcast(named), "motif_id").groupBy("peak_id", "tf").agg(F.min(F.struct(F.col("p_value"), F.col("motif_id"), F.col("_o"))).alias("b"))
    order = Window.partitionBy("peak_id").orderBy("b")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("peak_id", "tf", F.col("b.p_value").alias("p_value"), "rank")


def best_motifs(motifs: DataFrame) -> DataFrame:
    """One motif of each factor: the most informative, curated ones 10 ahead, the first on ties."""
    score = F.col("information") + F.when(F.col("curated"), 10.0).otherwise(0.0)
    order = Window.partitionBy("tf").orderBy(F.desc(F.round(score, 9)), "motif_id")
    return motifs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def borrow_family(assigned: DataFrame, families: DataFrame, target: DataFrame) -> DataFrame:
    """Peaks of a target factor's family members that lack the target itself: (peak_id, tf)."""
    member = families.join(target.join(families, "tf").select("family", F.col("tf").alias("target")), "family").where("tf <> target")
    seen = assigned.join(member.select("tf", "target"), "tf").select("peak_id", F.col("target").alias("tf")).distinct()
    return seen.join(assigned.select("peak_id", "tf"), ["peak_id", "tf"], "left_anti")


def families(factors: DataFrame) -> DataFrame:
    """Families of factors(tf) by root name."""
    return factors.select("tf", root_name(F.col("tf")).alias("family"))


def present_factors(assigned: DataFrame, expressed: DataFrame) -> DataFrame:
    """Assignments of factors among expressed(symbol), whatever the case."""
    return assigned.join(expressed.select(F.upper("symbol").alias("_u")).distinct(), F.upper(assigned["tf"]) == F.col("_u"), "left_semi")


def fallback_factors(links: DataFrame, factors: DataFrame, most: int = 5) -> DataFrame:
    """Linked genes of each peak that are factors, the first `most` by name."""
    order = Window.partitionBy("peak_id").orderBy("gene")
    return links.select("peak_id", "gene").distinct().join(factors.select(F.col("tf").alias("gene")), "gene", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("peak_id", F.col("gene").alias("tf"), "rank")
