"""Peaks that gain a target factor from its family: by members found there already, and by scans with the matrices of all members.

Only targets are added, never all members, so that large families do not multiply links. A scan's evidence is kept by (peak, sequence, family, library): it says
which factors all matrices that passed name, so one record answers for every target of the family, and neither hits nor misses are scanned for again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import motif

EVIDENCE = "peak_id long, seq_sha string, family string, library string, passed int, named array<string>"


def named_factors(motifs: DataFrame) -> DataFrame:
    """(motif_id, tf, family) of motifs whose tf_names join several factors by ::; names in upper case, nulls and empty names left out."""
    tf = motifs.select("motif_id", F.explode(F.split("tf_names", "::")).alias("tf")).select("motif_id", F.upper(F.trim("tf")).alias("tf")).where("tf <> ''")
    return tf.distinct().join(motif.families(tf.select("tf").distinct()), "tf").select("motif_id", "tf", "family")


def _library(motifs: DataFrame, targets: DataFrame, threshold: float, shortest: int) -> tuple[list[np.ndarray], list[tuple[str, str, list[tuple[int, frozenset[str]]]]]]:
    """All matrices of the targets' families, and for each family its digest and its members: the matrix's place and the family's factors that it names."""
    named = named_factors(motifs)
    wanted = named.join(targets.select(F.upper("tf").alias("tf")).distinct(), "tf", "left_semi").select("family").distinct()
    own = named.join(wanted, "family", "left_semi").groupBy("family", "motif_id").agg(F.sort_array(F.collect_set("tf")).alias("tfs"))
    rows = own.join(motifs.select("motif_id", "pwm").where(F.size("pwm") >= shortest), "motif_id").orderBy("family", "motif_id").collect()
    place: dict[str, int] = {}
    matrices: list[np.ndarray] = []
    members: dict[str, list] = {}
    for r in rows:
        if r["motif_id"] not in place:
            place[r["motif_id"]] = len(matrices)
            matrices.append(np.array([[*row, np.nan] for row in r["pwm"]]))
        members.setdefault(r["family"], []).append((r["motif_id"], list(r["tfs"]), [list(row) for row in r["pwm"]]))
    families = [(f, hashlib.sha256(json.dumps([threshold, m]).encode()).hexdigest(), [(place[i], frozenset(tfs)) for i, tfs, _ in m]) for f, m in members.items()]
    return matrices, families


def _scan(matrices: list[np.ndarray], families: list, threshold: float):
    """mapInArrow function: (peak_id, seq_sha, seq, done) to evidence, each matrix scored once a sequence at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for peak, sha, seq, done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                letters = motif.codes(seq)
                passes: dict[int, bool] = {}
                for family, digest, members in families:
                    if done and digest in done:
                        continue
                    hits, named = 0, None
                    for at, tfs in members:
                        if at not in passes:
                            tail = motif.best_window(letters, matrices[at])
                            passes[at] = tail is not None and tail[3] < threshold
                        if passes[at]:
                            hits, named = hits + 1, tfs if named is None else named & tfs
                            # no target of the family can be ruled out any more
                            if not named:
                                break
                    out.append((peak, sha, family, digest, hits, None if named is None else sorted(named)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["peak_id", "seq_sha", "family", "library", "passed", "named"])

    return run


def scan_families(sequences: DataFrame, motifs: DataFrame, targets: DataFrame, threshold: float = 1e-4, shortest: int = 5, known: DataFrame | None = None) -> DataFrame:
    """Evidence of sequences(peak_id, seq) for the families of targets(tf): a row for each sequence and family that `known` evidence does not hold.

    Members are all motifs(motif_id, tf_names, pwm) of `shortest` rows or more that name a factor of the family. named: the family's factors that every matrix
    that passed names, null where none did; a family's scan of a sequence ends as soon as it is empty. Null sequences are no evidence and give no row; others may
    be empty, masked or of any length. `known` of other sequences, matrices or thresholds does not count. The library of all families is small and held by every task.
    """
    matrices, families = _library(motifs, targets, threshold, shortest)
    spark = sequences.sparkSession
    if not families:
        return spark.createDataFrame([], EVIDENCE)
    todo = sequences.where("seq is not null").select("peak_id", F.sha2("seq", 256).alias("seq_sha"), "seq")
    if known is None:
        todo = todo.withColumn("done", F.array().cast("array<string>"))
    else:
        held = known.where(F.col("library").isin([d for _, d, _ in families])).groupBy("peak_id", "seq_sha").agg(F.collect_set("library").alias("done"))
        todo = todo.join(held, ["peak_id", "seq_sha"], "left").where((F.size("done") < len(families)) | F.col("done").isNull())
    return todo.select("peak_id", "seq_sha", "seq", "done").mapInArrow(_scan(matrices, families, threshold), EVIDENCE)


def family_additions(assigned: DataFrame, evidence: DataFrame, motifs: DataFrame, targets: DataFrame) -> DataFrame:
    """(peak_id, tf, way) of targets(tf) that assigned(peak_id, tf) lacks at a peak: `passive` where a member of the family is assigned, else `active` where evidence has a pass.

    A matrix that names the target itself is no evidence for it. Names are compared in upper case; targets that no motif names have no family and gain nothing.
    """
    named = named_factors(motifs).select("tf", "family").distinct()
    own = targets.select(F.upper("tf").alias("tf")).distinct().join(named, "tf")
    held = assigned.select("peak_id", F.upper("tf").alias("tf")).distinct()
    passive = motif.borrow_family(held, named, own.select("tf")).withColumn("way", F.lit("passive"))
    hits = evidence.where("named is not null").select("peak_id", "family", "named").distinct().join(F.broadcast(own), "family").where(~F.array_contains("named", F.col("tf")))
    active = hits.select("peak_id", "tf").distinct().join(held, ["peak_id", "tf"], "left_anti").join(passive.select("peak_id", "tf"), ["peak_id", "tf"], "left_anti")
    return passive.select("peak_id", "tf", "way").unionAll(active.withColumn("way", F.lit("active")))


def family_gains(assigned: DataFrame, additions: DataFrame, targets: DataFrame) -> DataFrame:
    """(tf, before, after, delta) of the targets that additions brought to more peaks."""
    count = F.count("*")
    before = assigned.select("peak_id", F.upper("tf").alias("tf")).distinct().groupBy("tf").agg(count.alias("before"))
    delta = additions.join(targets.select(F.upper("tf").alias("tf")).distinct(), "tf", "left_semi").select("peak_id", "tf").distinct().groupBy("tf").agg(count.alias("delta"))
    n = F.coalesce("before", F.lit(0))
    return delta.join(before, "tf", "left").select("tf", n.alias("before"), (n + F.col("delta")).alias("after"), "delta")
