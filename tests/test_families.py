"""Family scans against scans with every member, and evidence that is not made twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import families, motif

MOTIFS = "motif_id string, tf_names string, counts array<array<double>>"


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(4)
    names = ["FOX1", "FOX2", "FOX2::gata3", "GATA1", "FOX3", "GATA3", "SOX9", "FOX1::FOX2"]
    rows = [(f"M{i}", n, rng.integers(0, 9, size=(4 if i == 4 else 6, 4)).astype(float).tolist()) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, MOTIFS).withColumn("pwm", motif.log_odds(F.col("counts"))).cache()


@pytest.fixture(scope="module")
def peaks(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "".join(rng.choice(list("ACGTacgtN"), 60, p=[0.22] * 4 + [0.02] * 4 + [0.04]))) for i in range(80)]
    return spark.createDataFrame(rows + [(80, ""), (81, None), (82, "NNNNNNNNNN"), (83, "AC"), (0, rows[0][1])], "peak_id long, seq string").cache()


def every_member(motifs, peaks, targets, threshold, shortest):
    """(peak, target) where any matrix of the family passes that does not name the target."""
    passes = set()
    kept = {r["motif_id"]: [n.upper() for n in r["tf_names"].split("::")] for r in motifs.collect() if len(r["pwm"]) >= shortest}
    root = {n: n.rstrip("0123456789") for names in kept.values() for n in names} | {t: t.rstrip("0123456789") for t in targets}
    for hit in motif.scan(peaks, motifs, threshold).collect():
        for t in targets:
            names = kept.get(hit["motif_id"], [])
            if t not in names and root[t] in {root[n] for n in names}:
                passes.add((hit["peak_id"], t))
    return passes


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.6])
def test_additions_equal_scans_of_all_members(spark, library, peaks, threshold):
    targets = spark.createDataFrame([("fox1",), ("FOX2",), ("GATA3",), ("SOX9",), ("NONE1",), ("FOX1",)], "tf string")
    evidence = families.scan_families(peaks, library, targets, threshold)
    none = spark.createDataFrame([], "peak_id long, tf string")
    got = families.family_additions(none, evidence, library, targets).collect()
    want = every_member(library, peaks, ["FOX1", "FOX2", "GATA3", "SOX9"], threshold, 5)
    assert want and {(r["peak_id"], r["tf"]) for r in got} == want and len(got) == len(want) and {r["way"] for r in got} == {"active"}
    rows = evidence.collect()
    # a row for each sequence and family, misses included; none for a null sequence
    assert len(rows) == 3 * 84 and 81 not in {r["peak_id"] for r in rows}
    assert all((r["named"] is None) == (r["passed"] == 0) for r in rows)


def test_passive_goes_first_and_gains_are_counted(spark, library, peaks):
    targets = spark.createDataFrame([("FOX1",), ("GATA1",)], "tf string")
    assigned = spark.createDataFrame([(1, "fox2"), (2, "FOX1"), (2, "FOX2"), (3, "GATA3"), (3, "SOX9"), (1, "fox2")], "peak_id long, tf string")
    evidence = families.scan_families(peaks, library, targets, 0.3)
    got = {(r["peak_id"], r["tf"]): r["way"] for r in families.family_additions(assigned, evidence, library, targets).collect()}
    assert got[1, "FOX1"] == got[3, "GATA1"] == "passive" and (2, "FOX1") not in got
    active = {k for k, way in got.items() if way == "active"}
    assert active == every_member(library, peaks, ["FOX1", "GATA1"], 0.3, 5) - {(1, "FOX1"), (3, "GATA1"), (2, "FOX1")}
    gains = {r["tf"]: (r["before"], r["after"], r["delta"]) for r in families.family_gains(assigned, families.family_additions(assigned, evidence, library, targets), targets).collect()}
    fox = sum(k[1] == "FOX1" for k in got)
    assert gains["FOX1"] == (1, 1 + fox, fox) and gains["GATA1"][0] == 0


def test_known_evidence_is_not_scanned_again(spark, library, peaks):
    targets = spark.createDataFrame([("FOX1",), ("GATA1",)], "tf string")
    first = families.scan_families(peaks, library, targets, 0.3).cache()
    assert families.scan_families(peaks, library, targets, 0.3, known=first).count() == 0
    # another family, a changed sequence, another threshold: only these are scanned
    more = targets.unionAll(spark.createDataFrame([("SOX9",)], "tf string"))
    new = families.scan_families(peaks, library, more, 0.3, known=first).collect()
    assert {r["family"] for r in new} == {"SOX"} and len(new) == 84
    changed = peaks.withColumn("seq", F.when(F.col("peak_id") == 5, F.concat("seq", F.lit("ACGTTGCA"))).otherwise(F.col("seq")))
    assert {(r["peak_id"], r["family"]) for r in families.scan_families(changed, library, targets, 0.3, known=first).collect()} == {(5, "FOX"), (5, "GATA")}
    assert families.scan_families(peaks, library, targets, 0.2, known=first).count() == 2 * 84
    assert families.scan_families(peaks, library, targets.where("false"), 0.3).count() == 0
