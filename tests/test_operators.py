"""Hand-computed cases and invariants of the analytics operators."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import names, stats
from strandline.operators import binning, effects, linking, motif, network, projection, qc, regions, response, screening
from strandline.plans import frames, simulation
from strandline.sources import formats
from strandline.streaming import bins


def test_granger_equals_least_squares(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=53)
    y = np.zeros(53)
    for i in range(1, 53):
        y[i] = 0.5 + 0.3 * y[i - 1] + 0.7 * x[i - 1] + 0.8 * rng.normal()
    rows = [(1, float(y[i]), float(y[i - 1]), float(x[i - 1])) for i in range(1, 53)]
    got = screening.granger(spark.createDataFrame(rows, "k long, y double, l double, x double"), ["k"]).first()
    a, b, c = (np.array([r[j] for r in rows]) for j in (1, 2, 3))
    reduced = np.column_stack([np.ones(52), b])
    full = np.column_stack([reduced, c])
    sse = [((a - m @ np.linalg.lstsq(m, a, rcond=None)[0]) ** 2).sum() for m in (reduced, full)]
    assert got["sse_reduced"] == pytest.approx(sse[0], rel=1e-9)
    assert got["sse_full"] == pytest.approx(sse[1], rel=1e-9)
    assert got["coef"] == pytest.approx(np.linalg.lstsq(full, a, rcond=None)[0][2], rel=1e-9)
    assert got["f_stat"] == pytest.approx((sse[0] - sse[1]) / (sse[1] / 49), rel=1e-9)


def test_granger_skips_degenerate_series(spark):
    rows = [(1, float(i), 1.0, float(i % 3)) for i in range(30)] + [(2, float(i % 5), float(i % 3), float(i % 3)) for i in range(30)]
    assert screening.granger(spark.createDataFrame(rows, "k long, y double, l double, x double"), ["k"]).count() == 0


def test_f_tail_known_values(spark):
    got = spark.createDataFrame([(1.0, 1.0), (4.0, 10.0), (4.5, 37.0), (0.0, 9.0)], "f double, d double").select(stats.f_tail(F.col("f"), F.col("d")).alias("p")).toPandas()["p"]
    assert got[0] == pytest.approx(0.5, abs=1e-12)
    assert got[1] == pytest.approx(0.0733880, abs=1e-6)
    assert got[2] == pytest.approx(0.0406359, abs=2e-4)
    assert got[3] == pytest.approx(1.0)


def test_bh_ties_share_largest_rank(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.5])], "g long, i long, p double")
    got = screening.benjamini_hochberg(df, "p", ["g"]).orderBy("i").toPandas()["p_adj"].tolist()
    assert got == pytest.approx([0.08 / 3, 0.08 / 3, 0.08 / 3, 0.5])


def test_equal_frequency_bins_match_qcut(spark):
    for times in ([0.0, 0.25, 0.5, 0.75, 1.0] * 9, list(np.random.default_rng(7).random(53)), [0.1, 0.4, 0.5, 0.9]):
        cells = spark.createDataFrame([(i, float(t), 0) for i, t in enumerate(times)], "cell_id long, pseudotime double, branch long")
        for k in (5, 11):
            got = binning.equal_frequency_bins(cells, k).orderBy("cell_id").toPandas()["bin"]
            want = pd.qcut(pd.Series(times), k, labels=False, duplicates="drop")
            assert got.tolist() == want.tolist()


def test_hard_means_divide_by_cells_and_empty_features_are_zero(spark):
    cells = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 1)], "cell_id long, branch long, bin int")
    entries = spark.createDataFrame([(1, 7, 4.0), (3, 8, 1.0)], "cell_id long, feature_id long, value double")
    got = {(r["bin"], r["feature_id"]): r["value"] for r in binning.hard_bin_means(entries, cells).collect()}
    assert got == {(0, 7): 2.0, (0, 8): 0.0, (1, 7): 0.0, (1, 8): 1.0}


def test_allocated_bins_keep_the_least(spark):
    got = binning.allocate_bins({"a": 90, "b": 5, "c": 5}, 20)
    assert sum(got.values()) == 20 and min(got.values()) == 3


def test_constant_factor_supports_no_lag(spark):
    factor = spark.createDataFrame([(1, 0, b, 1.0) for b in range(12)], "feature_id long, branch long, bin int, value double")
    peak = spark.createDataFrame([(2, 0, b, 0.1 * b) for b in range(12)], "feature_id long, branch long, bin int, value double")
    edges = spark.createDataFrame([(1, 2)], "tf long, peak_id long")
    routes = screening.local_lag_routes(screening.local_lag_tests(factor, peak, edges, 3), 0.05).toPandas()
    assert set(routes["status"]) == {"no_supported_lag"} and set(routes["source_bin"]) == {-1}
    assert routes.sort_values("bin")["n_lag_attempts"].tolist() == [min(b, 3) + 1 for b in range(12)]
    assert routes["n_stat_tests"].sum() == 0


def test_linear_factor_is_supported_without_lag(spark):
    factor = spark.createDataFrame([(1, r, b, float(b)) for r in (0, 1) for b in range(12)], "feature_id long, branch long, bin int, value double")
    peak = factor.select(F.lit(2).cast("long").alias("feature_id"), "branch", "bin", (0.1 + 0.1 * F.col("value")).alias("value"))
    routes = screening.local_lag_routes(screening.local_lag_tests(factor, peak, spark.createDataFrame([(1, 2)], "tf long, peak_id long"), 3), 0.05).toPandas()
    assert set(routes["status"]) == {"supported"} and set(routes["selected_lag"]) == {0}


def test_pooled_fold_change_scopes(spark):
    ep = spark.createDataFrame([("a", "T", "g", 2.0, 8.0, "ok"), ("b", "T", "g", 10.0, 5.0, "ok"), ("a", "T", "h", 2.0, 8.0, "ok"), ("b", "T", "h", 9.0, 1.0, "quality_filtered")], "source_context string, target_gene string, affected_gene string, control_mean double, perturbed_mean double, status string")
    two = spark.createDataFrame([("a", 2), ("b", 6)], "source_context string, n_cells long")
    got = {r["affected_gene"]: r for r in effects.pooled_fold_change(ep, two).collect()}
    assert (got["g"]["control_mean"], got["g"]["perturbed_mean"]) == (8.0, 5.75)
    assert got["g"]["log2_fold"] == pytest.approx(math.log2(5.75 / 8)) and got["g"]["effect_scope"] == "full"
    three = spark.createDataFrame([("a", 2), ("b", 6), ("skipped", 3)], "source_context string, n_cells long")
    h = {r["affected_gene"]: r for r in effects.pooled_fold_change(ep, three).collect()}["h"]
    assert h["log2_fold"] == 2.0 and h["effect_scope"] == "partial" and h["cell_fraction"] == pytest.approx(2 / 11)
    assert json.loads(h["excluded"]) == {"b": "quality_filtered", "skipped": "endpoint_unavailable"}


def test_pathways_need_the_next_bin_and_finite_values(spark):
    f = "target_gene string, source_context string, branch long, bin int, source_bin int, tf string, peak_id string, delta double, method string"
    p = "target_gene string, source_context string, branch long, bin int, gene string, peak_id string, delta double, method string"
    tf = [("T", "c", 0, b, b, t, "p", d, "single") for b in (0, 1) for t, d in (("A", 0.2), ("B", -0.1))]
    pk = [("T", "c", 0, b, "g", "p", 0.3, "single") for b in (1, 2)]
    ends = spark.createDataFrame([("T", "c", "g", -0.5)], "target_gene string, source_context string, gene string, effect double")
    got = effects.pathways(spark.createDataFrame(tf, f), spark.createDataFrame(pk, p), ends).toPandas().set_index("tf")
    assert got["event_count"].tolist() == [2, 2]
    assert got.loc["A", "tf_sum"] == pytest.approx(0.4) and got.loc["B", "tf_sum"] == pytest.approx(-0.2)
    assert got["peak_sum"].tolist() == pytest.approx([0.6, 0.6])
    for bad in (0.0, float("nan"), float("inf")):
        none = spark.createDataFrame([("T", "c", 0, 1, "g", "p", bad, "single")], p)
        assert effects.pathways(spark.createDataFrame(tf, f), none, ends).count() == 0


def test_depth_is_taken_over_all_peaks(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 100.0), (1, 0, 2.0), (1, 1, 200.0)], "cell_id long, feature_id long, value double")
    got = {r["cell_id"]: r["value"] for r in qc.depth_log1p(a.where("feature_id = 0"), a).collect()}
    assert got[1] == pytest.approx(math.log1p(1e4 * 2 / 202)) and got[0] == pytest.approx(math.log1p(1e4 / 101))


def test_band_join_bounds(spark):
    peaks = spark.createDataFrame([(1, "c", 90, 110)], "peak_id long, chr string, start long, end long")
    genes = spark.createDataFrame([(k, "c", t) for k, t in enumerate([49, 50, 149, 150])], "gene_id long, chr string, tss long")
    assert sorted(r["tss"] for r in regions.band_pairs(peaks, genes, 50).collect()) == [50, 149]


def test_closure_budget_and_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["depth"]) for r in network.closure(edges, seeds, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(MemoryError):
        network.closure(edges, seeds, 5, 2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "src long, dst long")
    got = {r["node"]: r["component"] for r in network.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100


def test_responses_stay_in_bounds_and_fit(spark):
    x = np.linspace(0, 4, 40)
    y = 1 + 0.8 * (x - 2) / (1 + np.abs(x - 2))
    rows = spark.createDataFrame([(1, 1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 1, 1.0, float(b)) for b in y], "target_id long, input_id long, x double, y double")
    for family in ("saturation", "spline", "network"):
        got = {r["target_id"]: r for r in response.fit_responses(rows, family).collect()}
        assert got[1]["r2"] > 0.95, family
        assert got[2]["status"] == "constant_input"
        v = response.response(got[1]["family"], np.array(got[1]["params"]), np.linspace(-50, 50, 101), got[1]["low"], got[1]["high"])
        assert v.min() >= got[1]["low"] and v.max() <= got[1]["high"]


def test_propagation_identity_and_order(spark):
    state = spark.createDataFrame([(0, 0, b, layer, f, 1.0) for b in range(3) for layer in ("gene", "peak") for f in (1, 2)], "context long, branch long, bin int, layer string, feature_id long, value double")
    linear = [0.0, 1.0, 0.0, 0.0]
    rel = spark.createDataFrame([("peak", 1, 1, 0, 1.0, "saturation", linear, 0.0, 2.0), ("gene", 2, 1, 1, 1.0, "saturation", linear, 0.0, 2.0)], "layer string, target_id long, input_id long, lag int, alpha double, family string, params array<double>, low double, high double")
    asked = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 1, 0.0)], "context long, intervention long, feature_id long, strength double")
    d = response.propagate(state, rel, asked).toPandas()
    zero = d[d.intervention == 2]
    assert (zero.control == zero.perturbed).all()
    full = d[d.intervention == 1].set_index(["layer", "feature_id", "bin"])
    assert full.loc[("gene", 1, 0), "perturbed"] == 0 and full.loc[("gene", 1, 0), "status"] == "direct"
    assert full.loc[("peak", 1, 0), "perturbed"] == pytest.approx(0.5)
    assert full.loc[("gene", 2, 0), "status"] == "no_history" and full.loc[("gene", 2, 1), "perturbed"] < 1


def test_propagation_marks_readers_of_missing_inputs(spark):
    state = spark.createDataFrame([(0, 0, b, layer, f, 1.0) for b in range(3) for layer in ("gene", "peak") for f in (1, 2)], "context long, branch long, bin int, layer string, feature_id long, value double")
    linear = ("saturation", [0.0, 1.0, 0.0, 0.0], 0.0, 2.0)
    edges = [("peak", 1, 1, 0, 1.0), ("peak", 2, 2, 0, 1.0), ("gene", 2, 1, 1, 0.5), ("gene", 2, 9, 1, 0.5)]
    rel = spark.createDataFrame([e + linear for e in edges], "layer string, target_id long, input_id long, lag int, alpha double, family string, params array<double>, low double, high double")
    asked = spark.createDataFrame([(0, 1, 1, 1.0)], "context long, intervention long, feature_id long, strength double")
    got = {(r["layer"], r["feature_id"], r["bin"]): r for r in response.propagate(state, rel, asked).collect()}
    assert got["gene", 2, 0]["status"] == "no_history" and got["peak", 2, 0]["status"] == "ok"
    for key in (("gene", 2, 1), ("peak", 2, 1), ("gene", 2, 2), ("peak", 2, 2)):
        assert (got[key]["status"], got[key]["perturbed"], got[key]["origins"]) == ("unavailable", None, "peak 9"), key
    assert got["peak", 1, 1]["status"] == "ok" and got["peak", 1, 1]["perturbed"] == pytest.approx(0.5)


def test_propagation_covers_all_features(spark):
    sf = "/root/testdata/sf0.001"
    state = simulation.forward_propagation(spark, sf).toPandas()
    assert {k: set(v) for k, v in state.groupby("layer").feature_id} == {"gene": set(range(frames.GENES)), "peak": set(simulation.bin_state(spark, sf, 16)[1].toPandas().feature_id)}
    assert "unavailable" not in set(state.status)
    screen = screening.score_edges(screening.granger(simulation.lagged_rows(spark, sf, 16), ["gene", "peak"])).where("is_causal").toPandas()
    pairs = simulation.pair_rows(spark, sf).select("target_id", "input_id").distinct().toPandas()
    assert len(pairs) and set(map(tuple, pairs.to_numpy())) == set(zip(screen.gene, screen.peak, strict=True))


def test_partial_knock_out_halves_counts(spark):
    e = spark.createDataFrame([(1, 5, math.log1p(8.0)), (1, 6, 1.0)], "cell_id long, feature_id long, value double")
    got = {r["feature_id"]: r["value"] for r in effects.knock_out(e, spark.createDataFrame([(5,)], "feature_id long"), 0.5).collect()}
    assert math.expm1(got[5]) == pytest.approx(4.0) and got[6] == 1.0


def test_motif_scan_skips_masked_windows(spark):
    seqs = spark.createDataFrame([(1, "ACGTGCAATG" * 8), (2, "N" * 50), (3, "AC")], "peak_id long, seq string")
    m = spark.createDataFrame([("M", "TF", [[9.0, 0.0, 0.0, 0.0], [0.0, 9.0, 0.0, 0.0], [0.0, 0.0, 9.0, 0.0]])], "motif_id string, tf_names string, counts array<array<double>>").withColumn("pwm", motif.log_odds(F.col("counts")))
    assert {r["peak_id"] for r in motif.scan(seqs, m, 1.0).collect()} == {1}


def test_neighbours_are_exact(spark):
    v = np.random.default_rng(3).normal(size=(60, 8))
    e = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "r_id long, vec array<double>")
    got = projection.neighbours(e.where("r_id < 5").withColumnRenamed("r_id", "q_id"), e, 4, block=16).toPandas()
    for q in range(5):
        want = np.argsort(np.sqrt(((v - v[q]) ** 2).sum(axis=1)), kind="stable")[:4]
        assert got[got.q_id == q].sort_values("rank").r_id.tolist() == want.tolist()


def test_principal_components_match_svd(spark):
    v = np.random.default_rng(3).normal(size=(50, 6)) * np.array([5, 4, 3, 1, 1, 1])
    e = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(50)], "id long, vec array<double>")
    got = np.stack(projection.principal_components(e, 3).orderBy("id").toPandas().coords.to_list())
    u, s, _ = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-8)


def test_strict_flags(spark):
    df = spark.createDataFrame([(" TRUE",), ("0",), (None,)], "v string")
    assert [r[0] for r in df.select(names.strict_flag(F.col("v"))).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a flag"):
        spark.createDataFrame([("maybe",)], "v string").select(names.strict_flag(F.col("v"))).collect()


def test_formats(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('#c\n1\ts\tgene\t1200\t4801\t.\t-\t.\tgene_id "E1.2"; gene_name "SYMB";\n1\ts\texon\t1\t2\t.\t-\t.\tgene_id "E1.2";\n')
    g = formats.read_gtf_genes(spark, str(tmp_path / "g.gtf")).select("ref_id", "symbol", names.tss(F.col("strand"), F.col("start"), F.col("end")).alias("tss")).first()
    assert tuple(g) == ("E1.2", "SYMB", 4800)
    (tmp_path / "bad.gtf").write_text("1\ts\tgene\n")
    with pytest.raises(Exception, match="9 columns"):
        formats.read_gtf_genes(spark, str(tmp_path / "bad.gtf")).collect()
    (tmp_path / "x.fa").write_text(">chr1 first\nACGT\nACGT\n>chr2\nTTTT\n")
    genome = formats.read_fasta(spark, str(tmp_path / "x.fa"))
    peaks = spark.createDataFrame([(1, "1", 2, 6), (2, "chr2", 0, 9)], "peak_id long, chr string, start long, end long")
    assert [tuple(r) for r in formats.peak_sequences(peaks, genome).collect()] == [(1, "GTAC")]
    long = "".join("ACGT"[k * k % 7 % 4] for k in range(10_000))
    (tmp_path / "y.fa").write_text(">one\n" + long + "\n>two x\n" + "\n".join(long[k : k + 61] for k in range(0, len(long), 61)) + "\n")
    asked = [(k, c, a, b) for k, (c, a, b) in enumerate([("one", 0, 9000), ("two", 4090, 4200), ("chrtwo", 9990, 10000), ("two", 9990, 10001), ("one", 8191, 8193)])]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    got = {r["peak_id"]: r["seq"] for r in formats.peak_sequences(spark.createDataFrame(asked, "peak_id long, chr string, start long, end long"), formats.read_fasta(spark, str(tmp_path / "y.fa"))).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: long[a:b] for k, _, a, b in asked if b <= len(long)}
    (tmp_path / "m.pfm").write_text(">M1\n1 2 3 4\n5 6 7 8\n")
    assert formats.read_motifs(spark, str(tmp_path / "m.pfm")).first()["counts"] == [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]]
    (tmp_path / "t.txt").write_text("A TF\n# note\nB\n")
    assert {tuple(r) for r in formats.read_targets(spark, str(tmp_path / "t.txt")).collect()} == {("A", "TF"), ("B", "TARGET")}
    m = tmp_path / "mtx"
    m.mkdir()
    (m / "barcodes.tsv").write_text("c1\nc2\n")
    (m / "features.tsv").write_text("E1\tA\tGene Expression\nchr1:1-2\tp\tPeaks\n")
    (m / "matrix.mtx").write_text("%%MatrixMarket\n2 2 3\n1 1 5\n2 1 1\n1 2 7\n")
    assert {(r["cell_id"], r["feature_id"], r["value"]) for r in formats.read_matrix_market(spark, str(m)).collect()} == {("c1", "E1", 5.0), ("c1", "chr1:1-2", 1.0), ("c2", "E1", 7.0)}


def test_matrix_folders(spark, tmp_path):
    m = tmp_path / "mtx"
    m.mkdir()
    (m / "barcodes.tsv").write_text("c1\nc2\n")
    (m / "peaks.bed").write_text("chr1\t1\t20\nchr2\t5\t9\n")
    (m / "matrix.mtx").write_text("%%MatrixMarket\n%\n2 2 2\n1 1 5\n2 2 2\n")
    assert sorted((r["cell_id"], r["feature_id"], r["feature_type"], r["value"]) for r in formats.read_matrix_market(spark, str(m)).collect()) == [("c1", "chr1:1-20", "Peaks", 5.0), ("c2", "chr2:5-9", "Peaks", 2.0)]
    (m / "features.tsv").write_text("E1\tA\nchr1:1-2\tchr1:1-2\n")
    assert {r["feature_type"] for r in formats.read_matrix_market(spark, str(m)).collect()} == {"Gene Expression", "Peaks"}
    (m / "matrix.mtx").write_text("%%MatrixMarket\n2 2 9\n1 1 5\n2 2 2\n")
    with pytest.raises(ValueError, match="says"):
        formats.read_matrix_market(spark, str(m))


def test_loose_gtf_and_factor_files(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('1\ts\tgene\t10\t20\t.\t+\t.\tgene_id "E1"; gene_name "A";\nshort\n2\ts\tgene\t30\t40\t.\t-\t.\tgene_id=E2;gene_name=B\n3\ts\tgene\t50\t60\t.\t+\t.\tgene_id "E9"; gene_name "A";\n')
    wanted = spark.createDataFrame([("A",), ("E2",)], "name string")
    assert sorted(tuple(r) for r in formats.read_gtf_loosely(spark, str(tmp_path / "g.gtf"), wanted).collect()) == [("A", "3", 50), ("E2", "2", 40)]
    (tmp_path / "f.txt").write_text("Motif\tFactor\nM1\tb\nM1\tA\nM2\tc\n")
    assert sorted(tuple(r) for r in formats.read_motif_factors(spark, str(tmp_path / "f.txt")).collect()) == [("M1", "A::B"), ("M2", "C")]


def test_configurations_and_manifests():
    assert formats.load_config('{"a": {"b": 1}}', {"a": {"b": 0, "c": 2}, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3}
    assert formats.layered({"a": {"b": {"c": 1}}, "e": {}}, {"a": {"b": 2}}, {"a": {}, "e": {"f": 3}}) == {"a": {"b": 2}, "e": {"f": 3}}
    out = {"cache_dir": "c"}
    tasks = [
        {"name": "x", "output": {"dir": "o1"}, "joint_knockout": False},
        {"name": "y", "output": {"dir": "o2"}, "overrides": {"k": {"m": 5}, "output": {"dir": "no"}}, "knockout_genes": ["A", {"gene": "B", "type": "target"}]},
        {"name": "z", "output": {"dir": "o3"}, "base_config": "other"},
    ]
    base = {"k": {"m": 1, "n": 2}, "perturbation": {"joint_knockout": True, "x": 1}, "output": {"dir": "old", "checkpoint_dir": "old"}}
    manifest = {"defaults": {"input": {"f": "i"}, "output": out, "knockout_genes": ["C"]}, "tasks": tasks}
    y, x, z = formats.batch_plans(manifest, base, ["y", "x", "z"], {"other": {"q": 1}})
    assert (y["name"], y["config"]["k"], y["targets"]) == ("y", {"m": 5, "n": 2}, [("A", "TF"), ("B", "TARGET")])
    # silent tasks keep what the base says
    assert [p["config"]["perturbation"].get("joint_knockout") for p in (y, x, z)] == [True, False, None] and x["targets"] == [("C", "TF")]
    assert y["config"]["output"] == {"dir": "o2", "cache_dir": "c", "checkpoint_dir": None} and z["config"]["q"] == 1 and base["output"]["checkpoint_dir"] == "old"
    placed = formats.batch_plans(manifest | {"tasks": tasks[:2]}, base, folder="/m/n")[1]["config"]
    assert placed["output"] == {"dir": "/m/n/o2", "cache_dir": "/m/n/c", "checkpoint_dir": None}
    assert formats.located({"input": {"rna_h5ad": "s3://b/x", "genome_fasta": "../g.fa", "f": "y"}}, "/a/b")["input"] == {"rna_h5ad": "s3://b/x", "genome_fasta": "/a/g.fa", "f": "y"}
    good = {"name": "x", "output": {"dir": "o", "cache_dir": "c"}, "knockout_genes": ["A"]}
    bad = {
        "folder": [good | {"name": "../x"}], "another task's": [good, good | {"name": "w"}], "name x": [good, good | {"output": {"dir": "p", "cache_dir": "c"}}], "output.dir": [good | {"output": {"cache_dir": "c"}}],
        "typo": [good | {"typo": 1}], "not a bool": [good | {"joint_knockout": "yes"}], "twice": [good | {"knockout_genes": ["A", "A"]}], "no knock-out": [good | {"knockout_genes": ["all_tfs"]}], "missing": [{"name": "x"}],
        "task 2.*task 3": [good, 7, {"name": ".."}], "not there": [good | {"base_config": "none"}],
    }
    for said, wrong in bad.items():
        with pytest.raises(ValueError, match=said):
            formats.batch_plans({"tasks": wrong}, {"output": {"dir": "inherited"}})
    for order in (["x", "x"], ["x", "v"]):
        with pytest.raises(ValueError, match="order"):
            formats.batch_plans({"tasks": [good]}, {}, order)


def test_writers_round_trip(spark, tmp_path):
    bed = spark.createDataFrame([("chr1", 1, 5, "x", 7)], "chrom string, start long, end long, name string, score int")
    formats.write_bed(bed, str(tmp_path / "b"))
    assert [tuple(r) for r in formats.read_bed(spark, str(tmp_path / "b")).select("chr", "start", "end", "name").collect()] == [("chr1", 1, 5, "x")]
    assert formats.write_results({"a": bed, "routes": bed}, str(tmp_path / "r")) == ["a"]
    formats.write_by_intervention(spark.createDataFrame([("T/1", 2.0), ("T_1", 3.0)], "target_gene string, delta double"), str(tmp_path / "i"))
    assert len(list((tmp_path / "i").glob("target=*"))) == 2
    formats.write_variable_genes(spark.createDataFrame([("A", True, False), ("B", True, True), ("C", False, None)], "feature_id string, highly_variable boolean, forced boolean"), str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["A"]
    formats.append_hits(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, payload string"), str(tmp_path / "h"))
    assert [r["payload"] for r in formats.lookup_hits(spark, str(tmp_path / "h"), ["b", "z"]).collect()] == ["2"]
    (tmp_path / "h.csv").write_text("gene,bin\nA,1\nB,2\n")
    assert [tuple(r) for r in formats.read_history(spark, str(tmp_path / "h.csv"), "gene string, bin int", ["B"]).collect()] == [("B", 2)]


def test_predicted_changes_by_family(spark):
    rng = np.random.default_rng(1)
    singles = [(1, k, f, [float(v) for v in rng.normal(size=n)], 0.0, 2.0) for k, (f, n) in enumerate([("saturation", 4), ("spline", 8), ("network", 13), ("constant", 1)])]
    models = spark.createDataFrame(singles, "target_id long, input_id long, family string, params array<double>, low double, high double")
    weights = models.select("target_id", "input_id", F.lit(0.25).alias("alpha"))
    states = spark.createDataFrame([(k, 0, 0.3 * k, 0.9) for k in range(4)], "input_id long, bin int, x_old double, x_new double")
    want = [0.25 * np.diff(response.response(f, np.array(p), np.array([0.3 * k, 0.9]), 0.0, 2.0))[0] for _, k, f, p, _, _ in singles]
    got = {r["input_id"]: r["delta"] for r in response.contributions(models, weights, states).collect()}
    assert [got[k] for k in range(4)] == pytest.approx(want, abs=1e-12)
    assert response.predict_deltas(models, weights, states).first()["delta"] == pytest.approx(sum(want), abs=1e-12)
    with pytest.raises(Exception, match="unknown family"):
        response.contributions(models.withColumn("family", F.lit("tree")), weights, states).collect()


def test_small_operators(spark):
    m = spark.createDataFrame([("M1", "A", 3.0, False), ("M2", "A", 1.0, True), ("M3", "B", 2.0, False)], "motif_id string, tf string, information double, curated boolean")
    assert {r["tf"]: r["motif_id"] for r in motif.best_motifs(m).collect()} == {"A": "M2", "B": "M3"}
    c = spark.createDataFrame([(1, 7, 0.5), (1, 8, -0.9), (2, 7, 0.1)], "peak_id long, target_gene long, delta double")
    assert {r["peak_id"]: r["target_gene"] for r in effects.strongest_change(c).collect()} == {1: 8, 2: 7}
    f = spark.createDataFrame([(1, 1.0, 1.5), (1, 3.0, 2.5), (2, 4.0, 4.0)], "k long, y double, y_hat double")
    got = {r["k"]: r for r in screening.fit_metrics(f, ["k"]).collect()}
    assert got[1]["rmse"] == pytest.approx(0.5) and got[1]["r2"] == pytest.approx(0.75) and got[2]["r2"] is None
    w = spark.createDataFrame([(1, 0, 2.0), (1, 1, 6.0)], "cell_id long, bin int, w double")
    assert sorted(r["w"] for r in binning.membership(w).collect()) == [0.25, 0.75]
    assert (binning.max_lag(30), binning.max_lag(3), binning.max_lag(30, 2)) == (7, 1, 2)
    p = spark.createDataFrame([(i, float(i), "ok") for i in range(101)], "q_id long, nearest double, status string")
    assert {r["q_id"] for r in projection.out_of_distribution(p, p).where("status = 'out_of_distribution'").collect()} == {100}
    r = spark.createDataFrame([(1, 0, 3, "supported", 2), (1, 0, 3, "supported", 1), (1, 0, 4, "no_supported_lag", None)], "peak_id long, branch long, bin int, status string, selected_lag int")
    assert [tuple(x) for x in screening.minimum_supported_lag(r).collect()] == [(1, 0, 3, 1)]
    v = spark.createDataFrame([(float("nan"),), (None,), (0.2,)], "p double").select(stats.safe_p(F.col("p"))).collect()
    assert [x[0] for x in v] == [1.0, 1.0, 0.2]
    g = spark.range(1).select(stats.gumbel_tail(F.lit(2.0), F.lit(0.0), F.lit(1.0))).first()[0]
    beta = 6**0.5 / math.pi
    assert g == pytest.approx(1 - math.exp(-math.exp(-(2 + 0.5772156649015329 * beta) / beta)))


def test_lineages_number_and_merge(spark):
    sizes = spark.createDataFrame([(1, 50), (2, 40), (3, 60), (4, 5)], "node long, n_cells long")
    w = spark.createDataFrame([(1, 2, 9.0), (2, 3, 1.0), (3, 4, 2.0), (1, 4, 1.5)], "src long, dst long, weight double")
    assert {r["node"]: r["lineage"] for r in network.lineages(w, sizes, 5.0, 10).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_band_in_half_bases(spark):
    peaks = spark.createDataFrame([(1, "c", 90, 111)], "peak_id long, chr string, start long, end long")
    genes = spark.createDataFrame([(k, "c", t) for k, t in enumerate([50, 51, 149, 150, 151])], "gene_id long, chr string, tss long")
    assert sorted(r["tss"] for r in regions.band_pairs(peaks, genes, 50).collect()) == [51, 149, 150]


def test_ranges_equal_plain_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 500), rng.integers(0, 200, 500) / 7, strict=True)]
    df = spark.createDataFrame([(g, x, i) for i, (g, x) in enumerate(rows)], "g long, p double, i long")
    got = screening.benjamini_hochberg(df.withColumn("p", F.col("p") / 30), "p", ["g"]).toPandas()
    for g, part in got.groupby("g"):
        p = np.sort(part.p.to_numpy())
        adjusted = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        want = {x: min(1, adjusted[np.searchsorted(p, x, "right") - 1]) for x in p}
        assert part.p_adj.to_numpy() == pytest.approx([want[x] for x in part.p])


def test_stage_provenance(spark, tmp_path):
    df, s = spark.range(5).withColumn("x", F.col("id") * 2), formats.Settings()
    formats.save_stage(df, str(tmp_path / "s"), s)
    assert formats.load_stage(spark, str(tmp_path / "s"), s).count() == 5
    with pytest.raises(ValueError, match="other settings"):
        formats.load_stage(spark, str(tmp_path / "s"), formats.Settings.shipped())
    with pytest.raises(ValueError, match="unknown"):
        s.merged({"nope": 1})


def test_hit_store_refuses_conflicts(spark, tmp_path):
    hits = lambda rows: spark.createDataFrame(rows, "key string, payload string")
    at = str(tmp_path / "hits")
    assert formats.append_hits(hits([("a", "1")]), at) == 1
    assert formats.append_hits(hits([("a", "1"), ("b", "2")]), at) == 1
    with pytest.raises(ValueError, match="differ"):
        formats.append_hits(hits([("a", "9")]), at)


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400).repartition(3).write.parquet(str(tmp_path / "e"))
    got = bins.run_to_memory(bins.windowed_means(bins.read_events(spark, str(tmp_path / "e"), 1), late="400 days"), "means").toPandas()
    want = bins.windowed_means(spark.read.parquet(str(tmp_path / "e"))).toPandas()
    assert got.sort_values(["start", "event_type"]).n.tolist() == want.sort_values(["start", "event_type"]).n.tolist()


def test_cells_and_labels_must_agree(spark):
    cells = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9)], "cell_id long, t double")
    some = spark.createDataFrame([(1, "a"), (3, "b")], "cell_id long, label string")
    kept = linking.align_cells(cells, some)
    assert {r["cell_id"]: r["label"] for r in linking.attach_labels(kept, some).collect()} == {1: "a", 3: "b"}
    with pytest.raises(Exception, match="lacks reference cell 9"):
        linking.align_cells(cells, spark.createDataFrame([(1,), (9,)], "cell_id long")).count()
    for labels in ([(1, "a"), (2, "b"), (3, None)], [(1, "a"), (2, "b")], [(1, "a"), (2, "b"), (3, "c"), (4, "d")]):
        with pytest.raises(Exception, match="differ"):
            linking.attach_labels(cells, spark.createDataFrame(labels, "cell_id long, label string")).collect()
    with pytest.raises(Exception, match="repeated cell_id 1"):
        linking.align_cells(cells, spark.createDataFrame([(1,), (1,)], "cell_id long")).collect()


def test_names_of_genes(spark):
    records = spark.createDataFrame([("E1", "A"), ("E2", "A"), ("E3", "A_01"), ("E4", "B")], "id string, name string")
    assert {r["id"]: r["label"] for r in linking.numbered_labels(records).collect()} == {"E1": "A_01__E1", "E2": "A_02", "E3": "A_01", "E4": "B"}
    rows = spark.createDataFrame([(1, "E4,E2.7"), (2, None), (3, "PEAK:1:2-3"), (4, "E4,E2.7")], "k long, gene string")
    got = {r["k"]: r for r in linking.present_genes(rows, records, "gene").collect()}
    assert (got[1]["gene"], got[1]["gene_id"], got[1]["gene_name"], got[4]["gene_display_names_json"]) == ("B,A_02", "E4,E2", "B,A", '["B","A_02"]')
    assert got[2]["gene"] is None and got[3]["gene_id"] == "PEAK:1:2-3" and got[3]["gene_ids_json"] is None
    with pytest.raises(Exception, match="unknown gene id E9"):
        linking.present_genes(spark.createDataFrame([("E9",)], "gene string"), records, "gene").collect()


def test_requests_and_declarations(spark):
    aliases = spark.createDataFrame([("x", "1"), ("y", "2"), ("y", "3"), ("2", "3")], "alias string, id string")
    asked = linking.request_matches(spark.createDataFrame([("x",), ("y",), ("z",), ("2",)], "request string"), aliases)
    assert {r["request"]: (r["status"], r["id"]) for r in asked.collect()} == {"x": ("found", "1"), "y": ("ambiguous", None), "z": ("unknown", None), "2": ("found", "2")}
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "gene string")
    assert sorted(r[0] for r in linking.requested_rows(rows, "gene", asked.where("request <> 'y'")).collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="ambiguous"):
        linking.requested_rows(rows, "gene", asked)
    with pytest.raises(ValueError, match="unknown"):
        linking.requested_rows(rows, "gene", asked.where("request <> 'y'"), unknown_fails=True)
    declared = spark.createDataFrame([(1, 2)], "target long, input long")
    linking.require_declared(declared, declared)
    with pytest.raises(ValueError, match="declared"):
        linking.require_declared(spark.createDataFrame([(1, 3)], "target long, input long"), declared)


def test_links_of_reports(spark):
    known = spark.createDataFrame([("0",), ("cluster_1",), ("1",)], "cluster string")
    rows = spark.createDataFrame([("cluster_0",), ("cluster_1",), ("x",)], "cluster string")
    assert sorted(r[0] for r in linking.reconcile_clusters(rows, known).collect()) == ["0", "cluster_1", "x"]
    with pytest.raises(Exception, match="two spellings"):
        linking.reconcile_clusters(spark.createDataFrame([("cluster_0",), ("0",)], "cluster string"), known).collect()
    e = spark.createDataFrame([("ok", 1.0, None), ("ok", float("nan"), None), ("bad", 1.0, None), (None, 1.0, None), ("ok", 2.0, "unavailable")], "status string, delta_rna double, aggregation_scope string")
    assert [r["plot_available"] for r in linking.available_effects(e).collect()] == [True, False, False, False, False]
    with pytest.raises(ValueError, match="no effect column"):
        linking.available_effects(known)
    labels = spark.createDataFrame([("a", "10"), ("a", "9"), ("b", "10"), ("b", "x"), ("b", "9"), ("b", None)], "k string, label string")
    assert sorted(tuple(r) for r in linking.ordered_labels(labels, "k", "label").collect()) == [("a", "10", 2), ("a", "9", 1), ("b", "10", 1), ("b", "9", 2), ("b", "x", 3)]
    routes = spark.createDataFrame([(1, 7, 0, 2, "supported", 1, 1), (1, 7, 0, 1, "no_supported_lag", None, -1)], "tf long, peak_id long, branch long, bin int, status string, selected_lag int, source_bin int")
    state = spark.createDataFrame([(i, 0, b, 10.0 * i + b) for i in (1, 7) for b in range(3)], "feature_id long, branch long, bin int, value double")
    assert sorted(tuple(r) for r in linking.aligned_rows(state, state, routes).collect()) == [(7, 1, 0, 1, 71.0, 0.0, False), (7, 1, 0, 2, 72.0, 11.0, True)]
    with pytest.raises(Exception, match="lag differ"):
        linking.aligned_rows(state, state, routes.withColumn("source_bin", F.lit(0))).collect()


def test_joint_embedding_of_two_modalities(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(80, 6)) * [5, 3, 2, 1, 1, 1], rng.normal(size=(80, 4)) * [9, 1, 1, 0]
    frames_ = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>") for m in (a, b)]
    parts = []
    for m in (a, b):
        u, s, _ = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
        parts.append((u * s, s))
    want = np.hstack([c[:, :k] / np.sqrt((c[:, :k] ** 2).sum(axis=1).mean()) for (c, _), k in zip(parts, (5, 3))])
    got = np.stack(projection.joint_embedding(*frames_, 5).orderBy("id").toPandas().coords.to_list())
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-7)
    w = [np.sqrt((s[:2] ** 2).sum() / (s**2).sum()) for _, s in parts]
    want = np.hstack([c[:, :2] * w[1 - i] / sum(w) for i, (c, _) in enumerate(parts)])
    got = np.stack(projection.joint_embedding(*frames_, 2, equal_rms=False).orderBy("id").toPandas().coords.to_list())
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-7)
    with pytest.raises(ValueError, match="does not vary"):
        projection.joint_embedding(frames_[0], frames_[1].withColumn("vec", F.array(F.lit(1.0))), 2)
    e = spark.createDataFrame([(1, 5, 2.0), (2, 5, 4.0), (1, 6, 1.0), (2, 6, 1.0), (9, 5, 7.0)], "cell_id long, feature_id long, value double")
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id long")
    assert {r["id"]: r["vec"] for r in projection.variable_vectors(e, cells, 1).collect()} == {1: [2.0], 2: [4.0], 3: [0.0]}
    qc.require_size(e, 3, 2)
    with pytest.raises(ValueError, match="3 cells and 2 features"):
        qc.require_size(e)
