"""Genomic joins: distance bands, overlaps, nearest regions, and gene identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import strip_version
from strandline.operators.ordered import neighbours_along


def band_pairs(peaks: DataFrame, genes: DataFrame, distance: int) -> DataFrame:
    """Peak and gene pairs of a chromosome with tss in [mid - distance, mid + distance), the peak's mid (start + end) / 2 being exact.

    Positions are cut into buckets of the band's width, a peak goes to the two buckets its band can touch, and the band
    is checked within, in half bases: an equi join whose keys are spread along the chromosome.
    """
    width = 2 * distance
    twice = F.col("start") + F.col("end")
    low = F.floor((twice - 2 * distance) / (2 * width))
    p = peaks.withColumn("mid", twice / 2).withColumn("_b", F.explode(F.array(low, low + 1)))
    g = genes.withColumn("_b", F.floor(F.col("tss") / width))
    return p.join(g, ["chr", "_b"]).where((2 * F.col("tss") >= twice - 2 * distance) & (2 * F.col("tss") < twice + 2 * distance)).drop("_b")


def overlap_match(requests: DataFrame, peaks: DataFrame, width: int) -> DataFrame:
    """For each request(request_id, chr, q_start, q_end) the peak of largest overlap, first by start then id on ties."""
    r = requests.withColumn("_b", F.explode(F.sequence(F.floor(F.col("q_start") / width), F.floor((F.col("q_end") - 1) / width))))
    p = peaks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    both = r.join(p, ["chr", "_b"]).where((F.col("start") < F.col("q_end")) & (F.col("end") > F.col("q_start")))
    overlap = F.least("end", "q_end") - F.greatest("start", "q_start")
    best = both.groupBy("request_id").agg(F.max_by(F.struct("peak_id", overlap.alias("overlap")), F.struct(overlap, -F.col("start"), -F.col("peak_id"))).alias("m"))
    return best.select("request_id", "m.peak_id", "m.overlap")


def nearest_match(requests: DataFrame, peaks: DataFrame) -> DataFrame:
    """For each request the peak with the nearest centre on its chromosome; ties to the smaller id.

    Requests and peaks are ordered together along the chromosome in ranges of positions, and only the neighbours on either
    side, which may lie in another range, are compared.
    """
    r = requests.select("chr", (F.col("q_start") + F.col("q_end")).alias("at"), F.lit(1).alias("asked"), F.col("request_id").alias("id"))
    p = peaks.groupBy("chr", (F.col("start") + F.col("end")).alias("at")).agg(F.min("peak_id").alias("id")).select("chr", "at", F.lit(0).alias("asked"), "id")
    here = F.when(F.col("asked") == 0, F.struct("at", F.col("id").alias("peak_id")))
    near = neighbours_along(r.unionByName(p), "chr", ["at", "asked", "id"], here).where("asked = 1 and (_left is not null or _right is not null)")
    near = near.select(F.col("id").alias("request_id"), "at", F.col("_left").alias("l"), F.col("_right").alias("r"))
    dl, dr = F.col("at") - F.col("l.at"), F.col("r.at") - F.col("at")
    take = F.when(dr.isNull() | (dl < dr) | ((dl == dr) & (F.col("l.peak_id") < F.col("r.peak_id"))), F.struct(F.col("l.peak_id").alias("peak_id"), (dl / 2).alias("distance"))).otherwise(F.struct(F.col("r.peak_id").alias("peak_id"), (dr / 2).alias("distance")))
    return near.select("request_id", take.alias("m")).select("request_id", "m.peak_id", "m.distance")


def match_peaks(requests: DataFrame, peaks: DataFrame, width: int, nearest: bool) -> DataFrame:
    """Exact, else overlapping, else (if asked) nearest peak of each request, with the way it was found.

    Overlaps count in every mode; only the nearest step depends on the mode.
    """
    exact = requests.join(peaks.select("chr", F.col("start").alias("q_start"), F.col("end").alias("q_end"), "peak_id"), ["chr", "q_start", "q_end"]).groupBy("request_id").agg(F.min("peak_id").alias("exact"))
    out = requests.join(exact, "request_id", "left").join(overlap_match(requests, peaks, width).select("request_id", F.col("peak_id").alias("overlapping")), "request_id", "left")
    if nearest:
        out = out.join(nearest_match(requests, peaks).select("request_id", F.col("peak_id").alias("near")), "request_id", "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("long"))
    way = F.when(F.col("exact").isNotNull(), "exact").when(F.col("overlapping").isNotNull(), "overlap").when(F.col("near").isNotNull(), "nearest").otherwise("peak_not_found")
    return out.select("request_id", F.coalesce("exact", "overlapping", "near").alias("peak_id"), way.alias("match"))


def identify_genes(ids: DataFrame, reference: DataFrame) -> DataFrame:
    """Left join of gene ids on the reference by id without version, with the reason of those that do not match."""
    seen = ids.withColumn("norm_id", strip_version(F.col("raw_id")))
    count = Window.partitionBy("norm_id")
    joined = seen.withColumn("_n", F.count("*").over(count)).join(reference.select(strip_version(F.col("ref_id")).alias("norm_id"), "symbol"), "norm_id", "left")
    status = F.when(F.col("symbol").isNull(), "not_in_reference").when(F.col("_n") > 1, "duplicate_id").otherwise("ok")
    return joined.select("raw_id", "norm_id", "symbol", status.alias("status"))


def display_labels(reference: DataFrame) -> DataFrame:
    """The symbol of each id, numbered _01, _02 ... by id where several ids share it."""
    own = Window.partitionBy("symbol")
    number = F.row_number().over(own.orderBy("ref_id"))
    return reference.withColumn("_n", F.count("*").over(own)).withColumn("label", F.when(F.col("_n") > 1, F.concat("symbol", F.lit("_"), F.lpad(number.cast("string"), 2, "0"))).otherwise(F.col("symbol"))).drop("_n")


def resolve_tokens(tokens: DataFrame, reference: DataFrame, strict: bool = False) -> DataFrame:
    """Each token's id: the exact id, the id without version, a numbered label, or a symbol of a single gene in any case.

    A symbol of several genes is ambiguous: an error if strict, else status ambiguous.
    """
    labels = display_labels(reference)
    by_id = reference.select(F.col("ref_id").alias("token"), F.col("ref_id").alias("exact"))
    by_norm = reference.select(strip_version(F.col("ref_id")).alias("_k"), F.col("ref_id").alias("norm")).groupBy("_k").agg(F.min("norm").alias("norm"))
    by_label = labels.select(F.col("label").alias("token"), F.col("ref_id").alias("labelled")).groupBy("token").agg(F.min("labelled").alias("labelled"))
    by_symbol = reference.groupBy(F.lower("symbol").alias("_s")).agg(F.min("ref_id").alias("only"), F.count("*").alias("n_symbol"))
    out = tokens.join(by_id, "token", "left").withColumn("_k", strip_version(F.col("token"))).join(by_norm, "_k", "left").join(by_label, "token", "left").withColumn("_s", F.lower("token")).join(by_symbol, "_s", "left")
    found = F.coalesce("exact", "norm", "labelled", F.when(F.col("n_symbol") == 1, F.col("only")))
    status = F.when(found.isNotNull(), "ok").when(F.col("n_symbol") > 1, "ambiguous").otherwise("unknown")
    if strict:
        found = F.when(status == "ambiguous", F.raise_error(F.concat(F.lit("ambiguous gene: "), "token")).cast("string")).otherwise(found)
    return out.select("token", found.alias("ref_id"), status.alias("status"))


def expand_symbols(symbols: DataFrame, reference: DataFrame) -> DataFrame:
    """All ids of each symbol, in any case."""
    return symbols.join(reference.select(F.lower("symbol").alias("_s"), "ref_id"), F.lower(symbols["symbol"]) == F.col("_s")).drop("_s")
