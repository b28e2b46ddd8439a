"""Readers of genomic text formats as frames, and writers of the result formats."""

from __future__ import annotations

import json
import os
import posixpath
import re
from dataclasses import asdict, dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.names import feature_type as infer_type
from strandline.functions.names import file_prefix


def first_of(spark: SparkSession, folder: str, *names: str) -> str | None:
    """The first of some files that a folder has."""
    for name in names:
        try:
            spark.read.text(f"{folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        else:
            return f"{folder}/{name}"
    return None


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, place, value): the lines of one file; (block, place) grow along the file, a block being one of its splits."""
    return spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, value): the lines of one file numbered from 1, block by block."""
    lines = ordered_lines(spark, path)
    sizes = lines.groupBy("block").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("block").orderBy("place"))
    return lines.withColumn("_r", here).join(F.broadcast(sizes.select("block", start.alias("_s"))), "block").select((F.col("_r") + F.col("_s")).alias("i"), "value")


def read_matrix_market(spark: SparkSession, folder: str, feature_type: str | None = None) -> DataFrame:
    """(cell_id, feature_id, symbol, feature_type, value) of a 10x folder: barcodes, features and matrix, plain or (where there is no plain file) gzipped.

    A feature without a type is a peak if its name is one. Without a features file peaks.bed names the rows. A size line that does not
    agree with the axes and the number of entries is an error.
    """
    paths = {name: first_of(spark, folder, name, f"{name}.gz") for name in ("barcodes.tsv", "features.tsv", "genes.tsv", "peaks.bed", "matrix.mtx")}
    rows = paths["features.tsv"] or paths["genes.tsv"] or paths["peaks.bed"]
    if not (paths["barcodes.tsv"] and paths["matrix.mtx"] and rows):
        raise ValueError(f"{folder} needs barcodes.tsv, matrix.mtx and one of features.tsv, genes.tsv, peaks.bed")
    cells = numbered_lines(spark, paths["barcodes.tsv"]).select(F.col("i").alias("c"), F.split("value", "\t")[0].alias("cell_id"))
    part = lambda k: F.get(F.split("value", "\t"), F.lit(k))
    if rows == paths["peaks.bed"]:
        name = F.concat(part(0), F.lit(":"), part(1), F.lit("-"), part(2))
        features = numbered_lines(spark, rows).select(F.col("i").alias("r"), name.alias("feature_id"), name.alias("symbol"), F.lit("Peaks").alias("feature_type"))
    else:
        features = numbered_lines(spark, rows).select(F.col("i").alias("r"), part(0).alias("feature_id"), F.coalesce(part(1), part(0)).alias("symbol"), F.coalesce(part(2), infer_type(part(0))).alias("feature_type"))
    lines = ordered_lines(spark, paths["matrix.mtx"]).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = lines.agg(F.min(F.struct("block", "place", "value")).alias("h")).first()["h"]
    if head is None:
        raise ValueError(f"{paths['matrix.mtx']} has no size line")
    parts = F.split(F.trim("value"), r"\s+")
    entries = lines.where(~((F.col("block") == head["block"]) & (F.col("place") == head["place"]))).select(parts[0].cast("long").alias("r"), parts[1].cast("long").alias("c"), parts[2].cast("double").alias("value"))
    said, found = [int(x) for x in head["value"].split()], [features.count(), cells.count(), entries.count()]
    if said != found:
        raise ValueError(f"{paths['matrix.mtx']} says {said} rows, columns and entries, but there are {found}")
    joined = entries.join(features, "r").join(cells, "c").select("cell_id", "feature_id", "symbol", "feature_type", "value")
    return joined if feature_type is None else joined.where(F.col("feature_type") == feature_type)


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, symbol, chr, start, end, strand) of gene lines; coordinates become 0-based half-open.

    A line without nine columns, a gene without an id, or an id with two different annotations is an error.
    """
    cols = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    checked = lines.withColumn("_c", F.when(F.size(cols) == 9, cols).otherwise(F.raise_error(F.concat(F.lit("GTF line without 9 columns: "), F.substring("value", 1, 80))).cast("array<string>")))
    attribute = lambda k: F.nullif(F.regexp_extract(F.col("_c")[8], rf'(?:^|;)\s*{k}\s+"([^"]*)"', 1), F.lit(""))
    gene_id = attribute("gene_id")
    genes = checked.where(F.col("_c")[2] == "gene").select(
        F.coalesce(gene_id, F.raise_error(F.lit("GTF gene without gene_id")).cast("string")).alias("ref_id"), F.coalesce(attribute("gene_name"), gene_id).alias("symbol"),
        F.col("_c")[0].alias("chr"), (F.col("_c")[3].cast("long") - 1).alias("start"), F.col("_c")[4].cast("long").alias("end"), F.col("_c")[6].alias("strand"),
    ).distinct()
    twice = F.count("*").over(Window.partitionBy("ref_id"))
    return genes.withColumn("ref_id", F.when(twice > 1, F.raise_error(F.concat(F.lit("conflicting annotations of "), "ref_id")).cast("string")).otherwise(F.col("ref_id")))


def read_gtf_loosely(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(name, chr, tss) of wanted(name) genes by gene_name, else gene_id; short lines are passed over, and the last line of a name counts."""
    cols = F.split(F.trim("value"), "\t")
    lines = ordered_lines(spark, path).where(~F.col("value").startswith("#") & (F.size(cols) >= 9)).select("block", "place", cols.alias("c")).where(F.col("c")[2] == "gene")
    attribute = lambda k: F.nullif(F.regexp_extract(F.col("c")[8], rf'(?:^|;)\s*{k}[ =]\s*"?([^";]*)"?', 1), F.lit(""))
    tss = F.when(F.col("c")[6] == "+", F.col("c")[3]).otherwise(F.col("c")[4]).cast("long")
    found = lines.select("block", "place", F.col("c")[0].alias("chr"), tss.alias("tss"), F.posexplode(F.array(attribute("gene_name"), attribute("gene_id"))).alias("k", "name"))
    named = found.join(F.broadcast(wanted.select("name").distinct()), "name")
    one = named.groupBy("block", "place").agg(F.min(F.struct("k", "name", "chr", "tss")).alias("m"))
    return one.groupBy(F.col("m.name").alias("name")).agg(F.max_by(F.struct("m.chr", "m.tss"), F.struct("block", "place")).alias("l")).select("name", "l.chr", "l.tss")


#: Bases of a piece at most.
PIECE = 4096


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, at, seq): the lines of FASTA records as pieces of at most PIECE bases with their place from 0.

    Places are counted along a file's blocks: within a block by windows, and between blocks over one row each, so that no
    record has to fit a row or a task.
    """
    base = ordered_lines(spark, path).where(F.trim("value") != "").withColumn("head", F.col("value").startswith(">")).withColumn("n", F.when(F.col("head"), 0).otherwise(F.length(F.trim("value"))))
    order = Window.partitionBy("block").orderBy("place")
    runs = base.withColumn("run", F.sum(F.col("head").cast("int")).over(order)).withColumn("name", F.last(F.when(F.col("head"), F.regexp_extract("value", r"^>\s*([^\s]+)", 1)), True).over(order))
    ends = runs.groupBy("block").agg(F.max("run").alias("heads"), F.max_by("name", "place").alias("name"))
    tails = runs.join(F.broadcast(ends.select("block", "heads")), "block").where(F.col("run") == F.col("heads")).groupBy("block").agg(F.sum("n").alias("tail"))
    line = Window.orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    blocks = ends.join(tails, "block").withColumn("seg", F.sum((F.col("heads") > 0).cast("int")).over(line))
    blocks = blocks.withColumn("open", F.sum("tail").over(Window.partitionBy("seg").orderBy("block"))).withColumn("carry", F.coalesce(F.lag("open").over(line), F.lit(0))).withColumn("carried", F.last("name", True).over(before))
    here = F.sum("n").over(Window.partitionBy("block", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    placed = runs.withColumn("at", F.coalesce(here, F.lit(0))).join(F.broadcast(blocks.select("block", "carry", "carried")), "block").where("not head")
    first = F.col("run") == 0
    pieces = placed.select(F.when(first, F.col("carried")).otherwise(F.col("name")).alias("chrom"), (F.col("at") + F.when(first, F.col("carry")).otherwise(0)).alias("at"), F.posexplode(F.expr(f"regexp_extract_all(trim(value), '.{{1,{PIECE}}}', 0)")).alias("k", "seq"))
    return pieces.select("chrom", (F.col("at") + F.col("k") * PIECE).alias("at"), "seq")


def peak_sequences(peaks: DataFrame, genome: DataFrame) -> DataFrame:
    """(peak_id, seq) of peaks(peak_id, chr, start, end) that lie within their chromosomes, with or without chr in the name.

    genome has pieces (chrom, at, seq); peaks meet the pieces of the stretches of PIECE bases that they touch.
    """
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / PIECE), F.floor(b / PIECE)))
    p = peaks.where((F.col("start") >= 0) & (F.col("end") > F.col("start"))).select("peak_id", "start", "end", bare(F.col("chr")).alias("_k"), spread(F.col("start"), F.col("end") - 1).alias("_b"))
    g = genome.withColumn("_to", F.col("at") + F.length("seq")).select("at", "_to", "seq", bare(F.col("chrom")).alias("_k"), spread(F.col("at"), F.col("_to") - 1).alias("_b"))
    both = p.join(g, ["_k", "_b"]).where((F.col("at") < F.col("end")) & (F.col("_to") > F.col("start")))
    cut = F.substring("seq", F.greatest(F.col("start") - F.col("at"), F.lit(0)).cast("int") + 1, (F.least("_to", "end") - F.greatest("at", "start")).cast("int"))
    whole = both.groupBy("peak_id", "start", "end").agg(F.array_sort(F.collect_set(F.struct(F.col("at"), cut.alias("s")))).alias("l"))
    return whole.select("peak_id", "start", "end", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("seq")).where(F.length("seq") == F.col("end") - F.col("start")).select("peak_id", "seq")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(motif_id, counts) of a count-matrix file: a > line and then one line of A, C, G, T counts a position."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    rows = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return records.select(F.regexp_extract("value", r"^([^\s]+)", 1).alias("motif_id"), F.transform(F.slice(rows, 2, F.size(rows)), lambda r: F.split(F.trim(r), r"\s+").cast("array<double>")).alias("counts"))


def read_motif_factors(spark: SparkSession, path: str) -> DataFrame:
    """(motif_id, tf_names) of a two-column motif and factor file: factors upper case, joined by :: in order."""
    parts = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 2))
    return rows.groupBy(parts[0].alias("motif_id")).agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim(parts[1])))), "::").alias("tf_names")).where("motif_id <> 'Motif'")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(token, kind) of a target list: a gene and optionally TF or TARGET a line, # for comments; ALL stands for every feature."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(text, r"\s+")
    return spark.read.text(path).where(text != "").select(parts[0].alias("token"), F.upper(F.coalesce(F.get(parts, F.lit(1)), F.lit("TARGET"))).alias("kind")).distinct()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="chr string, start long, end long, name string")


def write_bed(rows: DataFrame, path: str) -> None:
    """Tab-separated chrom, start, end, name, score."""
    rows.select("chrom", "start", "end", "name", "score").write.csv(path, sep="\t")


def write_results(results: dict[str, DataFrame], path: str, details: bool = False, heavy: frozenset[str] = frozenset({"routes", "history", "contributions"})) -> list[str]:
    """Write each named frame as CSV with a header; heavy ones only where details are asked for. Returns the names written."""
    names = [n for n in results if details or n not in heavy]
    for n in names:
        results[n].write.csv(f"{path}/{n}", header=True)
    return names


def write_by_intervention(rows: DataFrame, path: str) -> None:
    """One folder for each target, its name made safe and unique."""
    rows.withColumn("target", file_prefix(F.col("target_gene"))).write.partitionBy("target").csv(path, header=True)


def append_hits(new: DataFrame, path: str) -> int:
    """Add hits(key, payload) not stored before; a stored key with another payload is an error. Returns how many were added."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new.write.parquet(path)
        return new.count()
    clash = new.join(old.withColumnRenamed("payload", "_old"), "key").where("payload <> _old")
    if not clash.isEmpty():
        raise ValueError("stored hits differ from new ones of the same key")
    add = new.join(old.select("key"), "key", "left_anti")
    n = add.count()
    if n:
        add.write.mode("append").parquet(path)
    return n


def lookup_hits(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Stored hits of a batch of keys (150 at most): the condition reaches the files' statistics."""
    if len(keys) > 150:
        raise ValueError("at most 150 keys a look-up; join larger sets")
    return spark.read.parquet(path).where(F.col("key").isin(keys))


def read_history(spark: SparkSession, path: str, schema: str, genes: list[str], column: str = "gene") -> DataFrame:
    """Rows of some genes of a CSV history with a header; the condition is pushed into the scan."""
    return spark.read.csv(path, header=True, schema=schema).where(F.col(column).isin(genes))


def write_variable_genes(features: DataFrame, path: str) -> None:
    """Names of truly variable features(feature_id, highly_variable, forced); those only kept by request are left out."""
    features.where("highly_variable and not coalesce(forced, false)").select("feature_id").orderBy("feature_id").write.text(path)


def leaves(config: dict, at: tuple = ()) -> dict[tuple, object]:
    """Values of a nested mapping by their paths; an empty mapping is a value."""
    out: dict[tuple, object] = {}
    for key, value in config.items():
        out |= leaves(value, (*at, key)) if isinstance(value, dict) and value else {(*at, key): value}
    return out


def layered(*layers: dict) -> dict:
    """Nested mappings over one another: a later value replaces what stands at its path, above it or below it; an empty mapping only fills a gap."""
    kept: dict[tuple, object] = {}
    for layer in layers:
        for path, value in leaves(layer).items():
            inside = [p for p in kept if p[: len(path)] == path]
            if value == {} and any(len(p) > len(path) or kept[p] == {} for p in inside):
                continue
            for p in [*inside, *(path[:k] for k in range(1, len(path)))]:
                kept.pop(p, None)
            kept[path] = value
    out: dict = {}
    for path, value in kept.items():
        here = out
        for key in path[:-1]:
            here = here.setdefault(key, {})
        here[path[-1]] = dict(value) if isinstance(value, dict) else value
    return out


def load_config(text: str, defaults: dict) -> dict:
    """A configuration in JSON (or in YAML, where its parser is installed) over defaults."""
    try:
        given = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as error:
            raise ValueError("the configuration is not JSON, and no YAML parser is installed") from error
        given = yaml.safe_load(text)
    if not isinstance(given, dict):
        raise ValueError("a configuration is a mapping")
    return layered(defaults, given)


#: The fields of a configuration that are paths.
PATH_FIELDS = {"input": ("rna_h5ad", "atac_h5ad", "annotation_gtf", "genome_fasta", "target_genes"), "output": ("dir", "cache_dir", "checkpoint_dir")}


def located(config: dict, folder: str) -> dict:
    """config with relative paths taken from `folder`; absolute ones and those with a scheme stay, and variables of the environment are filled in."""
    found: dict = {}
    for section, fields_ in PATH_FIELDS.items():
        for name in fields_:
            value = config.get(section, {}).get(name)
            if value is not None:
                path = os.path.expanduser(os.path.expandvars(str(value)))
                found.setdefault(section, {})[name] = path if re.match(r"\w+:", path) else posixpath.normpath(posixpath.join(folder, path))
    return layered(config, found)


#: What a task may hold: field, type, whether it has to be there once defaults are under it.
TASK_FIELDS = [("name", str, True), ("knockout_genes", list, True), ("base_config", str, False), ("input", dict, False), ("output", dict, False), ("overrides", dict, False), ("joint_knockout", bool, False)]
#: Folders that a task (or the defaults) names itself, so that none is taken over from a base.
OWN_FOLDERS = ("dir", "cache_dir")


def target_rows(values: list) -> tuple[list[tuple[str, str]], list[str]]:
    """(gene, TF or TARGET) of a task's knock-outs, names or mappings of gene and type, and what is wrong with them."""
    rows, faults = [], [] if values else ["knockout_genes is empty"]
    for value in values:
        entry = {"gene": value} if isinstance(value, str) else value if isinstance(value, dict) else {}
        gene, kind = entry.get("gene"), str(entry.get("type", "TF")).upper()
        plain = isinstance(gene, str) and gene and not re.search(r"\s|^#|^all", gene, re.IGNORECASE)
        if not plain or kind not in ("TF", "TARGET") or entry.keys() - {"gene", "type"}:
            faults.append(f"{value!r} is no knock-out")
        rows.append((gene, kind))
    twice = sorted({g for g, _ in rows if isinstance(g, str) and sum(g == other for other, _ in rows) > 1})
    return rows, faults + [f"{g} is knocked out twice" for g in twice]


def task_faults(task: object) -> list[str]:
    """What is wrong with one task, defaults under it, by the table of fields."""
    if not isinstance(task, dict):
        return ["not a mapping"]
    faults = [f"no field {f!r} is known" for f in sorted(task.keys() - {f for f, _, _ in TASK_FIELDS})]
    for field_, kind, needed in TASK_FIELDS:
        if field_ not in task:
            faults += [f"{field_} is missing"] * needed
        elif not isinstance(task[field_], kind):
            faults.append(f"{field_} is not a {kind.__name__}")
    if isinstance(task.get("name"), str) and (set(task["name"]) <= {"."} and len(task["name"]) < 3 or not re.fullmatch(r"[\w.-]+", task["name"], re.ASCII)):
        faults.append("the name is no folder's")
    if isinstance(task.get("knockout_genes"), list):
        faults += target_rows(task["knockout_genes"])[1]
    return faults


def batch_plans(manifest: dict, base: dict, order: list[str] | None = None, bases: dict[str, dict] | None = None, folder: str | None = None) -> list[dict]:
    """Plans (name, config, targets) of a manifest's tasks, in the order given; all faults of all tasks are told at once.

    A configuration is the base (or the one of `bases` that base_config names), under it the overrides, then input and output. joint_knockout is set only
    where the manifest says so. With a folder (the manifest's), the tasks' relative paths are taken from it; bases come with theirs. Output folders come from the task or the defaults, one `dir` a task; a checkpoint folder of the base is dropped.
    """
    defaults, listed = manifest.get("defaults", {}), manifest.get("tasks")
    if not isinstance(defaults, dict) or not isinstance(listed, list) or not listed:
        raise ValueError("a manifest has a mapping of defaults and a list of tasks")
    tasks = [layered(defaults, t) if isinstance(t, dict) else t for t in listed]
    faults = [(k, fault) for k, t in enumerate(tasks) for fault in task_faults(t)]
    plans, seen = [], {"name": {}, "output.dir": {}}
    for k, task in enumerate(tasks):
        if any(at == k for at, _ in faults):
            continue
        own = layered(task.get("overrides", {}), {f: task[f] for f in ("input", "output") if f in task})
        own = located(own, folder) if folder else own
        output = own.get("output", {})
        faults += [(k, f"output.{f} is not given") for f in OWN_FOLDERS if not output.get(f)]
        under = task.get("base_config")
        if under is not None and under not in (bases or {}):
            faults.append((k, f"base_config {under} is not there"))
        said = {"joint_knockout": task["joint_knockout"]} if "joint_knockout" in task else {}
        config = layered((bases or {}).get(under, base), {"output": {"checkpoint_dir": None}}, own, {"perturbation": said | {"knockout_type": "gene"}})
        plans.append({"name": task["name"], "config": config, "targets": target_rows(task["knockout_genes"])[0]})
        for what, value in (("name", task["name"]), ("output.dir", output.get("dir"))):
            seen[what].setdefault(value, []).append(k)
    faults += [(ks[-1], f"{what} {value} is another task's") for what, values in seen.items() for value, ks in values.items() if len(ks) > 1 and value]
    if faults:
        raise ValueError("; ".join(f"task {k + 1}: {fault}" for k, fault in sorted(faults, key=lambda f: f[0])))
    wanted = {name: k for k, name in enumerate(order)} if order is not None else {p["name"]: k for k, p in enumerate(plans)}
    if order is not None and (len(wanted) < len(order) or wanted.keys() - {p["name"] for p in plans}):
        raise ValueError("the order names unknown tasks or one twice")
    return sorted((p for p in plans if p["name"] in wanted), key=lambda p: wanted[p["name"]])


@dataclass(frozen=True)
class Settings:
    """Screening settings with the library's defaults; `shipped` are the stricter ones of the delivered configuration."""

    distance: int = 1_000_000
    alpha: float = 0.10
    least_effect: float = 0.02
    least_cells: int = 10
    most_bins: int = 50
    smoothing: str = "gaussian"
    overlap: float = 2.0
    aggregation: str = "strict_complete"

    @staticmethod
    def shipped() -> Settings:
        return Settings(distance=200_000, alpha=0.01, least_effect=0.1, aggregation="valid_cell_means")

    def merged(self, given: dict) -> Settings:
        """These settings with some replaced; unknown names are an error."""
        unknown = set(given) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **given)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def save_stage(df: DataFrame, path: str, settings: Settings) -> None:
    """A stage's table with its provenance: settings, schema and an order-free content hash."""
    df.write.parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(settings.to_json(), df.schema.json(), content_hash(spark.read.parquet(f"{path}/data")))], "settings string, schema string, hash string").coalesce(1).write.json(f"{path}/provenance")


def load_stage(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """A saved stage; other settings or changed content are refused."""
    kept = spark.read.json(f"{path}/provenance").first()
    if kept["settings"] != settings.to_json():
        raise ValueError("the stage was made with other settings")
    df = spark.read.parquet(f"{path}/data")
    if kept["hash"] != content_hash(df):
        raise ValueError("the stage's content has changed")
    return df


def content_hash(df: DataFrame) -> str:
    """A hash of a frame's rows whatever their order: sums of two 64-bit row hashes."""
    cols = sorted(df.columns)
    a, b = (F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in (1, 2))
    row = df.agg(a.alias("a"), b.alias("b"), F.count("*").alias("n")).first()
    return f"{row['a']}:{row['b']}:{row['n']}"
