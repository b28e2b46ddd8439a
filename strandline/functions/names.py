"""Column expressions on identifiers: genes, peaks, files, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK = r"^([^:]+?)[:-]([0-9]+)-([0-9]+)$"


def strip_version(gene_id: Column) -> Column:
    return F.regexp_replace(F.trim(gene_id), r"\.[0-9]+$", "")


def root_name(symbol: Column) -> Column:
    """The symbol without trailing digits, upper case."""
    return F.regexp_replace(F.upper(symbol), r"[0-9]+$", "")


def peak_part(name: Column, part: int) -> Column:
    """chr, start or end (1 to 3) of chr:start-end or chr-start-end; null where the name is no peak."""
    found = F.regexp_extract(name, PEAK, part)
    return F.when(found != "", found)


def plain_coordinates(request: Column) -> Column:
    """A coordinate request without thousands commas and with plain hyphens."""
    return F.translate(request, "‐‑‒–—−,", "------")


def feature_type(name: Column) -> Column:
    return F.when(name.rlike(PEAK), "Peaks").otherwise("Gene Expression")


def tss(strand: Column, start: Column, end: Column) -> Column:
    """Transcription start of a 0-based half-open gene."""
    return F.when(strand == "-", end - 1).otherwise(start)


def strict_flag(value: Column) -> Column:
    """true/false of a textual flag; anything else is an error, null stays null."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1", "yes", "t"), True).when(low.isin("false", "0", "no", "f"), False).when(low.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), low)).cast("boolean"))


def file_prefix(name: Column) -> Column:
    """A name made safe for files, with a hash of the original so that two names never share one."""
    return F.concat(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, 80), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8))


def cluster_id(label: Column) -> Column:
    return F.regexp_replace(label, r"^cluster_", "")
