"""Modules, import edges and the hash tree of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalised
from tessera.operators.chunking import file_facts

# What may follow an import specifier, in order of priority.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]


def import_edges(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst) of relative imports (path, specifier) that name a known path; the first candidate that exists wins."""
    base = normalised(F.concat_ws("/", F.regexp_replace("path", r"/?[^/]*$", ""), "specifier"))
    tried = imports.filter(F.col("specifier").startswith(".")).select(F.col("path").alias("src"), "specifier", F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(base, s))).alias("pos", "dst"))
    found = tried.join(paths.select(F.col("path").alias("dst")).distinct(), "dst")
    return found.groupBy("src", "specifier").agg(F.min_by("dst", "pos").alias("dst")).select("src", "dst").distinct()


def file_edges(files: DataFrame) -> DataFrame:
    """(src, dst): what (path, content) files import from one another, by their own import statements."""
    said = file_facts(files).filter("kind = 'import' and target is null").select(F.col("file_path").alias("path"), F.col("name").alias("specifier"))
    return import_edges(said, files.select("path"))


def cross_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, target, edges) counts of edges between different modules. modules: (path, module)."""
    a = modules.select(F.col("path").alias("src"), "module")
    b = modules.select(F.col("path").alias("dst"), F.col("module").alias("target"))
    return edges.join(a, "src").join(b, "dst").filter("module <> target").groupBy("module", "target").agg(F.count(F.lit(1)).alias("edges"))


def merges(edge_counts: DataFrame, modules: DataFrame, most_files: int = 3, least_edges: int = 2, share: float = 0.6) -> DataFrame:
    """(module, merged_into): small modules whose edges go to one other module by more than `share`; decided on the original assignment."""
    small = modules.groupBy("module").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") <= most_files)
    each = Window.partitionBy("module")
    ranked = edge_counts.withColumn("total", F.sum("edges").over(each)).withColumn("n", F.row_number().over(each.orderBy(F.desc("edges"), "target")))
    best = ranked.filter((F.col("n") == 1) & (F.col("total") >= least_edges) & (F.col("edges") / F.col("total") > share))
    return best.join(small, "module").select("module", F.col("target").alias("merged_into"))


def assignments(modules: DataFrame, merged: DataFrame) -> DataFrame:
    """(path, module, moved): `modules` (path, module) after `merged` (module, merged_into); one step, as merges are decided on the original assignment."""
    return modules.join(merged, "module", "left").select("path", F.coalesce("merged_into", "module").alias("module"), F.col("merged_into").isNotNull().alias("moved"))


def parent_hashes(rows: DataFrame, parent: str, child_hash: str, name: str = "hash") -> DataFrame:
    """(parent, hash): sha256 over the sorted child hashes, joined by |. The order of rows doesn't matter.

    All child hashes of a parent come together in one row, 65 bytes each, so a parent may have up to about 30 million children: a
    folder's files or a repository's folders, not all files of everything.
    """
    return rows.groupBy(parent).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child_hash)), "|"), 256).alias(name))
