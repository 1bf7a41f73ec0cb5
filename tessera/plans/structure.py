"""Module discovery, import graph and path queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import denied, extension, module_name, uri_component
from tessera.operators import search, structure
from tessera.plans.registry import query
from tessera.sources.tables import table

EDGES = """
edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
counts AS (SELECT src % 400 AS module, dst % 7 + 1000 AS target, count(*) AS edges FROM edges GROUP BY 1, 2)
"""


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Utilities' WHEN 1 THEN 'User Profile' || doc_id WHEN 2 THEN upper(substr(source, 1, 1)) || substr(source, 2) WHEN 3 THEN 'Root' ELSE 'Configuration' END AS module,
  CASE doc_id % 5 WHEN 3 THEN '.py' WHEN 4 THEN '' ELSE '.ts' END AS ext FROM documents
""")
def module_names(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id") % 5
    path = (
        F.when(n == 0, F.concat(F.lit("src/utils/"), "doc_id", F.lit(".ts")))
        .when(n == 1, F.concat(F.lit("src/controllers/user-profile"), "doc_id", F.lit(".controller.ts")))
        .when(n == 2, F.concat(F.lit("App/"), "source", F.lit("/x.TS")))
        .when(n == 3, F.lit("src/main.py"))
        .otherwise(F.lit("src/services/config/.env"))
    )
    return table(spark, folder, "documents").select("doc_id", module_name(path).alias("module"), extension(path).alias("ext"))


@query("""
SELECT page_id AS src_id, CASE WHEN page_id % 3 = 0 THEN (page_id + 1)::VARCHAR || '.ts' ELSE 'lib/index.ts' END AS dst FROM pages
WHERE (page_id % 3 = 0 AND page_id + 1 IN (SELECT page_id FROM pages)) OR page_id % 3 = 1
""")
def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    """'./7' from src/6.ts, '../lib' from src/7.ts, and a package that is not in the tree."""
    pages = table(spark, folder, "pages").select("page_id")
    paths = pages.select(F.concat(F.lit("src/"), "page_id", F.lit(".ts")).alias("path"))
    imports = pages.select(
        F.concat(F.lit("src/"), "page_id", F.lit(".ts")).alias("path"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("./"), (F.col("page_id") + 1).cast("string"))).when(F.col("page_id") % 3 == 1, "../lib").otherwise("react").alias("specifier"),
    )
    edges = structure.import_edges(imports, paths.unionByName(spark.createDataFrame([("lib/index.ts",)], "path string")))
    return edges.select(F.regexp_extract("src", r"(\d+)", 1).cast("long").alias("src_id"), F.regexp_replace("dst", "^src/", "").alias("dst"))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, folder, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    parts = table(spark, folder, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), (F.col("p_partkey") % 400).alias("module"))
    suppliers = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), (F.col("s_suppkey") % 7 + 1000).alias("module"))
    return edges, parts.unionByName(suppliers)


@query(f"WITH {EDGES} SELECT c.module, c.target, c.edges FROM counts c")
def cross_module_edges(spark: SparkSession, folder: str) -> DataFrame:
    return structure.cross_edges(*_graph(spark, folder))


MERGES = """
WITH files AS (SELECT o_orderkey AS file, 2 * (o_orderkey // 7) + CASE WHEN o_orderkey % 7 < 3 THEN 0 ELSE 1 END AS module FROM orders),
edges AS (SELECT DISTINCT module, l_orderkey, l_suppkey FROM lineitem JOIN files ON file = l_orderkey),
counts AS (SELECT module, -1 - CASE WHEN l_suppkey % 5 < 3 THEN 0 ELSE l_suppkey % 5 END AS target, count(*) AS edges FROM edges GROUP BY 1, 2),
r AS (SELECT *, sum(edges) OVER (PARTITION BY module) AS total, row_number() OVER (PARTITION BY module ORDER BY edges DESC, target) AS k FROM counts),
small AS (SELECT module, count(*) AS files FROM files GROUP BY 1),
merged AS (SELECT module, target FROM r JOIN small USING (module) WHERE k = 1 AND files <= 3 AND total >= 2 AND 5 * edges > 3 * total)
"""


def _modules(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as files in modules of three and of four, suppliers as files of three large modules, lines as imports: about three edges in five go to one of those, so shares lie around 0.6, on it too."""
    key, to = F.col("o_orderkey"), F.col("s_suppkey") % 5
    small = table(spark, folder, "orders").select(F.concat(F.lit("o"), key).alias("path"), (2 * F.floor(key / 7) + F.when(key % 7 < 3, 0).otherwise(1)).cast("long").alias("module"))
    large = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), (-1 - F.when(to < 3, 0).otherwise(to)).cast("long").alias("module"))
    edges = table(spark, folder, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return edges, small.unionByName(large)


@query(f"{MERGES} SELECT module, target AS merged_into FROM merged")
def module_merge(spark: SparkSession, folder: str) -> DataFrame:
    edges, modules = _modules(spark, folder)
    return structure.merges(structure.cross_edges(edges, modules), modules)


@query(f"{MERGES} SELECT file, coalesce(target, module) AS module, target IS NOT NULL AS moved FROM files LEFT JOIN merged USING (module)")
def module_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's module after small modules were merged."""
    edges, modules = _modules(spark, folder)
    rows = structure.assignments(modules, structure.merges(structure.cross_edges(edges, modules), modules))
    return rows.filter(F.col("path").startswith("o")).select(F.substring("path", 2, 20).cast("long").alias("file"), "module", "moved")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def component_first_n(spark: SparkSession, folder: str) -> DataFrame:
    return search.first_of_each(table(spark, folder, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("""
SELECT source, count(*) AS files, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) FILTER (WHERE lang = 'en') AS english FROM documents GROUP BY source
""")
def module_file_lists(spark: SparkSession, folder: str) -> DataFrame:
    english = F.count_if(F.col("lang") == "en")
    return table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), english.alias("english"))


@query(r"""
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'web/yarn.lock' WHEN 1 THEN 'dist/a.js' WHEN 2 THEN 'logo.PNG' WHEN 3 THEN 'src/dist/a.js' WHEN 4 THEN 'a.min.ts' ELSE url END AS path FROM pages)
SELECT page_id, path FROM p WHERE path IN ('src/dist/a.js', 'a.min.ts') OR (page_id % 6 = 5 AND NOT regexp_matches(path, '\.min\.(js|css)$'))
""")
def deny_list(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page_id") % 6
    path = F.when(n == 0, "web/yarn.lock").when(n == 1, "dist/a.js").when(n == 2, "logo.PNG").when(n == 3, "src/dist/a.js").when(n == 4, "a.min.ts").otherwise(F.col("url"))
    return table(spark, folder, "pages").select("page_id", path.alias("path")).filter(~denied(F.col("path")))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS tail, replace(url, '://', '%3A%2F%2F') AS half_encoded FROM pages")
def url_tail(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    encoded = F.replace(F.col("url"), F.lit("://"), F.url_encode(F.lit("://")))
    return pages.select("page_id", F.element_at(F.split("url", "/", -1), -1).alias("tail"), encoded.alias("half_encoded"))


@query(r"""
SELECT page_id, replace(replace(replace(replace(replace(url_encode('is:open ' || url || ' (a*b)!~' || chr(39) || 'é+'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM pages
""")
def url_encoded(spark: SparkSession, folder: str) -> DataFrame:
    """A search text as a part of an address."""
    return table(spark, folder, "pages").select("page_id", uri_component(F.concat(F.lit("is:open "), "url", F.lit(" (a*b)!~'é+"))).alias("encoded"))
