"""The tree store: JSON or gzipped JSON files as tables, and tables as Parquet.

Layout under one folder: attribute-statics, qc-specs, available-rca-baselines,
rca-baselines/<name>, root-descriptions, qc-builds/<spec>/<root>; each a file
with suffix .json or .json.gz.  Trees are flattened to node rows as they are
read; deep recursion never becomes a nested column type.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import BASELINE, LABEL, NODE, Level, QuerySpec


def _files(spark: SparkSession, base: str, endpoint: str) -> DataFrame:
    """path and content of the endpoint's files; Spark's text source unzips .gz by itself."""
    found = spark.read.text([f"{base}/{endpoint}.json*"], wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _parsed(content: str) -> object:
    """The JSON value, or None where it is malformed."""
    try:
        return json.loads(content)
    except (TypeError, ValueError):
        return None


def read_labels(spark: SparkSession, base: str) -> DataFrame:
    """attribute-statics as entity_type, id, name, meta (JSON text)."""
    entry = "map<string,map<string,struct<name:string,meta:string>>>"
    kinds = _files(spark, base, "attribute-statics").select(F.explode(F.from_json("content", entry)).alias("entity_type", "entities"))
    return kinds.select("entity_type", F.explode("entities").alias("id", "e")).select("entity_type", "id", "e.name", "e.meta").to(LABEL)


def with_parsed_meta(labels: DataFrame) -> DataFrame:
    """meta as a map; malformed or null text is an empty map."""
    return labels.withColumn("meta", F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>")))


def read_specs(spark: SparkSession, base: str) -> dict[str, QuerySpec]:
    """qc-specs; a spec table is small by nature and lives on the driver."""
    out = {}
    for row in _files(spark, base, "qc-specs").collect():
        for key, s in (_parsed(row["content"]) or {}).items():
            levels = tuple(Level(b["attribute_kind"], b["resolver_id"], b.get("control_format_str") or "{}", b.get("description") or "") for b in s["bifurcations"])
            out[key] = QuerySpec(key, s["root_entity_type"], levels, s.get("title", ""), s.get("description", ""))
    return out


def read_root_descriptions(spark: SparkSession, base: str, entity_type: str | None = None) -> DataFrame:
    entry = "map<string,array<struct<id:string,name:string,meta:string>>>"
    kinds = _files(spark, base, "root-descriptions").select(F.explode(F.from_json("content", entry)).alias("entity_type", "options"))
    kinds = kinds if entity_type is None else kinds.where(F.col("entity_type") == entity_type)
    return kinds.select("entity_type", F.inline("options")).to(LABEL)


def read_baseline_catalog(spark: SparkSession, base: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Names of the available baselines, without the ignored ones."""
    rows = _files(spark, base, "available-rca-baselines").select(F.explode(F.from_json("content", "baselines array<array<string>>")["baselines"]).alias("b"))
    rows = rows.select(*[F.get("b", i).alias(n) for i, n in enumerate(("root_type", "target", "basis", "hierarchy"))])
    return rows.withColumn("name", F.concat_ws("-", *rows.columns)).where(~F.col("name").isin(*ignored) if ignored else F.lit(True))


def read_baselines(spark: SparkSession, base: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """All baselines of the catalog as one long table."""
    catalog = read_baseline_catalog(spark, base, ignored)

    def flat(value: object, depth: int) -> Iterator[tuple[list[str], float]]:
        if depth == 0:
            yield [], float(value)
        elif isinstance(value, dict):
            for k, v in value.items():
                yield from (([k, *keys], rate) for keys, rate in flat(v, depth - 1))

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                by_basis, by_parent = r.basis != "Global", r.hierarchy != "Global"
                for keys, rate in flat(_parsed(r.content), 1 + by_basis + by_parent):
                    out.append((r.root_type, r.target, r.basis, r.hierarchy, keys[0] if by_basis else None, keys[by_basis] if by_parent else None, keys[-1], rate))
            yield pd.DataFrame(out, columns=BASELINE.names)

    files = _files(spark, base, "rca-baselines/*").withColumn("name", F.regexp_extract("path", r"([^/]+)\.json(?:\.gz)?$", 1))
    return catalog.join(files, "name").mapInPandas(run, BASELINE)


def read_trees(spark: SparkSession, base: str, spec_id: str = "*", root_id: str = "*") -> DataFrame:
    """qc-builds as node rows; children may be a map by id or a list of named nodes. Only the wanted files are read."""

    def walk(node: dict, path: list[str]) -> Iterator[tuple[list[str], float]]:
        todo = [(node, path)]
        while todo:
            node, path = todo.pop()
            yield path, float(node.get("weight") or 0)
            children = node.get("children") or {}
            pairs = children.items() if isinstance(children, dict) else ((str(c["name"]), c) for c in children)
            todo += [(c, [*path, k]) for k, c in pairs]

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                tree = _parsed(r.content)
                for path, weight in walk(tree, []) if isinstance(tree, dict) else ():
                    out.append((r.spec_id, r.root_id, len(path), path, path[:-1] if path else None, path[-1] if path else None, weight))
            yield pd.DataFrame(out, columns=NODE.names)

    files = _files(spark, base, f"qc-builds/{spec_id}/{root_id}")
    name = r"qc-builds/([^/]+)/([^/]+?)\.json(?:\.gz)?$"
    return files.select(F.regexp_extract("path", name, 1).alias("spec_id"), F.regexp_extract("path", name, 2).alias("root_id"), "content").mapInPandas(run, NODE)


def write_trees(nodes: DataFrame, base: str) -> None:
    """Each root's nodes as qc-builds/<spec>/<root>.json.gz; a root's tree is one file, so one task writes it.

    base is a folder that all executors reach, by any path that Spark writes to: Spark
    writes one text file a root, which then gets its name.
    """
    import pandas as pd

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {"weight": 0.0, "children": {}}
        for path, weight in sorted(zip((list(x) for x in pdf["path"]), pdf["weight"]), key=lambda r: len(r[0])):
            at = root
            for step in path:
                at = at["children"].setdefault(step, {"weight": 0.0, "children": {}})
            at["weight"] = float(weight)
        return pd.DataFrame({"spec_id": pdf["spec_id"][:1], "root_id": pdf["root_id"][:1], "value": [json.dumps(root)]})

    spark = nodes.sparkSession
    trees = nodes.select("spec_id", "root_id", "path", "weight").groupBy("spec_id", "root_id").applyInPandas(tree, "spec_id string, root_id string, value string")
    trees.write.partitionBy("spec_id", "root_id").option("compression", "gzip").text(f"{base}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{base}/parts/spec_id=*/root_id=*/part-*")):
        at = f.getPath()
        spec, root = (at.getParent().getParent().getName().split("=")[1], at.getParent().getName().split("=")[1])
        fs.mkdirs(path(f"{base}/qc-builds/{spec}"))
        fs.rename(at, path(f"{base}/qc-builds/{spec}/{root}.json.gz"))
    fs.delete(path(f"{base}/parts"), True)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Node table as Parquet, one folder a spec, rows of a root together: a root's read prunes files by statistics."""
    nodes.repartition("spec_id", "root_id").sortWithinPartitions("root_id", "level").write.mode("overwrite").partitionBy("spec_id").parquet(path)


def read_nodes(spark: SparkSession, path: str, spec_id: str, root_id: str | None = None) -> DataFrame:
    nodes = spark.read.parquet(path).where(F.col("spec_id") == spec_id)
    return nodes if root_id is None else nodes.where(F.col("root_id") == root_id)


def write_baselines(baselines: DataFrame, path: str) -> None:
    baselines.write.mode("overwrite").partitionBy("root_type", "target", "basis", "hierarchy").parquet(path)
