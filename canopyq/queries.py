"""The registered queries of the drill-down engine, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import numbers, text
from .model import ENTITY_KINDS, Basis, Control, Level, QuerySpec
from .operators import baselines, layout, lookup, metrics, rollup, search, selection, visible
from .plans import commands
from .sources import star, store
from .sources.shared import shared_checkpoint, shared_folder
from .sources.star import SPECS, table

ROOT = "3"
#: The frames of the as-of lookup.
FRAMES = (0, 3, 5, 8, 10)
POINTS = (-2, 0, 1, 3, 6, 8, 9, 11)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# ---- SQL building blocks ----

FLOW = """flow AS (SELECT s_nationkey AS root, n_regionkey AS region, c_nationkey AS nation, CAST(substr(p_brand, 7) AS INT) AS brand, t.type AS type, year(l_shipdate) AS year, o_orderkey AS order_id, o_orderpriority AS priority
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN part ON l_partkey = p_partkey JOIN (SELECT p_type AS k, dense_rank() OVER (ORDER BY p_type) AS type FROM (SELECT DISTINCT p_type FROM part)) t ON p_type = t.k)"""


def node_sql(spec_id: str, name: str = "node") -> str:
    """CTE of a spec's nodes: root, level, k, pk, ids, child, w; a and b: ids at levels 1 and 2."""
    a, b, c = SPECS[spec_id].columns
    return f"""{name} AS MATERIALIZED (SELECT root, (3 - (GROUPING({a}) + GROUPING({b}) + GROUPING({c})))::INT AS level,
 concat_ws('-', {a}, {b}, {c}) AS k, CASE WHEN GROUPING({a}) = 1 THEN NULL WHEN GROUPING({b}) = 1 THEN '' WHEN GROUPING({c}) = 1 THEN concat_ws('-', {a}) ELSE concat_ws('-', {a}, {b}) END AS pk,
 list_filter([{a}, {b}, {c}], lambda x: x IS NOT NULL) AS ids, coalesce({c}, {b}, {a}) AS child, {a} AS a, {b} AS b, count(*) AS w
 FROM flow GROUP BY GROUPING SETS ((root), (root, {a}), (root, {a}, {b}), (root, {a}, {b}, {c})))"""


def names_sql(kind: str) -> str:
    return {
        "Region": "SELECT r_regionkey AS id, r_name AS name FROM region",
        "Nation": "SELECT n_nationkey AS id, n_name AS name FROM nation",
        "Brand": "SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS id, p_brand AS name FROM part",
        "Type": "SELECT dense_rank() OVER (ORDER BY p_type) AS id, p_type AS name FROM (SELECT DISTINCT p_type FROM part)",
        "Year": "SELECT DISTINCT year(l_shipdate) AS id, CAST(year(l_shipdate) AS VARCHAR) AS name FROM lineitem",
    }[kind]


def visible_sql(spec_id: str, controls: list[Control], keys: list[str], root: str | None = None, extra: str = "", derived: dict[int, str] | None = None) -> str:
    """CTEs lv1 .. lvN of the visible levels, each with ranks, offsets and scales; derived: by level, the size's SQL over n."""
    spec = SPECS[spec_id]
    quoted = ", ".join(f"'{k}'" for k in keys) or "NULL"
    where = f"WHERE root = {root}" if root else ""
    out = [FLOW, node_sql(spec_id, "every"), f"node AS MATERIALIZED (SELECT * FROM every {where})", *([extra] if extra else [])]
    out.append("lv0 AS (SELECT root, 0 AS level, '' AS k, NULL::VARCHAR AS pk, []::INT[] AS ids, NULL::INT AS child, w::DOUBLE AS w, w::DOUBLE AS d, 0::BIGINT AS level_rank, 0::DOUBLE AS level_offset, 0::BIGINT AS sibling_rank, 0::DOUBLE AS sibling_offset, 0::DOUBLE AS scale_min, 1::DOUBLE AS scale_max, TRUE AS sel FROM node WHERE level = 0)")
    for i, c in enumerate(controls[: 1 if not keys else len(controls)], 1):
        excluded = ", ".join(c.exclude) or "NULL"
        place = f"list_position([{', '.join(c.include)}]::INT[], child)" if c.include else "NULL"
        best = "d DESC" if c.show_top else "d ASC"
        size = (derived or {}).get(i, "n.w::DOUBLE")
        out += [
            f"par{i} AS (SELECT root, k, row_number() OVER (PARTITION BY root ORDER BY ids) AS ord, count(*) OVER (PARTITION BY root) AS p FROM lv{i - 1} WHERE sel)",
            f"can{i} AS MATERIALIZED (SELECT n.*, ord, p, {size} AS d, CASE WHEN n.k IN ({quoted}) THEN 0 WHEN {place} IS NOT NULL THEN 1 ELSE 2 END AS block, {place} AS place FROM node n JOIN par{i} q ON q.root = n.root AND q.k = n.pk WHERE level = {i} AND NOT coalesce(child IN ({excluded}), FALSE))",
            f"forced{i} AS (SELECT * FROM can{i} WHERE block < 2 QUALIFY row_number() OVER (PARTITION BY root ORDER BY block, CASE WHEN block = 1 THEN place ELSE 0 END, ord, child) <= {c.limit_n})",
            f"seq{i} AS (SELECT q.root, q.ord, q.ord AS j, q.p AS m, (SELECT count(*) FROM can{i} c WHERE c.root = q.root AND c.ord = q.ord AND block = 2) AS n, {c.limit_n} - (SELECT count(*) FROM forced{i} f WHERE f.root = q.root) AS rem FROM par{i} q)",
            f"quo{i}(root, j, quota, rem) AS (SELECT root, j, floor(rem / m::DOUBLE + 0.5)::BIGINT, rem - least(floor(rem / m::DOUBLE + 0.5)::BIGINT, n) FROM seq{i} WHERE j = 1 UNION ALL SELECT s.root, s.j, floor(q.rem / (m - s.j + 1)::DOUBLE + 0.5)::BIGINT, q.rem - least(floor(q.rem / (m - s.j + 1)::DOUBLE + 0.5)::BIGINT, s.n) FROM quo{i} q JOIN seq{i} s ON s.root = q.root AND s.j = q.j + 1)",
            f"best{i} AS (SELECT *, row_number() OVER (PARTITION BY root, ord ORDER BY {best}, child) AS rn FROM can{i} WHERE block = 2)",
            f"shown{i} AS (SELECT root, k, pk, ids, child, w, d FROM forced{i} UNION ALL SELECT b.root, b.k, b.pk, b.ids, b.child, b.w, b.d FROM best{i} b JOIN seq{i} s ON s.root = b.root AND s.ord = b.ord JOIN quo{i} q ON q.root = s.root AND q.j = s.j WHERE rn <= quota)",
            f"""lv{i} AS MATERIALIZED (SELECT s.root, {i} AS level, s.k, s.pk, s.ids, s.child, s.w::DOUBLE AS w, s.d, row_number() OVER lev - 1 AS level_rank, coalesce(sum(s.d) OVER (lev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level_offset,
 row_number() OVER sib - 1 AS sibling_rank, coalesce(sum(s.d) OVER (sib ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sibling_offset,
 p.scale_min + (row_number() OVER sib - 1) * ((p.scale_max - p.scale_min) / count(*) OVER par) AS scale_min, p.scale_min + (row_number() OVER sib) * ((p.scale_max - p.scale_min) / count(*) OVER par) AS scale_max, s.k IN ({quoted}) AS sel
 FROM shown{i} s JOIN lv{i - 1} p ON p.root = s.root AND p.k = s.pk WINDOW lev AS (PARTITION BY s.root ORDER BY p.level_rank, s.d, s.child::VARCHAR DESC), sib AS (PARTITION BY s.root, s.pk ORDER BY s.d, s.child::VARCHAR DESC), par AS (PARTITION BY s.root, s.pk))""",
        ]
    return "WITH RECURSIVE " + ",\n".join(out)


def shown_sql(spec_id: str, controls: list[Control], keys: list[str], **more) -> str:
    """Ids, weights, ranks and offsets of all visible levels below the root."""
    n = 1 if not keys else len(controls)
    rows = " UNION ALL ".join(f"SELECT root::VARCHAR AS root_id, level::INT AS level, k AS key, child::VARCHAR AS child_id, round(d, 9) AS weight, level_rank::INT AS level_rank, round(level_offset, 9) AS level_offset FROM lv{i}" for i in range(1, n + 1))
    return visible_sql(spec_id, controls, keys, **more) + rows


def r9(c: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 9)
    return out.alias(name or c)


def nodes_of(spark: SparkSession, d: str, spec_id: str) -> DataFrame:
    return rollup.build_nodes(star.flow(spark, d), SPECS[spec_id])


def shown(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("level") > 0).select("root_id", "level", "key", "child_id", r9("weight"), "level_rank", r9("level_offset"))


def stored_nodes(spark: SparkSession, d: str, spec_id: str = "q1") -> DataFrame:
    """A spec's node table, worked out once and read by all that follows in a query."""
    return shared_checkpoint(nodes_of(spark, d, spec_id))


def visible_of(spark: SparkSession, d: str, controls: list[Control], keys: list[str] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Every root's visible tree; keys: the paths selected in each."""
    if keys is None:
        return visible.visible_tree(nodes_of(spark, d, "q1"), SPECS["q1"], controls, labels=labels)
    return visible.visible_tree(nodes_of(spark, d, "q1"), SPECS["q1"], controls, in_every_root(spark, d, keys), labels)


def in_every_root(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    """The same paths selected under every root."""
    roots = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("root_id"))
    return roots.withColumn("key", F.explode(F.array(*map(F.lit, keys))))


# ---- facts and roll-ups ----


@query(f"WITH {FLOW} SELECT root, region, nation, count(*) AS citations, count(DISTINCT order_id) AS works FROM flow GROUP BY ALL")
def flow_fact_counts(spark, d):
    return star.flow(spark, d).groupBy("root", "region", "nation").agg(F.count("*").alias("citations"), F.count_distinct("order_id").alias("works"))


@query(f"WITH {FLOW} SELECT count(DISTINCT order_id) AS works, count(DISTINCT root) AS roots, count(*) AS citations, count(DISTINCT nation) AS countries, count(DISTINCT brand) AS sub_concepts, count(DISTINCT type) AS concepts FROM flow")
def corpus_stats(spark, d):
    return rollup.corpus_stats(star.flow(spark, d))


def _rollup_sql(spec_id: str) -> str:
    return f"WITH {FLOW}, {node_sql(spec_id)} SELECT '{spec_id}' AS spec_id, root::VARCHAR AS root_id, level, k AS key, pk AS parent_key, child::VARCHAR AS child_id, w AS weight FROM node"


def _rollup(spark, d, spec_id):
    return rollup.keyed(nodes_of(spark, d, spec_id)).select("spec_id", "root_id", "level", "key", "parent_key", "child_id", "weight")


@query(_rollup_sql("q1"))
def rollup_nodes_q1(spark, d):
    return _rollup(spark, d, "q1")


@query(_rollup_sql("q2"))
def rollup_nodes_q2(spark, d):
    return _rollup(spark, d, "q2")


@query(_rollup_sql("q3"))
def rollup_nodes_q3(spark, d):
    return _rollup(spark, d, "q3")


@query(f"WITH {FLOW} SELECT root::VARCHAR AS root_id, 0 AS level, '' AS key, count(DISTINCT order_id) AS weight FROM flow GROUP BY root UNION ALL SELECT root::VARCHAR, 1, region::VARCHAR, count(DISTINCT order_id) FROM flow GROUP BY root, region UNION ALL SELECT root::VARCHAR, 2, concat_ws('-', region, nation), count(DISTINCT order_id) FROM flow GROUP BY root, region, nation UNION ALL SELECT root::VARCHAR, 3, concat_ws('-', region, nation, brand), count(DISTINCT order_id) FROM flow GROUP BY root, region, nation, brand")
def rollup_distinct_works(spark, d):
    """Weights that do not add up: distinct works at every level."""
    return rollup.keyed(rollup.build_nodes(star.flow(spark, d), SPECS["q1"], distinct="order_id")).select("root_id", "level", "key", "weight")


@query(f"WITH {FLOW} SELECT root, count(DISTINCT order_id) AS works FROM flow WHERE year >= 1997 AND priority IN ('1-URGENT', '2-HIGH') GROUP BY root HAVING count(DISTINCT order_id) >= 20")
def root_filter_having(spark, d):
    return rollup.frequent_roots(star.flow(spark, d), 20, 1997, ("1-URGENT", "2-HIGH"))


# ---- labels and metadata ----


@query(f"WITH {FLOW}, {node_sql('q1')} SELECT root::VARCHAR AS root_id, k AS key, coalesce(name, 'Unknown') AS name FROM node LEFT JOIN ({names_sql('Region')}) t ON t.id = child WHERE level = 2")
def labels_lookup_unknown(spark, d):
    """Ids looked up among labels of another kind, which most of them are not in."""
    nodes = rollup.keyed(nodes_of(spark, d, "q1")).where(F.col("level") == 2)
    return lookup.with_names(nodes, star.attribute_labels(spark, d), "Region").select("root_id", "key", "name")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.absent'), '') AS absent FROM events")
def meta_json_parse(spark, d):
    meta = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return table(spark, d, "events").select("event_id", F.coalesce(meta["k"].try_cast("long"), F.lit(0)).alias("k"), F.coalesce(meta["absent"], F.lit("")).alias("absent"))


# ---- visible trees ----

TOP3, BOTTOM3 = [Control(limit_n=3)], [Control(limit_n=3, show_top=False)]
FORCED = [Control(limit_n=3, include=("4", "2"), exclude=("1",))]
THREE = [Control(limit_n=4), Control(limit_n=5), Control(limit_n=6)]
CHOSEN = ["1", "2", "1-6", "1-11", "2-7"]
TIGHT = [Control(limit_n=3), Control(limit_n=7, exclude=("6", "11", "16"), include=("21", "7"))]


@query(shown_sql("q1", TOP3, []))
def visible_l1_top(spark, d):
    return shown(visible_of(spark, d, TOP3))


@query(shown_sql("q1", BOTTOM3, []))
def visible_l1_bottom(spark, d):
    return shown(visible_of(spark, d, BOTTOM3))


YEARS = SPECS["q3"].controls()


@query(shown_sql("q3", YEARS, []))
def visible_all_roots(spark, d):
    """Another spec, with its own default controls."""
    return shown(visible.visible_tree(nodes_of(spark, d, "q3"), SPECS["q3"], YEARS))


@query(shown_sql("q1", FORCED, []))
def visible_exclude_include(spark, d):
    return shown(visible_of(spark, d, FORCED))


@query(shown_sql("q1", THREE, CHOSEN))
def visible_selected(spark, d):
    return shown(visible_of(spark, d, THREE, CHOSEN))


@query(shown_sql("q1", TIGHT, ["1", "2"]))
def visible_balanced_quota(spark, d):
    """A parent with fewer children than its quota passes the rest on."""
    return shown(visible_of(spark, d, TIGHT, ["1", "2"]))


def _embedded_sql() -> str:
    spec, rows = SPECS["q1"], []
    for i in range(4):
        name = "''" if i == 0 else "coalesce(name, 'Unknown')"
        label = "" if i == 0 else f" LEFT JOIN ({names_sql(spec.kinds[i - 1])}) t ON t.id = v.child"
        below = f"coalesce((SELECT sum(d) FROM lv{i + 1} c WHERE c.root = v.root AND c.pk = v.k), 0)" if i < 3 else "0"
        rows.append(f"SELECT v.root::VARCHAR AS root_id, v.level::INT AS level, v.k AS key, v.pk AS parent_key, v.child::VARCHAR AS child_id, {name} AS name, v.d AS weight, {below}::DOUBLE AS children_sum_weight, level_rank::INT AS level_rank, level_offset::DOUBLE AS level_offset, sibling_rank::INT AS sibling_rank, sibling_offset::DOUBLE AS sibling_offset, sel AS is_selected, round(scale_min, 9) AS scale_min, round(scale_max, 9) AS scale_max, round((scale_min + scale_max) / 2, 9) AS scale_mid, 0::DOUBLE AS spec_raw, 0::DOUBLE AS spec_norm FROM lv{i} v{label}")
    return visible_sql("q1", THREE, CHOSEN) + " UNION ALL ".join(rows)


@query(_embedded_sql())
def visible_multilevel_embedded(spark, d):
    rows = visible_of(spark, d, THREE, CHOSEN, star.attribute_labels(spark, d))
    return rows.withColumns({c: r9(c) for c in ("scale_min", "scale_max", "scale_mid")})


@query(visible_sql("q1", THREE, CHOSEN) + " UNION ALL ".join(f"SELECT root::VARCHAR AS root_id, {i} AS level, sum(d) AS total_weight, count(*) AS total_nodes FROM lv{i} GROUP BY root" for i in range(4)))
def level_meta(spark, d):
    return visible.level_meta(visible_of(spark, d, THREE, CHOSEN)).select("root_id", "level", "total_weight", "total_nodes")


# ---- baselines and advantage ----


def _root_basis(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("root_id"), F.col("n_regionkey").cast("string").alias("basis_id"))


def root_meta(spark, d) -> DataFrame:
    """root_id and its metadata as a map."""
    labels = star.attribute_labels(spark, d).where(F.col("entity_type") == "Nation")
    return labels.select(F.col("id").alias("root_id"), F.from_json("meta", "map<string,string>").alias("meta"))


def _baseline(spark, d, basis: Basis, level: int = 3, nodes: DataFrame | None = None) -> DataFrame:
    return baselines.build_baseline(nodes_of(spark, d, "q1") if nodes is None else nodes, SPECS["q1"], level, basis, _root_basis(spark, d))


GG, BG, GH, BH = Basis(), Basis("Region", "Global"), Basis("Global", "Region"), Basis("Region", "Region")


def _baseline_sql(by_basis: bool, by_parent: bool, level: int = 3) -> str:
    """CTE base: basis_id, parent_id, child, rate of the level's ids over all roots."""
    b = "n_regionkey" if by_basis else "NULL::INT"
    p = "a" if by_parent else "NULL::INT"
    return f"""base AS (SELECT x.basis_id, x.parent_id, child, x.w / y.w::DOUBLE AS rate FROM
 (SELECT {b} AS basis_id, {p} AS parent_id, child, sum(w) AS w FROM every JOIN nation ON root = n_nationkey WHERE level = {level} GROUP BY 1, 2, 3) x JOIN
 (SELECT {b} AS basis_id, {p} AS parent_id, sum(w) AS w FROM every JOIN nation ON root = n_nationkey WHERE level = {1 if by_parent else 0} GROUP BY 1, 2) y ON x.basis_id IS NOT DISTINCT FROM y.basis_id AND x.parent_id IS NOT DISTINCT FROM y.parent_id)"""


def _shown_baseline(rows: DataFrame) -> DataFrame:
    return rows.select("basis_id", "parent_id", "child_id", r9("rate"))


def _baseline_query_sql(by_basis: bool, by_parent: bool) -> str:
    return f"WITH {FLOW}, {node_sql('q1', 'every')}, {_baseline_sql(by_basis, by_parent)} SELECT basis_id::VARCHAR AS basis_id, parent_id::VARCHAR AS parent_id, child::VARCHAR AS child_id, round(rate, 9) AS rate FROM base"


@query(_baseline_query_sql(False, False))
def baseline_gg(spark, d):
    return _shown_baseline(_baseline(spark, d, GG))


@query(_baseline_query_sql(True, False))
def baseline_bg(spark, d):
    return _shown_baseline(_baseline(spark, d, BG))


@query(_baseline_query_sql(False, True))
def baseline_gh(spark, d):
    return _shown_baseline(_baseline(spark, d, GH))


@query(_baseline_query_sql(True, True))
def baseline_bh(spark, d):
    return _shown_baseline(_baseline(spark, d, BH))


def _rca_sql(by_basis: bool, by_parent: bool, divisor: int, base: str | None = None, level: int = 3) -> str:
    """The metric of every node of a level, all roots; divisor: level of the whole."""
    key = {0: "''", 1: "a::VARCHAR", 2: "concat_ws('-', a, b)"}[divisor]
    basis = "b.basis_id IS NOT DISTINCT FROM " + ("t.n_regionkey" if by_basis else "NULL")
    parent = "b.parent_id IS NOT DISTINCT FROM " + ("t.a" if by_parent else "NULL")
    return f"""WITH {FLOW}, {node_sql('q1', 'every')}, {base or _baseline_sql(by_basis, by_parent, level)},
 t AS (SELECT n.*, n_regionkey, count(*) OVER (PARTITION BY root, pk) AS siblings, {key} AS whole FROM every n JOIN nation ON root = n_nationkey WHERE level = {level}),
 m AS (SELECT t.*, v.w AS divisor, t.w / v.w::DOUBLE AS rate, coalesce(b.rate, 0) AS base_rate FROM t JOIN every v ON v.root = t.root AND v.k = t.whole AND v.level = {divisor} LEFT JOIN base b ON b.child = t.child AND {basis} AND {parent})
 SELECT root::VARCHAR AS root_id, k AS key, round(rate, 9) AS node_rate, divisor AS node_divisor, round(base_rate, 9) AS baseline_rate, round((rate + 1 / siblings::DOUBLE) / (base_rate + 1 / siblings::DOUBLE), 9) AS spec_metric FROM m"""


def _metric(spark, d, basis: Basis, level: int = 3, admitted: Column | None = None) -> DataFrame:
    nodes = stored_nodes(spark, d)
    baseline = _baseline(spark, d, basis, level, nodes)
    rows = metrics.spec_metric(nodes, SPECS["q1"], level, basis, baseline if admitted is None else baseline.where(admitted), root_meta(spark, d))
    return _shown_metric(rows)


def _shown_metric(rows: DataFrame) -> DataFrame:
    return rows.select("root_id", "key", r9("node_rate"), "node_divisor", r9("baseline_rate"), r9("spec_metric"))


@query(_rca_sql(False, False, 0, level=1))
def rca_global(spark, d):
    return _metric(spark, d, GG, level=1)


@query(_rca_sql(True, False, 0, level=1))
def rca_basis(spark, d):
    return _metric(spark, d, BG, level=1)


@query(_rca_sql(False, True, 1))
def rca_hierarchy(spark, d):
    return _metric(spark, d, GH)


@query(_rca_sql(True, True, 1))
def rca_basis_hierarchy(spark, d):
    return _metric(spark, d, BH)


@query(_rca_sql(False, False, 2))
def rca_root_kind_divisor(spark, d):
    """The level above a brand is of the root's kind, so it is the whole."""
    return _metric(spark, d, GG)


@query(_rca_sql(False, False, 2, base=_baseline_sql(False, False).replace("base AS (SELECT x.basis_id", "base AS (SELECT * FROM (SELECT x.basis_id") + " WHERE rate >= 0.04)"))
def rca_missing_key(spark, d):
    """A baseline that holds frequent ids only: the others' rate is 0."""
    return _metric(spark, d, GG, admitted=F.col("rate") >= 0.04)


@query(f"WITH {FLOW}, {node_sql('q1', 'every')} SELECT n.root::VARCHAR AS root_id, n.k AS key, round(n.w / v.w::DOUBLE, 9) AS node_rate, v.w AS node_divisor, round(n.w / v.w::DOUBLE, 9) AS baseline_rate, 1::DOUBLE AS spec_metric FROM every n JOIN every v ON v.root = n.root AND v.level = 0 WHERE n.level = 3")
def rca_missing_baseline(spark, d):
    return _shown_metric(metrics.spec_metric(nodes_of(spark, d, "q1"), SPECS["q1"], 3, GG, None))


SIZED = [Control(limit_n=3), Control(limit_n=4), Control(limit_n=5, size_base="specialization")]
SIZED_KEYS = ["1", "2", "1-6", "2-7"]


@query(shown_sql("q1", SIZED, SIZED_KEYS, extra=_baseline_sql(False, False) + ", sib AS (SELECT root, pk, count(*) AS n FROM node WHERE level = 3 GROUP BY 1, 2), met AS (SELECT n.root, n.k, (n.w / v.w::DOUBLE + 1 / s.n::DOUBLE) / (coalesce(b.rate, 0) + 1 / s.n::DOUBLE) AS m FROM node n JOIN node v ON v.root = n.root AND v.k = n.pk AND v.level = 2 JOIN sib s ON s.root = n.root AND s.pk = n.pk LEFT JOIN base b ON b.child = n.child WHERE n.level = 3)", derived={3: "(SELECT m FROM met WHERE met.root = n.root AND met.k = n.k)"}))
def visible_by_specialization(spark, d):
    nodes = stored_nodes(spark, d)
    sizes = metrics.spec_metric(nodes, SPECS["q1"], 3, GG, _baseline(spark, d, GG, nodes=nodes))
    return shown(visible.visible_tree(nodes, SPECS["q1"], SIZED, in_every_root(spark, d, SIZED_KEYS), sizes={3: sizes}))


# ---- path profile ----

PATH = ["1", "6", "5"]


@query(f"WITH {FLOW}, {node_sql('q1', 'every')}, c AS (SELECT root, pk, count(*) AS n FROM every WHERE level = 3 GROUP BY 1, 2), m AS (SELECT x.*, p.w AS pw, n, p.w / n::DOUBLE AS comparison FROM every x JOIN every p ON p.root = x.root AND p.k = x.pk AND p.level = 2 JOIN c ON c.root = x.root AND c.pk = x.pk WHERE x.level = 3) SELECT root::VARCHAR AS root_id, k AS key, w AS weight, round(comparison, 9) AS comparison, round(w / comparison, 9) AS rate, CASE WHEN w / comparison > 1.2 THEN 'High' WHEN w / comparison < 0.75 THEN 'Low' ELSE 'Average' END AS description FROM m")
def path_profile_volume(spark, d):
    return metrics.volume_report(nodes_of(spark, d, "q1"), 3).select("root_id", "key", "weight", r9("comparison"), r9("rate"), "description")


@query(f"WITH {FLOW}, {node_sql('q1', 'every')}, path AS (SELECT root, level, k, child, CASE level WHEN 1 THEN 'cust' WHEN 2 THEN 'cust' ELSE 'part' END AS resolver FROM every WHERE root = {ROOT} AND k IN ('1', '1-6', '1-6-5') AND level > 0), l AS (SELECT *, lead(resolver) OVER (ORDER BY level) AS next FROM path) SELECT level, k AS key, CASE level WHEN 2 THEN (SELECT n_name FROM nation WHERE n_nationkey = child) ELSE 'Brand#' || child END AS name FROM l WHERE next IS NULL OR next <> resolver")
def path_profile_filters(spark, d):
    from .plans import explore

    got = explore.profile(stored_nodes(spark, d), SPECS["q1"], ROOT, PATH, star.attribute_labels(spark, d))
    return got["filters"].select("level", F.array_join("path", "-").alias("key"), "name")


def _all_bases_sql() -> str:
    parts = []
    for basis, by_basis, by_parent, divisor in ((GG, False, False, 2), (BG, True, False, 2), (GH, False, True, 1), (BH, True, True, 1)):
        parts.append(f"SELECT '{basis.basis}' AS basis, '{basis.hierarchy}' AS hierarchy, node_rate, node_divisor, baseline_rate, spec_metric, CASE WHEN spec_metric > 1.2 THEN 'High' WHEN spec_metric < 0.75 THEN 'Low' ELSE 'Average' END AS description FROM ({_rca_sql(by_basis, by_parent, divisor)}) WHERE root_id = '{ROOT}' AND key = '{'-'.join(PATH)}'")
    return " UNION ALL ".join(parts)


@query(_all_bases_sql())
def path_profile_all_bases(spark, d):
    from .plans import explore

    nodes, bases = stored_nodes(spark, d), [GG, BG, GH, BH]
    every = None
    for b in bases:
        one = baselines.build_baseline(nodes, SPECS["q1"], 3, b, _root_basis(spark, d))
        every = one if every is None else every.unionByName(one)
    got = explore.profile(nodes, SPECS["q1"], ROOT, PATH, star.attribute_labels(spark, d), every, root_meta(spark, d), bases)["metrics"]
    return got.select("basis", "hierarchy", r9("node_rate"), "node_divisor", r9("baseline_rate"), r9("spec_metric"), "description")


# ---- search ----


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'nation') AND contains(lower(n_name), '1') ORDER BY n_nationkey LIMIT 4")
def search_attr_topk(spark, d):
    labels = star.attribute_labels(spark, d).where(F.col("entity_type") == "Nation")
    return search.search_attributes(labels, "Nation 1", 4).select("id", "name")


@query(f"WITH {FLOW}, c AS (SELECT root, count(DISTINCT order_id) AS papers, count(*) AS citations FROM flow GROUP BY root) SELECT n_nationkey::VARCHAR AS id, n_name AS name, coalesce(papers, 0) AS papers, coalesce(citations, 0) AS citations FROM nation LEFT JOIN c ON root = n_nationkey WHERE contains(lower(n_name), 'nation_') ORDER BY coalesce(citations, 0) DESC, n_nationkey LIMIT 6")
def search_roots_topk(spark, d):
    return search.search_roots(star.root_descriptions(spark, d), "NATION_", 6).select("id", "name", "papers", "citations")


# ---- selections and commands ----


def _toggles(spark, d) -> DataFrame:
    """events as toggles: a session is a user, a path comes from the value's digits."""
    steps = [F.floor("value").cast("long") % 3, F.floor(F.col("value") * 10).cast("long") % 3]
    key = F.when(F.col("event_type").isin("click", "view"), steps[0].cast("string")).otherwise(F.concat(steps[0].cast("string"), F.lit("-"), steps[1].cast("string")))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), key.alias("key"))


_TOGGLES = """t AS (SELECT user_id::VARCHAR AS session, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN (floor(value)::BIGINT % 3)::VARCHAR ELSE (floor(value)::BIGINT % 3)::VARCHAR || '-' || (floor(value * 10)::BIGINT % 3)::VARCHAR END AS key FROM events)"""


@query(f"""WITH RECURSIVE {_TOGGLES}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS j FROM t),
f(session, j, sel) AS (SELECT DISTINCT session, 0::BIGINT, []::VARCHAR[] FROM o UNION ALL
 SELECT f.session, o.j, CASE WHEN list_contains(sel, o.key) THEN list_filter(sel, lambda s: s <> o.key AND NOT starts_with(s, o.key || '-')) WHEN NOT contains(o.key, '-') OR list_contains(sel, split_part(o.key, '-', 1)) THEN list_append(sel, o.key) ELSE sel END
 FROM f JOIN o ON o.session = f.session AND o.j = f.j + 1)
SELECT session, unnest(sel) AS key FROM (SELECT session, arg_max(sel, j) AS sel FROM f GROUP BY session)""")
def selection_fold(spark, d):
    return selection.fold_toggles(_toggles(spark, d))


@query(f"WITH {_TOGGLES} SELECT session, arg_max(key, seq) AS key FROM t GROUP BY session")
def last_highlight(spark, d):
    return selection.last_highlight(_toggles(spark, d))


DSL = "se1;se2;se2-7;sl2;mi14,2;sp9;zz1;se1-6;ce1;se2-7"


def _dsl_state() -> commands.State:
    return commands.replay(commands.start(SPECS["q1"]), DSL, SPECS)


@query(shown_sql("q1", [Control(), Control(include=("4", "2")), Control()], ["1", "2", "1-6"]))
def dsl_replay(spark, d):
    from .plans import explore

    return shown(explore.derive(spark, stored_nodes(spark, d), _dsl_state()))


@query("WITH s AS (SELECT user_id::VARCHAR AS root_id, (event_id % 4)::BIGINT AS a, (event_id % 7)::BIGINT AS b FROM events), m AS (SELECT root_id, min(a) AS a FROM s GROUP BY 1) SELECT s.root_id, min(s.a) || '-' || min(s.b) AS key FROM s JOIN m ON m.root_id = s.root_id AND m.a = s.a GROUP BY s.root_id")
def first_path(spark, d):
    """The first path of each user's selection of (a, a-b) pairs."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("root_id"), (F.col("event_id") % 4).cast("string").alias("a"), (F.col("event_id") % 7).cast("string").alias("b"))
    keys = e.select("root_id", F.col("a").alias("key")).union(e.select("root_id", F.concat_ws("-", "a", "b"))).distinct()
    return selection.first_paths(keys).select("root_id", "key")


@query("SELECT user_id, list_prepend(x, list_filter(l, lambda y: y <> x)) AS prepended, list_filter(l, lambda y: y <> x) AS removed, len(l)::INT AS size FROM (SELECT user_id, max(event_type) AS x, list(DISTINCT event_type ORDER BY event_type) AS l FROM events GROUP BY user_id)")
def filter_list_edit(spark, d):
    """Each user's list of event kinds (a handful, however many events), with its last one put first, and left out."""
    held = table(spark, d, "events").groupBy("user_id").agg(F.max("event_type").alias("x"), F.array_sort(F.collect_set("event_type")).alias("l"))
    less = F.array_remove("l", F.col("x"))
    return held.select("user_id", F.concat(F.array("x"), less).alias("prepended"), less.alias("removed"), F.size("l").alias("size"))


# ---- lookups ----

#: Baselines on offer, the four that are left out for their size among them.
CATALOG = [("Institution", t, b, h) for t in ("Institution", "Concept") for b in ("Global", "Country", "Continent") for h in ("Global", "Country", "Institution")]
PAPERS = QuerySpec("papers", "Institution", (Level("Country", "place"), Level("Institution", "place"), Level("Concept", "topic")))


@query("SELECT 'Institution' AS root_type, t AS target, b AS basis, h AS hierarchy, 'i-' || t || '-' || b || '-' || h AS name FROM (VALUES ('Institution'), ('Concept')) x(t), (VALUES ('Global'), ('Country'), ('Continent')) y(b), (VALUES ('Global'), ('Country'), ('Institution')) z(h) WHERE t = 'Concept' AND 'i-' || t || '-' || b || '-' || h NOT IN ('i-Institution-Country-Global', 'i-Concept-Continent-Institution', 'i-Institution-Country-Country', 'i-Concept-Country-Institution')")
def baseline_catalog_filter(spark, d):
    catalog = spark.createDataFrame(CATALOG, "root_type string, target string, basis string, hierarchy string")
    return lookup.available_baselines(catalog, PAPERS, 3)


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def entity_by_name(spark, d):
    last = table(spark, d, "nation").agg(F.max("n_name")).first()[0]
    return lookup.by_name(star.attribute_labels(spark, d), "Nation", last).select("id", "name")


@query(f"WITH p(i) AS (VALUES {', '.join(f'({i})' for i in POINTS)}), f(frame) AS (VALUES {', '.join(f'({i})' for i in FRAMES)}) SELECT i, coalesce(min(frame) FILTER (frame >= i), max(frame)) AS frame, 'text ' || coalesce(min(frame) FILTER (frame >= i), max(frame)) AS payload FROM p, f GROUP BY i")
def asof_frame_forward(spark, d):
    points = spark.createDataFrame([(i,) for i in POINTS], "i int")
    frames = spark.createDataFrame([(i, f"text {i}") for i in FRAMES], "frame int, payload string")
    return lookup.next_frame(points, frames)


@query(f"WITH f(frame) AS (VALUES {', '.join(f'({i})' for i in FRAMES)}), e AS (SELECT event_id, (event_id % 13)::INT AS i FROM events) SELECT event_id, coalesce(min(frame) FILTER (frame >= i), max(frame)) AS frame FROM e, f GROUP BY event_id")
def asof_frame_events(spark, d):
    """The same lookup for every event."""
    frames = spark.createDataFrame([(i, f"text {i}") for i in FRAMES], "frame int, payload string")
    return lookup.next_frame(table(spark, d, "events").select("event_id", (F.col("event_id") % 13).cast("int").alias("i")), frames).select("event_id", "frame")


@query("SELECT level, resolver FROM (SELECT level, resolver, lead(resolver) OVER (ORDER BY level) AS next FROM (VALUES (1, 'cust'), (2, 'cust'), (3, 'part')) t(level, resolver)) WHERE next IS NULL OR next <> resolver")
def resolver_lead(spark, d):
    levels = spark.createDataFrame([(i, x.resolver_id) for i, x in enumerate(SPECS["q1"].levels, 1)], "level int, resolver string")
    kept = levels.withColumn("_next", F.lead("resolver").over(Window.orderBy("level")))
    return kept.where(F.col("_next").isNull() | (F.col("_next") != F.col("resolver"))).drop("_next")


@query(f"WITH {FLOW}, {node_sql('q1', 'every')} SELECT root::VARCHAR AS root_id, level, k AS key, w AS weight FROM every WHERE root = {ROOT} AND k = '1-6'")
def node_by_path(spark, d):
    return rollup.keyed(lookup.node_at(nodes_of(spark, d, "q1"), ROOT, ["1", "6"])).select("root_id", "level", "key", "weight")


# ---- layout and scalars ----


@query("WITH l AS (SELECT level, CASE WHEN level = 1 THEN 300 + 600 / 4.0::DOUBLE / 2 ELSE 600 / 4.0::DOUBLE / 2 END AS s FROM range(4) t(level)) SELECT level::INT AS level, s::DOUBLE AS total_size, coalesce(sum(s) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS top_offset FROM l")
def level_bands(spark, d):
    return layout.level_bands(spark.range(4).select(F.col("id").cast("int").alias("level")), 600.0, expanded=1).select("level", "total_size", "top_offset")


@query(visible_sql("q1", THREE, CHOSEN) + "SELECT root::VARCHAR AS root_id, k AS key, round(10 + level_rank * 7.0::DOUBLE + 800 * level_offset / t, 9) AS x, round(5 + 800 * d / t, 9) AS width FROM (SELECT *, sum(d) OVER (PARTITION BY root) AS t FROM lv2)")
def sankey_offsets(spark, d):
    rows = visible_of(spark, d, THREE, CHOSEN).where(F.col("level") == 2)
    rows = rows.withColumn("_t", F.sum("weight").over(Window.partitionBy("root_id")))
    x, width = layout.offset_and_width(5.0, 800.0, 2.0, F.lit(10.0), F.col("level_rank"), F.col("level_offset"), F.col("weight"), F.col("_t"))
    return rows.select("root_id", "key", r9(x, "x"), r9(width, "width"))


@query("SELECT n_nationkey::INT AS id, 'M0.00,0.00 C0.00,50.00 ' || printf('%.2f', n_nationkey * 2.0::DOUBLE) || ',50.00 ' || printf('%.2f', n_nationkey * 2.0::DOUBLE) || ',100.00 L' || printf('%.2f', n_nationkey * 2.0::DOUBLE + 20) || ',100.00 C' || printf('%.2f', n_nationkey * 2.0::DOUBLE + 20) || ',50.00 10.00,50.00 10.00,0.00 Z' AS path FROM nation")
def ribbon_paths(spark, d):
    zero = F.lit(0.0)
    x1 = F.col("n_nationkey") * F.lit(2.0)
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), layout.ribbon_path(zero, x1, F.lit(10.0), F.lit(20.0), zero, F.lit(100.0)).alias("path"))


@query(f"WITH {FLOW}, {node_sql('q1', 'every')} SELECT root::VARCHAR AS root_id, k AS key, round(w / sum(w) OVER (PARTITION BY root, pk), 9)::DOUBLE AS share, round(coalesce(sum(w) OVER (PARTITION BY root, pk ORDER BY child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY root, pk), 9)::DOUBLE AS share_before FROM every WHERE level = 2")
def share_widths(spark, d):
    rows = rollup.keyed(nodes_of(spark, d, "q1")).where(F.col("level") == 2)
    return layout.shares(rows, ["root_id", "parent_key"]).select("root_id", "key", r9("share"), r9("share_before"))


@query("SELECT l_orderkey, l_linenumber, l_discount, 'rgb(' || floor(l_discount * 10 * 250)::INT || ',' || floor(abs(l_discount * 10 - 0.5::DOUBLE) * 440)::INT || ',' || floor(255 - l_discount * 10 * 250)::INT || ')' AS color FROM lineitem")
def color_scale(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", numbers.color_text(F.col("l_discount") * 10).alias("color"))


@query(f"WITH {FLOW}, y AS (SELECT root, year, count(*) AS n, row_number() OVER (PARTITION BY root ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY root) AS len, max(count(*)) OVER (PARTITION BY root) AS top FROM flow GROUP BY root, year) SELECT root, round(i / len::DOUBLE, 9) AS x, round(1 - n / top::DOUBLE, 9) AS y FROM y")
def series_normalise(spark, d):
    yearly = star.flow(spark, d).groupBy("root", "year").agg(F.count("*").alias("n"))
    series = yearly.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "n"))), lambda p: p["n"]).alias("values"))
    return layout.series_points(series, "values").select("root", F.inline("points")).select("root", r9("x"), r9("y"))


@query(f"""WITH RECURSIVE {FLOW}, {node_sql('q1', 'every')},
items AS MATERIALIZED (SELECT root, pk, list(child ORDER BY child) AS ids, list(w::DOUBLE ORDER BY child) AS ws FROM every WHERE level = 2 GROUP BY root, pk),
part AS MATERIALIZED (SELECT root, pk, lo, hi, coalesce(list_min(list_filter(range(lo + 2, hi), lambda c: list_sum(ws[lo + 1:c]) > list_sum(ws[lo + 1:hi]) / 2)), hi - 1) AS cut FROM items, (SELECT lo, hi FROM range(0, 30) a(lo), range(0, 31) b(hi) WHERE hi - lo > 1) WHERE hi <= len(ws)),
t(root, pk, lo, hi, x, y, w, h, along) AS (SELECT root, pk, 0::BIGINT, len(ws)::BIGINT, 0::DOUBLE, 0::DOUBLE, 100::DOUBLE, 100::DOUBLE, TRUE FROM items UNION ALL
 SELECT root, pk, CASE side WHEN 0 THEN lo ELSE cut END, CASE side WHEN 0 THEN cut ELSE hi END, CASE WHEN along AND side = 1 THEN x + w * f ELSE x END, CASE WHEN NOT along AND side = 1 THEN y + h * f ELSE y END,
  CASE WHEN NOT along THEN w WHEN side = 0 THEN w * f ELSE w - w * f END, CASE WHEN along THEN h WHEN side = 0 THEN h * f ELSE h - h * f END, NOT along
 FROM (SELECT t.*, part.cut, list_sum(ws[t.lo + 1:part.cut]) / list_sum(ws[t.lo + 1:t.hi]) AS f FROM t JOIN items USING (root, pk) JOIN part ON part.root = t.root AND part.pk = t.pk AND part.lo = t.lo AND part.hi = t.hi), (VALUES (0), (1)) s(side))
SELECT root || '-' || t.pk AS parent, ids[lo + 1]::VARCHAR AS child_id, round(x, 9) AS x, round(y, 9) AS y, round(w, 9) AS width, round(h, 9) AS height FROM t JOIN items USING (root, pk) WHERE hi - lo = 1 AND w > 0 AND h > 0""")
def treemap_bsp(spark, d):
    rows = rollup.keyed(nodes_of(spark, d, "q1")).where(F.col("level") == 2)
    tiles = layout.treemap_tiles(rows.select(F.concat_ws("-", "root_id", "parent_key").alias("parent"), "child_id", "weight"))
    return tiles.select("parent", "child_id", *[r9(c) for c in ("x", "y", "width", "height")])


@query(f"WITH {FLOW}, c AS (SELECT root, nation, count(*) * 10 AS n FROM flow GROUP BY ALL) SELECT root, nation, n, CASE WHEN n > 1000000 THEN NULL WHEN n > 1000 THEN (CASE WHEN n % 1000 IN (250, 750) THEN printf('%.1f', (n + 50) / 1000.0::DOUBLE) ELSE printf('%.1f', n / 1000.0::DOUBLE) END) || 'k' ELSE n::VARCHAR END AS short FROM c")
def format_number(spark, d):
    counts = star.flow(spark, d).groupBy("root", "nation").agg((F.count("*") * 10).alias("n"))
    return counts.select("root", "nation", "n", numbers.short_number_udf(F.col("n").cast("double")).alias("short"))


@query("SELECT name, unnest(['a', 'b', 'c']) AS child, unnest([1.5::DOUBLE, 2.5::DOUBLE, 3.5::DOUBLE]) * f AS weight FROM (VALUES ('x', 1), ('y', 2)) t(name, f)")
def json_tree_arrays(spark, d):
    """Trees whose children are a list of named nodes, flattened."""
    trees = [(n, '[{"name":"a","weight":%s},{"name":"b","weight":%s},{"name":"c","weight":%s}]' % (1.5 * f, 2.5 * f, 3.5 * f)) for n, f in (("x", 1), ("y", 2))]
    rows = spark.createDataFrame(trees, "name string, children string")
    return rows.select("name", F.inline(F.from_json("children", "array<struct<child:string,name:string,weight:double>>"))).toDF("name", "_", "child", "weight").select("name", "child", "weight")


@query("SELECT frame::INT AS frame, place::INT AS place, name, CASE WHEN frame < 3 THEN 'title' WHEN frame < 8 THEN 'row ' || place ELSE 'end' END AS stage FROM (VALUES (0), (3), (5), (8), (10)) f(frame), (VALUES (0, 'a'), (1, 'b'), (2, 'c')) u(place, name)")
def frames_crossjoin(spark, d):
    return layout.frame_grid(spark, list(FRAMES), ["a", "b", "c"])


@query("SELECT event_id, greatest(-2000::DOUBLE, least(value * 1000, 15000::DOUBLE)) AS clamped, floor(value * 1000 / 1000)::BIGINT AS bin, event_id % 5 = 0 AS fifth FROM events")
def clamp_and_bin(spark, d):
    return table(spark, d, "events").select("event_id", numbers.clamp(F.col("value") * 1000, -2000.0, 15000.0).alias("clamped"), F.floor(F.col("value") * 1000 / 1000).alias("bin"), (F.col("event_id") % 5 == 0).alias("fifth"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE n_regionkey = 3")
def root_listing(spark, d):
    """Root options of a type under an attribute value."""
    labels = star.attribute_labels(spark, d)
    meta = F.from_json("meta", "map<string,string>")
    return labels.where((F.col("entity_type") == "Nation") & (meta["Region"] == "3")).select("id", "name")


# ---- small parts of views ----


@query("SELECT k AS kind, CASE WHEN k IN ('Country', 'Continent') THEN 'Cited by paper published in' WHEN k = 'Institution' THEN 'Cited by paper published by' WHEN k IN ('Concept', 'SubConcept') THEN 'Where the original paper was categorized as' END AS words FROM (VALUES ('Institution'), ('Concept'), ('SubConcept'), ('Country'), ('Continent'), ('InstitutionType'), ('Period'), ('Year')) t(k)")
def path_descriptions(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ENTITY_KINDS], "kind string")
    return kinds.select("kind", text.described(F.col("kind")).alias("words"))


@query(f"WITH {FLOW}, {node_sql('q1', 'every')}, t AS (SELECT root, k, row_number() OVER (PARTITION BY root, pk ORDER BY child) - 1 AS i, count(*) OVER (PARTITION BY root, pk) AS n FROM every WHERE level = 2) SELECT root::VARCHAR AS root_id, k AS key, round(0.1::DOUBLE + 0.8::DOUBLE / n * i, 9) AS color_start, round(0.1::DOUBLE + 0.8::DOUBLE / n * (i + 1), 9) AS color_end FROM t")
def color_buckets(spark, d):
    """Each child's part of its parent's colour range, in id order."""
    group = Window.partitionBy("root_id", "parent_key")
    rows = rollup.keyed(nodes_of(spark, d, "q1")).where(F.col("level") == 2)
    rows = rows.withColumns({"_i": F.row_number().over(group.orderBy("id_num")) - 1, "_n": F.count("*").over(group)})
    start, end = numbers.color_bucket(0.1, 0.9, F.col("_i"), F.col("_n"))
    return rows.select("root_id", "key", r9(start, "color_start"), r9(end, "color_end"))


@query("SELECT '--color-range-' || n || ': ' || floor(n * 2.5::DOUBLE + 0.5)::INT || ', ' || floor(abs(n - 50) * 4.4::DOUBLE + 0.5)::INT || ', ' || floor(255 - n * 2.5::DOUBLE + 0.5)::INT || ';' AS step FROM range(5, 101, 5) t(n)")
def color_steps(spark, d):
    return spark.range(1).select(F.explode(numbers.color_steps()).alias("step"))


@query("SELECT n::INT AS n, unnest(list_transform(range(0, n), lambda i: round(2 + i * (10 / n::DOUBLE), 9))) AS value FROM range(0, 7) t(n)")
def value_steps(spark, d):
    counts = spark.range(7).select(F.col("id").cast("int").alias("n"))
    return counts.select("n", F.explode(numbers.value_steps(F.col("n"), 2.0, 12.0)).alias("value")).select("n", r9("value"))


LINK_TREE = {"x": 50.0, "width": 2000.0, "base": 2.9, "margin": 0.9}
LINK_SIZES = {"side": 0.8, "surface": 0.8, "top": 10.0, "bottom": 110.0}


@query(visible_sql("q1", THREE, CHOSEN) + """SELECT root_id, key, round(x, 6) AS x, round(width, 6) AS width, round(link_x, 6) AS link_x, round(link_width, 6) AS link_width FROM (
 SELECT root::VARCHAR AS root_id, k AS key, 50 + level_rank * 3.8::DOUBLE + space * level_offset / total AS x, 2.9::DOUBLE + space * d / total AS width,
  parent_x + 0.8::DOUBLE + sibling_rank * (least + gap) + room * sibling_offset / below AS link_x, least + room * d / below AS link_width FROM (
 SELECT *, 2000 - 2.9::DOUBLE * n - 0.9::DOUBLE * (n - 1) AS space, inside * 0.2::DOUBLE / greatest(m - 1, 1) AS gap, inside * 0.8::DOUBLE / (m * 1.8::DOUBLE) AS least, inside * (CASE WHEN m > 1 THEN 0.8::DOUBLE ELSE 1 END) - inside * 0.8::DOUBLE / (m * 1.8::DOUBLE) * m AS room FROM (
 SELECT c.*, 40.0::DOUBLE * p.level_rank AS parent_x, 36.0::DOUBLE - 1.6::DOUBLE AS inside, count(*) OVER (PARTITION BY c.root, c.pk) AS m, count(*) OVER (PARTITION BY c.root) AS n, sum(c.d) OVER (PARTITION BY c.root) AS total, sum(c.d) OVER (PARTITION BY c.root, c.pk) AS below FROM lv2 c JOIN lv1 p ON p.root = c.root AND p.k = c.pk)))""")
def child_links(spark, d):
    """Places of the second level's nodes, and of their links on the parents."""
    rows = visible_of(spark, d, THREE, CHOSEN)
    parents = rows.where(F.col("level") == 1).select("root_id", F.col("key").alias("parent_key"), (F.col("level_rank") * 40.0).alias("parent_x"), F.lit(36.0).alias("parent_width"), F.col("children_sum_weight").alias("siblings_weight"))
    siblings, level = Window.partitionBy("root_id", "parent_key"), Window.partitionBy("root_id")
    rows = rows.where(F.col("level") == 2).join(parents, ["root_id", "parent_key"])
    rows = rows.withColumns({"children": F.count("*").over(siblings), "level_nodes": F.count("*").over(level), "level_weight": F.sum("weight").over(level)})
    placed = layout.child_links(rows, LINK_TREE, LINK_SIZES)
    return placed.select("root_id", "key", *[F.round(c, 6).alias(c) for c in ("x", "width", "link_x", "link_width")])


@query("SELECT p_partkey, len(w)::INT AS n_words, list_sum(list_transform(w, lambda x: len(x) + 1))::INT - 1 AS line, greatest(len(w[1]), len(array_to_string(w[2:], ' ')))::INT AS longest, list_min(list_transform(w, lambda x: len(x)))::INT AS shortest_word, array_to_string(list_reverse(w), ' ') AS reversed FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def word_lines(spark, d):
    """Lengths of part names as one line and as two, their shortest word, and their words from behind."""
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    two = F.array(F.slice("w", 1, 1), F.slice("w", F.lit(2), F.size("w")))
    return rows.select("p_partkey", F.size("w").alias("n_words"), text.line_length(F.col("w")).alias("line"), F.greatest(text.longest_line(two), F.lit(0)).alias("longest"), F.array_min(F.transform("w", F.length)).alias("shortest_word"), F.array_join(F.reverse("w"), " ").alias("reversed"))


@query("SELECT n_nationkey::VARCHAR AS id, 'id ' || n_name || ' and ' || n_name || '$1' AS filled, replace(n_name, 'NATION_', 'N\\') AS replaced, CASE WHEN n_nationkey > 1 THEN 'paper' || 's' ELSE 'paper' END AS word, round(n_nationkey / 7.0::DOUBLE * 100, 2) AS percent FROM nation")
def text_fills(spark, d):
    """Placeholders filled, a first occurrence replaced, plurals and percentages."""
    rows = table(spark, d, "nation")
    return rows.select(F.col("n_nationkey").cast("string").alias("id"), text.filled(F.lit("id {pc_id} and {PC_ID}$1"), F.col("n_name")).alias("filled"), text.first_replaced(F.col("n_name"), "NATION_", "N\\").alias("replaced"), numbers.plural(F.col("n_nationkey"), "paper").alias("word"), numbers.percent(F.col("n_nationkey") / F.lit(7.0)).alias("percent"))


@query("SELECT * FROM (VALUES ('q1', 1, 10, TRUE, 'volume', 0, 0), ('q1', 2, 10, TRUE, 'volume', 0, 0), ('q1', 3, 10, TRUE, 'volume', 0, 0), ('q2', 1, 10, TRUE, 'volume', 0, 0), ('q2', 2, 10, TRUE, 'volume', 0, 0), ('q2', 3, 10, TRUE, 'volume', 0, 0), ('q3', 1, 7, TRUE, 'volume', 0, 0), ('q3', 2, 10, TRUE, 'volume', 0, 0), ('q3', 3, 10, TRUE, 'volume', 0, 0)) t(spec_id, level, limit_n, show_top, size_base, n_include, n_exclude)")
def spec_controls(spark, d):
    """Each spec's controls by level: the defaults with what its templates set."""
    rows = [(k, i, c.limit_n, c.show_top, c.size_base, c.include, c.exclude) for k, spec in SPECS.items() for i, c in enumerate(spec.controls(), 1)]
    df = spark.createDataFrame(rows, "spec_id string, level int, limit_n int, show_top boolean, size_base string, include array<string>, exclude array<string>")
    return df.select("spec_id", "level", "limit_n", "show_top", "size_base", F.size("include").alias("n_include"), F.size("exclude").alias("n_exclude"))


@query("WITH s(key, expanded) AS (VALUES ('ce1', 1), ('ce1;ce1', NULL), ('ce0;ce2', 2)), l AS (SELECT key, level, CASE WHEN expanded IS NULL THEN 150 WHEN level = expanded THEN 300 + 75 ELSE 75 END::DOUBLE AS s FROM s, range(4) t(level)) SELECT key, level::INT AS level, s AS total_size, coalesce(sum(s) OVER (PARTITION BY key ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS top_offset FROM l")
def expanded_bands(spark, d):
    """Bands of the levels after commands that expand and fold them."""
    out = None
    for key in ("ce1", "ce1;ce1", "ce0;ce2"):
        state = commands.replay(commands.start(SPECS["q1"]), key, SPECS)
        rows = layout.level_bands(spark.range(4).select(F.col("id").cast("int").alias("level")), 600.0, expanded=state.expanded).select(F.lit(key).alias("key"), "level", "total_size", "top_offset")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'Nation' AS root_type, n_nationkey::VARCHAR AS root_id, spec_id FROM nation, (VALUES ('q1'), ('q2'), ('q3')) t(spec_id)")
def route_listing(spark, d):
    """Every view that there is: a root and a spec."""
    roots = table(spark, d, "nation").select(F.lit("Nation").alias("root_type"), F.col("n_nationkey").cast("string").alias("root_id"))
    return roots.withColumn("spec_id", F.explode(F.array(*map(F.lit, SPECS))))


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey = 0 THEN n_nationkey::DOUBLE WHEN n_nationkey = 7 THEN 100 ELSE 1 END::DOUBLE AS size FROM nation")
def expanded_sizes(spark, d):
    """The size of a tile: its own if none is expanded, the whole for the expanded one, a point for others."""
    expanded = F.when(F.col("n_regionkey") != 0, F.lit(7))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), numbers.the_one(expanded, F.col("n_nationkey"), F.col("n_nationkey").cast("double"), F.lit(100.0), F.lit(1.0)).alias("size"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^[^?#]*\?([^#]*&)?page=') THEN regexp_extract(url, '^[^?#]*\?(?:[^#]*?&)?page=([^&#]*)', 1) END AS page, CASE WHEN regexp_matches(url, '^[^?#]*\?([^#]*&)?utm_source=') THEN regexp_extract(url, '^[^?#]*\?(?:[^#]*?&)?utm_source=([^&#]*)', 1) END AS source FROM pages")
def url_parameters(spark, d):
    """Query-string parameters as inputs of a view."""
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", text.url_parameter(url, "page").alias("page"), text.url_parameter(url, "utm_source").alias("source"))


@query()
def word_layout(spark, d):
    """Part names broken into lines for a box, upright or turned, with each word's place."""
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    rows = rows.withColumn("flat", text.fitted(F.col("w"), 60.0, 40.0, 1.2, 0.6)).withColumn("turned", text.fitted(F.col("w"), 40.0, 60.0, 1.2, 0.6))
    rows = rows.withColumn("rotate", F.col("turned.size") > F.col("flat.size")).withColumn("best", F.when(F.col("rotate"), F.col("turned")).otherwise(F.col("flat")))
    return rows.select("p_partkey", "rotate", r9(F.col("best.size") / 16.0, "scale"), F.inline(text.word_places(F.col("best.lines"), 1.2, 0.6, 16.0)))


@query("SELECT i::INT AS i, round(cos(i * 2 * pi() / 7), 9) AS x, round(sin(i * 2 * pi() / 7), 9) AS y FROM range(7) t(i)")
def polygon_points(spark, d):
    rows = spark.range(1).select(F.posexplode(numbers.polygon(7)).alias("i", "p"))
    return rows.select("i", r9(F.col("p.x"), "x"), r9(F.col("p.y"), "y"))


@query("SELECT event_id, value / 20 > 3.2::DOUBLE AS shows_count, value / 20 > 4.8::DOUBLE AS shows_order, round((greatest(len(event_type), len('view')) * 0.8::DOUBLE + 2) * 20, 9) AS label_width, year(current_date)::INT AS footer_year FROM events")
def control_room(spark, d):
    """What a control of some height shows, how wide its labels are, and the year in the footer."""
    count, order = numbers.control_slots(F.col("value") / 20)
    labels = F.array(F.col("event_type"), F.lit("view"))
    return table(spark, d, "events").select("event_id", count.alias("shows_count"), order.alias("shows_order"), r9(numbers.label_width(labels), "label_width"), F.year(F.current_date()).alias("footer_year"))


@query("SELECT event_id, CASE WHEN p < 24 AND p % 4 < 3 THEN (p // 4)::INT END AS open_child, CASE WHEN p < 24 AND p % 4 IN (1, 2) THEN (p // 4)::INT END AS expanded_child FROM (SELECT event_id, event_id % 25 AS p FROM events)")
def timer_states(spark, d):
    """The tour of six children, a tick an event."""
    opened, expanded = numbers.timer_state(F.col("event_id"), 6)
    return table(spark, d, "events").select("event_id", opened.alias("open_child"), expanded.alias("expanded_child"))


@query(f"WITH {FLOW}, {node_sql('q1')} SELECT 'q1' AS spec_id, root::VARCHAR AS root_id, level, k AS key, w::DOUBLE AS weight FROM node")
def tree_files(spark, d):
    """Every root's tree written as a JSON file of the store, and read back as node rows."""
    base = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    store.write_trees(nodes_of(spark, d, "q1"), base)
    return rollup.keyed(store.read_trees(spark, base)).select("spec_id", "root_id", "level", "key", "weight")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: the visible first level of every root with names, ranks and offsets."""
    d = "/root/testdata/sf0.001"
    return visible_of(spark, d, SPECS["q1"].controls(), labels=star.attribute_labels(spark, d))
