"""Queries of the record contracts: each builds JSON records from the star tables, some of them broken, and checks them.

The SQL of each tells the same findings from the plain columns, without any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import exprs, records
from sievework.operators import anchors, benchmarks, relations, roadmaps, specs, verdict_records, verdicts
from sievework.operators.anchors import Anchor
from sievework.operators.ordering import with_running
from sievework.plans.catalogue import query
from sievework.sources.staging import staged
from sievework.sources.tables import table




def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("gate", "defect", "detail").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities"))


def _counted_sql(parts: list[tuple[str, str, str, str]], gate: str, source: str) -> str:
    """(defect, detail, condition, entity) over a source."""
    rows = " UNION ALL ".join(f"SELECT '{d}' AS defect, {detail} AS detail, {e} AS e FROM {source} WHERE {c}" for d, detail, c, e in parts)
    return f"SELECT '{gate}' AS gate, defect, detail, count(*) AS n, count(DISTINCT e) AS n_entities FROM ({rows}) GROUP BY defect, detail"


def features(parts: DataFrame, *also: str) -> DataFrame:
    """A feature record for each part (and other columns of it); what is broken in it follows from its size."""
    size = F.col("p_size")
    text = "string"
    record = F.to_json(
        F.struct(
            F.col("p_partkey").cast(text).alias("feature_id"),
            F.when(size != 3, F.col("p_name")).alias("title"),
            F.col("p_brand").alias("bounded_context"),
            F.when(size > 10, F.concat("p_name", F.lit(". "), "p_type", F.lit("."))).otherwise(F.col("p_name")).alias("description"),
            F.array("p_brand").alias("source_documents"),
            F.array_compact(F.array(F.when(size == 7, F.lit("limit")))).alias("constraints"),
            F.when(size != 13, F.array()).alias("suggested_context_files"),
            F.array().cast("array<string>").alias("depends_on"),
            F.element_at(F.array(F.lit("High"), F.lit("Low"), F.lit(None).cast(text), F.lit("Urgent")), size % 4 + 1).alias("priority"),
            F.when(size == 20, F.struct(F.array(F.struct(F.lit("doc").alias("document"), F.array(F.lit("1")).alias("section_path"), F.lit(9).alias("line_start"), F.lit(3).alias("line_end"))).alias("title"))).alias("field_citations"),
        )
    )
    return parts.select(F.col("p_partkey").alias("entity"), "p_size", *also, record.alias("json"))


_FEATURE_RULES = [
    ("missing_key", "'title'", "p_size = 3", "p_partkey"),
    ("missing_key", "'suggested_context_files'", "p_size = 13", "p_partkey"),
    ("too_few_sentences", "'description'", "p_size <= 10", "p_partkey"),
    ("not_in_domain", "'priority'", "p_size % 4 = 3", "p_partkey"),
    ("lines_out_of_order", "''", "p_size = 20", "p_partkey"),
]


@query("q52_feature_contract", _counted_sql(_FEATURE_RULES, "feature", "part"))
def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    records_ = features(table(spark, sf_dir, "part").repartition("p_partkey"))  # a small table of much work
    return _counted(roadmaps.feature_findings(roadmaps.read_once(records_, "entity", "json"), "entity", "json", "feature"))


#: Parts in a plan; so a record is bounded, and there are more of them with more parts.
PLAN = 50


def _lists_of(rows: DataFrame, key: str, json: str = "json", order: str = "entity") -> DataFrame:
    """key and a JSON list of its records, in order; the groups are plans of ``PLAN`` parts."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, json))), lambda x: x[json])
    return rows.groupBy(key).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("list"))


@query(
    "q53_roadmap_contract",
    f"""WITH f AS (SELECT p_partkey // {PLAN} AS b, p_size AS s FROM part), d AS (
    SELECT 'missing_key' AS defect, 'title' AS detail, b, 2 AS n FROM f WHERE s = 3 UNION ALL SELECT 'missing_key', 'suggested_context_files', b, 2 FROM f WHERE s = 13
    UNION ALL SELECT 'too_few_sentences', 'description', b, 2 FROM f WHERE s <= 10 UNION ALL SELECT 'not_in_domain', 'priority', b, 2 FROM f WHERE s % 4 = 3 UNION ALL SELECT 'lines_out_of_order', '', b, 2 FROM f WHERE s = 20
    UNION ALL SELECT 'not_in_domain', 'mode', b, 1 FROM (SELECT DISTINCT b FROM f) WHERE b % 10 = 1
    UNION ALL SELECT 'not_the_same', '', b, 1 FROM (SELECT DISTINCT b FROM f WHERE s = 50))
    SELECT CAST(b AS VARCHAR) AS plan, defect, detail, sum(n) AS n FROM d GROUP BY ALL""",
)
def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roadmaps of plans: an epic for each type; the flat list lacks the features of size 50 where a plan has some."""
    parts = table(spark, sf_dir, "part")
    plan = F.floor(F.col("p_partkey") / PLAN).alias("plan")
    own = features(parts.select("*", plan), "plan", "p_type")
    epics = own.groupBy("plan", "p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity", "json"))), lambda x: x["json"]), ",").alias("fs"))
    head = F.to_json(F.struct(F.col("p_type").alias("id"), F.col("p_type").alias("name"), F.col("p_type").alias("bounded_context"), F.col("p_type").alias("description"), F.array(F.lit("d")).alias("source_documents")))
    epics = epics.withColumn("h", head).select("plan", F.col("p_type").alias("entity"), F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"features":['), "fs", F.lit("]}")).alias("json"))
    epics = _lists_of(epics, "plan").withColumnRenamed("list", "epics")
    listed = own.withColumn("json", F.when(F.col("p_size") != 50, F.col("json")))
    flat = listed.groupBy("plan").agg(F.concat(F.lit("["), F.array_join(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("entity", "json"))), lambda x: x["json"])), ","), F.lit("]")).alias("flat"))
    mode = F.when(F.col("plan") % 10 == 1, "other").otherwise("extract")
    top = F.to_json(F.struct(F.col("plan").cast("string").alias("project_name"), mode.alias("mode"), F.lit("why").alias("priority_rationale"), F.array().cast("array<string>").alias("constraints_and_dependencies"), F.array().cast("array<string>").alias("open_questions")))
    maps = epics.join(flat, "plan").withColumn("h", top).select(F.col("plan").alias("entity"), F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"epics":'), "epics", F.lit(',"feature_spec_inputs":'), "flat", F.lit("}")).alias("json"))
    found = roadmaps.roadmap_findings(maps, "entity", "json")
    return found.groupBy(F.substring_index("entity_id", ".", 1).alias("plan"), "defect", "detail").agg(F.count("*").alias("n"))


def verdicts_of(orders: DataFrame) -> DataFrame:
    """A verdict on each order; what is broken in it follows from its key."""
    k = F.col("o_orderkey") % 11
    verdict = F.when(k == 0, "maybe").when(k <= 5, "approve").otherwise("reject")
    one = F.struct(F.when(k == 7, "DC-99").otherwise("DC-03").alias("class"), F.when(k == 8, " ").otherwise(F.col("o_orderpriority")).alias("locus"))
    items = F.when(k.isin(2, 7, 8, 10), F.array(one)).when(k == 6, F.array(one, one)).otherwise(F.array().cast("array<struct<class: string, locus: string>>"))
    whole = F.to_json(F.struct(verdict.alias("verdict"), items.alias("findings")))
    json = F.when(k == 3, F.to_json(F.struct(verdict.alias("verdict"), F.lit("none").alias("findings")))).when(k == 4, F.lit("[1]")).otherwise(whole)
    return orders.select(F.col("o_orderkey").alias("entity"), "o_custkey", k.alias("k"), json.alias("json"))


@query(
    "q54_verdict_contract",
    """WITH o AS (SELECT o_orderkey AS e, o_orderkey % 11 AS k FROM orders), d AS (
    SELECT e, 'verdict_enum' AS defect, 'maybe' AS detail FROM o WHERE k = 0 UNION ALL SELECT e, 'approve_with_findings', '' FROM o WHERE k = 2 UNION ALL SELECT e, 'findings_shape', '' FROM o WHERE k = 3
    UNION ALL SELECT e, 'unloadable', 'not_object' FROM o WHERE k = 4 UNION ALL SELECT e, 'class_enum', 'findings[0]' FROM o WHERE k = 7 UNION ALL SELECT e, 'finding_locus', 'findings[0]' FROM o WHERE k = 8
    UNION ALL SELECT e, 'reject_without_findings', '' FROM o WHERE k = 9)
    SELECT 'verdict' AS gate, defect, detail, count(*) AS n, count(DISTINCT e) AS n_entities FROM d GROUP BY ALL""",
)
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(verdict_records.verdict_findings(verdicts_of(table(spark, sf_dir, "orders")), "entity", "json", "verdict"))


@query(
    "q55_found_text",
    """SELECT o_orderkey AS entity, CASE WHEN o_orderkey % 11 IN (2, 10) THEN concat('DC-03', chr(10), o_orderpriority) WHEN o_orderkey % 11 = 7 THEN concat('DC-99', chr(10), o_orderpriority)
    WHEN o_orderkey % 11 = 8 THEN concat('DC-03', chr(10), ' ') WHEN o_orderkey % 11 = 6 THEN concat('DC-03', chr(10), o_orderpriority, chr(10), 'DC-03', chr(10), o_orderpriority) ELSE '' END AS locus FROM orders""",
)
def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts_of(table(spark, sf_dir, "orders")).select("entity", verdict_records.found_text(F.col("json")).alias("locus"))


@query(
    "q56_bundle_contract",
    """SELECT c_custkey AS entity_id, 'bundle' AS gate, 'evidence_missing' AS defect, 'tests' AS detail FROM customer WHERE c_nationkey % 3 = 0
    UNION ALL SELECT c_custkey, 'bundle', 'id_missing', 'task_id' FROM customer WHERE c_nationkey % 5 = 1
    UNION ALL SELECT c_custkey, 'bundle', 'other_id', CAST(c_custkey + 1 AS VARCHAR) FROM customer WHERE c_nationkey = 7
    UNION ALL SELECT c_custkey, 'bundle', 'unknown_field', 'extra' FROM customer WHERE c_nationkey = 8""",
)
def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    text = F.col("c_custkey").cast("string")
    own = F.when(n == 7, (F.col("c_custkey") + 1).cast("string")).otherwise(text)
    json = F.to_json(F.struct(own.alias("bundle_id"), text.alias("feature_id"), F.when(n % 5 != 1, text).alias("task_id"), F.lit("ok").alias("honesty"), F.when(n % 3 != 0, "x").alias("tests"), F.when(n == 8, 1).alias("extra")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", json.alias("json"))
    return verdict_records.bundle_findings(rows, "c_custkey", "json", "bundle", ("bundle_id", "feature_id", "task_id"), ("honesty", "tests"), ("coverage",))


#: Customers that one list of a wave holds.
WAVE = 1000


@query(
    "q57_frontmatter",
    """WITH t AS (SELECT c_nationkey AS plan, c_custkey AS task, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), d AS (
    SELECT task, 'task_file_missing' AS defect FROM t WHERE task % 10 = 0 UNION ALL SELECT task, 'frontmatter_unparseable' FROM t WHERE task % 10 = 1 UNION ALL SELECT task, 'frontmatter_id_mismatch' FROM t WHERE task % 10 = 2
    UNION ALL SELECT task, 'task_type_missing' FROM t WHERE task % 10 = 3 UNION ALL SELECT task, 'task_type_invalid' FROM t WHERE seg = 'BUILDING' AND task % 10 > 3 OR seg = 'BUILDING' AND task % 10 = 2
    UNION ALL SELECT task, 'wave_mismatch' FROM t WHERE r % 2 = 0 AND task % 10 > 1) SELECT defect, count(*) AS n, min(task) AS first_task, max(task) AS last_task FROM d GROUP BY defect""",
)
def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of nations, tasks of customers; the files say wave 1, and every second task is in wave 2. A wave comes in lists of ``WAVE`` customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plan"), "c_custkey", "c_mktsegment", F.col("c_custkey").cast("string").alias("task"))
    c = staged(with_running(c, ["plan"], ["c_custkey"], F.lit(1), "r"))
    m = F.col("c_custkey") % 10
    path = F.concat(F.lit("tasks/"), "task", F.lit(".md")).alias("file_path")
    tasks = c.select("plan", "task", path)
    json = F.to_json(F.struct(F.when(m == 2, "other").otherwise(F.col("task")).alias("id"), F.when(m != 3, F.col("c_mktsegment")).alias("task_type"), F.col("plan").cast("string").alias("feature_id"), F.lit(1).alias("wave")))
    fronts = c.where(m != 0).select("plan", path, F.when(m != 1, json).alias("json"))
    waves = c.groupBy("plan", F.when(F.col("r") % 2 == 0, 2).otherwise(1).alias("place"), F.floor(F.col("r") / WAVE)).agg(F.collect_list("task").alias("wave")).select("plan", "place", "wave")
    plans = c.select("plan").distinct().select("plan", F.col("plan").cast("string").alias("plan_id"))
    found = specs.frontmatter_findings(tasks, fronts, waves, plans, "plan", ("AUTOMOBILE", "FURNITURE", "MACHINERY", "HOUSEHOLD"))
    number = F.col("entity_id").cast("long")
    return found.groupBy("defect").agg(F.count("*").alias("n"), F.min(number).alias("first_task"), F.max(number).alias("last_task"))


@query(
    "q58_linkage",
    """WITH t AS (SELECT DISTINCT l_orderkey % 50 AS plan, l_orderkey AS scenario, l_partkey AS task, l_linenumber AS no FROM lineitem), tasks AS (SELECT DISTINCT plan, task FROM t WHERE task % 7 <> 0),
    links AS (SELECT DISTINCT plan, scenario, task FROM t WHERE no > 1), d AS (
    SELECT 'dangling_task_tag' AS defect, count(*) AS n FROM links WHERE task % 7 = 0
    UNION ALL SELECT 'smoke_scenario_unlinked', count(*) FROM (SELECT DISTINCT plan, scenario FROM t WHERE scenario % 3 = 0) s WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.plan = s.plan AND l.scenario = s.scenario)
    UNION ALL SELECT 'feature_task_owns_no_scenario', count(*) FROM tasks k WHERE task % 2 = 0 AND NOT EXISTS (SELECT 1 FROM links l WHERE l.plan = k.plan AND l.task = k.task))
    SELECT defect, n FROM d WHERE n > 0""",
)
def q58(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("plan"), F.col("l_orderkey").cast("string").alias("scenario"), F.col("l_partkey"), F.col("l_linenumber").alias("no"), F.col("l_orderkey"))
    tagged = F.concat(F.lit("@task:"), F.col("l_partkey").cast("string"))
    own = rows.groupBy("plan", "scenario").agg(F.array_distinct(F.concat(F.array_compact(F.collect_list(F.when(F.col("no") > 1, tagged))), F.when(F.max("l_orderkey") % 3 == 0, F.array(F.lit("@smoke"))).otherwise(F.array().cast("array<string>")))).alias("tags")).withColumn("place", F.lit(1))
    tasks = rows.where("l_partkey % 7 <> 0").select("plan", F.col("l_partkey").cast("string").alias("task"), F.when(F.col("l_partkey") % 2 == 0, "feature").otherwise("docs").alias("task_type")).distinct()
    return specs.linkage_findings(specs.task_tags(own, "plan"), tasks, "plan").groupBy("defect").agg(F.count("*").alias("n"))


@query(
    "q59_manifest",
    """WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place, role FROM conversations), d AS (
    SELECT 'entry_field' AS defect, count(*) AS n FROM e WHERE role = 'system' UNION ALL SELECT 'id_not_sequential', count(*) FROM e WHERE place <> turn + 1
    UNION ALL SELECT 'confidence_enum', count(*) FROM e WHERE turn % 4 = 3 UNION ALL SELECT 'human_response_enum', count(*) FROM e WHERE turn % 5 = 4
    UNION ALL SELECT 'scenario_not_in_feature', count(*) FROM e WHERE role = 'tool' UNION ALL SELECT 'top_level_field', count(DISTINCT conv_id) FROM e WHERE conv_id % 9 = 0) SELECT defect, n FROM d WHERE n > 0""",
)
def q59(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    t = F.col("turn")
    entries = rows.select(
        "conv_id",
        place.alias("place"),
        F.format_string("ASSUM-%03d", (t + 1).cast("int")).alias("id"),
        F.col("role").alias("scenario"),
        F.lit("said").alias("assumption"),
        F.when(t % 4 == 3, "sure").otherwise("low").alias("confidence"),
        F.when(F.col("role") == "system", " ").otherwise("b").alias("basis"),
        F.when(t % 5 == 4, "perhaps").when(t % 5 == 3, "overridden: x").otherwise("confirmed").alias("human_response"),
    )
    heads = rows.select("conv_id").distinct().select("conv_id", F.lit("f").alias("feature"), F.lit("g").alias("generated"), F.when(F.col("conv_id") % 9 != 0, "s").alias("stack"), F.lit(True).alias("review_required"))
    names = rows.where("role <> 'tool'").select("conv_id", F.col("role").alias("scenario"))
    names = names.unionAll(rows.select("conv_id", F.lit("system").alias("scenario"))).distinct()
    return specs.manifest_findings(heads, entries, "conv_id", names).groupBy("defect").agg(F.count("*").alias("n"))


@query("q60_programs", """SELECT p_partkey, concat('def f():', chr(10), '    return ', p_size, chr(10), chr(10), 'assert f() == ', p_size, chr(10), 'assert f()', chr(10)) AS script, p_size AS number FROM part""")
def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("def f():\n    return "), size).alias("code"), F.array(F.concat(F.lit("assert f() == "), size), F.lit("assert f()")).alias("test_list"), F.lit("").alias("test_setup_code"), F.concat(F.lit("MBPP/"), size).alias("task_id"))
    for c in ("prompt", "canonical_solution", "test", "entry_point"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    kind = F.lit(benchmarks.TESTS)
    return rows.select("p_partkey", benchmarks.execution_script(kind, benchmarks.reference_program(kind)).alias("script"), benchmarks.task_number(F.col("task_id")).alias("number"))


@query(
    "q61_floor_and_lost_rows",
    """WITH g AS (SELECT c_mktsegment AS family, o_orderpriority AS task, o_orderkey AS row_id, o_orderstatus = 'F' AS ok FROM orders JOIN customer ON c_custkey = o_custkey), s AS (
    SELECT family, task, count(*) FILTER (ok) AS solved, count(*) AS total, CASE WHEN count(*) FILTER (NOT ok) <= 1000 THEN string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY CAST(row_id AS VARCHAR)) FILTER (NOT ok) ELSE CAST(count(*) FILTER (NOT ok) AS VARCHAR) END AS lost FROM g GROUP BY ALL)
    SELECT family AS entity_id, 'floor' AS gate, CASE WHEN family = 'BUILDING' THEN 'oracle_not_total' WHEN task = '2-HIGH' THEN 'no_baseline' ELSE 'below_floor' END AS defect,
    CASE WHEN family <> 'BUILDING' AND task = '2-HIGH' THEN task ELSE concat(task, ':', lost) END AS detail FROM s WHERE CASE WHEN family = 'BUILDING' THEN solved < total WHEN task = '2-HIGH' THEN true ELSE task = '1-URGENT' END""",
)
def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are market segments, tasks are priorities; one run is an oracle, one task has a high baseline, one has none."""
    grades = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("run"), F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("status"))
    candidates = grades.select("run").distinct().select("run", F.col("run").alias("family"), F.when(F.col("run") == "BUILDING", True).alias("oracle"))
    known = grades.where("task <> '2-HIGH'").select(F.col("run").alias("family"), "task").distinct().withColumn("baseline", F.when(F.col("task") == "1-URGENT", 1_000_000_000).otherwise(0))
    return benchmarks.floor_findings(grades, candidates, known)


@query(
    "q62_repetitions",
    """WITH s AS (SELECT DISTINCT p_brand AS task, p_size AS rep FROM part), g AS (SELECT task, rep FROM (SELECT DISTINCT task FROM s), range(1, 41) r(rep))
    SELECT task, rep, 'missing' AS defect FROM g ANTI JOIN s USING (task, rep) UNION ALL SELECT task, rep, 'extra' FROM s WHERE rep > 40""",
)
def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "part").select(F.col("p_brand").alias("task"), F.col("p_size").alias("rep"))
    return benchmarks.repetition_findings(seen, seen, 40)


@query(
    "q63_cited_documents",
    """SELECT DISTINCT o_orderkey, name, kind FROM (SELECT o_orderkey, o_orderpriority AS name, 'document' AS kind FROM orders UNION ALL SELECT l_orderkey, concat('p', l_partkey, '.md'), 'suggested_context_files' FROM lineitem
    UNION ALL SELECT l_orderkey, l_returnflag, 'cited_docs' FROM lineitem UNION ALL SELECT l_orderkey, concat('s', l_suppkey), 'source_documents' FROM lineitem) JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem GROUP BY 1) USING (o_orderkey)""",
)
def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cite documents in four ways, at several depths."""
    # Keys alone are sorted and shuffled; the records are made of them afterwards.
    keys = F.collect_list(F.struct("l_partkey", "l_returnflag", "l_suppkey")).alias("keys")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(keys)

    def line(k: Column) -> Column:
        source = F.struct(F.concat(F.lit("s"), k["l_suppkey"]).alias("filename"))
        return F.struct(F.array(F.concat(F.lit("p"), k["l_partkey"], F.lit(".md")), F.lit("x.txt")).alias("suggested_context_files"), F.array(k["l_returnflag"], F.lit(" ")).alias("cited_docs"), F.struct(F.array(source).alias("source_documents")).alias("inner"))

    json = F.to_json(F.struct(F.col("o_orderpriority").alias("document"), F.transform("keys", line).alias("lines")))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", F.explode(records.cited(json)).alias("c"))
    return rows.select("o_orderkey", "c.name", "c.kind")


_UNIT_ANCHORS = (Anchor("ring", 1, "ring"), Anchor("red", 1, "red"), Anchor("economy", 1, "ECONOMY"), Anchor("bolt", 1, "bolt"), Anchor("bolt", 2, "blue"))


def _plan_records(parts: DataFrame) -> DataFrame:
    """Plans of ``PLAN`` parts: a feature for each part, and an assumption for every part of size 9."""
    parts = parts.withColumn("plan", F.floor(F.col("p_partkey") / PLAN).cast("string"))
    feature = F.struct(F.col("p_partkey").cast("string").alias("feature_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.array(F.when(F.col("p_size") == 7, "limit")).alias("constraints"))
    said = F.array_compact(F.collect_list(F.when(F.col("p_size") == 9, F.struct(F.concat(F.lit("we need a "), "p_name").alias("statement")))))
    own = parts.groupBy("plan").agg(F.collect_list(feature).alias("features"), said.alias("assumptions"))
    json = F.to_json(F.struct(F.array(F.struct(F.col("plan").alias("id"), F.concat(F.lit("plan "), "plan").alias("name"), "features")).alias("epics"), "assumptions", F.array(F.lit("who?")).alias("open_questions"), F.lit("all of it").alias("priority_rationale")))
    return own.select(F.col("plan").alias("entity"), json.alias("json"))


@query(
    "q64_requirement_units",
    """SELECT CAST(p_partkey // 50 AS VARCHAR) AS entity, concat('feature:', p_partkey) AS unit, concat(p_name, chr(10), p_type, CASE WHEN p_size = 7 THEN concat(chr(10), 'limit') ELSE '' END) AS text FROM part
    UNION ALL SELECT DISTINCT CAST(p_partkey // 50 AS VARCHAR), concat('epic:', CAST(p_partkey // 50 AS VARCHAR)), concat('plan ', CAST(p_partkey // 50 AS VARCHAR)) FROM part UNION ALL SELECT DISTINCT CAST(p_partkey // 50 AS VARCHAR), 'priority_rationale', 'all of it' FROM part""",
)
def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roadmaps.requirement_units(_plan_records(table(spark, sf_dir, "part")), "entity", "json")


@query(
    "q65_licensed_units",
    """WITH a AS (SELECT CAST(p_partkey // 50 AS VARCHAR) AS entity, concat('feature:', p_partkey) AS unit, g.group_id, coalesce(nullif(regexp_extract(concat(p_name, chr(10), p_type), g.p1), ''), regexp_extract(concat(p_name, chr(10), p_type), g.p2)) AS matched
        FROM part, (VALUES ('ring', 'ring', 'ring'), ('red', 'red', 'red'), ('economy', 'ECONOMY', 'ECONOMY'), ('bolt', 'bolt', 'blue')) g(group_id, p1, p2)),
    h AS (SELECT * FROM a WHERE matched <> ''), own AS (SELECT DISTINCT entity, group_id FROM h),
    s AS (SELECT CAST(p_partkey // 50 AS VARCHAR) AS entity, p_partkey, g.group_id FROM part, (VALUES ('ring', 'ring', 'ring'), ('red', 'red', 'red'), ('economy', 'ECONOMY', 'ECONOMY'), ('bolt', 'bolt', 'blue')) g(group_id, p1, p2)
        WHERE p_size = 9 AND (contains(p_name, p1) OR contains(p_name, p2))),
    ok AS (SELECT entity, p_partkey FROM s JOIN own USING (entity, group_id) GROUP BY ALL HAVING count(*) <= 2), l AS (SELECT DISTINCT entity, group_id FROM s JOIN ok USING (entity, p_partkey))
    SELECT entity, unit, group_id, matched FROM h ANTI JOIN l USING (entity, group_id)""",
)
def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that the units of a plan assert and none of its statements licenses."""
    plans = _plan_records(table(spark, sf_dir, "part"))
    units, said = roadmaps.requirement_units(plans, "entity", "json"), roadmaps.license_statements(plans, "entity", "json")
    return anchors.unlicensed(units, said, "entity", "text", _UNIT_ANCHORS).select("entity", "unit", "group_id", "matched")


@query("q66_selection", "SELECT CAST(p_partkey // 50 AS VARCHAR) AS entity, CAST(p_partkey AS VARCHAR) AS feature_id, p_name AS title, '' AS bounded_context, 0 AS n_needs FROM part")
def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = roadmaps.selected_features(_plan_records(table(spark, sf_dir, "part")), "entity", "json")
    return roadmaps.reference_features(chosen, "entity").select("entity", "feature_id", "title", "bounded_context", F.size("depends_on").alias("n_needs"))


@query("q67_orders_without_lines", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.ungrounded(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("q68_unseen_sizes", "SELECT p_brand, p_size, p_type FROM (SELECT * FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_size FROM part), (SELECT DISTINCT p_type FROM part)) g ANTI JOIN (SELECT DISTINCT p_brand, p_size, p_type FROM part) USING (p_brand, p_size, p_type)")
def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return relations.unseen_grid(parts, [parts.select("p_brand"), parts.select("p_size"), parts.select("p_type")])


@query("q69_failed_entities", "SELECT 'low' AS gate, c_custkey AS entity_id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'high', c_custkey FROM customer WHERE c_acctbal > 9000")
def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    low, high = (c.where(w).select(F.lit(g).alias("gate"), F.col("c_custkey").alias("entity_id")) for g, w in (("low", "c_acctbal < 0"), ("high", "c_acctbal > 9000")))
    return verdicts.failed_entities(low.unionAll(high).unionAll(low))


_RULES_SQL = ", ".join(str((k, *r)) for k, r in enumerate(verdicts.SUITE_RULES))


@query(
    "q70_suite_verdicts",
    f"""WITH r AS (SELECT * FROM (VALUES {_RULES_SQL}) t(k, suite, gate, need, "of")), c AS (SELECT suite, gate, need, "of", count(c_custkey) AS n_results, count(c_custkey) FILTER (c_acctbal > 7000) AS n_passed
        FROM r LEFT JOIN customer ON c_nationkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 9 ELSE 0 END = k GROUP BY ALL),
    o AS (SELECT suite, CASE WHEN suite = 'gc' AND gate = 'G-G4' THEN 3 WHEN n_results < "of" THEN 2 WHEN n_passed >= need THEN 0 ELSE 1 END AS o FROM c)
    SELECT suite, ['PASS', 'FAIL', 'INVALID', 'BLOCKED'][max(o) + 1] AS verdict, count(*) AS n_gates FROM o GROUP BY suite""",
)
def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suites' gates by the customers of a nation each; one instrument is broken."""
    rules = verdicts.suite_rules(spark)
    numbered = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(verdicts.SUITE_RULES)], "k int, suite string, gate string")
    k = F.col("c_nationkey") + F.when(F.col("c_mktsegment") == "BUILDING", 9).otherwise(0)
    results = table(spark, sf_dir, "customer").select(k.alias("k"), (F.col("c_acctbal") > 7000).alias("passed")).join(F.broadcast(numbered), "k")  # a row for each gate
    blocked = rules.where("suite = 'gc' AND gate = 'G-G4'").select("suite", "gate")
    return verdicts.suite_verdict(verdicts.gate_outcomes(results.select("suite", "gate", "passed"), rules, blocked), "suite")


@query("q71_compile_results", """SELECT event_id AS entity_id, 'compile' AS gate, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'not_ok' END, CASE WHEN event_type = 'error' THEN 'errors' END, CASE WHEN event_type = 'click' THEN 'exit_code' END], lambda x: x IS NOT NULL)) AS defect,
    unnest(list_filter([CASE WHEN event_type = 'error' THEN '2' END, CASE WHEN event_type = 'error' THEN '2' END, CASE WHEN event_type = 'click' THEN '1' END], lambda x: x IS NOT NULL)) AS detail FROM events""")
def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    said = lambda s: F.struct(F.lit(s).alias("severity"), F.lit("m").alias("message"))
    envelope = F.to_json(F.struct((~bad).alias("ok"), F.when(bad, F.array(said("error"), said("warning"), said("error"))).otherwise(F.array(said("warning"))).alias("diagnostics"), F.when(bad, 2).otherwise(0).alias("errorCount")))
    rows = table(spark, sf_dir, "events").select("event_id", envelope.alias("envelope"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("code"))
    return verdict_records.compile_findings(rows, "event_id", "envelope", "code", "compile")


@query("q72_first_appearances", "SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL")
def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles in the order in which a conversation first has them, read out of a text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] ["), "role", F.lit("]")).alias("t"))
    names = benchmarks.first_appearances(rows, "conv_id", "turn", "t", r"\[([a-z]+)\]")
    order = names.select("conv_id", F.posexplode("names").alias("place", "role"))
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return order.join(first, ["conv_id", "role"]).select("conv_id", "role", "first_turn")


def _summary(n: Column, smoke: Column) -> Column:
    return F.concat(F.lit("**Stack**: x\n**Scenarios**: "), n, F.lit(" total ("), smoke, F.lit(" smoke, 0 regression)\n**Assumptions**: 0 total (0 high / 0 medium / 0 low)\n"), *(F.lit(f"| {name} ({t}) | 0 |\n") for t, name in specs.CATEGORIES.items()))


@query(
    "q73_summary_coherence",
    """SELECT user_id AS entity_id, 'summary' AS gate, 'scenarios' AS defect, concat(count(*) + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END, '/', count(*) FILTER (event_type = 'error') + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END, '/0') AS detail
    FROM events WHERE user_id % 4 = 0 OR user_id % 5 = 0 GROUP BY user_id""",
)
def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of users' events that claim one too many for some users."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    found = events.select("user_id", F.when(F.col("event_type") == "error", F.array(F.lit("@smoke"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    more = lambda m: F.when(F.col("user_id") % m == 0, 1).otherwise(0)
    claims = events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("s"))
    claims = claims.select("user_id", _summary((F.col("n") + more(4)).cast("string"), (F.col("s") + more(5)).cast("string")).alias("text"))
    entries = events.limit(0).select("user_id", F.lit("").alias("confidence"))
    return specs.summary_findings(claims, found, entries, "user_id", "text")


@query("q74_mode_assignment", "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, 'modes' AS gate, 'mode_assignment' AS defect, CASE WHEN p_size % 2 = 0 THEN 'task-work' ELSE 'direct' END AS detail FROM part WHERE (p_size % 2 = 0) <> (p_size % 8 >= 4)")
def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("task"), (F.col("p_size") % 8).alias("complexity"), F.when(F.col("p_size") % 2 == 0, "task-work").otherwise("direct").alias("implementation_mode"))
    return specs.mode_findings(tasks)


@query("q75_enriching_fields", "SELECT p_partkey, 1 + CAST(p_size > 10 AS INT) + CAST(p_size > 20 AS INT) + CAST(p_size % 2 = 0 AS INT) AS n FROM part")
def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    json = F.to_json(F.struct(F.lit(0).alias("priority"), F.when(size > 10, "Must").otherwise("").alias("moscow"), F.when(size > 20, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("acceptance_criteria"), F.when(size % 2 == 0, False).alias("role")))
    return table(spark, sf_dir, "part").select("p_partkey", roadmaps.enriching_fields(json).alias("n"))


@query("q76_line_ends", "SELECT p_partkey, concat(p_name, chr(10)) AS a, p_type AS b FROM part")
def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a task tag go, and nothing else changes."""
    text = F.concat(F.col("p_name"), F.lit("\n  @task:x-1\n"))
    return table(spark, sf_dir, "part").select("p_partkey", exprs.lines_without(text, specs.TASK_TAG).alias("a"), exprs.header_field(F.concat(F.lit("# Stack: no\n# Stack: "), "p_type", F.lit("\n")), r"^# Stack: (.*)$", last=True).alias("b"))
