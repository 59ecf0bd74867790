"""Checks of scenario files, their manifests, summaries and plans; inputs are tables of scenarios, entries, tasks and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.exprs import blank, blocks_of, header_counts, header_field, stripped, task_type
from sievework.functions.scenario_files import scenario_parts
from sievework.operators.anchors import Anchor, first_matches
from sievework.operators.findings import Rule, check, union
from sievework.operators.lines import out_of_place
from sievework.sources.staging import staged

#: Confidences, what people answer, the categories of scenarios and how a summary names them.
CONFIDENCE = ("high", "medium", "low")
ANSWERS = ("confirmed", "deferred")
OVERRIDDEN = "overridden: "
CATEGORIES = {"@key-example": "Key examples", "@boundary": "Boundary conditions", "@negative": "Negative cases", "@edge-case": "Edge cases"}
ENTRY_FIELDS = ("id", "scenario", "assumption", "confidence", "basis", "human_response")
ANNOTATION = r"\[ASSUMPTION:\s*confidence=(\w+)"
SUMMARY = {
    "stack": r"^\*\*Stack\*\*:\s*(.+)$",
    "generated": r"^\*\*Generated\*\*:\s*(.+)$",
    "review_required": r"^\*\*Review required\*\*:\s*(Yes|No)",
    "scenarios": r"^\*\*Scenarios\*\*:\s*(\d+)\s+total\s*\((\d+)\s+smoke,\s*(\d+)\s+regression\)",
    "assumptions": r"^\*\*Assumptions\*\*:\s*(\d+)\s+total\s*\((\d+)\s+high\s*/\s*(\d+)\s+medium\s*/\s*(\d+)\s+low",
}
HEADER_FIELDS = ("Feature", "Stack", "Assumptions", "Generated")
MISPLACED = ("no_feature_block", "multiple_feature_blocks", "text_before_feature", "step_outside_scenario", "malformed_tag_line", "rule_block_not_in_contract", "unterminated_docstring")
TASK_TAG = r"^\s*@task:\S+\s*$"


def scenarios(texts: DataFrame, key: str, text: str, *columns: str) -> DataFrame:
    """key, place (from 1), scenario, tags, comments and steps of every scenario; or only some of these columns.

    Tags and comments above a scenario belong to it, as do the comments inside it.
    """
    asked = columns or ("place", "scenario", "tags", "comments", "steps")
    parts = scenario_parts(texts, key, text, ["name" if c == "scenario" else c for c in asked], ("scenario",))
    return parts.select(key, *(F.col("name").alias("scenario") if c == "scenario" else c for c in asked))


def scenarios_of(parts: DataFrame, key: str) -> DataFrame:
    """The same for parts that were read before."""
    return parts.where("part = 'scenario'").select(key, "place", F.col("name").alias("scenario"), "tags", "comments", "steps")


def requirement_units(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, unit and text of the feature, the background and each scenario; comments and tags state nothing."""
    unit = F.when(F.col("part") == "scenario", F.concat(F.lit("scenario:"), "name")).otherwise(F.col("part"))
    told = F.when(F.col("part") == "feature", F.concat_ws("\n", F.coalesce("name", F.lit("")), F.when(F.col("text") != "", F.col("text")))).otherwise(F.col("text"))
    rows = scenario_parts(texts, key, text, ("part", "name", "text"), ("feature", "background", "scenario")).select(key, unit.alias("unit"), told.alias("text"))
    return rows.where(~((F.col("unit") == "feature") & blank(F.col("text"))))


def manifest_licenses(entries: DataFrame, key: str) -> DataFrame:
    """key and text of what licenses requirements: the assumptions of a manifest."""
    return entries.where("assumption IS NOT NULL").select(key, F.col("assumption").alias("text"))


def structure_findings(found: DataFrame, texts: DataFrame, key: str, text: str, story: Sequence[str] = ("As a", "I want", "So that"), parts: DataFrame | None = None) -> DataFrame:
    """Files with a byte order mark, without scenarios or without a part of the story in the feature's description, all that is out of
    place but for wrapped steps, and scenarios (of ``scenarios``) without steps or without a Then. ``parts`` are those of the texts, if they were read before."""
    parts = scenario_parts(texts, key, text, ("part", "line", "name", "text", "defect"), ("header", "mark", "feature", "defect")) if parts is None else parts
    own = F.when(F.col("part") == "feature", F.lower(F.translate("text", "\n", " ")))
    files = parts.where("part IN ('header', 'mark', 'feature')").select(key, own.alias("story"), (F.col("part") == "mark").alias("bom"), F.lit(0).alias("n"))
    files = files.unionByName(found.select(key, F.lit(None).cast("string").alias("story"), F.lit(None).cast("boolean").alias("bom"), F.lit(1).alias("n")))
    whole = files.groupBy(key).agg(F.max("story").alias("structure__story"), F.bool_or("bom").alias("structure__bom"), F.sum("n").alias("structure__n"))
    told = F.coalesce("structure__story", F.lit(""))
    rules = [Rule("byte_order_mark", F.col("structure__bom")), Rule("no_scenarios", F.col("structure__n") == 0), *(Rule("story_line_missing", ~F.contains(told, F.lit(s.lower())), F.lit(s)) for s in story)]
    placed = check(out_of_place(parts, key).where("defect <> 'wrapped_step_continuation'"), key, "structure", [Rule(d, F.col("defect") == d, F.col("line_no")) for d in MISPLACED])
    then = F.exists("steps", lambda s: F.substring_index(s, " ", 1) == "Then")
    own = [Rule("no_steps", F.size("steps") == 0, F.col("scenario")), Rule("no_then", ~then, F.col("scenario"))]
    return union(check(whole, key, "structure", rules), placed, check(found, key, "structure", own))


def category_findings(found: DataFrame, key: str, least: int = 8) -> DataFrame:
    """Files that lack a category, have few scenarios, or scenarios without a comment that tells why."""
    n = found.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("tags", t)).alias(t) for t in CATEGORIES))
    rules = [Rule("category_missing", F.col(f"`{t}`") == 0, F.lit(t)) for t in CATEGORIES] + [Rule("too_few_scenarios", F.col("n") < least, F.col("n"))]
    why = F.exists("comments", lambda c: c.rlike(r"^#\s*Why:"))
    return union(check(n, key, "categories", rules), check(found, key, "categories", [Rule("why_missing", ~why, F.col("scenario"))]))


def tag_count(found: DataFrame, key: str, tag: str) -> DataFrame:
    return found.groupBy(key).agg(F.count_if(F.array_contains("tags", tag)).alias("n"))


def task_tags(found: DataFrame, key: str) -> DataFrame:
    """key, scenario and the ids of its task tags; of scenarios with one name the last counts."""
    ids = F.transform(F.filter("tags", lambda t: t.startswith("@task:")), lambda t: F.substring_index(t, "@task:", -1))
    return found.groupBy(key, "scenario").agg(F.max_by(ids, "place").alias("tasks"), F.max_by("tags", "place").alias("tags"))


def banned_language(found: DataFrame, key: str, banned: Sequence[Anchor]) -> DataFrame:
    """Steps that a banned group matches, once for each group and step."""
    return first_matches(found.select(key, "scenario", F.explode("steps").alias("step")), "step", banned)


def implementation_comments(texts: DataFrame, key: str, text: str, *also: str) -> DataFrame:
    """key (and other columns), line_no and line."""
    at = F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    rows = texts.where(F.contains(F.col(text), F.lit("Implementation"))).select(key, *also, at).where(F.col("line").rlike(r"^\s*#\s*Implementation\s*:"))
    return rows.select(key, *also, (F.col("line_no") + 1).alias("line_no"), stripped(F.col("line")).alias("line"))


def header_block(text: Column) -> Column:
    """A struct of the fields in the comments before the feature; of several the last counts."""
    head = F.regexp_extract(text, r"(?s)\A(.*?)(?:^|\n)\s*Feature:", 1)
    own = F.when(head == "", text).otherwise(head)
    fields = [stripped(header_field(own, rf"^\s*#+\s*{f}:(.*)$", last=True)).alias(f.lower()) for f in HEADER_FIELDS]
    return F.struct(header_field(own, r"^\s*#+\s*(Generated by.*?)\s*$", last=True).alias("generated_by"), *fields)


def manifest_findings(manifests: DataFrame, entries: DataFrame, key: str, scenario_names: DataFrame, gate: str = "manifest") -> DataFrame:
    """manifests: key, feature, generated, stack (string), review_required (boolean); entries: key, place (from 1) and ENTRY_FIELDS; scenario_names: key, scenario."""
    top = [Rule("top_level_field", F.col(c).isNull(), F.lit(c)) for c in ("feature", "generated", "stack", "review_required")]
    should = F.format_string("ASSUM-%03d", F.col("place").cast("int"))
    empty = [Rule("entry_field", blank(F.col(c)), F.concat_ws(":", F.coalesce("id", F.concat(F.lit("#"), "place")), F.lit(c))) for c in ENTRY_FIELDS]
    answer = F.col("human_response")
    domain = [
        Rule("id_not_sequential", F.col("id") != should, F.col("id")),
        Rule("confidence_enum", ~F.col("confidence").isin(*CONFIDENCE), F.col("id")),
        Rule("human_response_enum", ~answer.isin(*ANSWERS) & ~answer.startswith(OVERRIDDEN), F.col("id")),
    ]
    lost = entries.where(~blank(F.col("scenario"))).join(scenario_names.select(key, "scenario").distinct(), [key, "scenario"], "left_anti")
    return union(check(manifests, key, gate, top), check(entries, key, gate, empty + domain), check(lost, key, gate, [Rule("scenario_not_in_feature", F.lit(True), F.col("id"))]))


def automatic_findings(manifests: DataFrame, entries: DataFrame, key: str, gate: str = "automatic") -> DataFrame:
    """Without people all is of low confidence and deferred, and a review is required."""
    own = entries.groupBy(key).agg(F.bool_and(F.col("confidence") == "low").alias("low"), F.bool_and(F.col("human_response") == "deferred").alias("deferred"))
    both = manifests.join(own, key, "left")
    return check(both, key, gate, [Rule("not_all_low", ~F.col("low")), Rule("not_all_deferred", ~F.col("deferred")), Rule("review_not_required", ~F.coalesce("review_required", F.lit(False)))])


def annotation_findings(found: DataFrame, entries: DataFrame, key: str, gate: str = "annotations") -> DataFrame:
    """Annotations with another confidence, and entries whose scenario has no annotation at all."""
    marks = found.select(key, "scenario", F.flatten(F.transform("comments", lambda c: F.regexp_extract_all(c, F.lit(ANNOTATION), 1))).alias("marks"))
    wrong = marks.select(key, "scenario", F.explode("marks").alias("mark"))
    none = entries.join(marks.groupBy(key, "scenario").agg(F.max(F.size("marks")).alias("n")), [key, "scenario"]).where("n = 0")
    return union(
        check(wrong, key, gate, [Rule("annotation_confidence_enum", ~F.col("mark").isin(*CONFIDENCE), F.concat_ws(":", "scenario", "mark"))]),
        check(none, key, gate, [Rule("annotation_missing", F.lit(True), F.col("id"))]),
    )


def parsed_summary(text: Column) -> Column:
    """A struct of what a summary claims; null where it claims nothing."""
    row = lambda tag, name: header_field(text, rf"\|\s*{name} \({tag}\)\s*\|\s*(\d+)\s*\|").try_cast("int").alias(tag)
    single = [header_field(text, SUMMARY[k]).alias(k) for k in ("stack", "generated", "review_required")]
    return F.struct(*single, header_counts(text, SUMMARY["scenarios"], 3).alias("scenarios"), header_counts(text, SUMMARY["assumptions"], 4).alias("assumptions"), F.struct(*(row(t, n) for t, n in CATEGORIES.items())).alias("categories"))


def summary_findings(summaries: DataFrame, found: DataFrame, entries: DataFrame, key: str, text: str, gate: str = "summary") -> DataFrame:
    """Claims of a summary (key, text) that differ from what the scenarios and the manifest's entries count to."""
    own = found.groupBy(key).agg(
        F.array(F.count("*"), F.count_if(F.array_contains("tags", "@smoke")), F.count_if(F.array_contains("tags", "@regression"))).cast("array<int>").alias("is_scenarios"),
        F.array(*(F.count_if(F.array_contains("tags", t)) for t in CATEGORIES)).cast("array<int>").alias("is_categories"),
    )
    held = entries.groupBy(key).agg(F.array(F.count("*"), *(F.count_if(F.col("confidence") == c) for c in CONFIDENCE)).cast("array<int>").alias("is_assumptions"))
    nothing = lambda n: F.array(*[F.lit(0)] * n)
    both = summaries.select(key, parsed_summary(F.col(text)).alias("s")).join(own, key, "left").join(held, key, "left")
    claimed = F.array(*(F.col(f"s.categories.`{t}`") for t in CATEGORIES))
    differs = lambda a, b, n: ~a.eqNullSafe(F.coalesce(b, nothing(n)))
    return check(
        both,
        key,
        gate,
        [
            Rule("scenarios", differs(F.col("s.scenarios"), F.col("is_scenarios"), 3), F.array_join("s.scenarios", "/")),
            Rule("assumptions", differs(F.col("s.assumptions"), F.col("is_assumptions"), 4), F.array_join("s.assumptions", "/")),
            Rule("categories", differs(claimed, F.col("is_categories"), len(CATEGORIES)), F.array_join(claimed, "/", "?")),
        ],
    )


def header_findings(headers: DataFrame, manifests: DataFrame, entries: DataFrame, key: str, gate: str = "header") -> DataFrame:
    """headers (key, feature, assumptions, generated) against the manifest's name, number of entries and timestamp."""
    n = entries.groupBy(key).agg(F.count("*").alias("n_entries"))
    theirs = manifests.select(key, F.col("feature").alias("m_feature"), F.col("generated").alias("m_generated"))
    both = headers.join(theirs, key, "left").join(n, key, "left")
    told = F.regexp_extract(F.coalesce("assumptions", F.lit("")), r"(\d+)", 1).try_cast("int")
    full = F.col("generated").rlike(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")
    return check(both, key, gate, [
        Rule("feature", ~F.col("feature").eqNullSafe(F.col("m_feature")), F.col("feature")),
        Rule("assumptions", ~told.eqNullSafe(F.coalesce("n_entries", F.lit(0)).cast("int")), told),
        Rule("generated", ~F.coalesce(full & (F.col("generated") == F.col("m_generated")), F.lit(False)), F.col("generated")),
    ])


def preserved(before: DataFrame, after: DataFrame, key: str, text: str, gate: str = "preserved") -> DataFrame:
    """Files that are not what they were once the lines with task tags are taken out."""
    from sievework.functions.exprs import lines_without

    both = before.select(key, F.col(text).alias("was")).join(after.select(key, F.col(text).alias("is")), key, "left")
    return check(both, key, gate, [Rule("missing", F.col("is").isNull()), Rule("changed", lines_without(F.col("is"), TASK_TAG.rstrip("$") + "$") != F.col("was"))])


# Layouts: tables of files (root, path).


def layout_findings(files: DataFrame, root: str, path: str, suffixes: Sequence[str], top: str = "features", gate: str = "layout") -> DataFrame:
    """One folder under ``top`` that holds a file ``<folder><suffix>`` for each suffix, and nothing else."""
    own = files.where(F.col(path).startswith(f"{top}/")).select(root, F.split(path, "/").alias("p"))
    folders = own.where(F.size("p") > 2).groupBy(root).agg(F.array_sort(F.collect_set(F.get("p", F.lit(1)))).alias("folders"))
    every = files.select(root).distinct().join(folders, root, "left")
    one = F.size("folders") == 1
    wrong = check(every, root, gate, [Rule("layout", ~F.coalesce(one, F.lit(False)), F.array_join("folders", ","))])
    single = every.where(one).select(root, F.get("folders", F.lit(0)).alias("folder"))
    expected = single.select(root, F.explode(F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat(F.lit(f"{top}/"), "folder", F.lit("/"), "folder", s))).alias("file"))
    there = own.join(single, root).select(root, F.array_join("p", "/").alias("file"))
    rows = lambda df, defect: check(df, root, gate, [Rule(defect, F.lit(True), F.col("file"))])
    return union(wrong, rows(expected.join(there, [root, "file"], "left_anti"), "missing_file"), rows(there.join(expected, [root, "file"], "left_anti"), "unexpected_file"))


# Plans: tasks (key, task, file_path, complexity, implementation_mode), waves (key, wave as a list of tasks, place from 1).


def wave_of(waves: DataFrame, key: str) -> DataFrame:
    """key, task and the first wave that holds it."""
    return waves.select(key, "place", F.explode("wave").alias("task")).groupBy(key, "task").agg(F.min("place").alias("wave"))


def frontmatter_findings(tasks: DataFrame, fronts: DataFrame, waves: DataFrame, plans: DataFrame, key: str, types: Sequence[str], aliases: dict[str, str] | None = None, gate: str = "frontmatter") -> DataFrame:
    """tasks against the frontmatter of their files (key, file_path, json), the wave they are in and the plan's id (key, plan_id).

    A file that is missing or has no frontmatter ends the check of its task.
    """
    field = lambda n: F.get_json_object("json", f"$.{n}")
    both = tasks.join(fronts.select(key, "file_path", "json", F.lit(True).alias("there")), [key, "file_path"], "left").join(wave_of(waves, key), [key, "task"], "left").join(plans.select(key, "plan_id"), key, "left")
    there, read = F.coalesce("there", F.lit(False)), F.col("json").isNotNull()
    kind = task_type(field("task_type"), aliases, "") if aliases else F.coalesce(field("task_type"), F.lit(""))
    rules = [
        Rule("frontmatter_id_mismatch", ~field("id").eqNullSafe(F.col("task")), field("id")),
        Rule("task_type_missing", field("task_type").isNull()),
        Rule("task_type_invalid", field("task_type").isNotNull() & ~kind.isin(*types), field("task_type")),
        Rule("feature_id_mismatch", ~field("feature_id").eqNullSafe(F.col("plan_id")), field("feature_id")),
        Rule("wave_mismatch", ~field("wave").eqNullSafe(F.col("wave").cast("string")), field("wave")),
    ]
    out = check(both, "task", gate, [Rule("task_file_missing", ~there, F.col("file_path")), Rule("frontmatter_unparseable", there & ~read), *(Rule(r.defect, there & read & r.failed, r.detail) for r in rules)])
    return out


def mode_findings(tasks: DataFrame, gate: str = "modes", from_complexity: int = 4) -> DataFrame:
    """Tasks of some complexity (5 if none is told) are task-work, simpler ones direct."""
    complexity, mode = F.coalesce("complexity", F.lit(5)), F.coalesce("implementation_mode", F.lit("task-work"))
    should = F.when(complexity >= from_complexity, "task-work").otherwise("direct")
    return check(tasks, "task", gate, [Rule("mode_assignment", mode != should, mode)])


def plan_facts(plans: DataFrame, files: DataFrame, key: str, folder: str = "tasks/backlog", needed: Sequence[str] = ("README.md", "IMPLEMENTATION-GUIDE.md"), guide: str = "IMPLEMENTATION-GUIDE.md", drawn_from: int = 3) -> DataFrame:
    """What ``plan_floors`` asks of plans (key, slug, json of the plan's YAML), from their files (key, path, text).

    n_tasks and n_waves come from the plan; has_diagram: the guide has a flow chart and, from ``drawn_from`` tasks on, a graph of the
    tasks; has_lint: each implementation task's file speaks of lint; files_missing are those that the folder of the slug lacks.
    Files may be many more than their table's size tells, so no side is broadcast unless its size has been measured.
    """
    plan = F.from_json("json", "struct<tasks: array<struct<id: string, file_path: string, task_type: string>>, orchestration: struct<parallel_groups: array<string>>>")
    none = F.array().cast("array<string>")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    own = staged(plans.select(key, "slug", plan.alias("p")).select(key, "slug", F.col("p.tasks").alias("tasks"), size("p.tasks").alias("n_tasks"), size("p.orchestration.parallel_groups").alias("n_waves")))  # read by all branches below, parsed once
    at = lambda name: F.concat(F.lit(folder + "/"), "slug", F.lit("/"), name)
    wanted = own.select(key, "slug", F.explode(F.array(*map(F.lit, needed))).alias("name")).select(key, "name", at(F.col("name")).alias("path"))
    lost = wanted.join(files.select(key, "path").hint("merge"), [key, "path"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("files_missing"))
    begins = lambda word: F.exists(blocks_of(F.col("text"), "mermaid"), lambda b: F.ltrim(b).startswith(word))
    drawn = own.select(key, "n_tasks", at(F.lit(guide)).alias("path")).join(files.hint("merge"), [key, "path"]).select(key, (begins("flowchart") & ((F.col("n_tasks") < drawn_from) | begins("graph TD"))).alias("has_diagram"))
    tasks = own.select(key, F.explode("tasks").alias("t")).select(key, F.col("t.file_path").alias("path"), "t.task_type").where(F.coalesce("task_type", F.lit("feature")).isin("feature", "refactor"))
    linted = tasks.join(files.hint("merge"), [key, "path"], "left").groupBy(key).agg(F.bool_and(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("lint"))).alias("has_lint"))
    out = own.select(key, "n_tasks", "n_waves").join(drawn.hint("merge"), key, "left").join(linted.hint("merge"), key, "left").join(lost.hint("merge"), key, "left")
    return out.select(key, "n_tasks", "n_waves", F.coalesce("has_diagram", F.lit(False)).alias("has_diagram"), F.coalesce("has_lint", F.lit(True)).alias("has_lint"), F.coalesce("files_missing", none).alias("files_missing"))


def plan_floors(plans: DataFrame, key: str, gate: str = "floors", tasks: int = 3, waves: int = 2) -> DataFrame:
    """plans (key, n_tasks, n_waves, has_diagram, has_lint, files_missing), as ``plan_facts`` makes them."""
    return check(plans, key, gate, [
        Rule("too_few_tasks", F.col("n_tasks") < tasks, F.col("n_tasks")),
        Rule("too_few_waves", F.col("n_waves") < waves, F.col("n_waves")),
        Rule("no_diagram", ~F.coalesce("has_diagram", F.lit(False))),
        Rule("no_lint_criterion", ~F.coalesce("has_lint", F.lit(False))),
        Rule("file_missing", F.size("files_missing") > 0, F.array_join("files_missing", ",")),
    ])


def linkage_findings(tags: DataFrame, tasks: DataFrame, key: str, gate: str = "linkage") -> DataFrame:
    """tags: key, scenario, tags, tasks (of ``task_tags``); tasks: key, task, task_type. Tags without a task, files without any tag, smoke scenarios without one, and feature tasks that no scenario has."""
    links = tags.select(key, "scenario", F.explode("tasks").alias("task"))
    dangling = links.join(tasks.select(key, "task"), [key, "task"], "left_anti")
    none = tags.groupBy(key).agg(F.sum(F.size("tasks")).alias("n")).where("n = 0")
    idle = tasks.where(F.coalesce("task_type", F.lit("feature")) == "feature").join(links.select(key, "task").distinct(), [key, "task"], "left_anti")
    one = lambda df, defect, detail: check(df, key, gate, [Rule(defect, F.lit(True), detail)])
    return union(
        one(dangling, "dangling_task_tag", F.concat_ws(":", "scenario", "task")),
        one(none, "no_scenarios_linked", None),
        one(tags.where(F.array_contains("tags", "@smoke") & (F.size("tasks") == 0)), "smoke_scenario_unlinked", F.col("scenario")),
        one(idle, "feature_task_owns_no_scenario", F.col("task").cast("string")),
    )
