"""What is said about an impact: the composed response, numbered evidence, checks of explanations, gate and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import IMPACT_PATHS, MAX_DEPTH, human_label
from .deps import resolve_changed
from .history import bundle
from .impact import change_score, impact, score, tests_for_change, tests_near

#: Pieces of evidence by kind, and the length of their texts.
PIECES = {"path": 10, "test": 8, "commit": 5, "pull": 5, "issue": 5}
TEXT = 120
#: Bounds of an explanation, and its confidences.
SUMMARY, FINDING, FINDINGS, NAME, NAMES, REFERENCES, REFERENCE = 800, 300, 6, 200, 40, 20, 16
CONFIDENCES = ("high", "medium", "insufficient")
LEVELS = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


def shortened(text: Column, most: int = TEXT) -> Column:
    """White space runs as one space, trimmed, and what is too long cut off with an ellipsis."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…")))


def response(g: Graph, roots: DataFrame, depth: int = MAX_DEPTH, limit: int = 100) -> dict[str, DataFrame]:
    """All about the impact of roots (column id): their nodes, scores, affected entities, tests and history. limit: of the
    entities asked for; four times as many paths are looked at, within the bound."""
    rows = impact(g, roots, depth, min(IMPACT_PATHS, 4 * limit))
    ids = roots.select("id")
    return {
        "roots": g.nodes.join(ids, "id", "left_semi").select("id", "label", human_label().alias("title")),
        "scores": score(g, ids, depth, min(IMPACT_PATHS, 4 * limit)),
        "entities": rows,
        "tests": tests_near(g, ids, rows),
        "history": bundle(g, ids),
    }


def evidence(g: Graph, roots: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, id, kind, ref, text) of each root (column id): paths (direct ones first, then by hops and target), tests, commits,
    pull requests and issues, numbered E1, E2, .. in this order."""
    ids = roots.select("id")
    rows = impact(g, ids, depth)
    near = Window.partitionBy("root").orderBy("impact", "hops", "target")
    ways = F.replace(F.col("path"), F.lit(">"), F.concat(F.lit(" → "), F.col("relationship"), F.lit(" → ")))
    paths = rows.select("root", F.lit("path").alias("kind"), F.row_number().over(near).cast("long").alias("rank"), F.col("target").alias("ref"), ways.alias("text"))
    found = tests_near(g, ids, rows).join(g.n("Test").select(F.col("id").alias("test"), "name"), "test")
    order = Window.partitionBy("root").orderBy("rank", "test")
    tests = found.select("root", F.lit("test").alias("kind"), F.row_number().over(order).cast("long").alias("rank"), F.col("test").alias("ref"), shortened(F.col("name")).alias("text"))
    past = bundle(g, ids).select("root", "kind", "rank", F.col("id").alias("ref"), shortened(F.col("title")).alias("text"))
    place = F.create_map(*(F.lit(x) for k, kind in enumerate(PIECES) for x in (kind, k)))
    most = F.create_map(*(F.lit(x) for kv in PIECES.items() for x in kv))
    every = paths.unionAll(tests).unionAll(past).where(F.col("rank") <= F.element_at(most, F.col("kind"))).withColumn("place", F.element_at(place, F.col("kind")))
    number = F.row_number().over(Window.partitionBy("root").orderBy("place", "rank"))
    return every.withColumn("id", F.concat(F.lit("E"), number.cast("string"))).select("root", "id", "kind", "ref", "text")


def checked(explanations: DataFrame, known: DataFrame, text: str = "text", key: str = "root") -> DataFrame:
    """explanations with error (null if valid) and the parsed struct: JSON, in a code fence or not, of a summary, lists of
    bounded numbers of bounded texts, references to evidence (key, id) that exists, and a confidence of the closed set. A
    null or malformed text is an error; a missing list is empty, and an entry that is no text is an error."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```\w*\s*", ""), r"\s*```$", ""))
    lists = {"keyFindings": (FINDINGS, FINDING), "directImpact": (NAMES, NAME), "indirectImpact": (NAMES, NAME), "evidenceReferences": (REFERENCES, REFERENCE)}
    raw = F.try_parse_json(body)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(raw, path, "variant"))
    array = lambda name: F.coalesce(F.try_variant_get(raw, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    plain = lambda name: F.coalesce(kind(f"$.{name}").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(raw, f"$.{name}", "variant").isNull())
    said = F.trim(F.try_variant_get(raw, "$.summary", "string"))
    ids = known.groupBy(F.col(key).alias("__key")).agg(F.collect_set("id").alias("__ids"))  # at most the pieces of a root
    step = explanations.join(ids, F.col(key) == F.col("__key"), "left")
    error = F.when(raw.isNull() | ~kind("$").startswith("OBJECT"), F.lit("not a JSON object"))
    error = error.when(~F.coalesce(kind("$.summary") == "STRING", F.lit(False)), F.lit("summary must be a text")).when(said == "", F.lit("summary is empty")).when(F.length(said) > SUMMARY, F.lit("summary is too long"))
    for name, (count, size) in lists.items():
        error = error.when(~plain(name) | (F.size(array(name)) > count), F.lit(f"{name} must be a list of at most {count} texts"))
        error = error.when(F.coalesce(F.array_max(F.transform(array(name), lambda x: F.length(F.trim(x)))) > size, F.lit(False)), F.lit(f"{name} holds a text that is too long"))
    refs = F.transform(array("evidenceReferences"), lambda x: F.trim(x))
    error = error.when(~F.forall(refs, lambda x: x.rlike(r"^E\d+$")), F.lit("a reference is no evidence id"))
    error = error.when(F.size(F.array_except(refs, F.coalesce("__ids", F.array().cast("array<string>")))) > 0, F.lit("a reference is unknown"))
    trust = F.try_variant_get(raw, "$.confidence", "string")
    error = error.when(~F.coalesce(trust.isin(*CONFIDENCES) & (kind("$.confidence") == "STRING"), F.lit(False)), F.lit("confidence must be high, medium or insufficient"))
    parsed = F.struct(said.alias("summary"), *(F.transform(array(n), lambda x: F.trim(x)).alias(n) for n in lists), trust.alias("confidence"))
    return step.withColumn("error", error).withColumn("explanation", F.when(F.col("error").isNull(), parsed)).drop("__key", "__ids")


def gate(g: Graph, paths: list[str], depth: int = MAX_DEPTH, fail_on: str | None = None) -> tuple[int, str]:
    """The exit code and text of a check of changed paths: 2 without paths, 1 if the risk is at or above fail_on (MEDIUM or
    HIGH), else 0. The text names dependents, tests, unresolved paths and the five riskiest tests."""
    if not paths:
        return 2, "no changed files"
    changed = resolve_changed(g, g.nodes.sparkSession.createDataFrame([(p,) for p in paths], "path string")).collect()
    files = g.nodes.sparkSession.createDataFrame([(r["id"],) for r in changed if r["resolved"]], "id string")
    row = change_score(g, files, depth).first()
    lines = [f"changed: {row['changed']}", f"dependents: {row['direct']} direct, {row['indirect']} indirect", f"tests: {row['tests']}", f"risk: {row['level']}", *(f"  {x}" for x in row["reasons"].split("; "))]
    lost = [r["raw"] for r in changed if not r["resolved"]]
    lines += [f"not in the graph: {', '.join(sorted(lost))}"] if lost else []
    lines += [f"test {t['test']}: covers {t['covers']}, risk {t['risk']}" for t in tests_for_change(g, files, depth).orderBy(F.desc("risk"), F.desc("covers"), "test").limit(5).collect()]
    failed = fail_on is not None and LEVELS[row["level"]] >= LEVELS[fail_on]
    return int(failed), "\n".join([*lines, *([f"FAILED: risk {row['level']} meets {fail_on}"] if failed else [])])


def report(g: Graph, root: str, depth: int = MAX_DEPTH) -> str:
    """A root's impact as Markdown: score, affected entities, tests by framework, and the newest history (5, 4 and 4)."""
    roots = g.nodes.sparkSession.createDataFrame([(root,)], "id string")
    parts = response(g, roots, depth)
    node, points = parts["roots"].first(), parts["scores"].first()
    out = [f"# Impact of {node['title'] if node else root}", "", f"Risk: **{points['level']}** ({points['points']} of 6): {points['reasons']}", ""]
    for kind in ("DIRECT", "INDIRECT"):
        rows = parts["entities"].where(F.col("impact") == kind).orderBy("hops", "target").collect()
        out += [f"## {kind.capitalize()} ({len(rows)})", "", *(f"- `{r['target']}`, {r['hops']} hops by {r['relationship']}: {r['path'].replace('>', ' → ')}" for r in rows), ""]
    tests = parts["tests"].join(g.n("Test").select(F.col("id").alias("test"), "name", "framework"), "test").groupBy("framework").agg(F.sort_array(F.collect_list("name")).alias("names")).orderBy("framework").collect()
    out += ["## Tests", "", *(f"- {r['framework']}: {', '.join(r['names'])}" for r in tests), ""]
    most = {"commit": 5, "pull": 4, "issue": 4}
    past = parts["history"].orderBy("kind", "rank").collect()
    out += ["## History", "", *(f"- {r['kind']} {r['id']}: {' '.join((r['title'] or '').split())}" for r in past if r["rank"] <= most[r["kind"]])]
    return "\n".join(out) + "\n"
