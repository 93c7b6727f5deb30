"""Tool-call linking: calls meet their results by identifier, in dependency order, with checked arguments.

A call names the calls whose results it needs. Levels follow from the names: a call without needs has
level 0, every other one more than the highest level it needs; calls of one need find
their level by pointer doubling, in rounds that grow with the logarithm of the longest chain; calls of several needs are settled in rounds. Calls on a cycle, or above one, never settle and are
marked. Arguments are parsed to a map of raw values, checked against a table of required and typed fields, and
written as canonical JSON: keys sorted by code point, no white space, values as canonical texts.

Defined cases: a null identifier links with nothing; of several results of a call the first by place counts and
their number is told; results without a call are kept as orphans; arguments that are null or no JSON object are
invalid and written as {}; needs that no call answers are missing and do not hold a call back. Calls that repeat
an identifier within a conversation are one call, the first by place. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import stored

#: Patterns of raw JSON values by type.
TYPES = {"string": r'^".*"$', "integer": r"^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$",
         "object": r"^\{.*\}$", "array": r"^\[.*\]$"}


def violations(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Fields that break their tool's schema: conv_id, call_id, problem. schemas: tool, field, type, required."""
    fields = calls.select("conv_id", "call_id", "tool", F.explode_outer("fields").alias("field", "value")).where("field IS NOT NULL")
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    # The table of schemas is the tools that the model may call; Spark chooses the join by its size.
    rules = schemas.select("tool", "field", "type", "required").distinct()
    given = fields.join(rules, ["tool", "field"], "left")
    wrong = given.where(F.col("type").isNull() | ~F.rlike("value", F.coalesce(kinds[F.col("type")], F.lit(".*")))).select(
        "conv_id", "call_id", F.concat(F.when(F.col("type").isNull(), F.lit("unknown ")).otherwise(F.lit("type of ")), "field").alias("problem"))
    need = calls.select("conv_id", "call_id", "tool", "fields").join(rules.where("required"), "tool")
    lacking = need.where(~F.coalesce(F.expr("map_contains_key(fields, field)"), F.lit(False))).select(
        "conv_id", "call_id", F.concat(F.lit("missing "), "field").alias("problem"))
    return wrong.unionByName(lacking)


def levels(calls: DataFrame) -> DataFrame:
    """Level of every call: conv_id, call_id, level; null on or above a cycle. calls: conv_id, call_id, needs."""
    nodes = calls.select("conv_id", "call_id").distinct()
    known = nodes.withColumnRenamed("call_id", "need")
    edges = stored(calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct().join(known, ["conv_id", "need"], "left_semi"))
    key, at = ["conv_id", "call_id"], ["conv_id", "need"]
    waiting = stored(edges.groupBy(*key).agg(F.count("*").alias("open"), F.min("need").alias("need")))
    # Calls of one need point to it; each round doubles how far they point, up to a call of none or several needs.
    up = stored(waiting.where("open = 1").select(*key, "need", F.lit(1).cast("long").alias("far")))
    total, span, moving = up.count(), 1, True
    while moving and span <= total:
        over = up.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("_need"), F.col("far").alias("_far"))
        moved = stored(up.join(over, at, "left").select(
            *key, F.coalesce("_need", "need").alias("need"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_need").isNotNull().alias("moved")))
        up, span, moving = moved.drop("moved"), span * 2, not moved.where("moved").isEmpty()
    # Calls of several needs go in rounds, over the ends of those pointers.
    rest = stored(waiting.where("open > 1").select(*key, "open", F.lit(0).cast("long").alias("top")))
    ends = up.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("_end"), "far")
    links = stored(edges.join(rest.select(*key), key, "left_semi").join(ends, at, "left").select(
        *key, F.coalesce("_end", "need").alias("need"), F.coalesce("far", F.lit(0)).alias("far")))
    settled = stored(nodes.join(waiting, key, "left_anti").withColumn("level", F.lit(0).cast("long")))
    done = settled
    while not rest.isEmpty() and not settled.isEmpty():
        freed = links.join(settled.withColumnRenamed("call_id", "need"), at).groupBy(*key).agg(
            F.count("*").alias("got"), F.max(F.col("level") + F.col("far")).alias("high"))
        left = stored(rest.join(freed, key, "left").select(
            *key, (F.col("open") - F.coalesce("got", F.lit(0))).alias("open"), F.greatest("top", "high").alias("top")))
        settled = stored(left.where("open = 0").select(*key, (F.col("top") + 1).alias("level")))
        done, rest = done.unionByName(settled), stored(left.where("open > 0"))
    single = up.join(done.withColumnRenamed("call_id", "need"), at, "left").select(*key, (F.col("level") + F.col("far")).alias("level"))
    never = rest.select(*key, F.lit(None).cast("long").alias("level"))
    return done.unionByName(single).unionByName(never).withColumn("level", F.col("level").cast("int"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without one.

    calls: conv_id, call_id, tool, arguments (JSON text), needs (array of call ids), place.
    results: conv_id, call_id, content, place. Returns conv_id, call_id, tool, level, place, arguments (canonical), valid,
    problems, n_missing, n_results, content, message (canonical JSON of the linked call).
    """
    key = ["conv_id", "call_id"]
    first = (
        calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key)
        .agg(F.min(F.struct("place", "tool", "arguments", "needs")).alias("c")).select(*key, "c.*")
        .withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    )
    variant = "try_parse_json(arguments)"
    parsed = stored(
        first.withColumn("is_object", F.coalesce(F.expr(f"schema_of_variant({variant}) LIKE 'OBJECT%'"), F.lit(False)))
        .withColumn("fields", F.expr(f"CASE WHEN is_object THEN transform_values(cast({variant} as map<string, variant>), (k, v) -> coalesce(to_json(v), 'null')) END"))
        .withColumn("arguments", F.expr(
            "CASE WHEN is_object THEN concat('{', array_join(transform(array_sort(map_keys(fields)), "
            "k -> concat('\"', replace(replace(k, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\":', fields[k])), ','), '}') ELSE '{}' END"))
    )
    answers = (
        results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key)
        .agg(F.min(F.struct("place", "content")).alias("r"), F.count("*").alias("n_results")).select(*key, "r.content", "n_results", F.col("r.place").alias("result_place"))
    )
    problems = violations(parsed, schemas).groupBy(*key).agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    missing = (
        parsed.select("conv_id", "call_id", F.explode("needs").alias("need"))
        .join(parsed.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti")
        .groupBy(*key).agg(F.countDistinct("need").alias("n_missing"))
    )
    linked = (
        parsed.join(answers, key, "full").join(levels(parsed), key, "left").join(problems, key, "left").join(missing, key, "left")
        .withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    )
    out = linked.select(
        *key, "tool", "level", F.coalesce("place", "result_place").alias("place"), F.coalesce("arguments", F.lit("{}")).alias("arguments"),
        (F.coalesce("is_object", F.lit(False)) & (F.size("problems") == 0)).alias("valid"), "problems",
        F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "content",
    )
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit(""))
    text = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    return out.withColumn("message", F.concat(
        F.lit('{"arguments":'), "arguments", F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("tool"), F.lit(',"result":'), text("content"), F.lit("}")))
