"""Chat formatting of tool traffic: link, order, validate and serialise calls.

Calls and results meet in a hash join on (conversation, identifier). Each call names the
calls it depends on; the order within a conversation is the log's order, except that a
call stands after all it depends on. Order keys: a call's key is its own place in the log
or, if later, that of its latest dependency, with one step added per such move. A log that
is in order already needs no further pass; otherwise keys are pushed along the offending
edges until none is left, each pass a join of narrow rows written to the shared folder.
Where one pass is not enough, cycles are found first and keys then move along whole paths of
late calls by doubling: a reversed chain or a cycle of n calls takes about log2(n) passes.
Only DataFrame functions run. Arguments are read as variants: their types are checked
against the tools' schemas, and they are written with sorted keys and no blanks.

A conversation may hold a third of all calls: calls are numbered within ranges of the order
and the ranges' counts are added up, so no task gets a whole conversation.

Defined cases. Repeated (conversation, identifier): the first in the log counts, `n_calls`
and `n_results` tell how many there were. Null conversation or identifier: status `no_id`,
no position. Results without a call: status `orphan`. Dependencies that are not in the
conversation count in `missing` and do not delay. Calls on or behind a cycle: status
`cycle`, placed by the log. Arguments that are no JSON object: `malformed`. Empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from broadsheet.llm.common import stored

#: JSON types as the variant functions name them.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"],
         "number": ["BIGINT", "DOUBLE", "DECIMAL"], "object": ["OBJECT"], "array": ["ARRAY"]}


def argument_errors(arguments: Column, name: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted faults of a call's arguments, joined by commas; empty if it is valid.

    `tools` maps a tool to its arguments: (type, whether required).
    """
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(F.when(is_object, arguments)), F.array().cast("array<string>"))
    per_tool = F.lit("unknown_tool")
    for tool, schema in tools.items():
        faults = []
        for key, (kind, required) in schema.items():
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            found = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
            wrong = F.array_contains(keys, key) & ~F.coalesce(found.isin(KINDS[kind]), F.lit(False))
            faults.append(F.when(wrong, f"type:{key}"))
            if required:
                faults.append(F.when(~F.array_contains(keys, key), f"missing:{key}"))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, schema))), lambda k: F.concat(F.lit("unknown:"), k))
        listed = F.concat(F.filter(F.array(*faults), lambda x: x.isNotNull()), extra)
        per_tool = F.when(name == tool, F.array_join(F.array_sort(listed), ",")).otherwise(per_tool)
    return F.when(is_object, per_tool).otherwise("malformed")


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def on_or_behind_cycles(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id) of calls on a cycle of edges (conv_id, call_id, needs) or behind one.

    Edges to calls without open needs fall away, round by round. Each call left follows one
    of its edges, and these paths are doubled: a path that never ends runs into a cycle, and
    a path of calls with one edge each that ends settles all of them at once. So a cycle or a
    chain of n calls takes about log2(n) passes.
    """
    ids = ["conv_id", "call_id"]
    target = lambda df, *more: df.select("conv_id", F.col("call_id").alias("needs"), *more)
    cyclic = edges.select(*ids).where("false")
    while not edges.isEmpty():
        leads_on = target(edges.select(*ids)).unionByName(target(cyclic)).distinct()
        edges = stored(edges.join(leads_on, ["conv_id", "needs"], "left_semi"), "open-edges")
        looped = target(cyclic, F.lit(True).alias("known"))
        paths = stored(edges.join(looped, ["conv_id", "needs"], "left").groupBy(*ids).agg(
            F.max(F.struct(F.coalesce("known", F.lit(False)).alias("known"), "needs")).alias("to"),
            (F.count("*") == 1).alias("single")).select(*ids, F.col("to.needs").alias("needs"), "single",
                                                        F.col("to.known").alias("cycle")), "call-paths")
        running = None
        while True:  # a path goes on while it has needs that are themselves open
            ahead = paths.select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("then"),
                                 F.col("single").alias("all_single"), F.col("cycle").alias("to_cycle"))
            paths = stored(paths.join(ahead, ["conv_id", "needs"], "left").select(
                *ids, "then", F.col("single") & F.coalesce("all_single", F.lit(True)),
                F.col("cycle") | F.coalesce("to_cycle", F.lit(False))).toDF(*ids, "needs", "single", "cycle"), "call-paths")
            now = paths.where("needs IS NOT NULL AND NOT cycle").count()
            if now == 0 or now == running:
                break
            running = now
        endless = F.col("cycle") | F.col("needs").isNotNull()
        cyclic = stored(cyclic.unionByName(paths.where(endless).select(*ids)), "cyclic-calls")
        settled = paths.where(endless | F.col("single")).select(*ids)
        edges = stored(edges.join(settled, ids, "left_anti"), "open-edges")
    return cyclic


def order_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id) -> place, step: the order in which no call precedes its dependencies."""
    ids = ["conv_id", "call_id"]
    labels = calls.select(*ids, F.col("seq").alias("place"), F.lit(0).alias("step"), F.lit(False).alias("cycle"))
    edges = (calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
             .join(calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi"))

    def late(labels: DataFrame) -> DataFrame:
        """Calls that stand no later than something they need: what and the key they must have."""
        below = labels.select("conv_id", F.col("call_id").alias("needs"), F.col("place").alias("p"), F.col("step").alias("s"))
        return (edges.join(below, ["conv_id", "needs"]).join(labels.where(~F.col("cycle")), ids)
                .where(F.struct("place", "step") <= F.struct("p", "s"))
                .groupBy(*ids).agg(F.max(F.struct("p", "s", "needs")).alias("most"))
                .select(*ids, F.struct(F.col("most.p"), (F.col("most.s") + 1).alias("s")).alias("key"), F.col("most.needs").alias("needs")))

    def along_paths(moves: DataFrame) -> DataFrame:
        """Moves that count the late calls behind the one waited for too, by doubled paths."""
        paths = moves.withColumn("far", F.lit(1))
        while True:
            ahead = paths.select("conv_id", F.col("call_id").alias("needs"), F.col("key").alias("k"),
                                 F.col("needs").alias("then"), F.col("far").alias("more"))
            further = F.struct(F.col("k.p").alias("p"), (F.col("k.s") + F.col("far")).alias("s"))
            paths = stored(paths.join(ahead, ["conv_id", "needs"], "left").select(
                *ids, F.greatest("key", further).alias("key"), F.col("then").alias("needs"),
                (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "late-paths")
            if paths.where("needs IS NOT NULL").isEmpty():
                return paths

    def moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
        return stored(labels.join(moves.select(*ids, "key"), ids, "left").select(
            *ids, F.coalesce("key.p", "place").alias("place"), F.coalesce("key.s", "step").alias("step"), "cycle"), "call-order")

    moves = stored(late(labels), "late-calls")
    if moves.isEmpty():
        return labels
    edges = stored(edges, "call-edges")
    log, labels = labels, moved(labels, moves)
    moves = stored(late(labels), "late-calls")
    if moves.isEmpty():
        return labels
    # More than one step behind: take out cycles, then move whole paths at a time.
    cyclic = on_or_behind_cycles(edges.join(moves.select("conv_id").distinct(), "conv_id", "left_semi"))
    known = cyclic.withColumn("known", F.lit(True))
    labels = stored(log.drop("cycle").join(known, ids, "left").select(
        *ids, "place", "step", F.coalesce("known", F.lit(False)).alias("cycle")), "call-order")
    moves = stored(late(labels), "late-calls")
    while not moves.isEmpty():
        labels = moved(labels, along_paths(moves))
        moves = stored(late(labels), "late-calls")
    return labels


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds position, gapless from 0 within conv_id: ranges of the order are numbered, then their counts added up.

    Ranges are cut anywhere in the order, also among calls of one place, so none is larger for a
    large conversation or for many calls that wait for the same one.
    """
    keys = ["conv_id", *order]
    at = F.monotonically_increasing_id()
    rows = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at), "ordered-calls")
    rows = rows.withColumn("range", F.shiftrightunsigned("at", 33))
    counts = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = W.Window.partitionBy("conv_id").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return (rows.join(starts, ["conv_id", "range"])
            .withColumn("position", F.col("at") + F.col("shift")).drop("range", "shift", "at"))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call and per orphan result: position, status, errors, canonical record.

    `calls`: conv_id, call_id, seq, name, arguments, depends_on (array). `results`:
    conv_id, call_id, seq, content.
    """
    ids = ["conv_id", "call_id"]
    has_ids = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    fields = ["seq", "name", "arguments", "depends_on"]
    first = F.min(F.struct(*fields))
    one = (calls.where(has_ids).groupBy(*ids).agg(first.alias("c"), F.count("*").alias("n_calls"))
           .select(*ids, *[F.col(f"c.{f}").alias(f) for f in fields], "n_calls"))
    answers = (results.where(has_ids).groupBy(*ids)
               .agg(F.min(F.struct("seq", "content")).alias("r"), F.count("*").alias("n_results"))
               .select(*ids, F.col("r.content").alias("content"), "n_results"))
    linked = one.join(answers, ids, "full_outer")
    keys = order_keys(one.select(*ids, "seq", "depends_on"))
    known = (one.select(*ids, F.explode(F.array_distinct("depends_on")).alias("needs"))
             .join(one.select("conv_id", F.col("call_id").alias("needs"), F.lit(1).alias("known")), ["conv_id", "needs"], "left")
             .groupBy(*ids).agg(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("missing")))
    placed = numbered(keys, ["place", "step", "call_id"])
    errors = argument_errors(F.col("arguments"), F.col("name"), tools)
    rows = (linked.join(placed.select(*ids, "position", "cycle"), ids, "left").join(known, ids, "left")
            .withColumn("errors", F.when(F.col("n_calls").isNotNull(), errors)))
    status = (F.when(F.col("n_calls").isNull(), "orphan").when(F.col("cycle"), "cycle")
              .when(F.col("errors") == "malformed", "malformed").when(F.col("errors") != "", "invalid")
              .when(F.col("n_results").isNull(), "unanswered").otherwise("ok"))
    arguments = F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("raw"))))
    record = F.to_json(F.struct(
        F.when(F.col("n_calls").isNotNull(), arguments).alias("arguments"), F.col("call_id").alias("id"),
        F.col("name"), F.col("content").alias("result")))
    kept = [*ids, "position", "status", "errors", "missing", "n_calls", "n_results", "record"]
    counted = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    linked = rows.withColumns({"status": status, "record": record}).select(
        *ids, F.col("position").cast("long").alias("position"), "status", "errors",
        counted("missing"), counted("n_calls"), counted("n_results"), "record")
    blank = lambda df, n: df.where(~has_ids).select(
        *ids, F.lit(None).cast("long").alias("position"), F.lit("no_id").alias("status"), F.lit(None).cast("string").alias("errors"),
        F.lit(0).cast("long").alias("missing"), F.lit(n).cast("long").alias("n_calls"),
        F.lit(1 - n).cast("long").alias("n_results"), F.lit(None).cast("string").alias("record"))
    return linked.select(*kept).unionByName(blank(calls, 1)).unionByName(blank(results, 0))
