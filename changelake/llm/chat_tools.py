"""Tool-call linking for chat transcripts, from DataFrame functions only.

Calls and results are hash-joined by conversation and identifier.  A call may
wait for results of other calls, and calls are ordered topologically.  Arguments are validated
against schemas, and each linked pair is serialised as canonical JSON: keys in
code point order, no white space, numbers in their shortest form.

Every join is on conversation *and* call, so a conversation with a third of all
rows is spread like any other; nothing gathers a conversation in one task.  The
place of a call is (level, seq), which needs no ranking.  Calls that wait for one
other at most find the nearest call before them that waits for several, or for
none, by pointer doubling, in as many rounds as the logarithm of the longest chain;
among calls that wait for several, levels are then settled a round for each such
call on a path.  So a fork costs rounds for its own paths only, and not for every
chain of the table.  Joins of calls with results, levels and pointers are shuffled
hash joins on unique keys.

Edge cases: a call without a result has status ``open``; a result without a call
``orphan``; of several calls, or several results, with one identifier the one of
lowest seq (then smallest content) counts and the others are dropped as repeats;
a call that waits for an unknown identifier doesn't wait; calls in a cycle, and
those behind it, have a null level; a null identifier or conversation never
links and such rows go; null or malformed arguments are invalid and serialised as null; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Name of a JSON schema type to a pattern of the variant types that it takes.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
#: Parameter: its type, or the schema of an object; and whether it is required.
Schema = dict[str, tuple]


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _problems(json: Column, parsed: Column, schema: Schema, prefix: str = "") -> Column:
    """What is wrong with an object, as an array of texts: parameters in order, then unknown ones."""
    keys = F.json_object_keys(json)
    known = F.array(*[F.lit(p) for p in sorted(schema)]) if schema else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    out = []
    for parameter, (kind, required) in sorted(schema.items()):
        has, quote = F.array_contains(keys, parameter), '"' if "'" in parameter else "'"
        value = F.try_variant_get(parsed, f"$[{quote}{parameter}{quote}]", "variant")
        nested = isinstance(kind, dict)
        name = "object" if nested else kind
        right = F.coalesce(F.schema_of_variant(value), F.lit("VOID")).rlike(f"^({TYPES[name]})$")
        missing = F.array(F.lit(f"missing {prefix}{parameter}")) if required else none
        inside = _problems(F.to_json(value), value, kind, f"{prefix}{parameter}.") if nested else none
        out.append(F.when(~has, missing).when(~right, F.array(F.lit(f"{prefix}{parameter} is not {name}"))).otherwise(inside))
    extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit(f"unknown {prefix}"), k))
    return F.concat(*out, extra)


def errors(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """What is wrong with a call's arguments, as text; empty if they are valid."""
    parsed = F.try_parse_json(arguments)
    out = F.lit("unknown tool")
    for tool, schema in schemas.items():
        no_object = arguments.isNull() | parsed.isNull() | F.json_object_keys(arguments).isNull()
        bad = F.when(no_object, F.lit("arguments are not an object")).otherwise(F.array_join(_problems(arguments, parsed, schema), "; "))
        out = F.when(name == tool, bad).otherwise(out)
    return out


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the lowest in the order of its other columns; combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first")).select(*keys, "first.*")


def levels(calls: DataFrame, waits: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for nothing, else one more than the last call waited for.

    waits: rows (conv_id, call_id, on): call_id needs the result of ``on``.
    """
    keys = ["conv_id", "call_id"]
    known = calls.select(*keys)
    edges = scratch.save(waits.join(known, keys).join(known.withColumnRenamed("call_id", "on"), ["conv_id", "on"]).select(*keys, "on").distinct())
    counted = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("on"))
    state = scratch.save(known.join(counted.hint("shuffle_hash"), keys, "left").withColumn("fork", F.coalesce(F.col("n") > 1, F.lit(False))).select(*keys, "fork", F.when(F.col("n") == 1, F.col("on")).alias("on")))
    forks = scratch.save(state.where("fork").select(*keys))
    anchored = _anchored(state.select(*keys, "on"), scratch)
    scratch.drop(state)
    if forks.isEmpty():
        settled = None
    else:
        # Edges of forks, each to the anchor of the call waited for; one in or behind a cycle has none, and never gets met.
        ahead = anchored.select("conv_id", F.col("call_id").alias("on"), "anchor", (F.col("far") + 1).alias("far"))
        condensed = edges.join(forks, keys, "left_semi").join(ahead, ["conv_id", "on"]).groupBy(*keys, F.coalesce("anchor", F.concat(F.lit("no anchor "), "call_id")).alias("anchor")).agg(F.max("far").alias("far"))
        settled = _settled(forks, scratch.save(condensed), anchored, scratch)
    scratch.drop(edges)
    if settled is None:
        return anchored.select(*keys, F.when(F.col("anchor").isNotNull(), F.col("far")).alias("level"))
    of = settled.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("start"))
    return anchored.join(of.hint("shuffle_hash"), ["conv_id", "anchor"], "left").select(*keys, (F.col("start") + F.col("far")).alias("level"))


def _anchored(state: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, anchor, far): the nearest call that ``on`` leads to and that has none itself, and how far it is.

    Each round looks twice as far; calls in a cycle, and those that wait for them, have no anchor.
    """
    keys = ["conv_id", "call_id"]
    state = scratch.save(state.select(*keys, F.coalesce("on", "call_id").alias("anchor"), F.when(F.col("on").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("on").isNotNull().alias("open")))
    waiting = state.where("open").count()
    reach, longest = 1, waiting
    while waiting and reach <= longest:  # no chain is longer than there are waiting calls; what waits then is in or behind a cycle
        ahead = state.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("far").alias("more"), F.col("open").alias("on"))
        jumped = state.where("open").join(ahead.hint("shuffle_hash"), ["conv_id", "anchor"]).select(*keys, F.col("next").alias("anchor"), (F.col("far") + F.col("more")).alias("far"), F.col("on").alias("open"))
        new = scratch.save(state.where("NOT open").unionByName(jumped))
        scratch.drop(state)
        state, reach = new, reach * 2
        waiting = state.where("open").count()
    return state.select(*keys, F.when(~F.col("open"), F.col("anchor")).alias("anchor"), "far")


def _settled(forks: DataFrame, live: DataFrame, anchored: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) of forks and of calls that wait for nothing; forks in or behind a cycle are left out.

    live: (conv_id, call_id, anchor, far), what each fork waits for.  A fork is settled in the round after the last of these.
    """
    keys = ["conv_id", "call_id"]
    roots = anchored.where("far = 0 AND anchor = call_id").select(*keys).join(forks, keys, "left_anti")
    parts = [scratch.save(roots.withColumn("level", F.lit(0).cast("long")))]
    best = None  # the furthest that forks with live edges are known to be
    while True:
        on = ["conv_id", "anchor"]
        last = parts[-1].select("conv_id", F.col("call_id").alias("anchor"), "level")
        met = live.join(last.hint("shuffle_hash"), on).select(*keys, (F.col("far") + F.col("level")).alias("level"))
        met = scratch.save((met if best is None else met.unionByName(best)).groupBy(*keys).agg(F.max("level").alias("level")))
        left = scratch.save(live.join(last.hint("shuffle_hash"), on, "left_anti").select(live.columns))
        blocked = left.select(*keys).distinct()
        ready = scratch.save(met.join(blocked.hint("shuffle_hash"), keys, "left_anti"))
        held = scratch.save(met.join(blocked.hint("shuffle_hash"), keys, "left_semi"))
        scratch.drop(live, met, *([best] if best is not None else []))
        live, best = left, held
        if ready.isEmpty():
            break
        parts.append(ready)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def link(calls: DataFrame, results: DataFrame, waits: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """conv_id, call_id, seq, level, status, valid, errors, message.

    calls: conv_id, call_id, seq, name, arguments (JSON); results: conv_id,
    call_id, seq, content; waits: see ``levels``.
    """
    scratch = Scratch(calls.sparkSession)
    keys = ["conv_id", "call_id"]
    some = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    asked = scratch.save(first_of(calls.where(some).select(*keys, "seq", "name", "arguments"), keys))
    given = first_of(results.where(some).select(*keys, F.col("seq").alias("result_seq"), "content"), keys)
    placed = asked.join(levels(asked, waits.where(some & F.col("on").isNotNull()), scratch).hint("shuffle_hash"), keys, "left")
    both = placed.join(given.hint("shuffle_hash"), keys, "full")
    status = F.when(F.col("seq").isNull(), "orphan").when(F.col("result_seq").isNull(), "open").otherwise("linked")
    wrong = F.when(F.col("seq").isNull(), F.lit("no call")).otherwise(errors(F.col("name"), F.col("arguments"), schemas))
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    message = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), F.coalesce(F.when(F.col("name").isNotNull(), quoted(F.col("name"))), F.lit("null")), F.lit(',"result":'), F.coalesce(F.when(F.col("content").isNotNull(), quoted(F.col("content"))), F.lit("null")), F.lit("}"))
    return both.select(*keys, F.coalesce("seq", "result_seq").cast("long").alias("seq"), F.col("level").cast("long").alias("level"), status.alias("status"), (wrong == "").alias("valid"), wrong.alias("errors"), message.alias("message"))


#: A turn that asks is a call of this tool.
CHAT: dict[str, Schema] = {"chat": {"role": ("string", True), "text": ("string", True), "turn": ("integer", True)}}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and waits of plain transcripts.

    Every turn that isn't an assistant's is a call; the assistant's turn after it
    is its result.  A call waits for the result of the turn before it.  A turn
    without a number has a null identifier, so ``link`` drops it; one without a
    role is neither call nor result and goes, as in the oracle SQL.
    """
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asks = turns.where("role <> 'assistant'")
    calls = asks.select("conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), F.lit("chat").alias("name"), F.to_json(F.struct("turn", "text", "role")).alias("arguments"))
    answers = turns.where("role = 'assistant'")
    results = answers.select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    waits = asks.select("conv_id", name(F.col("turn")).alias("call_id"), F.explode(F.array(name(F.col("turn") - 1), name(F.col("turn") - 2))).alias("on"))
    return calls, results, waits


def op3_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), CHAT)


QUERIES = {"op3_chat_tools": op3_chat_tools}
ORACLES = {
    "op3_chat_tools": """
WITH RECURSIVE asked AS (
  SELECT conv_id, call_id, min(seq) AS seq, arg_min(role, (seq, canonical)) AS role, arg_min(text, (seq, canonical)) AS text, min(canonical) AS canonical FROM
    (SELECT conv_id, concat_ws(':', conv_id, turn) AS call_id, turn AS seq, role, text,
       CASE WHEN text IS NULL THEN CAST(json_object('role', role, 'turn', turn) AS VARCHAR) ELSE CAST(json_object('role', role, 'text', text, 'turn', turn) AS VARCHAR) END AS canonical
     FROM conversations WHERE role <> 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY conv_id, call_id),
given AS (SELECT conv_id, concat_ws(':', conv_id, turn - 1) AS call_id, turn AS result_seq, min(text) AS content
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
edges AS (SELECT a.conv_id, a.call_id, b.call_id AS waited FROM asked a JOIN asked b ON a.conv_id = b.conv_id AND b.seq IN (a.seq - 1, a.seq - 2)),
walk AS (SELECT conv_id, call_id, CAST(0 AS BIGINT) AS level FROM asked
  UNION SELECT e.conv_id, e.call_id, w.level + 1 FROM edges e JOIN walk w ON e.conv_id = w.conv_id AND e.waited = w.call_id),
placed AS (SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY conv_id, call_id)
SELECT coalesce(a.conv_id, g.conv_id) AS conv_id, coalesce(a.call_id, g.call_id) AS call_id, CAST(coalesce(a.seq, g.result_seq) AS BIGINT) AS seq, p.level,
  CASE WHEN a.seq IS NULL THEN 'orphan' WHEN g.result_seq IS NULL THEN 'open' ELSE 'linked' END AS status,
  a.seq IS NOT NULL AND a.text IS NOT NULL AS valid,
  CASE WHEN a.seq IS NULL THEN 'no call' WHEN a.text IS NULL THEN 'missing text' ELSE '' END AS errors,
  concat('{"arguments":', coalesce(a.canonical, 'null'), ',"id":', CAST(to_json(coalesce(a.call_id, g.call_id)) AS VARCHAR), ',"name":', CASE WHEN a.seq IS NULL THEN 'null' ELSE '"chat"' END,
    ',"result":', CASE WHEN g.content IS NULL THEN 'null' ELSE CAST(to_json(g.content) AS VARCHAR) END, '}') AS message
FROM asked a LEFT JOIN placed p USING (conv_id, call_id) FULL JOIN given g ON a.conv_id = g.conv_id AND a.call_id = g.call_id
"""
}
