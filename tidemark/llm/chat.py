"""Chat formatting: links tool calls with their results, orders and validates them, and writes canonical JSON; no Python on the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_rank, forget, table, written

#: Tools that conversations may call: for each argument its type and whether it is required.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "get_weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}
#: Variant types that each type of a schema takes.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
SPAN = 256  # turns that are numbered together; a long conversation is spread over its spans


def _kind(v: Column) -> Column:
    """First word of the variant's own type: BIGINT, STRING, DECIMAL, OBJECT, ..."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$." + name, "variant")


def check_arguments(name: Column, args: Column, tools: dict) -> Column:
    """Null if the arguments fit the tool's schema, else the first fault in the schema's order."""
    out = F.when(name.isNull() | ~name.isin(list(tools)), F.lit("unknown tool")).when(args.isNull() | (_kind(args) != "OBJECT"), F.lit("no object"))
    for tool, schema in tools.items():
        for field, (kind, required) in sorted(schema.items()):
            v = _field(args, field)
            absent = v.isNull() | (_kind(v) == "VOID")
            if required:
                out = out.when((name == tool) & absent, F.lit(f"missing {field}"))
            out = out.when((name == tool) & ~absent & ~_kind(v).isin(TYPES[kind]), F.lit(f"type of {field}"))
        known = sorted(schema)
        extra = F.array_except(F.json_object_keys(F.to_json(args)), F.array(*map(F.lit, known)))
        out = out.when((name == tool) & (F.size(extra) > 0), F.concat(F.lit("extra "), F.array_min(extra)))
    return out


def read_calls(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message, or a call of it: key, conv, turn, seq, role, text, v (the object), kind, call_id, tool, args, needs, at."""
    c = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    v = F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    c = c.withColumn("v", v).withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("n")))
    listed = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    each = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(None).cast("variant")))
    c = c.select("*", F.posexplode(each).alias("seq", "item"))
    in_list = F.col("item").isNotNull()
    text = lambda col, path: F.try_variant_get(col, path, "string")
    c = c.withColumn("call_id", F.when(in_list, F.coalesce(text("item", "$.id"), text("item", "$.tool_call_id"))).otherwise(text("v", "$.tool_call_id")))
    c = c.withColumn("tool", F.when(in_list, F.coalesce(text("item", "$.function.name"), text("item", "$.name"))).otherwise(text("v", "$.name")))
    args = F.when(in_list, F.coalesce(F.try_variant_get("item", "$.function.arguments", "variant"), F.try_variant_get("item", "$.arguments", "variant"))).otherwise(_field(F.col("v"), "arguments"))
    # Arguments may be an object, or a string that holds one.
    c = c.withColumn("args", args).withColumn("args", F.when(_kind(F.col("args")) == "STRING", F.try_parse_json(text("args", "$"))).otherwise(F.col("args")))
    kind = F.when(F.col("call_id").isNotNull() & F.col("tool").isNotNull(), "call").when(~in_list & F.col("call_id").isNotNull() & F.col("role").isin("tool", "function"), "result").otherwise("message")
    c = c.withColumn("kind", kind)
    is_call, in_object = F.col("kind") == "call", F.when(in_list, F.col("item")).otherwise(F.col("v"))
    needs = F.coalesce(F.try_variant_get(in_object, "$.depends_on", "array<string>"), F.array(F.try_variant_get(in_object, "$.depends_on", "string")))
    c = c.withColumn("needs", F.when(is_call, F.array_distinct(F.filter(needs, lambda x: x.isNotNull()))))
    c = c.withColumn("v", F.when(in_list & is_call, F.col("item")).otherwise(F.col("v")))
    tie = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie")
    c = c.withColumn("call_id", F.when(F.col("kind") != "message", F.col("call_id"))).withColumn("tool", F.when(is_call, F.col("tool")))
    return c.withColumn("at", F.struct("turn", tie, "seq")).drop("item")


def dependency_places(ids: DataFrame, needs: DataFrame) -> DataFrame:
    """ids (key, call_id, first_call, first_result) with place, depth and cyclic of calls: place and depth sort a call behind
    all that it needs, directly or through others, and otherwise by turn.

    needs: (key, call_id, need) of first calls. A call stands at the greatest (turn, depth) of its own turn and of what
    it needs, a depth deeper: behind the needed call's result, and behind the call itself where no result came. Calls are
    peeled: a round settles those whose needs are all settled, and takes their needs away. The rounds are one more than
    the longest chain of needs has links, whatever else a conversation holds. What no round settles is on a cycle or
    behind one: it stays at its own turn and is marked cyclic. An identifier that no call has is ignored.
    """
    spark = ids.sparkSession
    rank = lambda turn: F.coalesce(turn, F.lit(-(1 << 40)))
    calls = ids.filter("first_call is not null").select("key", "call_id", rank(F.col("first_call")["turn"]).alias("turn"), rank(F.col("first_result")["turn"]).alias("result_turn"), F.col("first_result").isNotNull().alias("answered"))
    calls = written(calls, "call-turns")
    edges = needs.join(calls.select("key", F.col("call_id").alias("need")), ["key", "need"], "left_semi").select("key", "call_id", "need").distinct()
    end_type = "struct<place:bigint,depth:int>"
    edges = written(edges.withColumn("end", F.lit(None).cast(end_type)), "call-needs-0")
    own = F.struct(F.col("turn").alias("place"), F.lit(0).alias("depth")).cast(end_type)
    settled = written(calls.join(edges.select("key", "call_id").distinct(), ["key", "call_id"], "left_anti").withColumn("at", own), "call-places-0")
    rounds = [settled]
    while not edges.isEmpty() and not settled.isEmpty():
        place, depth = F.col("at")["place"], F.col("at")["depth"]
        end = F.greatest(F.struct(place.alias("place"), (depth + 1).alias("depth")), F.when(F.col("answered"), F.struct(F.col("result_turn").alias("place"), F.lit(0).alias("depth")))).cast(end_type)
        ends = settled.select("key", F.col("call_id").alias("need"), end.alias("now"))
        met = edges.join(ends, ["key", "need"], "left").select("key", "call_id", "need", F.coalesce("end", "now").alias("end"))
        ready = met.groupBy("key", "call_id").agg(F.count(F.lit(1)).alias("n"), F.count("end").alias("known"), F.max("end").alias("end")).filter("n = known").select("key", "call_id", "end")
        to = F.greatest(own, F.struct(F.col("end")["place"].alias("place"), (F.col("end")["depth"] + 1).alias("depth")).cast(end_type))
        settled = written(calls.join(ready, ["key", "call_id"]).withColumn("at", to).drop("end"), f"call-places-{len(rounds)}")
        before, edges = edges, written(met.join(settled.select("key", "call_id"), ["key", "call_id"], "left_anti"), f"call-needs-{len(rounds)}")
        forget(spark, before)
        rounds.append(settled)
    dependency_places.rounds = len(rounds) - 1
    done = spark.read.schema(settled.schema).parquet(*[r.folder for r in rounds])
    cyclic = calls.join(edges.select("key", "call_id").distinct(), ["key", "call_id"]).withColumn("at", own)
    every = done.withColumn("cyclic", F.lit(False)).unionByName(cyclic.withColumn("cyclic", F.lit(True)))
    every = written(every.select("key", "call_id", F.col("at.place").alias("place"), F.col("at.depth").alias("depth"), "cyclic"), "call-places")
    forget(spark, edges, calls, *rounds)
    return ids.join(every, ["key", "call_id"], "left")


def format_chat(conversations: DataFrame, tools: dict | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message, or a call of it: conversation, turn, pos, kind, call_id, tool, link, fault and canonical JSON.

    A message is a call if its text is a JSON object with a string at "tool_call_id" and one at "name"; a list
    "tool_calls" of objects with an "id" and a "function" of "name" and "arguments" (an object, or its JSON as a string)
    gives a row for each of them, which count as calls. A message is a result if it has "tool_call_id" and no "name"
    and its role is tool or function; every other text is a message. Calls and results meet by conversation and
    identifier in an equi-join of all rows with one row an identifier, which Spark runs as a hash or a sort-merge join by
    its size. Of calls with one identifier the first (by turn, then text, then place in its list) is the one that results
    link to, later ones are `repeated`; of results the first is `linked`, later ones `repeated`; without a partner they are
    `unanswered` or `orphan`. A call's arguments are tested against its tool's schema; the fault is null if they fit.

    pos is 1-based in the conversation and a topological order: by turn, but a result comes behind its call, and a call
    behind the results of the identifiers that its "depends_on" (a string or a list) names. Calls on a cycle of such needs,
    and behind one, stay at their own turn with the fault `cycle`. JSON has sorted keys and no blanks; numbers and nested
    objects are normalised by the variant type; text that isn't valid JSON, or repeats a key, is a message. Null roles,
    texts and turns stay null (turns first); messages of a null conversation form a conversation of their own. Rows alike
    in all four columns are interchangeable. Other columns aren't read; an empty table gives an empty one. A conversation of
    any length is numbered in spans of 256 turns, and never collected; rows without a turn are one span, dealt by text.
    """
    tools = TOOLS if tools is None else tools
    c = read_calls(conversations, conv_col, turn_col, role_col, text_col)
    # One row for each identifier, summed before the shuffle: a common identifier gathers nowhere.
    ids = c.filter("call_id is not null").groupBy("key", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", F.col("at"))).alias("first_call"), F.min(F.when(F.col("kind") == "result", F.col("at"))).alias("first_result"))
    needing = c.filter("size(needs) > 0")
    if needing.isEmpty():
        turn = F.coalesce(F.col("first_call")["turn"], F.when(F.col("first_call").isNotNull(), F.lit(-(1 << 40))))
        ids = ids.withColumn("place", turn).withColumn("depth", F.lit(0)).withColumn("cyclic", F.lit(False))
    else:
        needs = needing.join(ids.select("key", "call_id", "first_call"), ["key", "call_id"]).filter("at = first_call")
        ids = dependency_places(ids, needs.select("key", "call_id", F.explode("needs").alias("need")))
    linked = c.filter("call_id is not null").join(ids, ["key", "call_id"])
    plain = c.filter("call_id is null")
    for f in ids.schema:
        if f.name not in plain.columns:
            plain = plain.withColumn(f.name, F.lit(None).cast(f.dataType))
    d = linked.unionByName(plain)
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    first = is_call & (F.col("at") == F.col("first_call"))
    link = (
        F.when(is_call & ~first, "repeated").when(is_call & F.col("first_result").isNull(), "unanswered")
        .when(is_result & F.col("first_call").isNull(), "orphan").when(is_result & (F.col("at") != F.col("first_result")), "repeated").when(is_call | is_result, "linked")
    )
    fault = F.when(first & F.col("cyclic"), "cycle").when(is_call, check_arguments(F.col("tool"), F.col("args"), tools))
    d = d.withColumn("link", link).withColumn("fault", fault)
    # A row's own turn, and where it may stand at the earliest: (place, depth) of the call, one deeper for results.
    own = F.struct(F.coalesce("turn", F.lit(-(1 << 40))).alias("place"), F.lit(0).alias("depth"))
    behind = F.when(is_result & F.col("first_call").isNotNull(), F.struct("place", (F.col("depth") + 1).alias("depth"))).when(first, F.struct("place", "depth"))
    d = d.withColumn("where", F.greatest(own, behind)).withColumn("place", F.col("where.place")).withColumn("depth", F.col("where.depth"))
    # Order within the spans: turns, or parts of the texts' digests where there is no turn.
    none = F.conv(F.substring("at.tie", 1, 3), 16, 10).cast("long") + 4096 * F.col("depth") - (1 << 40)
    d = d.withColumn("span", F.when(F.col("place") == -(1 << 40), none).otherwise(F.floor(F.col("place") / SPAN)))
    order = [F.col("place"), F.col("depth"), F.col("at.turn").asc_nulls_first(), F.col("at.tie"), F.col("at.seq"), F.col("role").asc_nulls_first()]
    d = exact_rank(d, ["key"], "span", order, "pos")
    return d.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "pos", "kind", "call_id", "tool", "link", "fault", canonical(d).alias("json"))


def canonical(d: DataFrame) -> Column:
    """The message as JSON with sorted keys: content is the parsed object of a call or result, else the text."""
    text = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    role = F.expr("substring(to_json(array(role)), 2, length(to_json(array(role))) - 2)")
    content = F.when(F.col("kind") == "message", text).otherwise(F.to_json("v"))
    return F.concat(F.lit('{"content":'), content, F.lit(',"pos":'), F.col("pos").cast("string"), F.lit(',"role":'), role, F.lit("}"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of `conversations` in its place, with links, faults and canonical JSON."""
    return format_chat(table(spark, sf_dir, "conversations"))


#: Texts of derived calls by tool and fault, as SQL and Spark write them alike; %s is the identifier. The second form is canonical.
CALLS = (
    ('{"name": "search", "tool_call_id": "%s", "arguments": {"query": "q", "limit": 3}}', '{"arguments":{"limit":3,"query":"q"},"name":"search","tool_call_id":"%s"}', None),
    ('{"tool_call_id":"%s","name":"search","arguments":{"limit":3}}', '{"arguments":{"limit":3},"name":"search","tool_call_id":"%s"}', "missing query"),
    ('{"tool_call_id":"%s","name":"get_weather","arguments":{"city":"x","days":"two"}}', '{"arguments":{"city":"x","days":"two"},"name":"get_weather","tool_call_id":"%s"}', "type of days"),
    ('{"tool_call_id":"%s","name":"calculator","arguments":{"z":1,"expression":"1+1"}}', '{"arguments":{"expression":"1+1","z":1},"name":"calculator","tool_call_id":"%s"}', "extra z"),
    ('{"tool_call_id":"%s","name":"nope","arguments":{}}', '{"arguments":{},"name":"nope","tool_call_id":"%s"}', "unknown tool"),
    ('{"name":"calculator","tool_call_id":"%s"}', '{"name":"calculator","tool_call_id":"%s"}', "no object"),
)
RESULT = ('{"tool_call_id": "%s", "content": [1, {"b": 2, "a": true}]}', '{"content":[1,{"a":true,"b":2}],"tool_call_id":"%s"}')


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_chat on calls and results made of every row of `conversations`, by its conversation and turn."""
    c = table(spark, sf_dir, "conversations")
    k, call_id = (F.col("conv_id") * 7 + F.col("turn") * 3) % 11, F.concat(F.lit("i"), (F.col("turn") % 5).cast("string"))
    put = lambda t: F.replace(F.lit(t), F.lit("%s"), call_id)
    text = F.when(k == 9, F.col("text"))
    for i, (raw, _, _) in enumerate(CALLS):
        text = text.when(k == i, put(raw))
    text = text.when(k.between(6, 8), put(RESULT[0])).otherwise(F.col("text"))
    made = c.select("conv_id", "turn", F.when(k < 6, "assistant").when(k < 9, "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))
    return format_chat(made)


def _case(values: list, quote: bool = True) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("%s", "' || cid || '") + "'"
    return "CASE k " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


CALLS_ORACLE = f"""
WITH c AS (SELECT conv_id, turn::BIGINT AS turn, role, text, (conv_id * 7 + turn * 3) % 11 AS k, 'i' || (turn % 5) AS cid FROM conversations),
m AS (SELECT *, CASE WHEN k < 6 THEN 'call' WHEN k < 9 THEN 'result' ELSE 'message' END AS kind, CASE WHEN k < 6 THEN 'assistant' WHEN k < 9 THEN 'tool' ELSE role END AS rl,
  CASE WHEN k < 6 THEN {_case([x[0] for x in CALLS])} WHEN k < 9 THEN {_case([RESULT[0]]).replace("CASE k WHEN 0 THEN", "(").replace(" END", ")")} ELSE text END AS t,
  CASE WHEN k < 6 THEN {_case([x[1] for x in CALLS])} WHEN k < 9 THEN {_case([RESULT[1]]).replace("CASE k WHEN 0 THEN", "(").replace(" END", ")")} ELSE coalesce(to_json(text)::VARCHAR, 'null') END AS content,
  {_case([x[2] for x in CALLS])} AS fault, CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'search' WHEN 2 THEN 'get_weather' WHEN 3 THEN 'calculator' WHEN 4 THEN 'nope' WHEN 5 THEN 'calculator' END AS tool FROM c),
f AS (SELECT *, CASE WHEN kind = 'message' THEN NULL ELSE cid END AS id, row(turn, md5(coalesce(t, ''))) AS pt FROM m),
g AS (SELECT conv_id, id, min(pt) FILTER (kind = 'call') AS fc, min(pt) FILTER (kind = 'result') AS fr, min(turn) FILTER (kind = 'call') AS ct FROM f WHERE id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT f.*, CASE WHEN kind = 'call' AND pt <> fc THEN 'repeated' WHEN kind = 'call' AND fr IS NULL THEN 'unanswered' WHEN kind = 'result' AND fc IS NULL THEN 'orphan' WHEN kind = 'result' AND pt <> fr THEN 'repeated'
  WHEN kind <> 'message' THEN 'linked' END AS link, CASE WHEN kind = 'result' AND ct >= turn THEN ct ELSE turn END AS place, CASE WHEN kind = 'result' AND ct >= turn THEN 1 ELSE 0 END AS depth
  FROM f LEFT JOIN g ON g.conv_id = f.conv_id AND g.id = f.id),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, depth, turn, md5(coalesce(t, '')), rl NULLS FIRST) AS pos FROM l)
SELECT conv_id, turn, pos, kind, id AS call_id, tool, link, fault, '{{"content":' || content || ',"pos":' || pos || ',"role":' || coalesce(to_json(rl)::VARCHAR, 'null') || '}}' AS json FROM p
"""

ORACLE = """
WITH c AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*\\{') AND json_valid(text) THEN text::JSON END AS v FROM conversations),
k AS (SELECT *, CASE WHEN json_type(v, '$.tool_call_id') = 'VARCHAR' THEN v->>'$.tool_call_id' END AS cid, CASE WHEN json_type(v, '$.name') = 'VARCHAR' THEN v->>'$.name' END AS nm FROM c),
m AS (SELECT *, CASE WHEN cid IS NOT NULL AND nm IS NOT NULL THEN 'call' WHEN cid IS NOT NULL AND role IN ('tool', 'function') THEN 'result' ELSE 'message' END AS kind FROM k),
-- The tables at hand hold plain messages; calls and results are tested on fixtures.
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(text, '')), role NULLS FIRST) AS pos FROM m WHERE kind = 'message')
SELECT conv_id, turn, pos, kind, NULL::VARCHAR AS call_id, NULL::VARCHAR AS tool, NULL::VARCHAR AS link, NULL::VARCHAR AS fault,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"pos":' || pos || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json FROM p
"""
