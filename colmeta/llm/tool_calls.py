"""Chat formatting: link tool calls to their results, order them, validate their arguments, write canonical JSON.

DataFrame functions only. Messages are rows (conv_id, turn, role, text). A call message's text is a JSON object with
tool_calls: [{id, name, arguments, after}] and perhaps content, what is said beside them; after names calls of the conversation that it depends on. A result message
has the role "tool" and a JSON object {tool_call_id, content}. Every other message stays as it is. What else these objects
hold is kept as it is said, under `more`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, stored

#: A tool's arguments: name to (type, required). Types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_CALLS = "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>>"
_RAW, _FIELDS = "struct<tool_calls: array<string>>", "map<string, variant>"
#: Pattern of a variant's type, by argument type.
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def _fault(name: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, null if nothing."""
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    out = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "arguments are no object")
    for tool, fields in sorted(schemas.items()):
        is_tool = name == tool
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            if required:
                out = out.when(is_tool & (value.isNull() | F.is_variant_null(value)), f"{field} is missing")
            out = out.when(is_tool & value.isNotNull() & ~F.schema_of_variant(value).rlike(_KINDS[kind]), f"{field} is no {kind}")
        out = out.when(is_tool & (F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0), "unknown argument")
    return out.when(~name.isin(*schemas) | name.isNull(), "unknown tool")


def _more(fields: Column, known: Column) -> Column:
    """Canonical JSON of an object's fields but the known ones, null if there are none."""
    names = F.array_sort(F.filter(F.map_keys(fields), lambda k: ~F.array_contains(known, k)))
    rest = F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), fields[k].alias("value"))))
    return F.when(F.size(names) > 0, F.to_json(rest))


def _names(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def _inner(*fields: str) -> Column:
    """Fields as the inside of a JSON object, nulls too."""
    json = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.substring(json, F.lit(2), F.length(json) - 2)


def _part(name: str, json: Column) -> Column:
    """A field of a JSON object and a comma, nothing where it is null."""
    return F.coalesce(F.concat(F.lit(f'"{name}":'), json, F.lit(",")), F.lit(""))


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level of the calls that depend on others: 1 more than the highest they depend on, null in a cycle.

    Each round frees the calls whose dependencies are free; there are as many rounds as the longest chain has calls. A
    dependency on a call that isn't there counts as free.
    """
    ids = calls.select("conv_id", "id")
    edges = calls.select("conv_id", "id", F.explode("after").alias("dep")).distinct()
    pending = stored(edges.join(ids.withColumnRenamed("id", "dep"), ["conv_id", "dep"], "left_semi"))
    left, level, done = pending.count(), 0, []
    while left:
        level += 1
        blocked = pending.select("conv_id", F.col("id").alias("dep")).distinct()
        still = stored(pending.join(blocked, ["conv_id", "dep"], "left_semi"))
        now = still.count()
        if now == left:
            done.append(pending.select("conv_id", "id").distinct().withColumn("level", F.lit(None).cast("int")))
            break
        free = pending.select("conv_id", "id").distinct().join(still.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
        done.append(stored(free.withColumn("level", F.lit(level))))
        dropped(pending)
        pending, left = still, now
    out = ids.limit(0).withColumn("level", F.lit(0))
    for d in done:
        out = out.unionByName(d)
    return out


def linked(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """A row for each plain message, call and unclaimed result: conv_id, turn, kind, call_id, level, name, fault, status, after, json.

    Calls and results meet in a hash join on conversation and identifier. Of calls (or results) that share an identifier
    in a conversation the first by turn counts, one without a turn last; each other one is a row of its own, a
    duplicate, whose call_id is null and stands in its json: no two calls of a conversation share a call_id. A call without an identifier is named #<turn>.<position>, and has none if its turn is null. A null
    conversation or identifier joins nothing. status: answered, unanswered, cycle for calls; orphan for results without
    a call; duplicate for both; null for messages. level orders calls topologically: level, then turn; duplicates have
    none, calls that can't be joined are at 0. json has sorted keys and no spaces; arguments, results and all else that
    comes as JSON are canonical too, and stay text where they can't be parsed; numbers beyond 38 digits are written as
    doubles. after is a call's own list as JSON, null if it is empty; more and result_more hold the other fields of a call and of a result. What
    a call message says beside its calls is a message of its own, its other fields under more. White space before the
    object doesn't matter. A text that is no such JSON object, or one without any call, is a plain message; null texts are
    messages with a null content. No rows give none; other columns are not read.
    """
    m = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    bare = F.ltrim("text", F.lit(" \t\r\n"))
    m = m.withColumn("object", F.when(bare.startswith("{"), bare))
    m = m.withColumns({"said": F.from_json("object", _CALLS), "raw": F.from_json("object", _RAW)["tool_calls"], "fields": F.from_json("object", _FIELDS)})
    m = m.withColumn("calls", F.when(F.size("said.tool_calls") > 0, F.arrays_zip(F.col("said.tool_calls").alias("c"), F.col("raw").alias("raw"))))
    m = m.withColumn("answers", F.when(F.col("role") == "tool", F.get_json_object("object", "$.tool_call_id")))
    beside = m.where("calls is not null and answers is null").withColumn("more", _more(F.col("fields"), _names("content", "tool_calls"))).where("said.content <> '' or more is not null")
    beside = beside.select("turn", "conv_id", "role", F.col("said.content").alias("text"), "more")
    plain = m.where("calls is null and answers is null").select("turn", "conv_id", "role", "text", F.lit(None).cast("string").alias("more")).unionByName(beside)
    calls = m.where("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("at", "x")).withColumn("more", _more(F.from_json("x.raw", _FIELDS), _names("id", "name", "arguments", "after"))).select("conv_id", "turn", "at", "x.c.*", "more")
    calls = calls.withColumn("id", F.coalesce("id", F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit("."), F.col("at").cast("string")))).drop("at")
    own = F.when(F.col("calls").isNull(), _names("tool_call_id", "content")).otherwise(_names("tool_call_id", "content", "tool_calls"))
    results = m.where("answers is not null").select("conv_id", "turn", F.col("answers").alias("id"), F.to_json(F.col("fields")["content"]).alias("content"), _more(F.col("fields"), own).alias("result_more"))
    keyed = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    ranked = []
    for df, order in ((calls, ("name", "arguments", "after", "more")), (results, ("content", "result_more"))):
        first = Window.partitionBy("conv_id", "id").orderBy(F.col("turn").asc_nulls_last(), *order)
        ranked.append(stored(df.where(keyed).withColumn("nth", F.row_number().over(first))))
    only = F.lit(1).alias("nth")
    loose = calls.where(~keyed).select("*", only), results.where(~keyed).select("*", only)
    calls, results = (df.where("nth = 1").drop("nth") for df in ranked)
    levels = _levels(calls)
    is_call = lambda df: df.withColumn("known", F.lit(True))
    result = lambda df: df.withColumnRenamed("turn", "result_turn").withColumn("answer", F.lit(True))
    met = is_call(calls).join(result(results).hint("shuffle_hash"), ["conv_id", "id"], "full_outer").join(levels.withColumn("deep", F.lit(True)), ["conv_id", "id"], "left")
    for n, (df, free) in enumerate(zip(ranked, loose, strict=True)):
        apart = df.where("nth > 1").unionByName(free)
        met = met.unionByName((result if n else is_call)(apart), allowMissingColumns=True)
    parsed = F.try_parse_json("arguments")
    known, again = F.col("known").isNotNull(), F.coalesce(F.col("nth") > 1, F.lit(False))
    met = met.withColumns({
        "level": F.when(known & ~again, F.when(F.col("deep"), F.col("level")).otherwise(0)),
        "fault": F.when(known, _fault(F.col("name"), F.col("arguments"), parsed, schemas)),
        "canonical": F.coalesce(F.to_json(parsed), F.to_json(F.struct(F.col("arguments").alias("a"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("arguments").alias("a")))) - 6)),
    })
    met = met.withColumn("status", F.when(again, "duplicate").when(~known, "orphan").when(F.col("level").isNull(), "cycle").when(F.col("answer"), "answered").otherwise("unanswered"))
    whole = F.concat(F.lit("{"), _part("arguments", F.when(known & F.col("arguments").isNotNull(), F.col("canonical"))), _inner("id", "level"), F.lit(","), _part("more", F.col("more")), _inner("name"), F.lit(","), _part("result", F.coalesce("content", F.lit("null"))), _part("result_more", F.col("result_more")), _inner("status"), F.lit("}"))
    out = met.select("conv_id", F.when(known, F.col("turn")).otherwise(F.col("result_turn")).alias("turn"), F.when(known, "call").otherwise("result").alias("kind"), F.when(~again, F.col("id")).alias("call_id"), "level", "name", "fault", "status", F.when(F.size("after") > 0, F.to_json("after")).alias("after"), whole.alias("json"))
    said = plain.withColumn("content", F.col("text")).select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("after"), F.concat(F.lit("{"), _inner("content"), F.lit(","), _part("more", F.col("more")), _inner("role"), F.lit("}")).alias("json"))
    return out.unionByName(said)


#: Tools of the calls that as_tool_chat() makes.
CHAT_SCHEMAS: Schemas = {"answer": {"query": ("string", True), "words": ("integer", True)}, "search": {"query": ("string", True), "limit": ("integer", False)}}


def as_tool_chat(conversations: DataFrame) -> DataFrame:
    """The conversations table in the messages' form: a user's turn is a call, and the assistant's next turn its result.

    The call of turn t is c<conv>-<t>. It depends on the call two turns before, but for the first turn of each eight.
    Turns alternate between the two tools by their number; each seventh turn lacks its number of words.
    """
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    answer = turn % 4 < 2
    words = F.when(answer & (turn % 7 != 6), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))
    limit = F.when(~answer, F.lit(5))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), words.alias("words"), limit.alias("limit")))
    after = F.when(turn % 8 >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>"))
    call = F.struct(name(turn).alias("id"), F.when(answer, "answer").otherwise("search").alias("name"), arguments.alias("arguments"), after.alias("after"))
    text = F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(F.col("role") == "assistant", F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))).otherwise(F.col("text"))
    role = F.when(F.col("role") == "assistant", "tool").when(F.col("role") == "user", "assistant").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
