"""Conversations: from run events to messages, tool calls and reasonings, and back to a transcript.

Batch folding works in two steps. ``resolve_events`` says for every event which message, tool call and
reasoning block it belongs to and what was active before it; chats of usual size are resolved in place
after one shuffle, and a chat that holds a third of all events is cut into blocks, whose changes are put in order and
which are then finished side by side. The ``assemble_*`` functions then group the resolved events. The streaming job resolves with state and assembles with the same
functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.text import error_text, strip_placeholder
from larder.operators.aggregates import fold_ordered
from larder.operators.scan import BLOCK_ROWS, carry_forward, carry_within, running_totals
from larder.session import materialise

EVENT_FIELDS = {
    "chat_id": "string", "run_id": "string", "seq": "bigint", "ts": "timestamp", "type": "string",
    "message_id": "string", "parent_message_id": "string", "tool_call_id": "string", "name": "string",
    "role": "string", "delta": "string", "delta_list": "array<string>", "content": "string",
    "error_code": "string", "error_message": "string",
}
"""``seq`` numbers the events of a chat. ``MESSAGE`` events are the incoming user messages."""
EVENT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in EVENT_FIELDS.items())

# Event types, roles and texts that stored data contain.
TEXT = ("TEXT_MESSAGE_START", "TEXT_MESSAGE_CONTENT", "TEXT_MESSAGE_END", "TEXT_MESSAGE_CHUNK")
TOOL = ("TOOL_CALL_START", "TOOL_CALL_ARGS", "TOOL_CALL_RESULT", "TOOL_CALL_END", "TOOL_CALL_CHUNK")
THOUGHT = ("THINKING_TEXT_MESSAGE_START", "THINKING_TEXT_MESSAGE_CONTENT", "THINKING_TEXT_MESSAGE_END")
CHUNKS = ("TEXT_MESSAGE_CHUNK", "TOOL_CALL_CHUNK")
RUN_ENDS = ("RUN_FINISHED", "RUN_ERROR")
ASSISTANT = "assistant"
UNKNOWN_TOOL = "UNKNOWN"
NOT_A_USER = "The user cannot create new non-user messages."
SCOPE = ["chat_id", "run_id", "epoch"]
#: Events of one task. The windows sort them in several orders, so a task holds them several times.
TASK_EVENTS = 100_000
RESOLVED = ["target_id", "active_id", "tool_id", "active_tool", "block", "open_block", "step", "title"]


def _is(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def _derived_id(kind: str, seq: Column) -> Column:
    """A repeatable id in place of a random one: from the chat and the event it starts at."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\u0000", "chat_id", seq), 256), 1, 32))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def resolve_events(events: DataFrame, chat_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add to each event what it belongs to.

    ``target_id``: its message. ``active_id``: the message active before it. ``tool_id`` and
    ``active_tool`` (message, tool): the same for tool calls. ``block`` and ``open_block``: the
    reasoning block of a thought, and the block still open at any other event. ``step`` and
    ``title``: what the run was in.

    Runs of a chat may follow each other or take turns, and the user's messages come before the run that answers them.
    Chats of up to ``chat_rows`` events are shuffled once, texts included, and resolved in place; a count finds the
    larger ones, which are cut into blocks of as many numbers, so that no task gets more of a chat than that. The
    number of tasks comes from the same count.
    """
    sizes = events.groupBy("chat_id").count()
    total, most = sizes.agg(F.sum("count"), F.max("count")).first()
    tasks = max(2, -(-(total or 0) // TASK_EVENTS))  # by chat also for few events
    if (most or 0) <= chat_rows:
        return _resolve_in_place(events.repartition(tasks, "chat_id"))
    hot = sizes.filter(F.col("count") > chat_rows).select("chat_id")
    small = events.join(hot, "chat_id", "left_anti").repartition(tasks, "chat_id")
    large = events.join(hot, "chat_id", "left_semi")
    return _resolve_in_place(small).unionByName(_resolve_in_blocks(large, chat_rows, tasks))


def _resolve_in_place(events: DataFrame) -> DataFrame:
    """Chats of bounded size, each in one task: windows over rows that already lie together."""

    def least(df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column]) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: F.min(c).over(w) for n, c in cols.items()})

    own = F.when(_is(*TEXT), F.col("message_id")).when(
        _is("TOOL_CALL_START", "TOOL_CALL_CHUNK"), F.col("parent_message_id")
    )
    started = F.when(_is("RUN_STARTED"), F.col("seq"))
    rows = carry_within(events, ["chat_id", "run_id"], "seq", {"epoch": started})
    rows = rows.withColumns({"__own": own, "__touch": _is(*TEXT, *TOOL, *THOUGHT)})

    named = F.struct(F.col("name").alias("name"))
    nothing = F.struct(F.lit(None).cast("string").alias("name"))
    rows = carry_within(
        rows,
        SCOPE,
        "seq",
        upto={
            "__named": F.col("__own"),
            "__step": F.when(_is("STEP_STARTED"), named).when(_is("STEP_FINISHED"), nothing),
            "__title": F.when(_is("THINKING_START"), named).when(_is("THINKING_END"), nothing),
            "__tool": F.when(_is(*TOOL), F.col("tool_call_id")),
        },
        before={
            "__thought": F.when(_is(*THOUGHT), F.struct(F.col("type").alias("type"), F.col("seq").alias("seq"))),
            "__thought_end": F.when(_is("THINKING_END"), F.col("seq")),
        },
    )

    # How each scope begins: with an event that names a message, follows one, or starts a new one.
    loose = F.col("__touch") & F.col("__own").isNull()
    rows = least(
        rows,
        SCOPE,
        {
            "__first_named": F.when(F.col("__own").isNotNull(), F.col("seq")),
            "__first_follow": F.when(loose & ~_is(*CHUNKS), F.col("seq")),
            "__first_chunk": F.when(loose & _is(*CHUNKS), F.col("seq")),
            "__first_tool_chunk": F.when(_is("TOOL_CALL_CHUNK") & F.col("tool_call_id").isNull(), F.col("seq")),
        },
    )
    never = F.lit(2**62).cast("bigint")
    chunk_first = F.col("__first_chunk") < F.least(
        F.coalesce("__first_follow", never), F.coalesce("__first_named", never)
    )
    chunk_id = _derived_id("new", F.col("__first_chunk"))

    # Which message was created last in the chat, for events without an id and without an active message.
    created = F.when(_is("MESSAGE"), F.col("message_id")).otherwise(F.col("__own"))
    rows = rows.withColumns(
        {
            "__created": created,
            "__chunk_first": F.coalesce(chunk_first, F.lit(False)),
            "__prefix": F.col("__touch") & F.col("__named").isNull(),
        }
    )
    rows = least(
        rows, ["chat_id", "__created"], {"__first_seen": F.when(F.col("__created").isNotNull(), F.col("seq"))}
    )

    def point(id_: Column, role: Column) -> Column:
        return F.struct(id_.alias("id"), role.alias("role"), F.col("seq").alias("seq"))

    role = F.when(_is("MESSAGE"), F.coalesce("role", F.lit("user"))).otherwise(
        F.coalesce(F.when(_is("TEXT_MESSAGE_START"), F.col("role")), F.lit(ASSISTANT))
    )
    latest = F.when(F.col("__first_seen") == F.col("seq"), point(F.col("__created"), role)).when(
        F.col("__chunk_first") & (F.col("seq") == F.col("__first_chunk")), point(chunk_id, F.lit(ASSISTANT))
    )
    rows = carry_within(rows, ["chat_id"], "seq", before={"__last": latest})
    at_start = F.when(F.col("seq") == F.col("__first_follow"), F.col("__last"))
    rows = least(rows, SCOPE, {"__latest": at_start})
    rows = rows.withColumn("__since", F.coalesce("__latest.seq", F.lit(-1).cast("bigint")))
    waiting = F.col("__prefix") & ~F.col("__chunk_first")
    rows = least(
        rows, ["chat_id", "__since"], {"__chunk_since": F.when(waiting & _is(*CHUNKS), F.col("seq"))}
    )
    target = (
        F.when(~F.col("__touch"), F.lit(None).cast("string"))
        .when(F.col("__named").isNotNull(), F.col("__named"))
        .when(F.col("__chunk_first"), chunk_id)
        .when(F.col("__latest.role") == ASSISTANT, F.col("__latest.id"))
        .when(F.col("seq") >= F.col("__chunk_since"), _derived_id("new", F.col("__chunk_since")))
        .otherwise(_derived_id("implicit", F.col("__since")))
    )
    tool = F.when(_is(*TOOL), F.coalesce("__tool", _derived_id("tool", F.col("__first_tool_chunk"))))
    kind = F.col("__thought.type")
    ended = F.col("__thought_end") > F.col("__thought.seq")
    open_content = (kind == "THINKING_TEXT_MESSAGE_CONTENT") & ~F.coalesce(ended, F.lit(False))
    is_open = F.coalesce(open_content | (kind == "THINKING_TEXT_MESSAGE_START"), F.lit(False))
    rows = rows.withColumns(
        {
            "target_id": target,
            "tool_id": tool,
            "step": F.col("__step.name"),
            "title": F.col("__title.name"),
            "__opens": _is("THINKING_TEXT_MESSAGE_START") | (_is(*THOUGHT) & ~is_open),
            "__open_content": F.coalesce(open_content, F.lit(False)),
        }
    )
    tool_key = F.struct(F.col("target_id").alias("message_id"), F.col("tool_id").alias("tool_id"))
    rows = carry_within(
        rows,
        SCOPE,
        "seq",
        upto={"__block_at": F.when(F.col("__opens"), F.col("seq"))},
        before={
            "active_id": F.col("target_id"),
            "active_tool": F.when(F.col("tool_id").isNotNull(), tool_key),
            "__open_message": F.when(_is(*THOUGHT), F.col("target_id")),
        },
    )
    open_key = F.struct(F.col("__open_message").alias("message_id"), F.col("__block_at").alias("block"))
    return rows.withColumns(
        {
            "block": F.when(_is(*THOUGHT), F.col("__block_at")),
            "open_block": F.when(F.col("__open_content") & ~_is(*THOUGHT), open_key),
        }
    ).select(*events.columns, *RESOLVED)


#: ``__from`` of a stretch whose run started in an earlier block, or never; a place after all events.
GOES_ON, NEVER = -(2**62), 2**62
STRETCH = ["__chat", "__block", "__run", "__from"]


def _resolve_in_blocks(events: DataFrame, block_rows: int, tasks: int = 1) -> DataFrame:
    """Chats of any size. The events of one run in one block of ``block_rows`` numbers are a stretch.

    What a stretch changes is one row. These rows are put in order per run, which gives what was true before each
    stretch, and the stretches are then finished side by side. Events are joined by stretch, never by chat.
    """
    rows = _in_blocks(events, block_rows, tasks)
    before = _before_stretches(materialise(_changes(rows)), _created(events))
    return _finished(rows.repartition(tasks, *STRETCH).join(before, STRETCH)).select(*events.columns, *RESOLVED)


def _never(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(NEVER).cast("bigint"))


def _open(thought: Column, ended: Column) -> tuple[Column, Column]:
    """Whether a block is open after the thought, and whether it was opened by content."""
    content = (thought["type"] == "THINKING_TEXT_MESSAGE_CONTENT") & ~F.coalesce(ended, F.lit(False))
    content = F.coalesce(content, F.lit(False))
    return content | F.coalesce(thought["type"] == "THINKING_TEXT_MESSAGE_START", F.lit(False)), content


def _set_by_event() -> dict[str, Column]:
    """What an event sets for the events after it in its run."""
    named = F.struct(F.col("name").alias("name"))
    nothing = F.struct(F.lit(None).cast("string").alias("name"))
    return {
        "named": F.col("__own"),
        "step": F.when(_is("STEP_STARTED"), named).when(_is("STEP_FINISHED"), nothing),
        "title": F.when(_is("THINKING_START"), named).when(_is("THINKING_END"), nothing),
        "tool": F.when(_is(*TOOL), F.col("tool_call_id")),
        "thought": F.when(_is(*THOUGHT), F.struct(F.col("type").alias("type"), F.col("seq").alias("seq"))),
        "thought_end": F.when(_is("THINKING_END"), F.col("seq")),
    }


def _in_blocks(events: DataFrame, block_rows: int, tasks: int = 1) -> DataFrame:
    """Events with their stretch, and what each knows from the events before it in the stretch."""

    def key(c: str) -> Column:  # never NULL, so that it joins
        return F.coalesce(F.concat(F.lit("="), c), F.lit(""))

    own = F.when(_is(*TEXT), F.col("message_id")).when(
        _is("TOOL_CALL_START", "TOOL_CALL_CHUNK"), F.col("parent_message_id")
    )
    rows = events.withColumns(
        {
            "__chat": key("chat_id"),
            "__run": key("run_id"),
            "__block": F.floor(F.col("seq") / F.lit(block_rows)),
            "__own": own,
            "__touch": _is(*TEXT, *TOOL, *THOUGHT),
        }
    )
    rows = rows.repartition(tasks, *STRETCH[:3])
    rows = carry_within(rows, STRETCH[:3], "seq", {"__from": F.when(_is("RUN_STARTED"), F.col("seq"))})
    rows = rows.withColumn("__from", F.coalesce("__from", F.lit(GOES_ON).cast("bigint")))
    sets = {f"__{n}": c for n, c in _set_by_event().items()}
    before = {n: sets.pop(n) for n in ("__thought", "__thought_end")}
    return carry_within(rows, STRETCH, "seq", upto=sets, before=before)


def _changes(rows: DataFrame) -> DataFrame:
    """One row per stretch: what it sets, where it first does what, and the places whose meaning hangs on what was before."""
    seq, thought = F.col("seq"), _is(*THOUGHT)
    loose = F.col("__touch") & F.col("__own").isNull()
    is_open, _ = _open(F.col("__thought"), F.col("__thought_end") > F.col("__thought.seq"))
    opens = _is("THINKING_TEXT_MESSAGE_START") | (thought & F.col("__thought").isNotNull() & ~is_open)
    place = F.struct("seq", F.col("__named").alias("named"), F.col("__tool").alias("tool"))
    start = F.struct("seq", F.col("__thought_end").isNotNull().alias("ended"))

    def first(when: Column) -> Column:
        return F.min(F.when(when, seq))

    return rows.groupBy(*STRETCH).agg(
        F.max("chat_id").alias("chat_id"),
        *[F.max_by(c, F.when(c.isNotNull(), seq)).alias(f"set_{n}") for n, c in _set_by_event().items()],
        first(F.col("__own").isNotNull()).alias("first_named"),
        first(loose & ~_is(*CHUNKS)).alias("first_follow"),
        first(loose & _is(*CHUNKS)).alias("first_chunk"),
        first(_is("TOOL_CALL_CHUNK") & F.col("tool_call_id").isNull()).alias("first_tool_chunk"),
        F.max_by(place, F.when(F.col("__touch"), seq)).alias("last_touch"),
        F.max_by(place, F.when(_is(*TOOL), seq)).alias("last_tool"),
        F.max_by(place, F.when(thought, seq)).alias("last_thought"),
        F.min_by(start, F.when(thought, seq)).alias("first_thought"),
        F.max(F.when(opens, seq)).alias("last_open"),
    )


def _point(id_: Column, role: Column, seq: str) -> Column:
    return F.struct(id_.alias("id"), role.alias("role"), F.col(seq).alias("seq"))


def _created(events: DataFrame) -> DataFrame:
    """Where each message of a chat is named first, with its role there."""
    own = F.when(_is("MESSAGE", *TEXT), F.col("message_id")).when(
        _is("TOOL_CALL_START", "TOOL_CALL_CHUNK"), F.col("parent_message_id")
    )
    role = F.when(_is("MESSAGE"), F.coalesce("role", F.lit("user"))).otherwise(
        F.coalesce(F.when(_is("TEXT_MESSAGE_START"), F.col("role")), F.lit(ASSISTANT))
    )
    named = events.withColumn("__id", own).filter(F.col("__id").isNotNull())
    first = F.min_by(_point(F.col("__id"), role, "seq"), "seq")
    found = named.groupBy(F.coalesce(F.concat(F.lit("="), "chat_id"), F.lit("")).alias("__chat"), "__id").agg(first.alias("point"))
    return found.select("__chat", F.col("point.seq").alias("seq"), "point")


def _before_stretches(stretches: DataFrame, created: DataFrame) -> DataFrame:
    """For every stretch, what was true before it and how its scope, a run from one start to the next, begins."""
    in_run = Window.partitionBy("__chat", "__run").orderBy("__block", "__from")
    started = F.when(F.col("__from") != GOES_ON, F.col("__from"))
    epoch = F.last(started, ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, 0))
    rows = stretches.withColumn("__epoch", F.coalesce(epoch, F.lit(GOES_ON).cast("bigint")))
    scope = Window.partitionBy("__chat", "__run", "__epoch")
    earlier = scope.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)

    def before(c: Column | str) -> Column:
        return F.last(c, ignorenulls=True).over(earlier)

    firsts = ("named", "follow", "chunk", "tool_chunk")
    rows = rows.withColumns(
        {
            **{f"in_{n}": before(f"set_{n}") for n in ("named", "step", "title", "tool", "thought", "thought_end")},
            **{f"of_{n}": F.min(f"first_{n}").over(scope) for n in firsts},
        }
    )
    # A scope begins with an event that names a message, with a chunk that starts one, or with one that follows
    # the message that was created last in the chat.
    rows = rows.withColumns(
        {
            "chunk_first": F.col("of_chunk") < F.least(_never("of_follow"), _never("of_named")),
            "follows": F.col("of_follow") < F.least(_never("of_chunk"), _never("of_named")),
        }
    ).fillna(False, ["chunk_first", "follows"])
    chunk_point = _point(_derived_id("new", F.col("of_chunk")), F.lit(ASSISTANT), "of_chunk")
    by_chunk = rows.filter(F.col("chunk_first") & (F.col("first_chunk") == F.col("of_chunk")))
    asked = rows.filter(F.col("follows") & (F.col("first_follow") == F.col("of_follow"))).select(
        "__chat", F.col("of_follow").alias("seq"),
        F.when(F.col("of_chunk") < _never("of_named"), F.col("of_chunk")).alias("chunk"), F.lit(True).alias("asked"),
    )
    points = created.unionByName(by_chunk.select("__chat", F.col("of_chunk").alias("seq"), chunk_point.alias("point")))
    both = points.unionByName(asked, allowMissingColumns=True)
    latest = carry_forward(both, ["__chat"], "seq", before={"latest": "point"}).filter("asked").select(
        "__chat", F.col("seq").alias("of_follow"), "latest", "chunk",
        F.coalesce("latest.seq", F.lit(-1).cast("bigint")).alias("since"),
    )
    # Scopes that follow the same message share the one that the first chunk among them starts.
    chunks = latest.groupBy("__chat", "since").agg(F.min("chunk").alias("chunk_since"))
    latest = latest.drop("chunk").join(chunks, ["__chat", "since"], "left")
    rows = rows.join(latest, ["__chat", "of_follow"], "left")

    def target_at(place: str) -> Column:
        at = F.col(place)
        return F.when(at.isNotNull(), _target(F.coalesce(at["named"], F.col("in_named")), at["seq"]))

    tool = F.coalesce("last_tool.tool", "in_tool", _derived_id("tool", F.col("of_tool_chunk")))
    tool_key = F.struct(target_at("last_tool").alias("message_id"), tool.alias("tool_id"))
    ended = (F.col("in_thought_end") > F.col("in_thought.seq")) | F.col("first_thought.ended")
    is_open, _ = _open(F.col("in_thought"), ended)
    rows = rows.withColumns(
        {
            "in_active": before(target_at("last_touch")),
            "in_active_tool": before(F.when(F.col("last_tool").isNotNull(), tool_key)),
            "in_open_message": before(target_at("last_thought")),
            "in_block": before(F.coalesce("last_open", F.when(~is_open, F.col("first_thought.seq")))),
        }
    )
    kept = [c for c in rows.columns if c.startswith("in_")]
    return rows.select(*STRETCH, *kept, "chunk_first", "of_chunk", "of_tool_chunk", "latest", "since", "chunk_since")


def _target(named: Column, seq: Column) -> Column:
    """The message of an event that touches one, from what its run named last and how the scope begins."""
    return (
        F.when(named.isNotNull(), named)
        .when(F.col("chunk_first"), _derived_id("new", F.col("of_chunk")))
        .when(F.col("latest.role") == ASSISTANT, F.col("latest.id"))
        .when(seq >= F.col("chunk_since"), _derived_id("new", F.col("chunk_since")))
        .otherwise(_derived_id("implicit", F.col("since")))
    )


def _finished(rows: DataFrame) -> DataFrame:
    """Events joined with what was true before their stretch, resolved inside the stretch."""
    thought, thought_end = F.coalesce("__thought", "in_thought"), F.coalesce("__thought_end", "in_thought_end")
    is_open, open_content = _open(thought, thought_end > thought["seq"])
    rows = rows.withColumns(
        {
            "target_id": F.when(F.col("__touch"), _target(F.coalesce("__named", "in_named"), F.col("seq"))),
            "tool_id": F.when(_is(*TOOL), F.coalesce("__tool", "in_tool", _derived_id("tool", F.col("of_tool_chunk")))),
            "step": F.coalesce("__step", "in_step")["name"],
            "title": F.coalesce("__title", "in_title")["name"],
            "__opens": _is("THINKING_TEXT_MESSAGE_START") | (_is(*THOUGHT) & ~is_open),
            "__open_content": open_content,
        }
    )
    tool_key = F.struct(F.col("target_id").alias("message_id"), F.col("tool_id").alias("tool_id"))
    rows = carry_within(
        rows,
        STRETCH,
        "seq",
        upto={"__block_at": F.when(F.col("__opens"), F.col("seq"))},
        before={
            "__active": F.col("target_id"),
            "__active_tool": F.when(F.col("tool_id").isNotNull(), tool_key),
            "__open_message": F.when(_is(*THOUGHT), F.col("target_id")),
        },
    )
    block = F.coalesce("__block_at", "in_block")
    open_key = F.struct(F.coalesce("__open_message", "in_open_message").alias("message_id"), block.alias("block"))
    return rows.withColumns(
        {
            "active_id": F.coalesce("__active", "in_active"),
            "active_tool": F.coalesce("__active_tool", "in_active_tool"),
            "block": F.when(_is(*THOUGHT), block),
            "open_block": F.when(F.col("__open_content") & ~_is(*THOUGHT), open_key),
        }
    )


def _error() -> Column:
    return F.when(_is("RUN_ERROR"), error_text("error_code", "error_message"))


def _touched_and_closed(
    resolved: DataFrame, key: Column, touched: Column, ends: Column, active: Column, closes: Column
) -> DataFrame:
    """A row ``e`` for the thing an event belongs to, and one for the thing that it closes."""
    touch = F.when(touched, F.struct(key.alias("key"), F.lit(True).alias("touch"), ends.alias("closed")))
    close = F.when(
        active.isNotNull() & closes,
        F.struct(active.alias("key"), F.lit(False).alias("touch"), F.lit(True).alias("closed")),
    )
    return resolved.withColumn("e", F.explode(F.array_compact(F.array(touch, close))))


def assemble_messages(resolved: DataFrame, agent: str = "agent") -> DataFrame:
    """Messages from resolved events: content, first role, step and time, whether open, last error."""
    given = _is("MESSAGE")
    id_ = F.when(given, F.col("message_id")).otherwise(F.col("target_id"))
    moved = F.col("target_id").isNotNull() & ~_same("target_id", "active_id")
    rows = _touched_and_closed(
        resolved, id_, id_.isNotNull(), _is("TEXT_MESSAGE_END") | given, F.col("active_id"), _is(*RUN_ENDS) | moved
    ).withColumn("message_id", F.col("e.key"))
    touch = F.col("e.touch")
    at, error = F.when(touch, F.col("seq")), F.when(~touch, _error())
    piece = F.when(_is("TEXT_MESSAGE_CONTENT", "TEXT_MESSAGE_CHUNK"), F.col("delta")).when(given, F.col("content"))
    origin = F.struct(
        given.alias("given"), F.col("name").alias("name"), F.col("step").alias("step"), F.col("ts").alias("ts"),
        F.col("seq").alias("seq"), F.when(_is("TEXT_MESSAGE_START", "MESSAGE"), F.col("role")).alias("role"),
    )
    out = fold_ordered(
        rows,
        ["chat_id", "message_id"],
        "seq",
        first={"o": (origin, at)},
        last={"error": (error, F.when(error.isNotNull(), F.col("seq")))},
        any_of={"closed": F.col("e.closed")},
        texts={"content": F.when(touch, piece)},
    ).filter(F.col("o").isNotNull())
    given_first = F.col("o.given")
    return out.select(
        "chat_id",
        "message_id",
        F.coalesce("o.role", F.when(given_first, F.lit("user")).otherwise(F.lit(ASSISTANT))).alias("role"),
        F.when(given_first, F.coalesce("o.name", F.lit(""))).otherwise(F.lit(agent)).alias("name"),
        "content",
        F.col("o.step").alias("step"),
        (~F.col("closed")).alias("in_progress"),
        "error",
        F.col("o.ts").alias("created_at"),
        F.col("o.seq").alias("created_seq"),
    )


def assemble_tool_calls(resolved: DataFrame) -> DataFrame:
    """Tool calls from resolved events: joined arguments, last result, first name."""
    here = F.struct(F.col("target_id").alias("message_id"), F.col("tool_id").alias("tool_id"))
    used = F.col("tool_id").isNotNull()
    moved = used & ~here.eqNullSafe(F.col("active_tool"))
    rows = _touched_and_closed(
        resolved.filter(used | _is(*RUN_ENDS)), here, used, _is("TOOL_CALL_END"), F.col("active_tool"), _is(*RUN_ENDS) | moved
    ).select(
        "chat_id", "seq", "ts", "type", "name", "delta", "content", "error_code", "error_message", "e",
        F.col("e.key.message_id").alias("message_id"), F.col("e.key.tool_id").alias("tool_call_id"),
    )
    touch = F.col("e.touch")
    at, error = F.when(touch, F.col("seq")), F.when(~touch, _error())
    named = F.when(_is("TOOL_CALL_START", "TOOL_CALL_CHUNK"), F.col("name"))
    origin = F.struct(named.alias("name"), F.col("ts").alias("ts"), F.col("seq").alias("seq"))
    out = fold_ordered(
        rows,
        ["chat_id", "message_id", "tool_call_id"],
        "seq",
        first={"o": (origin, at)},
        last={
            "result": (F.col("content"), F.when(touch & _is("TOOL_CALL_RESULT"), F.col("seq"))),
            "error": (error, F.when(error.isNotNull(), F.col("seq"))),
        },
        any_of={"closed": F.col("e.closed")},
        texts={"arguments": F.when(touch & _is("TOOL_CALL_ARGS", "TOOL_CALL_CHUNK"), F.col("delta"))},
    ).filter(F.col("o").isNotNull())
    return out.select(
        "chat_id",
        "message_id",
        "tool_call_id",
        F.coalesce("o.name", F.lit(UNKNOWN_TOOL)).alias("name"),
        "arguments",
        F.coalesce("result", F.lit("")).alias("content"),
        (~F.col("closed")).alias("in_progress"),
        "error",
        F.col("o.ts").alias("created_at"),
        F.col("o.seq").alias("created_seq"),
    )


def assemble_reasonings(resolved: DataFrame) -> DataFrame:
    """Reasoning blocks from resolved events, numbered by the event that opens them."""
    here = F.struct(F.col("target_id").alias("message_id"), F.col("block").alias("block"))
    used = F.col("block").isNotNull()
    ends = _is("THINKING_END", *RUN_ENDS)
    rows = _touched_and_closed(
        resolved.filter(used | ends), here, used, _is("THINKING_TEXT_MESSAGE_END"), F.col("open_block"), ends
    ).select(
        "chat_id", "seq", "ts", "type", "title", "delta", "delta_list", "error_code", "error_message", "e",
        F.col("e.key.message_id").alias("message_id"), F.col("e.key.block").alias("block"),
    )
    touch = F.col("e.touch")
    at, error = F.when(touch, F.col("seq")), F.when(~touch, _error())
    quoted = F.transform("delta_list", lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    listed = F.concat(F.lit("\n["), F.array_join(quoted, ", "), F.lit("]"))
    piece = F.when(touch & _is("THINKING_TEXT_MESSAGE_CONTENT"), F.coalesce("delta", listed))
    out = fold_ordered(
        rows,
        ["chat_id", "message_id", "block"],
        "seq",
        first={"o": (F.struct(F.col("title").alias("title"), F.col("ts").alias("ts")), at)},
        last={"error": (error, F.when(error.isNotNull(), F.col("seq")))},
        any_of={"closed": F.col("e.closed")},
        texts={"content": piece},
    ).filter(F.col("o").isNotNull())
    return out.select(
        "chat_id",
        "message_id",
        "block",
        F.coalesce("o.title", F.lit("")).alias("name"),
        "content",
        (~F.col("closed")).alias("in_progress"),
        "error",
        F.col("o.ts").alias("created_at"),
    )


def fold_messages(events: DataFrame, agent: str = "agent") -> DataFrame:
    return assemble_messages(resolve_events(events), agent)


def fold_tool_calls(events: DataFrame) -> DataFrame:
    return assemble_tool_calls(resolve_events(events))


def fold_reasonings(events: DataFrame) -> DataFrame:
    return assemble_reasonings(resolve_events(events))


def unclosed_chats(messages: DataFrame) -> DataFrame:
    """Chats with a message that no event closed, and how many."""
    return messages.filter("in_progress").groupBy("chat_id").agg(F.count(F.lit(1)).alias("open_messages"))


def active_id(events: DataFrame, keys: Sequence[str], seq: str, id_col: str, out: str = "active_id") -> DataFrame:
    """Last known id at each row: rows without one belong to the id before them."""
    return carry_forward(events, keys, seq, {out: id_col})


def dedup_messages(incoming: DataFrame, stored: DataFrame | None = None, keys: Sequence[str] = ("chat_id", "message_id")) -> DataFrame:
    """Mark each incoming message: accepted, duplicate, or rejected with an error.

    New messages come from users only. The first user message of an id is accepted, in the order of ``seq`` and then of
    all other columns; a stored one comes before all. Messages of others under an id are rejected while no user message
    of that id came before them, and duplicates after it. Of rows that agree in everything one is accepted.
    """
    keys = list(keys)
    rest = sorted(c for c in incoming.columns if c not in (*keys, "seq"))
    place = F.struct("seq", *rest)
    # Equal rows become one row with a number, so that a tie has one winner without a window over the id.
    rows = incoming.groupBy(*incoming.columns).agg(F.count(F.lit(1)).alias("__copies"))
    first = rows.groupBy(*keys).agg(F.min(F.when(F.col("role") == "user", place)).alias("__first"))
    rows = rows.join(first, keys)
    known = F.lit(False)
    if stored is not None:
        rows = rows.join(stored.select(*keys, F.lit(True).alias("__known")).distinct(), keys, "left")
        known = F.coalesce("__known", F.lit(False))
    rows = rows.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    wins = (F.col("role") == "user") & place.eqNullSafe(F.col("__first")) & (F.col("__nth") == 1)
    status = (
        F.when(known, "duplicate")
        .when(wins, "accepted")
        .when((F.coalesce("role", F.lit("")) != "user") & (F.col("__first").isNull() | (place < F.col("__first"))), "rejected")
        .otherwise("duplicate")
    )
    error = F.when(F.col("status") == "rejected", F.lit(NOT_A_USER))
    marked = rows.withColumn("status", status).withColumn("error", error)
    return marked.select(*incoming.columns, "status", "error")


def chat_list(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Every chat with its update time: its latest message, or its own creation without one."""
    latest = messages.groupBy("chat_id").agg(F.max("created_at").alias("__latest"))
    return chats.join(latest, "chat_id", "left").withColumn(
        "update_time", F.coalesce("__latest", "created_at")
    ).drop("__latest")


def chat_detail(chats: DataFrame, messages: DataFrame, chat_id) -> DataFrame:
    """The messages of one chat in order, each with the chat's update time.

    Both inputs are cut to the chat before the join, so the filter reaches both scans.
    """
    own = F.col("chat_id") == F.lit(chat_id)
    mine = messages.filter(own)
    return chat_list(chats.filter(own), mine).select("chat_id", "update_time").join(mine, "chat_id").orderBy(
        "created_at", "message_id"
    )


def transcript(messages: DataFrame, tools: DataFrame, reasonings: DataFrame) -> DataFrame:
    """Messages, tool results and reasonings as one list; sort it with ``transcript_order``.

    Inputs carry ``message_uuid``; an item without a public id is shown under its ``uuid``.
    """
    head = messages.select("message_uuid", F.col("created_at").alias("message_ts"), F.col("chat_id").alias("__chat"))
    text = messages.select(
        "chat_id", F.col("created_at").alias("message_ts"), F.col("message_uuid").alias("message_id"),
        F.lit(0).alias("kind"), F.lit(None).cast(messages.schema["created_at"].dataType).alias("child_ts"),
        F.coalesce("public_id", "message_uuid").alias("id"), "role", "name", "content",
        F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("arguments"),
        "in_progress", "error",
    )

    def children(df: DataFrame, kind: int, id_: Column, role: str, content: Column, call: Column, args: Column):
        return df.join(head, "message_uuid").select(
            F.col("__chat").alias("chat_id"), "message_ts", F.col("message_uuid").alias("message_id"),
            F.lit(kind).alias("kind"), F.col("created_at").alias("child_ts"), id_.alias("id"),
            F.lit(role).alias("role"), "name", content.alias("content"), call.alias("tool_call_id"),
            args.alias("arguments"), "in_progress", "error",
        )

    shown = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(
        F.concat(F.lit("Completed "), F.col("name"))
    )
    calls = children(
        tools, 1, F.coalesce("tool_call_id", "uuid"), "tool", shown, F.coalesce("public_id", "uuid"), F.col("arguments")
    )
    none = F.lit(None).cast("string")
    thoughts = children(reasonings, 2, F.coalesce("public_id", "uuid"), "reasoning", F.col("content"), none, none)
    return text.unionByName(calls).unionByName(thoughts)


def placed(rows: DataFrame, out: str = "place") -> DataFrame:
    """Number the rows of a transcript from 1 within each chat; messages are counted, so a long chat is no single sort.

    Rows of one message are few and are numbered together; before them come all rows of earlier messages.
    """
    at = F.struct("message_ts", "message_id")
    counted = rows.groupBy("chat_id", at.alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    counted = running_totals(counted, ["chat_id"], "__at", {"__before": "__n"}).drop("__n")
    inside = Window.partitionBy("chat_id", "__at").orderBy("kind", "child_ts", "id")
    numbered = rows.withColumn("__at", at).withColumn("__nth", F.row_number().over(inside))
    return numbered.join(counted, ["chat_id", "__at"]).withColumn(out, F.col("__before") + F.col("__nth")).drop("__at", "__nth", "__before")


def attach_tool_results(history: DataFrame) -> DataFrame:
    """Tool invocations with their results, beside all rows that are neither.

    ``history`` has ``chat_id, id, role, content, tool_calls array<struct<id,name,arguments>>``. A tool
    row whose id is that of a call becomes the call's result; one without a call stays a row. Of several
    results of one call the last counts, by ``created_at`` or ``seq`` where there is one and then by content.
    """
    calls = history.filter(F.size("tool_calls") > 0).select(
        "chat_id", F.col("id").alias("message_id"), "role", F.explode("tool_calls").alias("call")
    )
    results = history.filter((F.col("role") == "tool") & (F.coalesce("content", F.lit("")) != "")).select(
        "chat_id", F.col("id").alias("__call"), F.struct(*[c for c in ("created_at", "seq") if c in history.columns], "content").alias("__result")
    )
    results = results.groupBy("chat_id", "__call").agg(F.max("__result")["content"].alias("result"))
    invoked = calls.withColumn("__call", F.col("call.id")).join(results, ["chat_id", "__call"], "left").select(
        "chat_id",
        "message_id",
        "role",
        F.lit("tool-invocation").alias("part"),
        F.col("__call").alias("tool_call_id"),
        F.col("call.name").alias("tool_name"),
        F.col("call.arguments").alias("arguments"),
        F.try_parse_json("call.arguments").isNotNull().alias("arguments_are_json"),
        F.when(F.col("result").isNotNull(), "result").otherwise("call").alias("state"),
        F.col("result").alias("text"),
    )
    called = calls.select("chat_id", F.col("call.id").alias("id"), F.lit("tool").alias("role")).distinct()
    rest = history.filter(F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0).join(called, ["chat_id", "id", "role"], "left_anti")
    none = F.lit(None).cast("string")
    plain = rest.select(
        "chat_id", F.col("id").alias("message_id"), "role", F.lit("text").alias("part"), none.alias("tool_call_id"),
        none.alias("tool_name"), none.alias("arguments"), F.lit(None).cast("boolean").alias("arguments_are_json"),
        none.alias("state"), F.col("content").alias("text"),
    )
    return invoked.unionByName(plain)


def delete_chats(ids: DataFrame, chats: DataFrame, messages: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table when chats go: their messages and the messages' children go too."""
    gone = ids.select("chat_id").distinct()
    lost = messages.join(gone, "chat_id", "left_semi").select("message_uuid")
    left = {"chats": chats.join(gone, "chat_id", "left_anti"), "messages": messages.join(gone, "chat_id", "left_anti")}
    for name, df in children.items():
        left[name] = df.join(lost, "message_uuid", "left_anti")
    return left


def apply_partial(base: DataFrame, updates: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Overwrite the fields that an update sets; NULL leaves the old value. One update per key."""
    keys = [key] if isinstance(key, str) else list(key)
    fields = [c for c in updates.columns if c not in keys]
    side = updates.select(*keys, *[F.col(c).alias(f"__u_{c}") for c in fields])
    return base.join(side, keys, "left").select(
        *[F.coalesce(F.col(f"__u_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def upsert_identities(
    base: DataFrame,
    updates: DataFrame,
    key: Sequence[str] = ("provider_user_id", "provider_type"),
    seq: str = "seq",
) -> DataFrame:
    """Insert or update by key. Of several updates, the last non-NULL value of each field counts.

    The updates are reduced to one row per key by an aggregate, so a key with very many of them is
    combined before the shuffle.
    """
    keys = list(key)
    fields = [c for c in base.columns if c not in keys]
    given = [c for c in fields if c in updates.columns]
    latest = updates.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__u_{c}") for c in given]
    )
    return base.join(latest, keys, "full_outer").select(
        *[
            F.col(c) if c not in given else F.coalesce(F.col(f"__u_{c}"), F.col(c)).alias(c)
            for c in base.columns
        ]
    )


def identity_by_external(identities: DataFrame, provider_type: str, provider_user_id: str) -> DataFrame:
    return identities.filter(
        (F.col("provider_type") == provider_type) & (F.col("provider_user_id") == provider_user_id)
    )


def expired_tokens(identities: DataFrame, now: Column, leeway_s: int = 60) -> DataFrame:
    from larder.functions.scalars import is_expired

    return identities.filter(is_expired("access_token_expires_at", now, leeway_s))


# The fields of stored message documents.
_CHILD = "uuid string, agui_id string, role string, name string, content string, in_progress boolean, error string, created_at string"
PAYLOAD_SCHEMA = (
    "v int, message_uuid string, chat_id string, agui_id string, role string, name string, content string, "
    "step string, in_progress boolean, error string, created_at string, "
    f"tool_calls array<struct<{', '.join(f.replace(' ', ':', 1) for f in (_CHILD + ', tool_call_id string, arguments string').split(', '))}>>, "
    f"reasonings array<struct<{', '.join(f.replace(' ', ':', 1) for f in _CHILD.split(', '))}>>"
)


def decode_payloads(df: DataFrame, body: str = "body", version: int = 1) -> DataFrame:
    """Stored message documents of one version as columns, with defaults for missing fields."""

    def child(x: Column, role: str, extra: Mapping[str, Column]) -> Column:
        return F.struct(
            x["uuid"].alias("uuid"),
            x["agui_id"].alias("public_id"),
            F.coalesce(x["role"], F.lit(role)).alias("role"),
            F.coalesce(x["name"], F.lit("")).alias("name"),
            strip_placeholder(x["content"]).alias("content"),
            F.coalesce(x["in_progress"], F.lit(True)).alias("in_progress"),
            x["error"].alias("error"),
            x["created_at"].try_cast("timestamp").alias("created_at"),
            *[c.alias(n) for n, c in extra.items()],
        )

    p = df.withColumn("__p", F.from_json(body, PAYLOAD_SCHEMA)).filter(F.col("__p.v") == version)
    tools = F.transform(
        F.coalesce("__p.tool_calls", F.array()),
        lambda x: child(x, "tool", {"tool_call_id": x["tool_call_id"], "arguments": strip_placeholder(x["arguments"])}),
    )
    thoughts = F.transform(F.coalesce("__p.reasonings", F.array()), lambda x: child(x, "reasoning", {}))
    return p.select(
        F.col("__p.message_uuid").alias("message_uuid"),
        F.nullif(F.col("__p.chat_id"), F.lit("")).alias("chat_id"),
        F.col("__p.agui_id").alias("public_id"),
        F.coalesce("__p.role", F.lit("user")).alias("role"),
        F.coalesce("__p.name", F.lit("")).alias("name"),
        strip_placeholder("__p.content").alias("content"),
        F.col("__p.step").alias("step"),
        F.coalesce("__p.in_progress", F.lit(True)).alias("in_progress"),
        F.col("__p.error").alias("error"),
        F.col("__p.created_at").try_cast("timestamp").alias("created_at"),
        tools.alias("tool_calls"),
        thoughts.alias("reasonings"),
    )
