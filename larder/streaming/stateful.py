"""State functions of the two streaming jobs that need state of their own.

Both take the rows of one key in one micro-batch; the trigger bounds their number.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd

from larder.operators.conversations import CHUNKS, EVENT_FIELDS, EVENT_SCHEMA, RUN_ENDS, TEXT, THOUGHT, TOOL

ALERT_SCHEMA = (
    "location_id string, item_id string, ts timestamp, alert string, days_of_supply double, "
    "minimum_days_supply int, late boolean"
)
ALERT_STATE = "below boolean, ts timestamp"


def cross_minimum(key, batches, state):
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    below, last = state.get if state.exists else (None, None)
    out = []
    for r in rows.itertuples(index=False):
        if last is not None and r.ts < pd.Timestamp(last):
            out.append((*key, r.ts, None, r.days_of_supply, r.minimum_days_supply, True))
            continue
        now = bool(r.days_of_supply < r.minimum_days_supply)
        if now != bool(below):
            alert = "BELOW_MINIMUM" if now else "RECOVERED"
            out.append((*key, r.ts, alert, r.days_of_supply, r.minimum_days_supply, False))
        below, last = now, r.ts
    state.update((below, pd.Timestamp(last).to_pydatetime()))
    names = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]
    yield pd.DataFrame(out, columns=names).astype({"late": bool})


RESOLVED_SCHEMA = (
    EVENT_SCHEMA + ", target_id string, active_id string, tool_id string, "
    "active_tool struct<message_id:string,tool_id:string>, block bigint, "
    "open_block struct<message_id:string,block:bigint>, step string, title string, late boolean"
)
CHAT_STATE = "state string"
#: The fields that say what an event belongs to.
RESOLVING = ("type", "run_id", "seq", "name", "message_id", "role", "parent_message_id", "tool_call_id")


def _derived(kind: str, chat: str, seq: int) -> str:
    return f"{kind}-" + hashlib.sha256(f"{chat}\0{seq}".encode()).hexdigest()[:32]


def resolve_one(chat: str, state: dict, e: dict) -> dict:
    """What one event belongs to; the state moves on. Follows the batch rules event by event."""
    runs, seen = state.setdefault("runs", {}), state.setdefault("seen", {})
    kind, run_id, seq = e["type"], e["run_id"] or "", int(e["seq"])
    if kind == "RUN_STARTED":
        runs[run_id] = {}
    run = runs.setdefault(run_id, {})

    def created(id_, role, public=True):
        if id_ not in seen:
            seen[id_] = True
            state["last"] = [id_, role, public]

    out = {"active_id": run.get("active"), "active_tool": run.get("tool"), "open_block": None}
    if run.get("content_open") and kind not in THOUGHT:
        out["open_block"] = {"message_id": run.get("thought_message"), "block": run.get("block")}
    if kind == "STEP_STARTED":
        run["step"] = e["name"]
    elif kind == "STEP_FINISHED":
        run["step"] = None
    elif kind == "THINKING_START":
        run["title"] = e["name"]
    elif kind == "THINKING_END":
        run["title"] = None
        if run.get("content_open"):
            run["content_open"] = run["block_open"] = False
    elif kind == "MESSAGE":
        created(e["message_id"], e["role"] or "user")
    touched = kind in TEXT or kind in TOOL or kind in THOUGHT
    if touched:
        named = e["message_id"] if kind in TEXT else None
        if kind in ("TOOL_CALL_START", "TOOL_CALL_CHUNK"):
            named = e["parent_message_id"]
        active = run.get("active")
        if named is None and kind in CHUNKS:
            named = active if active and run.get("public", True) else _derived("new", chat, seq)
        if named is not None:
            role = e["role"] if kind == "TEXT_MESSAGE_START" and e["role"] else "assistant"
            created(named, role)
            run["active"], run["public"] = named, True
        elif not active:
            last = state.get("last")
            if last and last[1] == "assistant":
                run["active"], run["public"] = last[0], last[2]
            else:
                id_ = _derived("implicit", chat, state.get("last_seq", -1))
                created(id_, "assistant", public=False)
                run["active"], run["public"] = id_, False
        out["target_id"] = run["active"]
    if state.get("last") and state["last"][0] != state.get("last_id") and state["last"][2]:
        state["last_id"], state["last_seq"] = state["last"][0], seq
    if kind in TOOL:
        tool = e["tool_call_id"] or (run.get("tool") or {}).get("tool_id") or _derived("tool", chat, seq)
        run["tool"] = {"message_id": run["active"], "tool_id": tool}
        out["tool_id"] = tool
    if kind in THOUGHT:
        if kind == "THINKING_TEXT_MESSAGE_START" or not run.get("block_open"):
            run["block"] = seq
        run["block_open"] = kind != "THINKING_TEXT_MESSAGE_END"
        run["content_open"] = kind == "THINKING_TEXT_MESSAGE_CONTENT"
        run["thought_message"] = run["active"]
        out["block"] = run["block"]
    out["step"], out["title"] = run.get("step"), run.get("title")
    if kind in RUN_ENDS:
        run["ended"] = True
    return out


def make_resolver(idle_seconds: int, keep_seconds: int):
    """State function of a chat. Idle runs are closed; the state goes when nothing came for longer still."""
    names = list(EVENT_FIELDS)
    extra = ["target_id", "active_id", "tool_id", "active_tool", "block", "open_block", "step", "title"]

    def rows_of(columns, resolved):
        added = {x: [r.get(x) for r in resolved] for x in extra}
        numbers = {x: pd.array(v, "Int64") for x, v in (("seq", columns["seq"]), ("block", added["block"]))}
        return pd.DataFrame({**columns, **added, **numbers, "late": [bool(r.get("late")) for r in resolved]})

    def recalled(state):
        memory = json.loads(state.get[0]) if state.exists else {}
        return {**memory, "seen": dict.fromkeys(memory.get("seen", []))}

    def stored(memory):
        return (json.dumps({**memory, "seen": list(memory["seen"])}),)

    def shifted(memory, number):
        """An event's number after the closing events that were put before it, each of which has a number of its own."""
        return number + sum(n for at, n in memory.get("shifts", []) if at < number)

    def resolve(key, batches, state):
        (chat,) = key
        memory = recalled(state)
        if state.hasTimedOut and memory.get("closed"):
            state.remove()
            return
        if state.hasTimedOut:
            open_runs = {r: s for r, s in memory.get("runs", {}).items() if s.get("active") and not s.get("ended")}
            closed = []
            for nth, run_id in enumerate(sorted(open_runs), 1):
                e = dict.fromkeys(names)
                e.update(chat_id=chat, run_id=run_id, seq=shifted(memory, memory["seq"]) + nth, type="RUN_FINISHED")
                e["ts"] = pd.Timestamp(memory["ts"], unit="us")
                closed.append((e, resolve_one(chat, memory, e)))
            if closed:
                memory.setdefault("shifts", []).append([memory["seq"], len(closed)])
            memory["idle"] = sorted(set(memory.get("idle", [])) | set(open_runs))
            memory["runs"], memory["closed"] = {}, True
            state.update(stored(memory))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_seconds * 1000)
            if closed:
                events, resolved = zip(*closed)
                yield rows_of({n: [e[n] for e in events] for n in names}, resolved)
            return
        parts = list(batches)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
        if not pdf["seq"].is_monotonic_increasing:
            pdf = pdf.sort_values("seq", kind="stable")
        memory.pop("closed", None)
        idle, numbers, resolved = set(memory.get("idle", [])), [], []
        # A missing value is None, never NaN, which differs from itself.
        for values in zip(*([v if v == v else None for v in pdf[n].tolist()] for n in RESOLVING)):
            e = dict(zip(RESOLVING, values))
            late, number = e["run_id"] in idle, int(e["seq"])
            if not late:
                e["seq"] = shifted(memory, number)
            numbers.append(e["seq"])
            resolved.append({"late": True} if late else resolve_one(chat, memory, e))
        memory["seq"] = max(memory.get("seq", -1), int(pdf["seq"].iloc[-1]))
        for name, column in (("ts", "ts"), ("at", "arrived")):
            memory[name] = max(memory.get(name, 0), pd.Timestamp(pdf[column].max()).value // 1000)
        state.update(stored(memory))
        timeout = max(memory["at"] // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(timeout)
        yield rows_of({**{n: pdf[n].array for n in names}, "seq": numbers}, resolved)

    return resolve
