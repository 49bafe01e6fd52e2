"""Chats: message normalisation, tool calls, history truncation, evaluation positions.

Rows with plain role/content messages stay in JVM expressions. Free-form JSON
messages (tool calls, parts) are parsed in one Arrow map over their text.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.answers import balanced
from framewright.operators.records import map_records

#: Speakers of share-style turns.
ROLES = {"system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "chatgpt": "assistant", "model": "assistant", "bot": "assistant"}

#: Speakers of agents' share-style turns.
AGENT_ROLES = {
    "system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant",
    "function_call": "tool_call", "tool_call": "tool_call", "observation": "tool_response", "tool_response": "tool_response", "tool": "tool_response",
}


def role_of(c: Column) -> Column:
    """The chat role of a speaker; an unknown one is an error."""
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(c, F.lit("null")))))


def from_turns(turns: Column, who: str = "from", said: str = "value") -> Column:
    """array<struct<from, value>> -> array<struct<role, content>>."""
    return F.transform(turns, lambda t: F.struct(role_of(t[who]).alias("role"), F.coalesce(t[said], F.lit("")).alias("content")))


def checked(messages: Column) -> Column:
    """Null contents are empty; a role that no chat has is an error."""
    bad = lambda m: F.when(m["role"].isin("system", "user", "assistant", "tool"), m["role"]).otherwise(F.raise_error(F.concat(F.lit("unsupported role: "), F.coalesce(m["role"], F.lit("null")))))
    return F.transform(messages, lambda m: F.struct(bad(m).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def gathered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, messages): message rows as one ordered array a conversation."""
    m = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(conv).agg(m.alias("__m")).select(conv, F.transform("__m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _content(v) -> str:
    if isinstance(v, list):
        return " ".join(str(p["text"]) for p in v if isinstance(p, dict) and "text" in p)
    return "" if v is None else str(v)


def normalise_messages(messages: list[dict]) -> list[dict]:
    """OpenAI-style messages: text contents, tool calls with id, type and JSON arguments; what can't be right is an error."""
    out = []
    for m in messages:
        role = m.get("role")
        if role not in ("system", "user", "assistant", "tool"):
            raise ValueError(f"unsupported role: {role}")
        n = m | {"content": _content(m.get("content"))}
        if role == "assistant" and "reasoning_content" in m:
            if not isinstance(m["reasoning_content"], (str, type(None))):
                raise ValueError("reasoning_content isn't a string")
            n["reasoning_content"] = m["reasoning_content"] or ""
        if role == "assistant" and "tool_calls" in m:
            n["tool_calls"] = [_call(c, i) for i, c in enumerate(_listed(m["tool_calls"], "tool_calls"))]
        if role == "tool" and not (isinstance(m.get("tool_call_id"), str) and m["tool_call_id"]):
            raise ValueError("a tool message has no tool_call_id")
        out.append(n)
    return out


def _listed(v, name: str) -> list:
    if not isinstance(v, list):
        raise ValueError(f"{name} isn't a list")
    return v


def _call(c: dict, i: int) -> dict:
    f = c.get("function") if isinstance(c, dict) else None
    if not isinstance(f, dict) or not isinstance(f.get("name"), str) or not f["name"] or f.get("arguments") is None:
        raise ValueError(f"tool call {i} has no function with name and arguments")
    for k in ("id", "type"):
        if c.get(k) is not None and not isinstance(c[k], str):
            raise ValueError(f"tool call {i}: {k} isn't a string")
    args = f["arguments"] if isinstance(f["arguments"], str) else json.dumps(f["arguments"])
    return c | {"id": c.get("id") or f"call_{i}", "type": c.get("type") or "function", "function": f | {"arguments": args}}


def _loaded(v):
    return json.loads(v) if isinstance(v, str) else v


def agent_messages(messages: list[dict], example: str | int | None = None, last_thought_only: bool = False) -> list[dict]:
    """Agent turns as chat messages.

    tool_call turns in a row are one assistant message (or join the text before
    them); tool responses take their ids in order; thoughts of earlier turns go
    if asked.
    """
    head = "call" if example is None else f"call_{example}"
    out: list[dict] = []
    waiting: list[str] = []
    n = k = 0
    before = None
    for m in messages:
        role = m.get("role")
        if role == "tool_call":
            call = _loaded(m.get("content") or "{}")
            if not isinstance(call.get("name"), str) or not call["name"]:
                raise ValueError("a tool call has no name")
            args = call.get("arguments", "")
            entry = {"id": f"{head}_{n}", "type": "function", "function": {"name": call["name"], "arguments": args if isinstance(args, str) else json.dumps(args, ensure_ascii=False)}}
            n += 1
            if before == "tool_call":
                out[-1]["tool_calls"].append(entry)
                waiting.append(entry["id"])
            else:
                if out and out[-1]["role"] == "assistant" and "tool_calls" not in out[-1]:
                    out[-1]["tool_calls"] = [entry]
                else:
                    out.append({"role": "assistant", "content": "", "tool_calls": [entry]})
                waiting = [entry["id"]]
        elif role in ("tool_response", "tool"):
            k = k + 1 if before in ("tool_response", "tool") else 0
            c = m.get("content", "")
            out.append({"role": "tool", "content": c if isinstance(c, str) else json.dumps(c, ensure_ascii=False), "tool_call_id": waiting[k] if k < len(waiting) else f"{head}_response_{n}_{k}"})
        elif role in ("system", "user", "assistant"):
            waiting = []
            c = m.get("content", "")
            t = {"role": role, "content": c if isinstance(c, str) else "" if c is None else str(c)}
            if role == "assistant" and m.get("reasoning_content"):
                t["reasoning_content"] = str(m["reasoning_content"])
            out.append(t)
        else:
            raise ValueError(f"unsupported role: {role!r}")
        before = role
    if last_thought_only:
        last = max((i for i, m in enumerate(out) if m["role"] == "assistant"), default=-1)
        for i, m in enumerate(out):
            if i != last:
                m.pop("reasoning_content", None)
    return out


def messages_of(row: dict, roles: dict[str, str] = ROLES) -> list[dict]:
    """Messages of a row, from messages or conversations (texts are JSON); a turn's reasoning_content stays with it."""
    m = _loaded(row.get("messages"))
    if m is None:
        turns = _loaded(row.get("conversations"))
        if turns is None:
            raise ValueError("neither messages nor conversations")
        m = []
        for t in _listed(turns, "conversations"):
            who = t.get("from", t.get("role"))
            if who not in roles:
                raise ValueError(f"unknown role: {who!r}")
            thought = {k: t[k] for k in ("reasoning_content",) if t.get(k)}
            m.append({"role": roles[who], "content": t.get("value", t.get("content", ""))} | thought)
    return _listed(m, "messages")


def tools_of(v) -> list | None:
    """A list of tools, from JSON too; none if empty."""
    got = _loaded(v.strip() or None) if isinstance(v, str) else v
    if got is not None and not isinstance(got, list):
        raise ValueError("tools isn't a list")
    return got or None


def normalised(df: DataFrame, id_col: str, messages: str = "messages", tools: str | None = None) -> DataFrame:
    """(id, messages, tools, error): JSON texts in, normalised JSON texts out; a row that can't be read says why."""
    cols = [F.col(id_col).alias("id"), F.col(messages).alias("messages"), (F.col(tools) if tools else F.lit(None)).cast("string").alias("tools")]

    def one(r: dict):
        try:
            t = tools_of(r["tools"])
            yield {"id": r["id"], "messages": json.dumps(normalise_messages(messages_of(r)), ensure_ascii=False), "tools": t and json.dumps(t, ensure_ascii=False), "error": None}
        except (ValueError, AttributeError, TypeError) as e:
            yield {"id": r["id"], "messages": None, "tools": None, "error": str(e)}

    return map_records(df.select(*cols), one, f"id {dict(df.dtypes)[id_col]}, messages string, tools string, error string").withColumnRenamed("id", id_col)


def agent_positions(df: DataFrame, id_col: str, messages: str | None = "messages", tools: str | None = None, conversations: str | None = None) -> DataFrame:
    """(id, turn_index, prompt_messages, tools, gt_tool_calls): a row for each assistant message that calls tools.

    Rows come with chat messages or, where those are null, with share-style turns (conversations).
    """
    named = {"messages": messages, "conversations": conversations, "tools": tools}
    cols = [F.col(id_col).alias("id"), *[(F.col(c) if c else F.lit(None)).cast("string").alias(n) for n, c in named.items()]]

    def args(v):
        try:
            got = json.loads(v) if v else {}
        except ValueError:
            got = {}
        return got

    def one(r: dict):
        m = agent_messages(messages_of(r, AGENT_ROLES), r["id"])
        t = tools_of(r["tools"])
        calls = [i for i, x in enumerate(m) if x.get("tool_calls")]
        for k, i in enumerate(calls):
            told = [{"name": c["function"]["name"], "arguments": args(c["function"]["arguments"])} for c in m[i]["tool_calls"]]
            yield {"id": r["id"], "turn_index": k, "prompt_messages": json.dumps(m[:i], ensure_ascii=False), "tools": t and json.dumps(t, ensure_ascii=False), "gt_tool_calls": json.dumps(told, ensure_ascii=False)}

    return map_records(df.select(*cols), one, f"id {dict(df.dtypes)[id_col]}, turn_index int, prompt_messages string, tools string, gt_tool_calls string").withColumnRenamed("id", id_col)


def assistant_positions(df: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """(conv, turn, prefix): every assistant turn with the number of messages before it."""
    w = Window.partitionBy(conv).orderBy(turn)
    return df.withColumn("prefix", (F.row_number().over(w) - 1).cast("long")).where(F.col(role) == "assistant").select(conv, turn, "prefix")


def truncated(df: DataFrame, conv: str, turn: str, role: str, cost: Column, budget: int) -> DataFrame:
    """df with `kept`: system messages and the largest run of last exchanges whose cost fits; at least the last exchange.

    An exchange starts at a user message. What fits whole stays whole, and a
    conversation without user messages too. One window by conversation.
    """
    w = Window.partitionBy(conv)
    up = w.orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.col(turn).desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__c", cost).withColumn("__other", F.max((F.col(role) != "system").cast("int")).over(up))
    d = d.withColumn("__sys", F.col("__other") == 0).withColumn("__user", F.col(role) == "user")
    d = d.withColumn("__fixed", F.sum(F.when(F.col("__sys"), F.col("__c")).otherwise(0)).over(w)).withColumn("__all", F.sum("__c").over(w))
    d = d.withColumn("__tail", F.sum(F.when(~F.col("__sys"), F.col("__c")).otherwise(0)).over(down))
    fits = F.col("__user") & (F.col("__fixed") + F.col("__tail") <= budget)
    d = d.withColumn("__cut", F.min(F.when(fits, F.col(turn))).over(w)).withColumn("__last", F.max(F.when(F.col("__user"), F.col(turn))).over(w))
    start = F.coalesce("__cut", "__last")
    kept = F.col("__sys") | (F.col("__all") <= budget) | start.isNull() | (F.col(turn) >= start)
    return d.withColumn("kept", kept).drop("__c", "__other", "__sys", "__user", "__fixed", "__all", "__tail", "__cut", "__last")


def question_answers(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, question, answer): a user message and the assistant message right after it."""
    w = Window.partitionBy(conv).orderBy(turn)
    d = df.withColumn("__r", F.lead(role).over(w)).withColumn("__t", F.lead(text).over(w))
    return d.where((F.col(role) == "user") & (F.col("__r") == "assistant")).select(conv, turn, F.col(text).alias("question"), F.col("__t").alias("answer"))


def mapped_columns(df: DataFrame, columns: dict[str, str], answer: str = "answer") -> DataFrame:
    """Renamed columns (new -> old) of the rows whose answer isn't blank; a missing source column is an error."""
    if answer not in columns or len(columns) not in (2, 3):
        raise ValueError("two or three columns, one of them the answer")
    if missing := [c for c in columns.values() if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(o).alias(n) for n, o in columns.items()]).where(F.trim(F.coalesce(F.col(answer).cast("string"), F.lit(""))) != "")


def usable(df: DataFrame, ids: str = "input_ids", labels: str = "labels", ignore: int = -100) -> DataFrame:
    """Rows with equally long columns and at least one label that counts."""
    return df.where((F.size(ids) == F.size(labels)) & F.exists(labels, lambda x: x != ignore))


# ---- tool calls ----------------------------------------------------------------------------------------


def _made(obj, raw: str) -> dict | None:
    if not isinstance(obj, dict) or not isinstance(obj.get("name"), str) or not obj["name"]:
        return None
    args, ok = _arguments(obj.get("arguments", obj.get("parameters", {})))
    return {"name": obj["name"], "arguments": args, "valid": ok, "raw": raw}


def _arguments(v) -> tuple[dict, bool]:
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return {}, False
    return (v, True) if isinstance(v, dict) else ({}, False)


def _after(text: str, pattern: str, opener: str, closer: str):
    """(match, body) for anchors that a balanced part follows at once."""
    for m in re.finditer(pattern, text):
        if text[m.end() : m.end() + 1] == opener:
            part = next(balanced(text[m.end() :], opener, closer), None)
            if part and part[0] == 0:
                yield m, text[m.end() : m.end() + part[1]]


def _try(body: str):
    try:
        return json.loads(body), True
    except ValueError:
        return None, False


def tool_calls(text: str | None) -> list[dict]:
    """Calls (name, arguments, valid, raw) in the first of five dialects that is found.

    Channel messages; tags; a python tag; a bracketed list after [TOOL_CALLS];
    else any JSON object with a name.
    """
    text = text or ""
    found = []
    for m, body in _after(text, r"<\|channel\|>\s*commentary\s+to=functions\.([\w\-]+)[^<]*<\|message\|>\s*", "{", "}"):
        args, ok = _arguments(body)
        found.append({"name": m[1], "arguments": args, "valid": ok, "raw": m[0] + body})
    if found:
        return found
    broken = lambda raw: {"name": None, "arguments": {}, "valid": False, "raw": raw}
    for m in re.finditer(r"<tool_call>\s*(.+?)\s*</tool_call>", text, re.S):
        got, ok = _try(m[1])
        found += [broken(m[0])] if not ok else [c for o in (got if isinstance(got, list) else [got]) if (c := _made(o, m[0]))]
    if found:
        return found
    for m, body in _after(text, r"<\|python_tag\|>\s*", "{", "}"):
        got, ok = _try(body)
        found += [broken(m[0] + body)] if not ok else [c for c in [_made(got, m[0] + body)] if c]
    if found:
        return found
    for m, body in _after(text, r"\[TOOL_CALLS\]\s*", "[", "]"):
        got, ok = _try(body)
        found += [c for o in got or [] if (c := _made(o, m[0] + body))] if ok else []
    if found:
        return found
    return [c for a, b in balanced(text) if (c := _made(_try(text[a:b])[0], text[a:b]))]


METRICS = ("has_call", "name_correct", "args_json_valid", "args_field_recall", "args_field_precision", "args_exact_match")


def call_scores(guess: list[dict], truth: list[dict]) -> dict[str, float]:
    """Six metrics, call by call in order, averaged over the true calls; missing calls count 0, extra ones not at all."""
    total = dict.fromkeys(METRICS, 0.0)
    for i, t in enumerate(truth):
        if i >= len(guess):
            break
        g, want = guess[i], _arguments(t.get("arguments", {}))[0]
        own = set(g["arguments"]) if g["valid"] else set()
        both = len(own & set(want))
        row = (1.0, g["name"] == t.get("name"), g["valid"], both / len(want) if want else not own, both / len(own) if own else not want, g["valid"] and g["arguments"] == want)
        for k, v in zip(METRICS, row):
            total[k] += float(v)
    return {k: v / len(truth) if truth else 0.0 for k, v in total.items()}


def score_calls(df: DataFrame, id_col: str, answer: str, truth: str) -> DataFrame:
    """(id, six metrics) of answers against true calls (JSON list of name and arguments)."""
    def one(r: dict):
        yield {"id": r["id"]} | call_scores(tool_calls(r["a"]), json.loads(r["t"] or "[]"))

    kind = dict(df.dtypes)[id_col]
    return map_records(df.select(F.col(id_col).alias("id"), F.col(answer).alias("a"), F.col(truth).alias("t")), one, f"id {kind}, " + ", ".join(f"{m} double" for m in METRICS)).withColumnRenamed("id", id_col)


def call_means(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("num_samples"))


#: Names of types in tool definitions and in JSON schemas.
TYPES = {"str": "string", "string": "string", "int": "integer", "integer": "integer", "float": "number", "number": "number", "bool": "boolean", "boolean": "boolean", "list": "array", "array": "array", "dict": "object", "object": "object"}


def tool_schema(tools: list[dict] | None) -> list[dict]:
    """Tool definitions as function schemas: a parameter without a default is required; tools without a name go."""
    out = []
    for t in tools or []:
        if not t.get("name"):
            continue
        given = {k: p for k, p in (t.get("parameters") or {}).items() if p is not None}
        props = {k: {"type": TYPES.get(str(p.get("type", "string")).lower(), "string"), "description": p.get("description", "")} | {x: p[x] for x in ("enum", "default") if x in p} for k, p in given.items()}
        need = [k for k, p in given.items() if "default" not in p]
        out.append({"type": "function", "function": {"name": t["name"], "description": t.get("description", ""), "parameters": {"type": "object", "properties": props} | ({"required": need} if need else {})}})
    return out


def tagged(value, sort_keys: bool = True) -> str:
    """JSON as nested tags: <s_key>..</s_key>, list entries joined by <sep/>."""
    if isinstance(value, dict):
        if set(value) == {"text_sequence"}:
            return str(value["text_sequence"])
        keys = sorted(value, reverse=True) if sort_keys else list(value)
        return "".join(f"<s_{k}>{tagged(value[k], sort_keys)}</s_{k}>" for k in keys)
    if isinstance(value, list):
        return "<sep/>".join(tagged(v, sort_keys) for v in value)
    return str(value)
