"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn is written as <s>role<r>text</s>. The control strings <s>, <r>, </s>, [INST] and [/INST] inside roles and texts get a
backslash after their first character, and backslashes are doubled, so a text can be read back whatever it holds.

Prefix sums of the turns' tokens choose turn-aligned spans: a window opens with the conversation's system turn and as many of the last
`history` tokens of turns before its span as leave room for its first turn, then takes new turns while the budget lasts. A window is within
the budget wherever its first turn and the system turn are; where they aren't, it holds just those two. The loss mask covers the texts of the
assistant turns of the span; turns repeated as history are masked out, so each assistant text is a target once.

Tokens are an expression over a row's columns, for instance a column that `token_counts.count_tokens` has filled; without one they
are estimated as 4 characters a token and 4 for the marks.

Null roles and texts are empty strings; null turns sort first; rows with equal conv_id and turn are taken in order of role and text (equal rows
one after the other); a null conv_id is a conversation of its own; a conversation whose turns are all empty has windows of marks alone; very long texts are windows
of their own; an empty table gives an empty result; only conv_id, turn, role, text and what `tokens` names are read. A conversation is one row,
as its digest needs the whole of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, PART, CLOSE = "<s>", "<r>", "</s>"
_CONTROL = r"\\|<(?=/?s>|r>)|\[(?=/?INST\])"
BUDGET, HISTORY = 1024, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(\\|<|\[)\\", "$1")


def formatted(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(PART), escape(turn["text"]), F.lit(CLOSE))


_WINDOW = "struct<formatted:string,loss:array<struct<start:int,length:int>>,repeated:int,tokens:int>"
_PART = "struct<s:string,n:int,after:int>"


def _as(kind: str, **fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items())).cast(kind)


def estimated_tokens() -> Column:
    return F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("int") + 4


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """conv_id, window int, formatted string, loss array<struct<start int, length int>> (characters from 0), repeated int (turns masked out as history), tokens int.

    One pass over a conversation's turns keeps the window that is open and the last `history` tokens of turns, so the work is in proportion to the turns."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    tokens = estimated_tokens() if tokens is None else F.coalesce(tokens, F.lit(0)).cast("int")
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), tokens.alias("n")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), formatted(x).alias("s"), F.length(escape(x["text"])).alias("size"), x["n"].alias("n")))
    system = F.get(F.filter(parts, lambda x: x["role"] == "system"), F.lit(0))
    state = f"struct<system:{_PART},passed:int,total:int,done:array<{_WINDOW}>,open:{_WINDOW},recent:array<{_PART}>>"
    first = _as(state, system=F.when(system.isNotNull(), _as(_PART, s=system["s"], n=system["n"], after=F.lit(0))), passed=F.lit(None), total=F.lit(0), done=F.array(), open=F.lit(None), recent=F.array())

    def step(z: Column, x: Column) -> Column:
        o = z["open"]
        opens = o.isNull() | (o["tokens"] + x["n"] > budget)
        start = z["total"]
        since = lambda r: start - (r["after"] - r["n"])  # noqa: E731  tokens from that turn up to here
        near = F.filter(z["recent"], lambda r: since(r) <= budget - x["n"])
        away = z["passed"].isNotNull() & ~F.exists(near, lambda r: r["after"] - r["n"] == z["passed"])
        beside = F.filter(z["recent"], lambda r: since(r) <= budget - x["n"] - z["system"]["n"])
        repeated = F.when(away, F.concat(F.array(z["system"]), beside)).otherwise(near)
        before = F.when(opens, F.array_join(F.transform(repeated, lambda r: r["s"]), "")).otherwise(o["formatted"])
        used = F.when(opens, F.aggregate(repeated, F.lit(0), lambda n, r: n + r["n"])).otherwise(o["tokens"])
        spans = F.when(opens, F.array().cast("array<struct<start:int,length:int>>")).otherwise(o["loss"])
        span = _as("struct<start:int,length:int>", start=F.length(before) + F.length(x["s"]) - len(CLOSE) - x["size"], length=x["size"])
        now = _as(_WINDOW, formatted=F.concat(before, x["s"]), loss=F.when(x["role"] == "assistant", F.concat(spans, F.array(span))).otherwise(spans), repeated=F.when(opens, F.size(repeated)).otherwise(o["repeated"]), tokens=used + x["n"])
        total = start + x["n"]
        recent = F.filter(F.concat(z["recent"], F.array(_as(_PART, s=x["s"], n=x["n"], after=total))), lambda r: total - (r["after"] - r["n"]) <= history)
        passed = F.coalesce(z["passed"], F.when(x["role"] == "system", start))
        done = F.when(opens & o.isNotNull(), F.concat(z["done"], F.array(o))).otherwise(z["done"])
        return _as(state, system=z["system"], passed=passed, total=total, done=done, open=now, recent=recent)

    made = F.aggregate(parts, first, step, lambda z: F.concat(z["done"], F.array(z["open"])))
    return turns.select("conv_id", F.posexplode(made).alias("window", "w")).select("conv_id", "window", "w.*")


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the windows' strings and masks."""
    f = F.col("formatted")
    turns = F.transform(F.filter(F.split(f, CLOSE), lambda x: x != ""), lambda x: F.concat(unescape(F.substring_index(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), PART, 1)), F.lit("\n"), unescape(F.substring_index(x, PART, -1)), F.lit("\n")))
    new = F.slice(turns, F.col("repeated") + 1, F.size(turns))
    loss = F.array_join(F.transform("loss", lambda x: unescape(F.substring(f, x["start"] + 1, x["length"]))), "")
    rows = formatted_windows.select("conv_id", F.struct("window", F.array_join(new, "").alias("turns"), F.size(new).alias("n"), loss.alias("loss"), F.length(f).alias("chars")).alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("w", lambda x: x[field]), "")

    def summed(field: str) -> Column:
        return F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[field])

    return whole.select("conv_id", summed("n").alias("n_turns"), F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), summed("chars").alias("formatted_chars"))
