r"""Chat formatting in budgeted windows, in DataFrame operations alone.

Template: ``<|turn ROLE|>TEXT<|end|>`` for a turn that the window brings, ``<|past ROLE|>TEXT<|end|>`` for one that it
repeats as context. Inside texts and roles a backslash follows every backslash and every first character of a control
string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``; in roles also ``|>``); taking out the backslash before a
character reverses this, and no escaped text holds a control string.

Windows: a turn costs its formatted characters divided by four, rounded up. Prefix sums of these costs choose spans of
whole turns: a window takes turns while their sum stays within the budget less what the system turn and the repeated
history may take; a longer turn stands alone. Every window retains the system turn (the first, if its role is system)
and repeats the last turns before its span whose costs are at most ``history``. The loss mask holds the texts of assistant
turns where they are new and never where they are repeated, so each is learned from once.

Scale: one shuffle by conversation; a conversation is one row, as one hash over all its turns needs anyway. Windows are found by
a fold over the costs alone, with at most ``HISTORY / LEAST_COST`` steps back for each, and are slices of the turns, so
the work grows with the turns and what windows repeat of them.

Edge cases: a null text or role is empty; null conversation ids form one conversation; null turns come first, equal
turns are ordered by role and text; repeated rows are turns of their own. An empty table gives an empty result. The
columns are taken by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import let
from tessella.llm.common import settle, table

BUDGET, HISTORY = 1024, 256
#: Turns that a step of the fold takes.
FOLD = 256
CONTROL = r"[\\]|<(?=\||/?s>)|\[(?=/?INST\])"
END = "<|end|>"
#: Cost of an empty turn without a role.
LEAST_COST = len("<|turn |>" + END) // 4


def escape(text: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(text, control, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _starts(costs: Column, room: Column) -> Column:
    """First turns (from 1) of the windows: the budget's fold over costs alone, in blocks so that no array grows by each turn."""

    def place(s: Column, at: Column) -> Column:
        cost = F.element_at(costs, at)
        fits = (at > 1) & (s["used"] + cost <= room)
        return F.struct(
            (cost + F.when(fits, s["used"]).otherwise(0)).alias("used"),
            F.when(fits, s["firsts"]).otherwise(F.concat(s["firsts"], F.array(at))).alias("firsts"),
        )

    def block(s: Column, first: Column) -> Column:
        none = F.struct(s["used"].alias("used"), F.array().cast("array<int>").alias("firsts"))
        inner = F.aggregate(F.sequence(first, F.least(first + FOLD - 1, F.size(costs))), none, place)
        return let(inner, lambda x: F.struct(x["used"].alias("used"), F.concat(s["all"], F.array(x["firsts"])).alias("all")))

    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<array<int>>").alias("all"))
    return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(costs), F.lit(FOLD)), none, block)["all"])


def _repeats(costs: Column, first: Column, history: int) -> Column:
    """How many turns before ``first`` have costs of at most ``history`` together; each costs at least ``LEAST_COST``."""
    most = history // LEAST_COST
    if not most:
        return F.lit(0)
    back = F.when(first > 1, F.sequence(first - 1, F.greatest(first - most, F.lit(1)), F.lit(-1)))
    none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))

    def step(s: Column, at: Column) -> Column:
        total = s["sum"] + F.element_at(costs, at)
        return F.struct(total.alias("sum"), (s["n"] + (total <= history).cast("int")).alias("n"))

    return F.coalesce(F.aggregate(back, none, step)["n"], F.lit(0))


def spans(costs: Column, has_system: Column, budget: int, history: int) -> Column:
    """Structs (first, past, stop) of a conversation's windows: own turns from first to stop - 1, repeated ones from past.

    Every value is bound once by ``let``; a column named in a lambda would be computed anew for each element.
    """
    room = F.greatest(F.lit(budget) - history - F.when(has_system, F.element_at(costs, 1)).otherwise(0), F.lit(1))

    def of(firsts: Column) -> Column:
        stop = lambda i: F.coalesce(F.get(firsts, i + 1), F.size(costs) + 1)
        return F.transform(
            firsts, lambda f, i: F.struct(f.alias("first"), (f - _repeats(costs, f, history)).alias("past"), stop(i).alias("stop"))
        )

    return let(room, lambda r: let(_starts(costs, r), of))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows (conv_id, window, formatted, mask): mask lists the code points from start to stop that the loss covers."""
    role = escape(F.coalesce("role", F.lit("")), CONTROL + r"|\|(?=>)")
    turns = (
        conversations.select("conv_id", F.struct("turn", role.alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    cost = lambda t: F.ceil((F.length(t["role"]) + F.length(t["text"]) + len("<|turn |>" + END)) / 4).cast("int")
    piece = lambda new: lambda t: F.struct(
        F.concat(F.lit("<|turn " if new else "<|past "), t["role"], F.lit("|>")).alias("head"), t["text"].alias("text"),
        (F.lit(new) & (t["role"] == "assistant")).alias("learned"),
    )

    def whole(own: Column) -> Column:
        """The windows of a conversation, as the pieces of slices of its turns."""
        system = F.element_at(own, 1)["role"] == "system"
        part = lambda a, z, new: F.transform(F.slice(own, a, z - a), piece(new))
        head = lambda s: part(F.lit(1), F.when(system & (s["past"] > 1), 2).otherwise(1), False)
        pieces = lambda s: F.concat(head(s), part(s["past"], s["first"], False), part(s["first"], s["stop"], True))
        made = let(F.transform(own, cost), lambda costs: spans(costs, system, budget, history))
        return F.transform(made, lambda s, i: F.struct(i.alias("window"), pieces(s).alias("pieces")))

    # The pieces refer to the turns in place; a window's text is first copied when its row is written.
    found = turns.select("conv_id", F.explode(let(F.col("turns"), whole)).alias("w")).select("conv_id", "w.window", "w.pieces")
    start = lambda s, p: s["at"] + F.length(p["head"])
    stop = lambda s, p: start(s, p) + F.length(p["text"])
    mask = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask")),
        lambda s, p: F.struct(
            (stop(s, p) + len(END)).alias("at"),
            F.when(p["learned"], F.concat(s["mask"], F.array(F.struct(start(s, p).alias("start"), stop(s, p).alias("stop")))))
            .otherwise(s["mask"])
            .alias("mask"),
        ),
    )
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    return found.select("conv_id", "window", formatted.alias("formatted"), mask["mask"].alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation from its windows: the turns and the learned text, unescaped."""
    of = lambda n: F.regexp_extract_all("formatted", F.lit(r"(?s)<\|turn (.*?)\|>(.*?)<\|end\|>"), F.lit(n))
    turns = F.zip_with(of(1), of(2), lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    learned = F.array_join(
        F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["stop"] - m["start"]))), ""
    )
    all_windows = formatted.select("conv_id", F.struct("window", turns.alias("turns"), learned.alias("learned"), F.length("formatted").alias("chars")).alias("w"))
    whole = all_windows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["learned"]), "").alias("learned"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w["chars"]).alias("formatted_chars"),
        F.size("ws").alias("windows"),
    )


def op7_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    found = read_back(settle(windows(rows.union(added)), "chat-windows"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESCAPED = r"replace(replace(replace(replace(replace(replace({0}, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"
OP7_SQL = rf"""
with recursive rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
        length(replace({_ESCAPED.format("role")}, '|>', '|\>')) + length({_ESCAPED.format("text")}) + 16 as chars
    from rows
), costed as (
    select *, ceil(chars / 4.0)::int as cost from turns
), summed as (
    select *, sum(cost) over (partition by conv_id order by i) - cost as before,
        case when first_value(role) over (partition by conv_id order by i) = 'system' then 1 else 0 end as has_system,
        first_value(cost) over (partition by conv_id order by i) as first_cost
    from costed
), placed as (
    select conv_id, i, cost as used, 0 as w from summed where i = 1
    union all
    select s.conv_id, s.i, case when p.used + s.cost <= greatest({BUDGET - HISTORY} - s.has_system * s.first_cost, 1) then p.used + s.cost else s.cost end,
        case when p.used + s.cost <= greatest({BUDGET - HISTORY} - s.has_system * s.first_cost, 1) then p.w else p.w + 1 end
    from placed p join summed s on s.conv_id = p.conv_id and s.i = p.i + 1
), firsts as (
    select conv_id, w, min(i) as first from placed group by conv_id, w
), opened as (
    select f.*, s.before as first_before from firsts f join summed s on s.conv_id = f.conv_id and s.i = f.first
), repeated as (
    select s.conv_id, sum(s.chars) as chars from opened o join summed s on s.conv_id = o.conv_id and s.i < o.first
        and (o.first_before - s.before <= {HISTORY} or (s.i = 1 and s.has_system = 1))
    group by s.conv_id
), whole as (
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256, sum(chars) as chars
    from summed group by conv_id
)
select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (w.chars + coalesce(r.chars, 0))::bigint as formatted_chars
from whole w left join repeated r using (conv_id)
"""
