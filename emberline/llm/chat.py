"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by turn (ties: role, then text; null turns first).
Neighbours of one role are merged: the texts of each run are aggregated as an array and joined into one block.
Layout of a block:

    <turn ROLE>\\n TEXT [\\n<next>\\n TEXT ...] \\n</turn>\\n

A backslash stands before each backslash of a text and before each "<" of a text that would begin one of these marks,
so a mark never occurs inside a text and the text can be had back exactly. In a role "\\", "<" and ">" are written as
"\\\\", "\\l" and "\\g", so that the first ">" ends it, however long it is.

The loss mask is a list of spans, one for each turn of the loss role. Positions are summed in groups of GROUP turns,
the groups' totals after that, so no step walks over all turns before it.

Null texts and roles count as empty; a null conversation is one of its own. Repeated rows are turns of their own. An
empty table gives no rows. Other columns are not read, whatever their names. A conversation is one output value, so its
turns meet in one task and a value of Spark bounds it (2 GB); they are escaped before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEXT, END = "\n<next>\n", "\n</turn>\n"
GROUP = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|<(?=turn |next>|/turn>)", r"\\$0")


def escape_role(role: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are taken first, from the left; what is between them holds only the two letters."""
    plain = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), plain), "\\")


def _groups(array: Column) -> Column:
    """array in slices of GROUP members; none for an empty one."""
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(GROUP))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(array, k, F.lit(GROUP)))


def _spans(parts: Column) -> Column:
    """Start and length of the texts of the loss role; parts: array of (before, length, loss), before: other characters."""
    groups = _groups(parts)
    totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda s, p: s + p["before"] + p["length"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
    offsets = F.aggregate(totals, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list")))["list"]
    none = F.array().cast("array<struct<start:int,length:int>>")

    def walk(g: Column, k: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            at = s["at"] + p["before"]
            more = F.concat(s["spans"], F.array(F.struct(at.alias("start"), p["length"].alias("length"))))
            return F.struct((at + p["length"]).alias("at"), F.when(p["loss"], more).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(g, F.struct(F.get(offsets, k).alias("at"), none.alias("spans")), step)["spans"]

    return F.flatten(F.transform(groups, walk))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_blocks, and loss_spans: array of start (from 0) and length, in code points of formatted."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), raw.alias("raw"), escape(raw).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    place = F.sequence(F.lit(1), F.size("turns"))
    differs = lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])
    chats = chats.withColumn("starts", F.filter(place, lambda i: F.coalesce(differs(i), F.lit(True))))
    run = lambda s, k: F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s)
    block = lambda r: F.struct(r[0]["role"].alias("role"), F.transform(r, lambda t: t["text"]).alias("texts"))
    chats = chats.select("conv_id", F.transform(F.transform("starts", run), block).alias("blocks"))
    head = lambda b: F.concat(F.lit("<turn "), escape_role(b["role"]), F.lit(">\n"))

    def parts(b: Column, k: Column) -> Column:
        opening = F.length(head(b)) + F.when(k > 0, len(END)).otherwise(0)
        return F.transform(b["texts"], lambda x, i: F.struct(F.when(i == 0, opening).otherwise(len(NEXT)).alias("before"), F.length(x).alias("length"), (b["role"] == loss_role).alias("loss")))

    return chats.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(END))), "").alias("formatted"),
        F.size("blocks").alias("n_blocks"),
        _spans(F.flatten(F.transform("blocks", parts))).alias("loss_spans"),
    )


def read_chats(df: DataFrame) -> DataFrame:
    """Adds turns (array of role and text) and loss_text, both read from formatted and loss_spans alone."""
    blocks = F.filter(F.split("formatted", r"\n</turn>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        coded = F.substring_index(b, ">", 1)  # "<turn " and the role
        role = unescape_role(F.substr(coded, F.lit(len("<turn ") + 1)))
        body = F.substr(b, F.length(coded) + len(">\n") + 1)
        return F.transform(F.split(body, r"\n<next>\n", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    def texts(g: Column) -> Column:
        """Of a group of spans, cut from the stretch that holds them."""
        base, last = g[0]["start"], F.element_at(g, -1)
        stretch = F.substr("formatted", base + 1, last["start"] + last["length"] - base)
        return F.transform(g, lambda s: unescape(F.substr(stretch, s["start"] - base + 1, s["length"])))

    return df.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": F.array_join(F.flatten(F.transform(_groups(F.col("loss_spans")), texts)), "")})
