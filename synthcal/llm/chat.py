"""Chat formatting in budgeted windows; DataFrame functions only.

A turn is written ``<turn role>`` newline, escaped text, ``</turn>`` newline, the role URL-encoded. In texts a backslash is
doubled and one is put behind the ``<`` of ``<turn`` and ``</turn``, so neither marker occurs inside a text and
:func:`unescaped` gives back every text exactly.

Windows: prefix sums of the turns' tokens cut a conversation into spans of whole turns. A turn of at most ``long`` tokens
belongs to the span in which it starts, spans being ``stride`` tokens wide; a longer one is a span of its own. So a span
holds at most ``stride + long`` tokens, half the budget, or one turn. Every window after the first also shows the system
turn again (the first turn, if its role is ``system`` and it takes at most a quarter of the budget) and the last turns of
the span before, as far as they fit into a quarter of the budget and into what the window's own turns leave of it. A window
never exceeds ``budget`` tokens unless a single turn and the system turn alone do. Only what a window shows for the first
time and an assistant says is under the loss mask; repeated targets are masked.

A conversation of any length is never ordered in one task, whatever its turn numbers: turns are dealt by ranges of
conversation, number, role and text and get places in that order, prefix sums are taken within blocks of at most ``2 **
BLOCK_BITS`` places and of block sums, the span that follows is found by a join, and a window gathers at most the budget's
tokens or one turn. Repeated rows are dealt by row; only texts that agree in role and their first ``SAME`` characters and go
on beyond them, within one turn number, are sorted in one task (with spilling). Texts are left out of all steps between
their places and their windows. :func:`read_back` joins a conversation's text again, in one row, because its digest is that of the whole text.

Defined results: a null text or role is an empty one; a null conversation id is an id of its own; turns with equal
numbers are ordered by role and text, null turn numbers first; repeated rows are turns of their own; an empty table gives
no windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthcal.llm.shared import WORD, materialize

END = "</turn>\n"
#: Tokens of a window and of a turn's markers.
BUDGET, OVERHEAD = 1024, 4
#: Places of a block, as a power of two, and characters of a text that decide to which range it is dealt.
BLOCK_BITS, SAME = 8, 256


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<(/?turn)", r"<\\$1")


def unescaped(text: Column) -> Column:
    """Drops the first of two backslashes and a lone one."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def limits(budget: int) -> tuple[int, int, int]:
    """Tokens of a span's width, of a turn that is a span of its own, and of a repeated system turn or history."""
    return max(1, budget * 3 // 8), budget // 8, budget // 4


def ordered_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Every turn with its cost in tokens and its place: a number that grows in the order of conversation, turn, role and text. Written."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), t.alias("text"), (F.regexp_count(t, F.lit(WORD)) + OVERHEAD).cast("long").alias("cost")
    )
    # texts no longer than their start are repeats of each other where it is equal, so any row may come first
    rows = rows.withColumns({"start": F.substring("text", 1, SAME), "longer": F.length("text") > SAME, "row": F.monotonically_increasing_id()})
    rows = rows.withColumn("row", F.when(~F.col("longer"), F.col("row")))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "start", "longer", "row").sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(dealt.select("conv_id", "role", "text", "cost", F.monotonically_increasing_id().alias("place")), "chat-order")


def placed_turns(ordered: DataFrame, budget: int) -> DataFrame:
    """Every turn's place with the tokens before it, the start of its span and the end, and whether it is the system turn."""
    stride, long, _ = limits(budget)
    turns = ordered.select("conv_id", "place", "cost", (F.col("role") == "system").alias("system"), F.shiftright("place", BLOCK_BITS).alias("block"), (F.col("cost") > long).cast("long").alias("long"))
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("cost").alias("cost"), F.sum("long").alias("long"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_ahead": F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in ("cost", "long")}
    blocks = materialize(blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), *(v.alias(k) for k, v in sums.items())), "chat-blocks")
    before = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns({f"{c}_within": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cost", "long")})
    turns = turns.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    turns = turns.withColumn("start", F.col("cost_ahead") + F.col("cost_within"))
    # long turns part the others: those between two of them share the even number, a long one has the odd one after it
    turns = turns.withColumn("group", 2 * (F.col("long_ahead") + F.col("long_within")) + F.col("long"))
    turns = turns.withColumn("cell", F.when(F.col("long") == 1, F.lit(0).cast("long")).otherwise(F.floor(F.col("start") / stride)))
    span = Window.partitionBy("conv_id", "group", "cell")
    turns = turns.withColumns({"first": F.min("start").over(span), "reach": F.max(F.col("start") + F.col("cost")).over(span)})
    return turns.select("conv_id", "place", "start", "cost", "first", "reach", ((F.col("start") == 0) & F.col("system")).alias("system"))


def chat_windows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """conv_id, window (tokens before its own turns), tokens, formatted, repeated (turns shown again, at the front) and loss
    (start, length in code points)."""
    _, _, most = limits(budget)
    ordered = ordered_turns(conversations, conv_id, turn, role, text)
    turns = materialize(placed_turns(ordered, budget), "chat-turns")
    said = ordered.select(F.col("place").alias("o_place"), "role", "text")
    system = turns.where(F.col("system") & (F.col("cost") <= most)).join(said, F.col("place") == F.col("o_place"))
    system = materialize(system.select(F.col("conv_id").alias("s_conv"), F.col("role").alias("s_role"), F.col("text").alias("s_text"), F.col("cost").alias("s_cost")), "chat-system")
    # the spans after the first, each with what is left for history, found by the place where the one before ends
    later = turns.where("first > 0").groupBy("conv_id", "first").agg((F.max("reach") - F.col("first")).alias("own"))
    later = later.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    room = F.least(F.lit(most), budget - F.col("own") - F.coalesce("s_cost", F.lit(0)))
    later = materialize(later.select(F.col("conv_id").alias("l_conv"), F.col("first").alias("l_first"), room.alias("room"), "s_role", "s_text", "s_cost"), "chat-spans")
    own = turns.select("conv_id", F.col("first").alias("window"), F.lit(True).alias("new"), "start", "place", "cost")
    last = turns.where(~F.col("system") & (F.col("reach") - F.col("start") <= most))
    again = last.join(later.select("l_conv", "l_first", "room"), F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("reach") == F.col("l_first")))
    again = again.where(F.col("reach") - F.col("start") <= F.col("room")).select("conv_id", F.col("reach").alias("window"), F.lit(False).alias("new"), "start", "place", "cost")
    shown = own.unionByName(again).join(said, F.col("place") == F.col("o_place")).drop("place", "o_place")
    first = later.where("s_cost is not null").select(F.col("l_conv").alias("conv_id"), F.col("l_first").alias("window"), F.lit(False).alias("new"), F.lit(0).cast("long").alias("start"), F.col("s_role").alias("role"), F.col("s_text").alias("text"), F.col("s_cost").alias("cost"))
    item = F.struct("new", "start", F.concat(head(F.col("role")), escaped(F.col("text")), F.lit(END)).alias("s"), F.length(head(F.col("role"))).alias("h"), (F.col("role") == "assistant").alias("loss"))
    windows = shown.unionByName(first).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(item)).alias("t"), F.sum("cost").alias("tokens"))
    sizes = F.transform("t", lambda x: F.length(x["s"]))
    at = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    spans = F.filter(
        F.zip_with("t", F.slice(at, F.lit(1), F.size("t")), lambda x, s: F.when(x["new"] & x["loss"], F.struct((s + x["h"]).alias("start"), (F.length(x["s"]) - x["h"] - len(END)).alias("length")))),
        lambda x: x.isNotNull(),
    )
    return windows.select("conv_id", "window", "tokens", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"), F.size(F.filter("t", lambda x: ~x["new"])).alias("repeated"), spans.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations as the windows hold them: conv_id, n_turns, turns (role, newline, text, newline each), loss text, formatted_chars."""
    own = F.split("formatted", END, -1)
    own = F.slice(own, F.col("repeated") + 1, F.greatest(F.size(own) - 1 - F.col("repeated"), F.lit(0)))
    role = lambda s: F.url_decode(F.substring_index(F.substr(s, F.lit(7)), ">\n", 1))
    said = lambda s: unescaped(F.regexp_replace(s, r"(?s)\A<turn [^>]*>\n", ""))
    turns = F.transform(own, lambda s: F.concat(role(s), F.lit("\n"), said(s), F.lit("\n")))
    lost = F.transform("loss", lambda x: unescaped(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    parts = windows.select("conv_id", F.struct("window", F.size(own).alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(lost, "").alias("lost"), F.length("formatted").alias("chars")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    return whole.select("conv_id", total("n").alias("n_turns"), F.array_join(F.transform("p", lambda x: x["turns"]), "").alias("turns"), F.array_join(F.transform("p", lambda x: x["lost"]), "").alias("lost"), total("chars").alias("formatted_chars"))


def digests(conversations: DataFrame) -> DataFrame:
    """The read-back conversations as digests and sizes."""
    return conversations.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars")
