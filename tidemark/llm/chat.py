"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are taken in blocks of ``BLOCK`` turn numbers, so that a hot conversation spreads; a
block knows the system turn and the last turns of the block before it. Within a block, prefix sums of turn
tokens fall into cells of the window's capacity: the turns that lie whole in a cell are a window, a turn that
crosses the end of its cell is a window of its own. So windows begin and end with turns, and none is over
the budget unless one turn alone is.

A later window repeats the system turn and up to ``HISTORY`` turns before it. The loss mask covers assistant
texts that are new in their window, so each text is learnt once.

The template writes ``### role``, a line end, the text, ``</turn>`` and a line end. Inside roles and texts a
backslash marks what would be a control string: ``\\`` for itself, ``#\\#`` for two hashes, ``<\\/turn>`` for the
end mark, and in roles one before a line end. Dropping the backslash before any character gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blank

#: Tokens of a window, turns of history, and the parts of the budget that history and the system turn may take.
BUDGET, HISTORY, HISTORY_PART, SYSTEM_PART = 2_048, 2, 4, 2
#: Turn numbers of a block.
BLOCK = 1_024
#: Tokens of the marks around a turn.
MARKS = 4
#: A token is a run of letters, digits and underscores, or any other character that is no white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Fixed values of the template.
OPEN, CLOSE = "### ", "</turn>\n"

_SYSTEM, _ECHO, _OWN, _MORE = 0, 1, 2, 3


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _in_blocks(turns: DataFrame, history: int) -> DataFrame:
    """Own turns of each block with copies of the system turn and of the turns before it."""
    rows = turns.withColumn("kind", F.lit(_OWN))
    edge = (F.col("block") + 1) * BLOCK - history
    echoes = turns.where(F.col("turn") >= edge).withColumn("block", F.col("block") + 1).withColumn("kind", F.lit(_ECHO))
    later = turns.where("block > 0").select("conv_id", "block").distinct()
    first = turns.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.min(F.struct("block", F.col("turn").isNotNull().alias("numbered"), "turn", "text", "tokens")).alias("s")
    )
    first = first.select(F.col("conv_id").alias("owner"), "s")
    systems = later.join(first, F.col("conv_id").eqNullSafe(F.col("owner"))).where(F.col("block") > F.col("s.block")).select(
        "conv_id", "s.turn", F.lit("system").alias("role"), "s.text", "s.tokens", "block", F.lit(_SYSTEM).alias("kind")
    )
    none = F.lit(None)
    more = later.select("conv_id").distinct().select(
        "conv_id", none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("tokens"),
        F.lit(0).cast("long").alias("block"), F.lit(_MORE).alias("kind"),
    )
    return rows.unionByName(echoes).unionByName(systems).unionByName(more)


def windows(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """(conv_id, block, window, formatted, spans, repeated, n_turns, tokens, continued), one row per window.

    Windows of a conversation order by (block, window). ``spans`` are the code point offsets [start, end) in
    ``formatted`` that the loss covers; the first ``repeated`` of the ``n_turns`` turns stood in an earlier
    window. ``continued`` says that the conversation has turns in later blocks.

    Turns order by number (null first), ties by role and text; repeated rows are turns of their own. Turn
    numbers below zero and null ones belong to the first block. A null role or text is empty, a null
    conversation is one conversation. The system turn is the earliest turn whose role is ``system``; one over
    half of the budget is not repeated, and history is cut to what fits a quarter. Texts are never cut: a turn
    over the budget is a window over the budget. Other columns are ignored; an empty table has no windows.
    """
    turns = df.select(
        df[conv_id].alias("conv_id"), df[turn].cast("long").alias("turn"), blank(df[role]).alias("role"), blank(df[text]).alias("text")
    )
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS)
    turns = turns.withColumn("block", F.greatest(F.coalesce(F.expr(f"floor(turn / {BLOCK})"), F.lit(0)), F.lit(0)).cast("long"))

    block = Window.partitionBy("conv_id", "block")
    ordered = block.orderBy("kind", F.col("turn").asc_nulls_first(), "role", "text")
    is_system = (F.col("role") == "system") & F.col("kind").isin(_SYSTEM, _OWN)
    rows = _in_blocks(turns, history).select(
        "*", F.row_number().over(ordered).alias("at"),
        (is_system & (F.count(F.when(is_system, 1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) == 1)).alias("pinned"),
        F.coalesce(F.sum(F.when(F.col("kind") == _OWN, F.col("tokens"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    held = F.coalesce(F.max(F.when(F.col("pinned") & (F.col("tokens") <= budget // SYSTEM_PART), F.col("tokens"))).over(block), F.lit(0))
    rows = rows.withColumn("room", F.lit(budget - budget // HISTORY_PART) - held)
    cell, end = F.floor(F.col("before") / F.col("room")), F.floor((F.col("before") + F.col("tokens") - 1) / F.col("room"))
    number = F.when(F.col("kind") == _OWN, cell * 2 + F.when(cell == end, 0).otherwise(1)).otherwise(F.col("kind") - _OWN - _MORE)
    item = F.struct("at", "role", "text", "tokens", "pinned")
    grouped = rows.groupBy("conv_id", "block", number.alias("window")).agg(F.sort_array(F.collect_list(item)).alias("turns"))

    # Copies of the system turn, echoes and the mark of further blocks are the windows below zero.
    in_order = block.orderBy("window")
    echo, more = _ECHO - _OWN - _MORE, _MORE - _OWN - _MORE
    tail = F.expr(f"slice(turns, greatest(size(turns) - {history - 1}, 1), {history})")
    pinned = F.expr("filter(turns, t -> t.pinned)")
    linked = grouped.select(
        "conv_id", "block", "window", "turns",
        F.lag(F.when((F.col("window") >= 0) | (F.col("window") == echo), tail)).over(in_order).alias("past"),
        F.first(F.when(F.size(pinned) > 0, pinned), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("system"),
        F.max(F.col("window") == more).over(block).alias("continued"),
    ).where("window >= 0")
    linked = linked.withColumn("system", F.expr(f"filter(coalesce(system, array()), t -> t.tokens <= {budget // SYSTEM_PART})"))
    fits = f"(t, i) -> NOT t.pinned AND aggregate(slice(past, i + 1, {history}), 0L, (n, x) -> n + x.tokens) <= {budget // HISTORY_PART}"
    linked = linked.withColumn("past", F.expr(f"CASE WHEN past IS NULL THEN slice(turns, 1, 0) ELSE filter(past, {fits}) END"))
    return _formatted(linked)


def _formatted(linked: DataFrame) -> DataFrame:
    def part(is_new: bool):
        return lambda t: F.struct(
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
            (F.lit(is_new) & (t["role"] == "assistant")).alias("learnt"), t["tokens"].alias("tokens"),
        )

    again = F.concat("system", "past")
    parts = linked.select(
        "conv_id", "block", "window", F.size(again).alias("repeated"), "continued",
        F.concat(F.transform(again, part(False)), F.transform("turns", part(True))).alias("parts"),
    )
    spans = F.expr(f"""
        aggregate(parts, named_struct('at', 0, 'spans', cast(array() AS array<struct<start: int, end: int>>)), (s, p) -> named_struct(
          'at', s.at + length(p.head) + length(p.body) + {len(CLOSE)},
          'spans', CASE WHEN p.learnt THEN concat(s.spans, array(named_struct('start', s.at + length(p.head), 'end', s.at + length(p.head) + length(p.body))))
                   ELSE s.spans END), s -> s.spans)""")
    close = CLOSE.replace("\n", "\\n")
    return parts.select(
        "conv_id", "block", "window", F.expr(f"concat_ws('', transform(parts, p -> concat(p.head, p.body, '{close}')))").alias("formatted"),
        spans.alias("spans"), "repeated", F.size("parts").alias("n_turns"), F.expr("aggregate(parts, 0L, (n, p) -> n + p.tokens)").alias("tokens"), "continued",
    )


def read_back(out: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from what ``windows`` returns.

    New turns are parsed from the formatted text, learnt texts are cut out of it by the mask. Digests of a
    conversation in one block are taken where its windows lie; only longer ones meet again, one row per block.
    """
    head = r"(?s)^### ((?:[^\\\n]++|\\.)*+)\n"
    raw = F.split("formatted", CLOSE, -1)
    parsed = F.transform(
        F.slice(raw, F.col("repeated") + 1, F.col("n_turns") - F.col("repeated")),
        lambda t: F.concat(unescape(F.regexp_extract(t, head, 1)), F.lit("\n"), unescape(F.substr(t, F.length(F.regexp_extract(t, head, 0)) + 1)), F.lit("\n")),
    )
    learnt = F.transform("spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    windows_back = out.select(
        "conv_id", "block", "window", "continued", (F.size(raw) - 1 - F.col("repeated")).alias("new"), F.length("formatted").alias("chars"),
        F.concat_ws("", parsed).alias("turns"), F.concat_ws("", learnt).alias("loss"),
    )
    pieces = windows_back.groupBy("conv_id", "block").agg(
        F.max("continued").alias("continued"), F.sum("new").alias("new"), F.sum("chars").alias("chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
    ).withColumn("turns", F.expr("concat_ws('', transform(w, x -> x.turns))")).withColumn("loss", F.expr("concat_ws('', transform(w, x -> x.loss))"))
    whole = (F.col("block") == 0) & ~F.col("continued")
    kept = [F.when(whole, F.sha2(c, 256)).otherwise(F.col(c)).alias(c) for c in ("turns", "loss")]
    pieces = pieces.select("conv_id", "block", "new", "chars", F.length("loss").alias("loss_chars"), whole.alias("whole"), *kept)
    joined = pieces.groupBy("conv_id").agg(
        F.sum("new").alias("n_turns"), F.max("whole").alias("whole"), F.sum("loss_chars").alias("loss_chars"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("block", "turns", "loss"))).alias("b"),
    )

    def digest(name: str) -> Column:
        text = F.expr(f"concat_ws('', transform(b, x -> x.{name}))")
        return F.when(F.col("whole"), text).otherwise(F.sha2(text, 256)).alias(f"{name}_sha256")

    return joined.select("conv_id", "n_turns", digest("turns"), "loss_chars", digest("loss"), "formatted_chars")
