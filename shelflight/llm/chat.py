"""Chat formatting: conversations rebuilt from an event log, then rendered.

An event is (conv_id, message, seq, kind, role, text).  ``start`` opens a message and gives its
role, ``delta`` appends text, ``edit`` replaces all text so far, ``regenerate`` throws away what
was said so far (the deltas after it are the new answer), ``delete`` withdraws the message.  The
log is folded per message, so a conversation of any length is folded by many tasks; only the
finished messages of a conversation meet in one row, because one string is what is asked for.

Edge rows: null text and null role are empty; unknown kinds change nothing; a message without
any ``start`` has the role ``""``; repeated events apply again, in order; equal ``seq`` are taken
in the order of kind and text; a conversation without messages has no row; a null ``conv_id`` is
a conversation of its own.  Columns besides these six are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("start", "edit", "regenerate", "delta", "delete")  # the order at equal ``seq``


def escape(x: Column) -> Column:
    """No control string and no line break of the template can occur in the result.

    Every backslash becomes ``\\b``, every ``<|`` becomes ``<\\p``; so each backslash in the
    result stands before its letter and the three replacements can be taken back one by one.
    """
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\n"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("\\n"), F.lit("\n")))


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: every row starts a message and streams its text."""
    row = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    message = F.struct(F.col("turn"), F.xxhash64(row).alias("row"))
    both = F.array(
        F.struct(F.lit("start").alias("kind"), F.lit(0).alias("seq"), row["role"].alias("role"),
                 F.lit("").alias("text")),
        F.struct(F.lit("delta").alias("kind"), F.lit(1).alias("seq"), F.lit("").alias("role"),
                 row["text"].alias("text")),
    )
    numbered = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("copy"))
    return numbered.select("conv_id", message.alias("message"), "copy", F.inline(both))


def fold_events(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(conv_id, message, role, text) of every message that was not deleted."""
    keys = keys or ["conv_id", "message"]
    kind_order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    event = F.struct(
        F.col("seq"), kind_order.alias("at"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("role", F.lit("")).alias("role"), F.col("kind"),
    )
    log = events.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("log"))

    def last(kinds: tuple[str, ...]) -> Column:
        """Position of the last event of these kinds, 0 for none."""
        hit = F.transform("log", lambda e, i: F.when(e["kind"].isin(*kinds), i + 1).otherwise(0))
        return F.array_max(hit)

    log = log.withColumn("cut", last(("edit", "regenerate", "delete"))).withColumn("opened", last(("start",)))
    said = F.transform(
        F.filter("log", lambda e, i: (e["kind"] == "delta") & (i >= F.col("cut"))
                 | (e["kind"] == "edit") & (i + 1 == F.col("cut"))),
        lambda e: e["text"],
    )
    role = F.when(F.col("opened") > 0, F.element_at("log", F.col("opened"))["role"]).otherwise(F.lit(""))
    gone = F.when(F.col("cut") > 0, F.element_at("log", F.col("cut"))["kind"] == "delete").otherwise(F.lit(False))
    return log.filter(~F.coalesce(gone, F.lit(False))).select(*keys, role.alias("role"), F.array_join(said, "").alias("text"))


def render(messages: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, formatted): the messages of a conversation by ``order``, one string."""
    turn = F.concat(
        F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END), F.lit("\n")
    )
    item = F.struct(*order, "role", "text", turn.alias("turn_text"))
    turns = F.array_sort(F.collect_list(item))
    return messages.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): roles and texts parsed from the rendered string.

    ``loss`` is the text under the loss mask: what the assistant says, unescaped, in order.
    """
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, len(START) + 1, F.length(p)))
    turns = F.transform(body, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
    ))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return formatted.withColumn("turns", turns).select(
        "conv_id", "turns", F.array_join(loss, "").alias("loss"), "formatted"
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Turns to events, events to messages, messages to rendered strings."""
    keys = ["conv_id", "message", "copy"]
    return render(fold_events(events_of_turns(conversations), keys), ["message", "copy"])
