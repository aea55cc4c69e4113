r"""Chat formatting with a grammar round trip.

A conversation is written as turns ``### Role: text</turn>\n``. The parser is deterministic: it cuts at ``</turn>\n``,
takes what stands before the first ``: `` as the role, and undoes the escapes ``\b`` (backslash), ``\h`` (#) and ``\l``
(<). A turn whose role or text holds a control string or a backslash conflicts with that grammar and is escaped. Then the text
is parsed again; if it does not give back the turns it was made of, every turn is escaped, which makes it exact: an
escaped turn holds no ``#``, no ``<``, no colon in the role, and a backslash only as the beginning of an escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Source strings and what stands for them; the backslash comes first when escaping and last when undoing it.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LOSS_ROLE = "assistant"


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def conflicts(role: Column, text: Column) -> Column:
    """Whether a turn holds a string that the grammar reads in another way."""
    marks = [text.contains(m) for m in ("\\", "###", "</turn>")] + [role.contains(m) for m in ("\\", "#", "<", ":", "\n")]
    found = marks[0]
    for m in marks[1:]:
        found = found | m
    return found


def _title(role: Column) -> Column:
    """Known roles are written with a capital; any other role stays as it is."""
    return F.when(role.isin("system", "user", "assistant"), F.initcap(role)).otherwise(role)


def _named(title: Column) -> Column:
    return F.when(title.isin("System", "User", "Assistant"), F.lower(title)).otherwise(title)


def rendered(role: Column, text: Column, escape: Column) -> Column:
    r"""One turn. A role "User" of its own would be read as "user": it is written behind the mark ``\r``."""
    own = F.when(role.isin("System", "User", "Assistant"), F.concat(F.lit("\\"), F.lit("r"), escaped(role, ROLE_ESCAPES))).otherwise(F.when(escape, escaped(_title(role), ROLE_ESCAPES)).otherwise(_title(role)))
    return F.concat(F.lit(OPEN), own, F.lit(MIDDLE), F.when(escape, escaped(text)).otherwise(text), F.lit(CLOSE))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    # After the last turn comes an empty rest.
    bodies = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(body: Column) -> Column:
        cut = F.locate(MIDDLE, body)
        head = F.substring(body, F.lit(len(OPEN) + 1), cut - F.lit(len(OPEN) + 1))
        role = F.when(head.startswith("\\r"), unescaped(F.substring(head, F.lit(3), F.length(head)), ROLE_ESCAPES)).otherwise(_named(unescaped(head, ROLE_ESCAPES)))
        return F.struct(role.alias("role"), unescaped(F.substring(body, cut + F.lit(len(MIDDLE)), F.length(body))).alias("text"))

    return F.transform(bodies, turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, recovered, loss_spans, round_trip), one row per conversation.

    ``turns`` has conv_id, turn, role and text. Turns stand in order of ``turn``, then role and text, null first; repeated
    rows are turns of their own. Null texts and roles count as empty. ``recovered`` are the turns parsed back from
    ``formatted``; ``loss_spans`` are the (start, length) of the escaped assistant texts in it, in code points, start from
    0. A null conv_id is a conversation like any other. Other columns are ignored; an empty table gives no rows. The text of one
    conversation is one value, so its turns meet in one row; nothing else is gathered by key.
    """
    # A row number of the order makes the array sort cheap and exact.
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    drawn = rows.withColumn("at", F.row_number().over(order)).withColumn("conflict", conflicts(F.col("role"), F.col("text")))
    first = drawn.withColumn("piece", rendered(F.col("role"), F.col("text"), F.col("conflict"))).withColumn("whole", rendered(F.col("role"), F.col("text"), F.lit(True)))
    gathered = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "conflict", "piece", "whole"))).alias("t"))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    joined = lambda field: F.array_join(F.transform("t", lambda x: x[field]), "")
    tried = gathered.withColumn("source", source).withColumn("sparing", joined("piece")).withColumn("agrees", parsed(F.col("sparing")) == F.col("source"))
    # Where the sparing form is read back in another way, every turn is escaped.
    final = tried.withColumn("formatted", F.when(F.col("agrees"), F.col("sparing")).otherwise(joined("whole")))
    sized = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.length(F.when(F.col("agrees"), x["piece"]).otherwise(x["whole"])).alias("n"), F.length(F.when(F.col("agrees") & ~x["conflict"], x["text"]).otherwise(escaped(x["text"]))).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    # A text ends where the closing mark of its turn begins.
    step = lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["role"] == LOSS_ROLE, F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["n"] - x["m"] - len(CLOSE)).alias("start"), x["m"].alias("length"))))).otherwise(acc["spans"]).alias("spans"))
    spans = F.aggregate(sized, zero, step, lambda acc: acc["spans"])
    return final.withColumn("recovered", parsed(F.col("formatted"))).select("conv_id", "formatted", "recovered", spans.alias("loss_spans"), (F.col("recovered") == F.col("source")).alias("round_trip"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, round_trip), read back from the output."""
    turns = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
