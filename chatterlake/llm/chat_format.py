"""Chat formatting: one marked text per conversation, one training example per assistant turn.

A turn is `<s>[INST]role[/INST]text</s>`. Inside roles and texts every backslash is doubled
and every control string gets a backslash after its first character, so no text can close
or open a turn, and taking the backslashes away again gives the text back.

Each assistant turn is exploded into an example of its own: its context is everything
before its text, all preceding turns included, and only its text is trainable. A row of
`examples` holds its target and the length of its context, a prefix of the conversation's
formatted text, so a long conversation is kept once, not once for each reply; `expanded`
writes contexts out where they are wanted. Places add up in a window over the turns, in
time linear in them. SQL functions only.

Defined cases. A null role or text is empty. Turns are in the order of (turn, role, text),
null turns first; rows that repeat stay. A null conv_id is a conversation of its own. A
conversation without assistant turns has no example and loses nothing. A very long
conversation is one value, as its formatted text is: it must fit a task. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template.
OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """The text without any control string in it."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, ROLE, TEXT, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    """The text as it was: a backslash goes, what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, places.

    places: for each assistant turn, in order, its nth turn (from 0), and where its
    trainable text starts (code points, from 1) and how long it is in `formatted`.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(OPEN + ROLE), escaped(F.col("role")), F.lit(TEXT)).alias("head"), escaped(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.withColumns({"nth": F.row_number().over(order) - 1, "upto": upto})
    start = F.col("upto") - len(CLOSE) - F.length("body") + 1
    place = F.when(F.col("role") == TRAINED, F.struct("nth", start.cast("int").alias("start"), F.length("body").alias("length")))
    whole = F.array_sort(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))))
    found = parts.groupBy("conv_id").agg(whole.alias("pieces"), F.array_sort(F.collect_list(place)).alias("places"))
    return found.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "places")


def examples(found: DataFrame, *kept: str) -> DataFrame:
    """One row per example: conv_id, example, turn, context_chars (its context is so long a prefix of `formatted`), target; and the columns kept.

    A conversation without examples has one row with nulls.
    """
    targets = F.transform("places", lambda x: F.struct(x["nth"].alias("turn"), (x["start"] - 1).alias("context_chars"), F.substring("formatted", x["start"], x["length"]).alias("target")))
    return found.select("conv_id", *kept, targets.alias("targets")).select("conv_id", *kept, F.posexplode_outer("targets").alias("example", "x")).select(
        "conv_id", *kept, "example", "x.turn", "x.context_chars", "x.target")


def expanded(found: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, turn, context (all before the text), target (the only trainable part)."""
    rows = examples(found, "formatted").filter("example is not null")
    return rows.select("conv_id", "example", "turn", F.substring("formatted", F.lit(1), F.col("context_chars")).alias("context"), "target")


def turns_of(formatted_text: Column) -> Column:
    """Role and text of each turn, unescaped, read back from a formatted text."""
    pieces = F.split(formatted_text, CLOSE, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN + ROLE) + 1)), TEXT, 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, TEXT) + len(TEXT))).alias("text")))


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations and their examples hold, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    loss_*: of the targets of the exploded examples, unescaped, in their order.
    """
    back = formatted(conversations).withColumn("turns", turns_of(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = back.select("conv_id", "formatted", "places", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    # conv_id alone tells conversations apart; the other keys only come along, and need no shuffle of their own.
    about = ["n_turns", "turns_sha256", "formatted_chars"]
    each = examples(whole, *about)
    learned = F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", unescaped(F.col("target")).alias("text")))))
    found = each.groupBy("conv_id", *about).agg(learned.alias("learned")).withColumn("loss", F.array_join(F.transform("learned", lambda x: x["text"]), ""))
    return found.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", F.size("learned").cast("long").alias("n_examples"))


SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CAST(24 + length(replace(role, '\', '\\')) + length(replace(text, '\', '\\')) AS BIGINT) - 4
    + CAST((length(role || chr(1) || text) - length(replace(role || chr(1) || text, '<s>', ''))) // 3
    + (length(role || chr(1) || text) - length(replace(role || chr(1) || text, '[INST]', ''))) // 6
    + (length(role || chr(1) || text) - length(replace(role || chr(1) || text, '[/INST]', ''))) // 7
    + (length(role || chr(1) || text) - length(replace(role || chr(1) || text, '</s>', ''))) // 4 AS BIGINT) AS chars FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_examples
FROM marked GROUP BY conv_id
"""
