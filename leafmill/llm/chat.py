"""Chat formatting: a finite-state machine over roles, and a declarative template with per-segment loss flags.

All in DataFrame functions. A Template says how a turn opens and closes, which roles are trained on, and which role
may follow which. Each turn gives three segments (opening, text, closing); only the text of a trained role is under the
loss. Control strings inside texts and roles are escaped, so that output can be read back exactly: the escape sign
and each control string become the sign and one letter, and no control string is left in what is escaped.

chat_segments() gives the segments turn by turn and gathers nothing. format_chats() gives one row for each
conversation, which must hold its whole text: a single conversation has to fit into one value (2 GB).

Defined results: a null text or role is empty. Turns are taken in the order of turn, role and text (nulls first), so
ties have one order and repeated rows stay. A conversation whose roles the machine does not accept is formatted all the
same, with valid false and the place of its first bad turn. An empty table gives an empty result; a null conversation
id is a conversation. Columns beside the four are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import table


@dataclass(frozen=True)
class Template:
    before_role: str = "### "
    after_role: str = ":\n"
    close: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    #: State (the last role, or "" at the start) and the roles that may follow.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    sign: str = "\\"
    #: Control strings and the letters that stand for them after the sign.
    controls: dict[str, str] = field(default_factory=lambda: {"###": "h", "</turn>": "t"})
    role_controls: dict[str, str] = field(default_factory=lambda: {"\n": "n", ":": "c"})


def escaped(text: Column, t: Template, role: bool = False) -> Column:
    out = F.replace(text, F.lit(t.sign), F.lit(t.sign + "b"))
    for control, letter in (t.controls | (t.role_controls if role else {})).items():
        out = F.replace(out, F.lit(control), F.lit(t.sign + letter))
    return out


def unescaped(text: Column, t: Template, role: bool = False) -> Column:
    # The sign occurs in escaped text before a letter only, so no replacement can make or hide another.
    for control, letter in (t.controls | (t.role_controls if role else {})).items():
        text = F.replace(text, F.lit(t.sign + letter), F.lit(control))
    return F.replace(text, F.lit(t.sign + "b"), F.lit(t.sign))


def move(state: Column, role: Column, t: Template) -> Column:
    """The machine's next state: the role, or null where it may not follow."""
    out = F.lit(None).cast("string")
    for before, after in t.moves.items():
        out = F.when(state == before, F.when(role.isin(*after), role)).otherwise(out)
    return out


def segments_of(role: Column, text: Column, t: Template) -> Column:
    """Array of three structs (text, loss)."""
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    return F.array(
        part(F.concat(F.lit(t.before_role), escaped(role, t, role=True), F.lit(t.after_role)), off),
        part(escaped(text, t), role.isin(*t.trained)),
        part(F.lit(t.close), off),
    )


def _turns(chats: DataFrame, t: Template, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = chats.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return said.withColumn("segments", segments_of(F.col("role"), F.col("text"), t))


def chat_segments(chats: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each segment: conv, turn, place (of the turn), segment, text, loss, allowed (the turn may stand here)."""
    rows = _turns(chats, template, conv, turn, role, text)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    # Each state is the role before it as long as all is well, so one look back tells whether a turn may stand here.
    before = F.coalesce(F.lag("role").over(order), F.lit(""))
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("allowed", move(before, F.col("role"), template).isNotNull())
    each = rows.select("conv", "turn", "place", "allowed", F.posexplode("segments").alias("segment", "s"))
    return each.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "place", "segment", "s.text", "s.loss", "allowed")


def format_chats(chats: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, formatted, segments (text, loss), valid, first_bad (place of a turn, or null)."""
    rows = _turns(chats, template, conv, turn, role, text)
    gathered = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("turns"))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("bad"))
    step = lambda a, x: F.struct(
        x["role"].alias("state"), (a["place"] + 1).alias("place"),
        F.coalesce(a["bad"], F.when(move(a["state"], x["role"], template).isNull(), a["place"])).alias("bad"))
    bad = F.aggregate("turns", start, step)["bad"]
    out = gathered.select(F.col("conv").alias(conv), F.flatten(F.transform("turns", lambda x: x["segments"])).alias("segments"), bad.alias("first_bad"))
    return out.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", F.col("first_bad").isNull().alias("valid"), "first_bad")


def read_back(formatted: Column, t: Template = Template()) -> Column:
    """Array of structs (role, text): the turns of a formatted conversation."""
    turns = F.filter(F.split(formatted, f"\\Q{t.close}\\E"), lambda x: x != "")
    body = lambda x: F.substring(x, len(t.before_role) + 1, F.length(x))
    head = lambda x: F.substring_index(body(x), t.after_role, 1)
    return F.transform(turns, lambda x: F.struct(
        unescaped(head(x), t, role=True).alias("role"),
        unescaped(F.substring(body(x), F.length(head(x)) + len(t.after_role) + 1, F.length(x)), t).alias("text")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Template()
    planted = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(more)
    made = format_chats(chats, t)
    turns = made.select("conv_id", "valid", "formatted", read_back(F.col("formatted"), t).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("lost"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("lost", lambda s: unescaped(s["text"], t)), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
each AS (
  SELECT *, 4 + length(role) + 2 + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8 AS chars FROM turns)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system|(system )?user( assistant user)*( assistant)?)') AS valid
FROM each GROUP BY conv_id
"""
