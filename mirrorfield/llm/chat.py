r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of a role are merged into one block with
array aggregation, and the blocks are concatenated:

    ### User:\n<turn>first text</turn>\n<turn>second text</turn>\n\n### Assistant:\n<turn>...</turn>\n\n

Texts are escaped: a backslash becomes \\, "###" becomes \#\#\#, and the "<" of "<turn>" and "</turn>" becomes \<. So
no text can hold a control string, and reading back is a split at control strings. Loss falls on what stands
between <turn> and </turn> in the blocks of the assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfield.llm.common import table

ASSISTANT = "assistant"
HEAD, OPEN, CLOSE, MORE, END = "### ", "<turn>", "</turn>", "\n", "\n\n"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, hidden in (("###", "\\#\\#\\#"), (OPEN, "\\" + OPEN), (CLOSE, "\\" + CLOSE)):
        text = F.replace(text, F.lit(plain), F.lit(hidden))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) for each conversation of (conv_id, turn, role, text).

    Turns are sorted by turn, a null turn first, ties by role and text; repeated rows stay, each a turn. A null text
    is empty, a null role the empty role; rows with a null conv_id form one conversation. Other columns are ignored; no rows give no rows.
    """
    kept = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), kept.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), escaped(t["text"]), F.lit(CLOSE))
    marked = F.transform(
        "turns",
        lambda t, i: F.when(F.get("turns", i - 1)["role"].eqNullSafe(t["role"]), F.concat(F.lit(MORE), piece(t))).otherwise(
            F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(HEAD), escaped(t["role"]), F.lit(":\n"), piece(t))
        ),
    )
    return grouped.select("conv_id", F.concat(F.array_join(marked, ""), F.lit(END)).alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), by its control strings alone."""
    blocks = F.filter(F.split(formatted, r"(?<!\\)### "), lambda b: b != "")
    heads = lambda b: unescaped(F.regexp_extract(b, r"(?s)\A(.*?):\n<turn>", 1))
    texts = lambda b: F.split(b, r"(?<!\\)<turn>")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.slice(texts(b), 2, 1 << 30),
                lambda x: F.struct(heads(b).alias("role"), unescaped(F.regexp_replace(x, r"(?s)</turn>\n*\z", "")).alias("text")),
            ),
        )
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, ASSISTANT, ok)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    read = format_conversations(rows).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OK = "'\\### Assistant: </turn> ok'"
_ESCAPED = r"replace(replace(replace(replace({0}, '\', '\\'), '###', '\#\#\#'), '<turn>', '\<turn>'), '</turn>', '\</turn>')"

OP5_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {_OK} union all select -7, 1, 'assistant', {_OK}
), ordered as (
  select *, row_number() over w as i, lag(role) over w as before from rows window w as (partition by conv_id order by turn nulls first, role, text)
), marked as (
  select *, case when before = role then chr(10) else (case when i > 1 then chr(10) || chr(10) else '' end) || '### ' || {_ESCAPED.format("role")} || ':' || chr(10) end
    || '<turn>' || {_ESCAPED.format("text")} || '</turn>' as piece
  from ordered
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  (length(string_agg(piece, '' order by i)) + 2)::bigint as formatted_chars
from marked group by conv_id
"""
