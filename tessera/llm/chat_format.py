"""Chat formatting: conversations as one string each, with a loss mask, reversibly.

Turns are collected as structs and sorted; adjacent turns of one role become one
block, whose parts stay apart; blocks are concatenated::

    <|im_start|>role\\ntext<|part|>text<|im_end|>\\n

Inside texts and roles every ``<|`` is written ``<||``, so no text can hold a
marker, and reading back undoes it.  The loss mask is a list of (start, length)
in code points of the formatted string: the assistant's texts, without markers.
DataFrame functions only.

Results for odd input: a null text or role is empty; turns with one number are
ordered by role and text, null numbers first; repeated rows are turns of their
own; rows with a null conversation id are one conversation; no rows, no result;
other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the template.
START, PART, END = "<|im_start|>", "<|part|>", "<|im_end|>\n"
OPEN, ESCAPED, LINE = "<|", "<||", "<|line|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(ESCAPED))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPED), F.lit(OPEN))


def escape_role(role: Column) -> Column:
    """A role ends at the first line feed, so its own become a marker."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def chat_format(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_mask (array of start, length) of each conversation."""
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    parts = turns.withColumn("parts", F.transform("turns", lambda t, i: F.struct(
        F.when((i > 0) & (role_at(i - 1) == t["role"]), F.lit(PART)).otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).alias("before"),
        escape(t["text"]).alias("text"),
        F.when(role_at(i + 1) == t["role"], F.lit("")).otherwise(F.lit(END)).alias("after"),
        (t["role"] == loss_role).alias("loss"),
    )))
    each = parts.select("conv_id", F.posexplode("parts").alias("i", "p")).select("conv_id", "i", "p", F.length("p.before").alias("b"), F.length("p.text").alias("t"), F.length("p.after").alias("a"))
    order = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("start", F.sum(F.col("b") + F.col("t") + F.col("a")).over(order) - F.col("t") - F.col("a"))
    packed = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", F.concat("p.before", "p.text", "p.after").alias("piece"), F.col("p.loss").alias("loss"), "start", F.col("t").cast("long").alias("length")))).alias("all"))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted string was made of."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block))
        name = unescape_role(F.substring(role, F.lit(len(START) + 1), F.length(role)))
        return F.transform(F.split(body, r"<\|part\|>"), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(out: DataFrame) -> DataFrame:
    """Of a formatted table, what reading it back gives."""
    out = out.withColumn("turns", read_turns(F.col("formatted")))
    out = out.withColumn("loss", F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), ""))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that is added to the table: both turns hold another template's control strings.
ADDED_ID, ADDED_TEXT = -1, "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    return digests(chat_format(rows.unionByName(added)))


ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
n AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
l AS (SELECT *, length(replace(text, '<|', '<||'))
  + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 13 + length(replace(replace(role, '<|', '<||'), chr(10), '<|line|>')) END
  + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 11 END AS chars FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
