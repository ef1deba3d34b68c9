"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example: all turns before it as context, its reply as the only trainable span. Turns
after the last assistant turn make one example without a target, so that the output holds each conversation whole.

A turn reads `<turn>role<says>text<done>`. Inside roles and texts `\\`, `<` and `[` are written `\\s`, `\\l` and `\\b`, so no
control string of this or of another template (</s>, [INST]) can appear in a text; reading undoes that.

Cases: null texts and roles are empty; turns are ordered by turn (null first), then role and text, so repeated rows
and ties keep a defined order; each row with a null conv_id is a conversation of its own, as nothing says which rows
belong together; long texts are never cut; an example holds its whole context, as the method asks, so a conversation's
output grows with the square of its turns; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, DONE = "<turn>", "<says>", "<done>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_len): formatted text of each example and its trainable span in
    code points, from 0; loss_start and loss_len are null where an example has no target."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), e(role).alias("role"), e(text).alias("text")).alias("t"))
    chats = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.union(rows.where("conv_id is null").select("conv_id", F.array("t")))
    head = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SAYS))
    parts = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("asks"), F.char_length(head(t)).alias("skip"), F.char_length(escaped(t["text"])).alias("size"), F.concat(head(t), escaped(t["text"]), F.lit(DONE)).alias("said")))
    chats = chats.select("conv_id", parts.alias("parts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i)["asks"] | (i == F.size("parts")))
    one = chats.select("conv_id", "parts", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("parts", F.col("end"))
    body = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("end")), lambda p: p["said"]), "")
    one = one.select("conv_id", "example", body.alias("formatted"), last["asks"].alias("asks"), last["size"].alias("size"))
    start = F.char_length("formatted") - F.col("size") - F.lit(len(DONE))
    return one.select("conv_id", "example", "formatted", F.when(F.col("asks"), start).alias("loss_start"), F.when(F.col("asks"), F.col("size")).alias("loss_len"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    said = F.filter(F.split(formatted, DONE), lambda x: x != "")
    return F.transform(said, lambda x: F.struct(unescaped(F.replace(F.substring_index(x, SAYS, 1), F.lit(TURN), F.lit(""))).alias("role"), unescaped(F.substring_index(x, SAYS, -1)).alias("text")))


def read_loss(formatted: Column, start: Column, size: Column) -> Column:
    return unescaped(F.substring(formatted, start + 1, size))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what is read back from its examples; only the last one's turns and each one's target travel."""
    loss = F.coalesce(read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_len")), F.lit(""))
    rows = examples.select("conv_id", "example", F.char_length("formatted").cast("long").alias("chars"), loss.alias("loss"), "formatted")
    one = F.struct("example", "loss")
    out = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("losses"), F.max_by("formatted", "example").alias("whole"), F.sum("chars").alias("formatted_chars"))
    # conversations without an id are one row and so one example each
    out = out.union(rows.where("conv_id is null").select("conv_id", F.array(one), "formatted", "chars"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    turns = read_turns(F.col("whole"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest(format_chats(chats.unionByName(more)))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL
), l AS (
  SELECT *, length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '[', '\b')) + length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '[', '\b')) + 18 AS n,
    row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id, own) AS m FROM c
), p AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, own ORDER BY i) AS upto FROM l
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = m)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id, own
"""
