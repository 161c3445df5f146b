"""Preference formatting of conversations, in built-in functions only.

A pair is two conversations, chosen and rejected. Their longest common prefix of
turns (same role and text) is rendered once as the prompt; what follows on each
side is its completion, with the character spans of the assistant's texts, the
only ones that count for a loss. A turn is rendered as
``<|role|>\\ntext<|end|>\\n``.

``natural_pairs`` makes the pairs where none are given: chosen is a conversation
up to its last assistant turn, rejected the same with the last reply of another
conversation in that turn. Conversations are dealt by hash into parts of about
``GROUP``; the reply comes from the next one by conv_id in the part (from the
first, after the last), so no task sees all conversations. A conversation that
has no reply to lend or to replace has no rejected side; none is dropped.

Cases: turns are ordered by turn, role, text (nulls first); null roles and texts
are empty; repeated turns are turns; rows without a conv_id form one
conversation; equal replies leave empty completions; an empty table gives no
rows; further columns are not read. A conversation is one row of the result, so
its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm.mixing import unit_hash

GROUP = 64
ANSWERS = "assistant"


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order as structs of role and text."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return lists.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def last_answer(turns: Column) -> Column:
    """Place of the last assistant turn from 1, or 0."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == ANSWERS, i + 1).otherwise(0))), F.lit(0))


def natural_pairs(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected): the sides' turns; rejected is null where there is none."""
    total = conversations.agg(F.greatest(F.ceil(F.count("*") / group), F.lit(1)).cast("long")).scalar()
    placed = conversations.withColumns({"part": unit_hash(F.col("conv_id")) % total, "place": last_answer(F.col("turns"))})
    placed = placed.withColumn("reply", F.when(F.col("place") > 0, F.get(F.col("turns.text"), F.col("place") - 1)))
    w = Window.partitionBy("part").orderBy("conv_id")
    own = F.struct(F.col("conv_id").alias("id"), F.col("reply").alias("reply"))
    donor = F.when(F.count("*").over(Window.partitionBy("part")) > 1, F.coalesce(F.lead(own).over(w), F.first(own).over(w)))
    lent = placed.withColumn("donor", donor).withColumn("able", (F.col("place") > 0) & F.col("donor.reply").isNotNull())
    cut = F.when(F.col("place") > 0, F.slice("turns", F.lit(1), F.col("place"))).otherwise(F.col("turns"))
    swapped = F.concat(F.slice("turns", F.lit(1), F.greatest(F.col("place") - 1, F.lit(0))), F.array(F.struct(F.lit(ANSWERS).alias("role"), F.col("donor.reply").alias("text"))))
    return lent.select(F.col("conv_id").alias("chosen_id"), cut.alias("chosen"), F.when(F.col("able"), F.col("donor.id")).alias("rejected_id"), F.when(F.col("able"), swapped).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two lists share from the start."""
    both = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: F.get(a, i - 1) == F.get(b, i - 1)), False)
    return F.when(both < 1, 0).when(differs > 0, F.least(differs - 1, both)).otherwise(both).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def answer_spans(turns: Column) -> Column:
    """Start and end of each assistant text in ``rendered(turns)``, as 'start:end' joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begins = acc["at"] + F.char_length(t["role"]) + 5
        ends = begins + F.char_length(t["text"])
        span = F.concat(begins.cast("string"), F.lit(":"), ends.cast("string"))
        spans = F.when(t["role"] == ANSWERS, F.concat_ws(",", F.when(acc["spans"] != "", acc["spans"]), span)).otherwise(acc["spans"])
        return F.struct((ends + 8).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """Prompt, completions and masks of every pair (chosen_id, chosen, rejected_id, rejected)."""
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    p = pairs.withColumn("n_common", F.when(F.col("rejected").isNull(), 0).otherwise(common_turns(F.col("chosen"), F.col("rejected"))))
    p = p.withColumn("rejected", F.coalesce("rejected", none))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    p = p.select("chosen_id", "rejected_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("prompt"), rest("chosen").alias("chosen_rest"), rest("rejected").alias("rejected_rest"))
    return p.select(
        "chosen_id", "rejected_id", "n_common", rendered(F.col("prompt")).alias("prompt"),
        rendered(F.col("chosen_rest")).alias("chosen_completion"), answer_spans(F.col("chosen_rest")).alias("chosen_loss"),
        rendered(F.col("rejected_rest")).alias("rejected_completion"), answer_spans(F.col("rejected_rest")).alias("rejected_loss"),
    )


def op8_chat_preferences(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return formatted(natural_pairs(gathered(turns)))


ORACLE = r"""
WITH lists AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations GROUP BY conv_id),
placed AS (
  SELECT *, ('0x' || substr(md5(coalesce(conv_id::VARCHAR, '')), 1, 15))::BIGINT % greatest(ceil((SELECT count(*) FROM lists) / 64.0), 1)::BIGINT AS part,
         coalesce(list_max(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN ts[i].role = 'assistant' THEN i ELSE 0 END)), 0) AS place FROM lists),
replies AS (SELECT *, CASE WHEN place > 0 THEN ts[place].text END AS reply FROM placed),
lent AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY part) > 1 THEN CASE WHEN row_number() OVER w < count(*) OVER (PARTITION BY part) THEN lead(reply) OVER w ELSE first_value(reply) OVER w END END AS donor,
         CASE WHEN row_number() OVER w < count(*) OVER (PARTITION BY part) THEN lead(conv_id) OVER w ELSE first_value(conv_id) OVER w END AS donor_id
  FROM replies WINDOW w AS (PARTITION BY part ORDER BY conv_id ASC NULLS FIRST)),
pairs AS (
  SELECT conv_id AS chosen_id, CASE WHEN place > 0 THEN ts[1:place] ELSE ts END AS a, CASE WHEN place > 0 AND donor IS NOT NULL THEN donor_id END AS rejected_id,
         CASE WHEN place > 0 AND donor IS NOT NULL THEN list_concat(ts[1:place - 1], [{'role': 'assistant', 'text': donor}]) ELSE [] END AS b FROM lent),
counted AS (
  SELECT *, CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE
    coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) END AS n
  FROM pairs),
cut AS (SELECT chosen_id, rejected_id, n::INT AS n_common, a[1:n] AS p, a[n + 1:] AS c, b[n + 1:] AS r FROM counted)
SELECT chosen_id, rejected_id, n_common,
  coalesce(list_aggregate(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS chosen_completion,
  coalesce(list_aggregate(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(c[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(c[i].role) + 5)::BIGINT::VARCHAR || ':' ||
    (coalesce(list_sum(list_transform(c[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(c[i].role) + 5 + length(c[i].text))::BIGINT::VARCHAR), 'string_agg', ','), '') AS chosen_loss,
  coalesce(list_aggregate(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS rejected_completion,
  coalesce(list_aggregate(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(r[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(r[i].role) + 5)::BIGINT::VARCHAR || ':' ||
    (coalesce(list_sum(list_transform(r[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length(r[i].role) + 5 + length(r[i].text))::BIGINT::VARCHAR), 'string_agg', ','), '') AS rejected_loss
FROM cut
"""
