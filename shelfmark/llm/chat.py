"""Preference formatting: a shared prompt and two masked completions for each pair.

The longest common prefix of turns (equal role and text) of the chosen and the
rejected conversation is rendered once as the prompt. What follows in each is
its completion, with the ranges of characters that are trained on: the texts of
assistant turns and the mark that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template of a turn: role, then text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as an array of (turn, role, text).

    Null roles are read as "", null texts as "", null turn numbers come first.
    Rows alike in number are ordered by role and text, and repeated rows are
    turns of their own. Rows without a conversation are left out.
    """
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def trained_ranges(turns: Column) -> Column:
    """Character ranges (start, stop) of the rendered turns that are trained on."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t))
        stop = start + F.length(t["text"]) + len(CLOSE)
        out = F.when(t["role"] == TRAINED_ROLE, F.array_append(state["out"], F.struct(start.alias("start"), stop.alias("stop")))).otherwise(state["out"])
        return F.struct(stop.alias("at"), out.alias("out"))

    return F.aggregate(turns, empty, step, lambda state: state["out"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """All columns of pairs but chosen and rejected (arrays of turns), and prompt_turns, prompt,
    chosen, chosen_mask, rejected and rejected_mask.

    Columns of pairs with these names are replaced; all others stay. A null
    conversation counts as one without turns. Two equal conversations give two
    empty completions. Pairs are formatted one by one, so repeated ones too; an
    empty table gives an empty one. Texts are rendered whole, however long.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected", "prompt_turns", "prompt", "chosen_mask", "rejected_mask")]
    # Other columns go under names of their own until the end, so that none can clash.
    names = [f"c{i}" for i in range(len(kept))]
    both = pairs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept, names)], F.coalesce("chosen", none).alias("_c"), F.coalesce("rejected", none).alias("_r"))
    shorter = F.least(F.size("_c"), F.size("_r"))

    def differs(i: Column) -> Column:
        c, r = F.get("_c", i), F.get("_r", i)
        return (c["role"] != r["role"]) | (c["text"] != r["text"])

    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    both = both.withColumn("prompt_turns", F.coalesce(F.get(F.filter(places, differs), 0), shorter).cast("int"))
    c, r = (F.slice(x, F.col("prompt_turns") + 1, F.size(x)) for x in ("_c", "_r"))
    c, r = (F.when(F.size(x) > F.col("prompt_turns"), y).otherwise(none) for x, y in (("_c", c), ("_r", r)))
    done = both.select(
        *names, "prompt_turns", render(F.slice("_c", F.lit(1), F.col("prompt_turns"))).alias("prompt"), render(c).alias("chosen"), trained_ranges(c).alias("chosen_mask"), render(r).alias("rejected"), trained_ranges(r).alias("rejected_mask")
    )
    return done.toDF(*kept, *done.columns[len(kept) :])


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, rejected): conversations 2 k and 2 k + 1 as a pair, where both exist.

    Repeated rows are turns of their own, an empty table gives no pair, and other columns are not looked at.
    """
    own = conversations(turns)
    side = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    pair = own.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).agg(
        F.max(F.when(side, F.struct("conv_id", "turns"))).alias("c"), F.max(F.when(~side, F.struct("conv_id", "turns"))).alias("r")
    )
    return pair.where("c is not null and r is not null").select("pair_id", F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.col("c.turns").alias("chosen"), F.col("r.turns").alias("rejected"))


def _mask_text(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"))), ",")


def formatted(turns: DataFrame) -> DataFrame:
    """The preference pairs of neighbouring conversations, masks as text."""
    done = format_preferences(neighbour_pairs(turns))
    return done.select("pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", _mask_text("chosen_mask").alias("chosen_mask"), "rejected", _mask_text("rejected_mask").alias("rejected_mask"))


FORMATTED_SQL = """
WITH t AS (
  SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT pair_id, max(conv_id) FILTER (WHERE side = 0) AS chosen_id, max(conv_id) FILTER (WHERE side = 1) AS rejected_id FROM t GROUP BY pair_id),
ok AS (SELECT * FROM p WHERE chosen_id IS NOT NULL AND rejected_id IS NOT NULL),
n AS (SELECT pair_id, least(count(*) FILTER (WHERE side = 0), count(*) FILTER (WHERE side = 1)) AS shorter FROM t GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.pos) AS first_diff FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side = 1
      WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
k AS (SELECT ok.*, coalesce(d.first_diff - 1, n.shorter) AS prompt_turns FROM ok JOIN n USING (pair_id) LEFT JOIN d USING (pair_id)),
r AS (SELECT t.*, k.prompt_turns, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body FROM t JOIN k USING (pair_id)),
m AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM r WHERE pos > prompt_turns),
c AS (SELECT conv_id, string_agg(body, '' ORDER BY pos) AS body,
      string_agg((spot + length(head))::BIGINT || ':' || (spot + length(body))::BIGINT, ',' ORDER BY pos) FILTER (WHERE role = 'assistant') AS mask FROM m GROUP BY conv_id),
q AS (SELECT conv_id, string_agg(body, '' ORDER BY pos) AS prompt FROM r WHERE pos <= prompt_turns GROUP BY conv_id)
SELECT k.pair_id, k.chosen_id, k.rejected_id, k.prompt_turns, coalesce(q.prompt, '') AS prompt, coalesce(x.body, '') AS chosen, coalesce(x.mask, '') AS chosen_mask,
       coalesce(y.body, '') AS rejected, coalesce(y.mask, '') AS rejected_mask
FROM k LEFT JOIN q ON q.conv_id = k.chosen_id LEFT JOIN c x ON x.conv_id = k.chosen_id LEFT JOIN c y ON y.conv_id = k.rejected_id
"""
