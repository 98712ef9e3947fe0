"""Preference formatting: one shared prompt and two masked completions.

A pair of conversations is compared turn by turn.  The longest common turn
prefix is rendered once as the prompt; what follows in either conversation is
rendered as its completion.  A mask says which characters of a completion are
trained on: those of assistant turns, end mark included, header excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "op1_preference_format"
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


#: What would look like a mark inside a role or a text, and what is written for it.
MARK, ESCAPED = "<|im_", r"<\|im_"
FIRST = -(1 << 62)


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(ESCAPED))


def _turn(turn: Column, role: Column, text: Column) -> list[Column]:
    """Turn, role and text without nulls; a line break in a role is a blank, so that it ends where the header does."""
    role = F.translate(F.coalesce(role, F.lit("")), "\n\r", "  ")
    return [F.coalesce(turn.cast("bigint"), F.lit(FIRST)).alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text")]


def _render(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), _safe(t["role"]), F.lit(MIDDLE), _safe(t["text"]), F.lit(CLOSE))), ""
    )


def _mask(turns: Column, trained: str) -> Column:
    """'start:end' of every trained stretch of the rendered turns, in characters."""
    head = F.lit(len(OPEN) + len(MIDDLE))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head + F.length(_safe(t["role"]))
        end = begin + F.length(_safe(t["text"])) + F.lit(len(CLOSE))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        grown = F.when(t["role"] == trained, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["out"], " "))


def _formatted(sides: DataFrame, trained: str) -> DataFrame:
    """Rows (pair_id, c, r), c and r being arrays of turns in order, to the formatted pair."""
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.filter(
        F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.element_at("c", i)["role"] != F.element_at("r", i)["role"])
        | (F.element_at("c", i)["text"] != F.element_at("r", i)["text"]),
    )
    g = sides.withColumn("n", F.when(F.size(differs) > 0, F.element_at(differs, 1) - 1).otherwise(shorter))
    tail = lambda x: F.slice(F.col(x), F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    g = g.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), tail("c").alias("c"), tail("r").alias("r"))
    return g.select(
        "pair_id",
        F.col("n").cast("bigint").alias("n_common"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _mask(F.col("c"), trained).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("r"), trained).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", trained: str = "assistant") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) of every pair.

    ``chosen`` and ``rejected`` hold one row a turn: pair, turn, role, text;
    other columns are ignored, whatever their names.  Both sides are gathered
    in one grouping on the pair, the only shuffle; a pair is one row of the
    result, so its turns must fit in a row.  Turns are taken in the order
    (turn, role, text); repeated rows are turns of their own.  A null role or
    text counts as empty, a null turn sorts first, rows of a null pair are
    passed over.  A pair that only one side has gets an empty prompt and an
    empty completion for the other.  Turns agree if role and text agree; their
    numbers need not.  Empty tables give no rows.

    Roles and texts can't forge marks: "<|im_" inside them is written "<\\|im_",
    and a line break in a role is a blank.  Turns are compared as they are, and
    masks count what is written.
    """

    def side(df: DataFrame, kind: str) -> DataFrame:
        cols = _turn(F.col("turn"), F.col("role"), F.col("text"))
        return df.select(F.col(pair).alias("pair_id"), F.lit(kind).alias("kind"), *cols).where("pair_id is not null")

    def turns(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("turn", "role", "text"))))

    both = side(chosen, "c").unionByName(side(rejected, "r"))
    return _formatted(both.groupBy("pair_id").agg(turns("c").alias("c"), turns("r").alias("r")), trained)


def rival_replies(conversations: DataFrame) -> DataFrame:
    """(pair_id, c, r): the turns of both sides of pairs made of plain conversations.

    Chosen is each conversation up to its last assistant turn.  Rejected has
    the same history and then the last assistant turn of the conversation whose
    id differs in the lowest bit; where that has none, the history alone.
    A conversation without an assistant turn is its own prompt.  Two rivals are
    gathered in one group, so a conversation is read and sent once.
    """
    turn = _turn(F.col("turn"), F.col("role"), F.col("text"))
    c = conversations.select(F.col("conv_id").cast("bigint").alias("id"), *turn).where("id is not null")
    g = c.groupBy(F.shiftright("id", 1).alias("both")).agg(F.array_sort(F.collect_list(F.struct("id", "turn", "role", "text"))).alias("t"))
    g = g.select("t", F.explode(F.array_distinct(F.transform("t", lambda x: x["id"]))).alias("pair_id"))

    def replies(own: bool) -> Column:
        mine = lambda x: (x["id"] == F.col("pair_id")) if own else (x["id"] != F.col("pair_id"))
        said = F.filter("t", lambda x: mine(x) & (x["role"] == "assistant"))
        return F.array_max(F.transform(said, lambda x: F.struct(x["turn"].alias("turn"), x["text"].alias("text"))))

    g = g.select("pair_id", "t", replies(True).alias("last"), replies(False).alias("rival"))
    plain = lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"))
    until = lambda keep: F.transform(F.filter("t", lambda x: (x["id"] == F.col("pair_id")) & (F.col("last").isNull() | keep(x))), plain)
    reply = F.struct(F.col("last.turn").alias("turn"), F.lit("assistant").alias("role"), F.col("rival.text").alias("text"))
    history = until(lambda x: x["turn"] < F.col("last.turn"))
    rejected = F.when(F.col("last").isNotNull() & F.col("rival").isNotNull(), F.array_append(history, reply)).otherwise(history)
    return g.select("pair_id", until(lambda x: x["turn"] <= F.col("last.turn")).alias("c"), F.array_sort(rejected).alias("r"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair against a rival reply."""
    return _formatted(rival_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "assistant")


SQL = r"""
WITH c AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, translate(coalesce(role, ''), chr(10) || chr(13), '  ') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS lt, max_by(text, turn) AS ltext FROM c WHERE role = 'assistant' GROUP BY conv_id),
side AS (
  SELECT c.conv_id AS pair_id, 'c' AS kind, c.turn, c.role, c.text FROM c LEFT JOIN last USING (conv_id) WHERE lt IS NULL OR turn <= lt
  UNION ALL
  SELECT c.conv_id, 'r', c.turn, c.role, c.text FROM c LEFT JOIN last USING (conv_id) WHERE lt IS NULL OR turn < lt
  UNION ALL
  SELECT a.conv_id, 'r', a.lt, 'assistant', b.ltext FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
num AS (SELECT *, row_number() OVER (PARTITION BY pair_id, kind ORDER BY turn, role, text) AS i FROM side),
cmp AS (SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.i, y.i) AS i, x.i IS NOT NULL AND y.i IS NOT NULL AND x.role = y.role AND x.text = y.text AS same
  FROM (SELECT * FROM num WHERE kind = 'c') x FULL JOIN (SELECT * FROM num WHERE kind = 'r') y ON x.pair_id = y.pair_id AND x.i = y.i),
pre AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS n FROM cmp GROUP BY pair_id),
ren AS (SELECT num.* REPLACE (replace(role, '<|im_', '<\|im_') AS role), n, '<|im_start|>' || replace(role, '<|im_', '<\|im_') || chr(10) || replace(text, '<|im_', '<\|im_') || '<|im_end|>' || chr(10) AS s FROM num JOIN pre USING (pair_id)),
pos AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM ren WHERE i > n)
SELECT pre.pair_id, CAST(pre.n AS BIGINT) AS n_common,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM ren WHERE ren.pair_id = pre.pair_id AND kind = 'c' AND i <= ren.n), '') AS prompt,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM pos WHERE pos.pair_id = pre.pair_id AND kind = 'c'), '') AS chosen,
  coalesce((SELECT string_agg(CAST(ofs + 13 + length(role) AS BIGINT) || ':' || CAST(ofs + length(s) AS BIGINT), ' ' ORDER BY i) FROM pos WHERE pos.pair_id = pre.pair_id AND kind = 'c' AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM pos WHERE pos.pair_id = pre.pair_id AND kind = 'r'), '') AS rejected,
  coalesce((SELECT string_agg(CAST(ofs + 13 + length(role) AS BIGINT) || ':' || CAST(ofs + length(s) AS BIGINT), ' ' ORDER BY i) FROM pos WHERE pos.pair_id = pre.pair_id AND kind = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM pre
"""
