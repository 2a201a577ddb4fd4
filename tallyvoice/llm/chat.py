"""Chat formatting after a cumulative-snapshot collapse (operator 7), with DataFrame functions only.

Logged conversations are often snapshots: each holds the turns of the one before and some more. Every
turn gets a hash of its position, role and text; the running exclusive-or of these is the rolling hash
of each turn prefix (two of 64 bits). A conversation whose whole hash is the hash of a proper prefix
of another is dropped by an anti-join, of equal ones the smallest id stays, and the rest are rendered.

Positions and running hashes are computed per block of ``BLOCK`` turn numbers, then carried over the
blocks of a conversation, so that the longest window is a block and one row per block; prefix hashes
are made distinct before the join, so a very common first turn is one row. Only rendering gathers a
conversation in one row, which is its result.

Defined results: turns are ordered by number (nulls first), role and text; a repeated row counts
once; null roles and texts read as empty; rows with a null conv_id are one conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024
#: A rendered turn: role, then text.
TURN = "<|start|>{role}\n{text}<|end|>\n"


def turns_with_prefixes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, position from 1, role, text, and the hashes h1 and h2 of the prefix that ends here."""
    rows = conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    sizes = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))
    sizes = sizes.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), "before")
    same = lambda: F.col("conv").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))
    rows = rows.withColumn("at", F.row_number().over(inside)).join(sizes, same()).select(
        "conv", "block", (F.col("at") + F.col("before")).alias("position"), "role", "text"
    )
    marked = rows.withColumns(
        {"x1": F.xxhash64("position", "role", "text"), "x2": F.xxhash64("text", "position", F.lit(7), "role")}
    )
    totals = marked.groupBy("conv", "block").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    carried = totals.select(
        F.col("conv").alias("_c"), F.col("block").alias("_b"),
        *[F.coalesce(F.bit_xor(f"t{k}").over(earlier), F.lit(0).cast("long")).alias(f"c{k}") for k in (1, 2)],
    )
    running = Window.partitionBy("conv", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(carried, same()).select(
        "conv", "position", "role", "text",
        *[F.bit_xor(f"x{k}").over(running).bitwiseXOR(F.col(f"c{k}")).alias(f"h{k}") for k in (1, 2)],
    )


def maximal(turns: DataFrame) -> DataFrame:
    """Ids and lengths of the conversations that no other one begins with; of equal ones the first."""
    lengths = turns.groupBy("conv").agg(F.max(F.struct("position", "h1", "h2")).alias("last"))
    whole = lengths.groupBy("last.position", "last.h1", "last.h2").agg(F.min("conv").alias("conv"))
    last = lengths.select(F.col("conv").alias("_c"), F.col("last.position").alias("n"))
    proper = (
        turns.join(last, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("position") < F.col("n")))
        .select("position", "h1", "h2").distinct()
    )
    return whole.join(proper, ["position", "h1", "h2"], "left_anti").select("conv", F.col("position").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, template: str = TURN) -> DataFrame:
    """conv, n_turns and the rendered text of each kept conversation."""
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    said = F.concat(F.lit(head), F.col("role"), F.lit(middle), F.col("text"), F.lit(tail))
    chosen = kept.select(F.col("conv").alias("_c"), "n_turns")
    return (
        turns.join(chosen, F.col("conv").eqNullSafe(F.col("_c")))
        .groupBy("conv", "n_turns")
        .agg(F.sort_array(F.collect_list(F.struct("position", said.alias("said")))).alias("turns"))
        .select("conv", "n_turns", F.array_join("turns.said", "").alias("text"))
    )


def format_chats(conversations: DataFrame, conv: str = "conv_id", template: str = TURN, **columns) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, text."""
    turns = turns_with_prefixes(conversations, conv, **columns)
    return render(turns, maximal(turns), template).withColumnRenamed("conv", conv)


def report(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations).select(
        "conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


#: The query in DuckDB: conversations as lists of turns, a list that begins a longer or an earlier equal one goes.
SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), convs AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|start|>' || role || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said
  FROM turns GROUP BY conv_id
), prefixes AS (
  SELECT t.conv_id, string_agg('<|start|>' || role || chr(10) || text || '<|end|>' || chr(10), '')
         OVER (PARTITION BY t.conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS said
  FROM turns t
), proper AS (
  SELECT DISTINCT md5(p.said) AS h FROM prefixes p JOIN convs c USING (conv_id) WHERE length(p.said) < length(c.said)
), firsts AS (
  SELECT min(conv_id) AS conv_id, n_turns, said FROM convs GROUP BY n_turns, said
)
SELECT conv_id, n_turns, length(said)::BIGINT AS n_chars, sha256(said) AS text_sha256
FROM firsts WHERE md5(said) NOT IN (SELECT h FROM proper)
"""
