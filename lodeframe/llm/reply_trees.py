"""Chat formatting of reply trees, in DataFrame operations alone.

A message table ``(tree, node, parent, role, text, score)`` holds trees of replies. Iterative self-joins double, round by round,
how far each message sees towards its root, and so find every root-to-leaf path's depth and summed score in as many rounds as
the logarithm of the longest path. Branches are ranked within their tree by score; the chosen leaves then walk back along the
same doubled pointers, the longest first, which enumerates their paths. Each path is formatted as one conversation.

The template wraps a turn as ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside roles and texts, of this template and of others
in use, get a backslash behind their first character, and backslashes are doubled, so that what was written can be read
back. The loss mask is an array of ``[start, end)`` intervals of code points of the formatted text: the assistant's texts.

Defined results: a null role or text is empty; a null score counts 0; a message whose parent isn't in its tree is a root; rows
that repeat a ``(tree, node)`` keep the one smallest by role and text; equal branch scores rank by their leaf; messages on a
cycle have no root and so no path; a null ``tree`` is a tree like others; a message whose node is null is left out; an empty
table gives an empty result; other columns are left out. In ``from_turns`` the rows of a conversation follow one another by
turn, ties by role and text, and none is lost.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import written
from lodeframe.storage import kept_counting

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings that are never left bare in a text, by first character and rest. These are fixed values.
CONTROL = [("<", "|"), ("<", "s>"), ("<", "/s>"), ("<", "<SYS>>"), ("<", "</SYS>>"), ("[", "INST]"), ("[", "/INST]")]
#: Tables of messages that have reached their root, by round, before they are written as one.
SEEN_TABLES = 3
_REST = "|".join(re.escape(rest) for _, rest in CONTROL)


def escape(text: Column) -> Column:
    """Reversible: after doubling, backslashes come in even runs, so a single one behind < or [ can only be the mark."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(<|\\[)({_REST})", "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, f"(<|\\[)\\\\({_REST})", "$1$2"), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends at its line's end, so line ends in it are marked too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Undo from the left: an even run of backslashes before n is text, an odd one ends in the mark of a line end.
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def from_turns(turns: DataFrame) -> DataFrame:
    """A table ``(conv_id, turn, role, text)`` as trees without branches: each row replies to the one before it."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _unique(messages: DataFrame) -> DataFrame:
    role, text = (F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    rows = messages.where("node IS NOT NULL").select("tree", "node", "parent", role, text, score)
    first = F.row_number().over(Window.partitionBy("tree", "node").orderBy("role", "text", "parent", "score"))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def _union(tables: list[DataFrame]) -> DataFrame:
    """Written tables as one, by a single scan where their types are the same."""
    if any(x.dtypes != tables[0].dtypes for x in tables):
        return reduce(DataFrame.unionByName, tables)
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(getattr(x, "_kept_at", None) or x._written_at for x in tables))


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that sorts both sides. Spark goes by the size of files, and pointers make small files of many rows: broadcast, all
    of these would pass through the driver."""
    return left.join(right.hint("merge"), on, how)


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree: ``(tree, leaf, branch, branch_score, depth, node)``, where ``depth``
    counts from 0 at the root."""
    # Within a struct, a null tree equals itself.
    nodes = messages.select(F.struct("tree").alias("tree"), "node", "parent", "score")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    links = _met(nodes, known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), "score")
    # A message's state: the one that it sees, none if it sees past its root; score and number of messages on the way, that
    # one excluded. hops[k]: the messages with another 2**k steps up. Only these go on to the next round.
    start = links.select("tree", "node", "up", "score", F.lit(1).cast("long").alias("size"))
    state, going_on = kept_counting(start, "up IS NOT NULL", False)
    states, seen, hops = [state], [state], []
    # A path is no longer than the table, so what still goes on after these rounds is on a cycle.
    rounds = state.count().bit_length()
    while going_on and len(hops) < rounds:
        going = state.where("up IS NOT NULL")
        hops.append(going)
        if len(seen) > SEEN_TABLES:
            # Only trees with messages on their way are looked up again.
            seen = [written(_met(_union(seen).where("up IS NULL"), going.select("tree").distinct(), ["tree"], "left_semi"), "reply-seen", False)]
        ahead = going.unionByName(_union(seen).where("up IS NULL")).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("size").alias("_size"))
        further = _met(going, ahead, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("size") + F.col("_size")).alias("size"))
        state, going_on = kept_counting(further, "up IS NOT NULL", False)
        states.append(state)
        seen.append(state)
    ends = _union(states).where("up IS NULL")
    leaves = _met(ends, states[0].where("up IS NOT NULL").select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    walk = chosen.select("tree", F.col("node").alias("leaf"), F.col("branch").cast("long").alias("branch"), F.col("score").alias("branch_score"), (F.col("size") - 1).alias("depth"), "node")
    for k, hop in reversed([*enumerate(hops)]):
        walk = _met(walk, hop.select("tree", "node", F.col("up").alias("_up"), F.col("size").alias("_steps")), ["tree", "node"], "left")
        # Each row stays, and is followed by the one that it sees, so a plan names the walk so far once.
        here, higher = F.struct("depth", "node"), F.struct((F.col("depth") - F.col("_steps")).alias("depth"), F.col("_up").alias("node"))
        walk = walk.select("tree", "leaf", "branch", "branch_score", F.inline(F.filter(F.array(here, higher), lambda x: x["node"].isNotNull())))
        # The last hop, a single step, goes on unwritten.
        walk = written(walk, "reply-walk", False) if k else walk
    return walk.withColumn("tree", F.col("tree.tree"))


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row a path: ``(tree, leaf, branch, formatted, loss_mask)``."""
    said = messages.select(F.struct("tree").alias("tree"), "node", "role", "text")
    turns = _met(chosen.withColumn("tree", F.struct("tree")), said, ["tree", "node"]).withColumn("tree", F.col("tree.tree"))
    turns = turns.withColumn("_head", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))).withColumn("_body", escape(F.col("text")))
    # A path is one row of the result, so its turns meet in one group; trees without end have no formatted form.
    rows = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "_head", "_body", (F.col("role") == "assistant").alias("_loss")))).alias("_turns"))
    formatted = F.array_join(F.transform("_turns", lambda x: F.concat(x["_head"], x["_body"], F.lit(END))), "")
    state = "struct<at:bigint,mask:array<struct<start:bigint,end:bigint>>>"

    def step(acc, x):
        start = acc["at"] + F.length(x["_head"])
        end = start + F.length(x["_body"])
        mask = F.when(x["_loss"], F.concat(acc["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["mask"])
        return F.struct((end + F.length(F.lit(END))).alias("at"), mask.alias("mask"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")).cast(state)
    mask = F.aggregate("_turns", first, lambda a, x: step(a, x).cast(state), lambda a: a["mask"])
    return rows.select("tree", "leaf", "branch", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The formatted rows with ``turns``, an array of role and text, and ``loss_text``, the text under the mask, both parsed from
    the formatted text alone and unescaped."""
    pieces = F.slice(F.split("formatted", re.escape(TURN)), 2, 1 << 30)

    def turn(piece):
        # The first line end closes the role; the end mark closes the text.
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(1), cut - 1)
        text = F.substring(piece, cut + 1, F.length(piece) - cut - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    under = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int")))), "")
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), under.alias("loss_text"))


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best branches of reply trees, formatted."""
    messages = _unique(messages)
    return format_paths(messages, paths(messages, branches))


def reply_trees_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{ok}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = written(from_turns(turns), "reply-messages", False)
    rows = read_back(format_paths(messages, paths(messages)))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Of the longest UTF-8 texts too, DuckDB's sha256 digests bytes as Spark's sha2 does.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g') AS body,
    replace(regexp_replace(replace(role, '\', '\\'), '(<|\[)(\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g'), chr(10), '\n') AS head
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<|turn|>' || head || chr(10) || body || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
