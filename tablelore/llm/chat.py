r"""Conversations out of reply trees, and their template.

Messages answer messages, so a tree of them holds as many conversations as it has leaves.
Self-joins, each of which reaches twice as far up as the one before, give every message its
place below the root and the score of its branch; the best branches of a tree are chosen,
and the same joins, taken backwards from the chosen leaves, list their messages. The text
moves once, when a chosen path is written out. Everything is DataFrame expressions.

A formatted turn is ``### role: text </turn>`` and a line break. Control strings in texts
get one more backslash before them, so that no text can end its turn or begin another, and
lose it again when read. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelore.session import write_once

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = r"(###|</turn>)"
#: Roles whose texts are learned.
LEARNED = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + _CONTROL, r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + _CONTROL, "$1$2")


def linear(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Messages of a table of turns: each answers the one before it in its conversation.

    Null roles and texts are empty. Turns go by number, a null one first; rows of the same
    turn by role and text.
    """
    named = rows.select(
        F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return named.select("tree", place.alias("id"), F.when(place > 1, place - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same_tree(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def _climb(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """How far every message is below its root, and tables that lead up from it.

    Table k is ``(tree, id, up, n, total)`` of the messages that have one 2 ** k messages
    above, named ``up``; ``n`` and ``total`` count and add up the scores from ``id`` to below
    it. The other result is ``(tree, id, n, total)``, up to the root. Messages that have
    reached it are not looked at again, so a few long conversations cost no more than they
    hold. Those that lead into a circle never reach one.
    """
    parents = links.select("tree", F.col("id").alias("up"))
    joined = links.alias("a").join(parents.alias("b"), _same_tree("a", "b") & (F.col("a.parent") == F.col("b.up")), "left")
    state = write_once(joined.select("a.tree", "a.id", "b.up", F.lit(1).cast("long").alias("n"), F.col("a.score").alias("total")), "chat-climb")
    most, levels, rooted = links.count(), [], None
    while True:
        there = state.where("up is null").drop("up")
        rooted = there if rooted is None else rooted.union(there)
        open_ = state.where("up is not null")
        if open_.isEmpty() or 1 << len(levels) > most:
            return levels, rooted
        levels.append(open_)
        known = open_.union(rooted.select("tree", "id", F.lit(None).cast(links.schema["id"].dataType).alias("up"), "n", "total"))
        higher = open_.alias("a").join(known.alias("b"), _same_tree("a", "b") & (F.col("a.up") == F.col("b.id")))
        state = write_once(
            higher.select("a.tree", "a.id", "b.up", (F.col("a.n") + F.col("b.n")).alias("n"), (F.col("a.total") + F.col("b.total")).alias("total")),
            "chat-climb",
        )


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """``(tree, leaf, rank, score, id, position)``: the messages of each tree's ``keep`` best root-to-leaf paths.

    A branch scores the mean of its messages; ties go to the longer one, then to the smaller
    leaf. Takes ``messages(tree, id, parent, score)`` with distinct ids in a tree.
    """
    links = write_once(messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "chat-links")
    levels, rooted = _climb(links)
    answered = links.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = rooted.alias("a").join(answered.alias("b"), _same_tree("a", "b") & (F.col("a.id") == F.col("b.id")), "left_anti")
    score = F.col("total") / F.col("n")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "id")
    ranked = leaves.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    path = ranked.select("tree", F.col("id").alias("leaf"), "rank", "score", "id", (F.col("n") - 1).alias("position"))
    for k in reversed(range(len(levels))):
        # messages 2 ** k above those found so far: in all, every distance once
        path = write_once(path, "chat-path")
        up = path.alias("a").join(levels[k].alias("b"), _same_tree("a", "b") & (F.col("a.id") == F.col("b.id")))
        path = path.union(up.select("a.tree", "leaf", "rank", "score", "b.up", F.col("position") - (1 << k)))
    return path


def conversations(messages: DataFrame, keep: int = 1, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per chosen branch: ``tree, leaf, rank, score, n_turns, formatted, mask``.

    Takes ``messages(tree, id, parent, role, text, score)``; other columns play no part.
    ``formatted`` is the whole conversation, ``mask`` has an entry for each turn: the span
    (``start``, ``end``, in code points of ``formatted``) of its text, if a model should
    learn it, else null.

    A message whose parent is null or not in its tree is a root, and a tree may have
    several. Messages that lead into a circle are on no path. Of rows that repeat an id, the one with
    the highest score stays, then the smallest role and text; rows without an id are left out. Null
    roles and texts are empty, a null score is 0, a null tree is a tree. An empty
    table gives an empty table.
    """
    same = Window.partitionBy("tree", "id").orderBy(F.desc_nulls_last("score"), "role", "text", "parent")
    named = messages.select(
        "tree", "id", "parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("score").cast("double").alias("score"),
    )
    one = named.where("id is not null").withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    return formatted(one, branches(one, keep), learned)


def formatted(messages: DataFrame, paths: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """The messages of ``paths`` (see :func:`branches`) written out, as :func:`conversations` returns them."""
    path = paths.withColumnRenamed("tree", "branch_tree").withColumnRenamed("id", "branch_id").withColumnRenamed("score", "branch_score")
    met = path.join(messages, F.col("tree").eqNullSafe(F.col("branch_tree")) & (F.col("id") == F.col("branch_id")))
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(MIDDLE))
    turns = met.select(
        "tree", "leaf", "rank", F.col("branch_score").alias("score"), "position", F.col("role").isin(*learned).alias("learn"),
        head.alias("head"), escaped(F.col("text")).alias("body"),
    )
    long = F.length("head") + F.length("body") + len(CLOSE)
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(long).over(before), F.lit(0)) + F.length("head")
    span = F.struct(start.alias("start"), (start + F.length("body")).alias("end"))
    placed = turns.select(
        "tree", "leaf", "rank", "score", "position", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("learn"), span).alias("span")
    )
    whole = placed.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"), F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("position", "turn", "span"))).alias("turns"),
    )
    return whole.select(
        "tree", "leaf", "rank", "score", "n_turns", F.array_join("turns.turn", "").alias("formatted"), F.col("turns.span").alias("mask")
    )


def read_turns(done: DataFrame) -> DataFrame:
    """``(tree, leaf, position, role, text, learned)``: the turns read back from ``formatted`` and ``mask``.

    ``learned`` is the text under the mask's span, cut out of the formatted conversation by
    its code points; null where the turn has none.
    """
    cut = F.split("formatted", F.lit(CLOSE), -1)
    turns = F.arrays_zip(F.slice(cut, 1, F.size(cut) - 1).alias("turn"), F.col("mask").alias("span"))
    each = done.select("tree", "leaf", F.posexplode(turns).alias("position", "t")).select("tree", "leaf", "position", "t.turn", "t.span")
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn") + len(CLOSE)).over(before), F.lit(0))
    head = F.substring_index("turn", MIDDLE, 1)
    return each.withColumn("start", start).select(
        "tree", "leaf", "position",
        F.url_decode(F.substring(head, len(OPEN) + 1, F.length(head))).alias("role"),
        unescaped(F.substring("turn", F.length(head) + len(MIDDLE) + 1, F.length("turn"))).alias("text"),
        unescaped(F.substring("turn", (F.col("span.start") - F.col("start") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int"))).alias("learned"),
    )


def read_digests(done: DataFrame) -> DataFrame:
    """One row per conversation, all read back from it: ``tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256``."""
    turn = F.struct("position", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "learned")
    read = read_turns(done).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    learned = F.array_join("turns.learned", "")  # leaves out the nulls
    return read.select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns.turn", ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
    )
