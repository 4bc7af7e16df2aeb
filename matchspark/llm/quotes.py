"""Conversations from quoting messages, with DataFrame functions only.

*Parsing.* A line's quote level is the number of ``>`` it starts with. Lines of level 0
are the message's own; attributions ("… wrote:") above a deeper quote belong to the quote.

*Hashing.* Passages are the lines of a level, and all of them together (a quote that
was wrapped anew still matches as a whole). Case and white space are normalised.

*Linking.* The original of a quoted passage is the earliest message of the conversation
that has it as its own passage and comes before the quoting one; failing that, the earliest
message of any other conversation. A message answers the one that most words of its
outermost linked level come from; of equal ones the latest.

*Ordering.* Depth and thread are found by pointer doubling, in a number of rounds that is
the logarithm of the longest chain. A thread's messages are numbered by position, which
puts every reply after what it answers.

Originals are folded to one row per passage before they are joined, so a passage that a
third of all messages have makes no pairs; numbering works in blocks of positions, so a
thread may be of any length.

Defined results: a null text is empty; a message without a linked quote starts a thread;
a passage without words is none. Rows repeated in full are one message and get the same
result each; different messages at one place are told apart by role and text, but never answer
each other. A null position or conversation is a value of its own, and a null position answers nothing
and comes first. An empty table stays empty. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.session import cut

#: Positions in one block of the numbering.
BLOCK = 256
#: Ends of attribution lines, and beginnings of those that go over several lines, in the languages the corpus has. Fixed values.
WROTE = ("wrote", "writes", "schrieb", "escribió", "a écrit")
OPENERS = ("On", "At", "In", "Am", "El", "Le")
_LEVEL, _HERE = r"((?:[> \t]*>)?)", r"(?![ \t]*>)"
#: Does not end as a sentence does, so it may go on.
_OPEN_END = r"(?<![.!?:; \t])[ \t]*\n"
_LAST = "(?:" + "|".join(WROTE) + r") ?:[ \t]*\n(?=\1[ \t]*>)"
_WRAPPED = rf"(?:[ \t]*(?:{'|'.join(OPENERS)})\b[^\n]*{_OPEN_END}\1{_HERE}(?:[^\n]*{_OPEN_END}\1{_HERE})?)"
#: A heading of up to three lines, or a line and the word alone on the next, right above a deeper quote.
_ATTRIBUTION = rf"(?m)^{_LEVEL}{_HERE}(?:{_WRAPPED}?[^\n]*{_LAST}|[^\n]*{_OPEN_END}\1[ \t]*{_LAST})"
_PREFIX = r"^[ \t>]*>"
KEY = ["conv", "pos", "mark"]


def bare(text: Column) -> Column:
    """Text without attributions."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), _ATTRIBUTION, "")


def own_text(text: Column) -> Column:
    """A message without its quotes."""
    kept = F.regexp_replace(bare(text), r"(?m)^[ \t]*>[^\n]*(?:\n|\z)", "")
    return F.regexp_replace(kept, r"\A\s+|\s+\z", "")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def _passages(rows: DataFrame) -> DataFrame:
    """(KEY, level, hash, words): distinct passages of each message, level by level."""
    lines = rows.select(*KEY, F.posexplode(F.split(bare(F.col("text")), "\n")).alias("n", "line"))
    quoted = F.regexp_extract("line", _PREFIX, 0)
    level = F.length(F.regexp_replace(quoted, "[^>]", "")).alias("level")
    lines = lines.select(*KEY, "n", level, _normal(F.expr("substring(line, length(regexp_extract(line, '^[ \\\\t>]*>', 0)) + 1)")).alias("said"))
    lines = lines.filter(F.col("said") != "")
    # bounded by the message, which is one row
    whole = lines.groupBy(*KEY, "level").agg(F.sort_array(F.collect_list(F.struct("n", "said"))).alias("all"))
    said = F.array_union(F.col("all.said"), F.array(F.array_join(F.col("all.said"), " ")))
    each = whole.select(*KEY, "level", F.explode(said).alias("said"))
    words = F.size(F.split("said", " ")).alias("words")
    return each.select(*KEY, "level", F.sha2("said", 256).alias("hash"), words)


def _links(passages: DataFrame) -> DataFrame:
    """(KEY, level, words, source…): each quoted passage with its original, where there is one."""
    own = passages.filter("level = 0")
    at = F.struct("conv", "pos", "mark")
    near = own.filter("pos is not null").groupBy(F.col("conv").alias("c"), "hash").agg(F.min(at).alias("near"))
    far = own.groupBy("hash").agg(F.min(at).alias("far"))
    quoted = passages.filter("level > 0")
    found = quoted.join(near.withColumnRenamed("hash", "h"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")), "left")
    found = found.join(far, "hash", "left")
    inside = F.when(F.col("near.pos") < F.col("pos"), F.col("near"))
    outside = F.when(~F.col("far.conv").eqNullSafe(F.col("conv")), F.col("far"))
    return found.select(*KEY, "level", "words", inside.alias("source"), F.when(inside.isNull(), outside).alias("foreign"))


def _same(left: list[str], right: list[str]) -> Column:
    parts = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]
    return parts[0] & parts[1] & parts[2]


def _threads(nodes: DataFrame) -> DataFrame:
    """(node, up): parents, null at a start. Returns (node, root, depth)."""
    state = nodes.select(
        "node", F.coalesce("up", "node").alias("root"), F.col("up").isNotNull().cast("long").alias("depth")
    )
    state = last = cut(state, "threads")
    while True:
        above = state.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = state.join(above, "root").select("node", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "more")
        moved = last = cut(moved, "threads", last)
        if moved.filter("more > 0").isEmpty():
            return moved.select("node", "root", "depth")
        state = moved.drop("more")


def _numbered(found: DataFrame) -> DataFrame:
    """Adds ``nth``: place within (conv, root) by position, from 0."""
    block = F.floor(F.coalesce("pos", F.lit(-1)) / BLOCK)
    placed = found.withColumn("block", block)
    inner = Window.partitionBy("root", "block").orderBy(F.col("pos").asc_nulls_first(), "depth", "mark")
    totals = placed.groupBy("root", "block").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("root").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("root", "block", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    ranked = placed.withColumn("inside", F.row_number().over(inner) - 1)
    return ranked.join(before, ["root", "block"]).withColumn("nth", F.col("before") + F.col("inside"))


def conversations(
    messages: DataFrame, conversation: str = "conv_id", position: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, pos, role, body, parent, thread, depth, nth, n_passages, n_linked, n_foreign, formatted), a row per message.

    ``parent`` and ``thread`` are the positions of the message answered and of the thread's first; ``nth`` is the
    place in the thread; ``n_…`` count quoted passages, those with an original in the conversation and in another.
    ``formatted`` is the turn as a chat template has it.
    """
    rows = messages.select(
        F.col(conversation).alias("conv"), F.col(position).cast("long").alias("pos"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"), F.xxhash64(role, text).alias("mark"),
    )
    passages = cut(_passages(rows).distinct(), "passages")
    links = cut(_links(passages), "quote-links")
    tally = links.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_passages"), F.count("source").alias("n_linked"), F.count("foreign").alias("n_foreign")
    )
    votes = links.filter("source is not null").groupBy(*KEY, "level", "source").agg(F.sum("words").alias("words"))
    best = F.max(F.struct(-F.col("level"), F.col("words"), F.col("source.pos"), F.col("source"))).getField("source").alias("source")
    parents = votes.groupBy(*KEY).agg(best)
    nodes = cut(rows.select(*KEY).distinct().withColumn("node", F.monotonically_increasing_id()), "messages")
    to = [F.col(k).alias(f"{k}2") for k in KEY]
    chosen = parents.select(*to, F.col("source.pos").alias("pos3"), F.col("source.mark").alias("mark3"))
    named = nodes.join(chosen, _same(KEY, [f"{k}2" for k in KEY]), "left").drop("conv2", "pos2", "mark2")
    targets = nodes.select(*to, F.col("node").alias("up"))
    linked = named.join(targets, _same(["conv", "pos3", "mark3"], ["conv2", "pos2", "mark2"]), "left")
    linked = cut(linked.select(*KEY, "node", F.when(F.col("pos3").isNotNull(), F.col("up")).alias("up"), F.col("pos3").alias("parent")), "parents")
    threads = _threads(linked)
    starts = nodes.select(F.col("node").alias("root"), F.col("pos").alias("thread"))
    placed = linked.join(threads, "node").join(starts, "root")
    placed = _numbered(placed).join(tally.withColumnsRenamed({k: f"{k}2" for k in KEY}), _same(KEY, [f"{k}2" for k in KEY]), "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_passages", "n_linked", "n_foreign")}
    info = placed.withColumns(counts).select(*to, "parent", "thread", "depth", "nth", *counts)
    body = own_text(F.col("text"))
    whole = rows.withColumn("body", body).join(info, _same(KEY, ["conv2", "pos2", "mark2"]))
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return whole.select("conv", "pos", "role", "body", "parent", "thread", "depth", "nth", *counts, said.alias("formatted"))


def as_mail(messages: DataFrame) -> DataFrame:
    """The turns of ``conversations`` as mail: each quotes the turn before it, and that one's quote of the turn before."""
    turns = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    one = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    for back in (1, 2):
        said = one.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(f"back{back}"))
        turns = turns.join(said, ["conv_id", "turn"], "left")
    first = F.concat(F.lit("They wrote:\n"), F.regexp_replace("back1", "(?m)^", "> "), F.lit("\n"))
    second = F.concat(F.lit("> They wrote:\n"), F.regexp_replace("back2", "(?m)^", "> > "), F.lit("\n"))
    quote = F.concat(F.coalesce(first, F.lit("")), F.coalesce(second, F.lit("")))
    return turns.select("conv_id", "turn", "role", F.concat(quote, F.col("text")).alias("text"))
