"""Operator 6: quotation linking, in DataFrame functions only.

Lines that begin with ``>`` signs are quotes of that level. Neighbouring lines of one level are a
passage; passages and lines are normalised (case, white space, marks) and hashed, and joined to the
own passages, lines and paragraphs (between blank lines, with white space made equal, so wrapping does
not matter) of the conversation's messages, of which there is one row a hash. A quoted passage is split
at its blank lines as well. A message answers the latest original among its first-level quotes, else its latest
at any level.

Messages that answer one another form a conversation: ``root_turn`` names it, ``reply_path`` holds the turns from the
root down, and ``position`` counts its messages in reply order, each before its answers and those by turn. The
body has no quotes, and no line that announces one (``On ... wrote:``) right before it. Positions come from ranges of
paths, so no task holds a conversation; only messages with quotes are exploded.

Cases: null texts have no body and quote nothing; a null key or turn links with nothing; rows of one turn share
parent, path and position, and repeated rows count once; quotes that match nothing leave the message a root;
of originals of equal text the earliest counts; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import indexed
from ..session import materialize

MARK = r"^[ \t]*(?:>[ \t]*)+"
BLANK = r"\n\s*\n"
#: How mail programs announce a quote.
ANNOUNCE = r"(?i)^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb\b.*|el\b.*\bescribió)\s*:\s*$"


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, MARK, 0), " \t", ""))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h): the hashes of what quoting messages hold; level 0 is their own text."""
    lines = messages.select("conv_id", "turn", "row", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    lines = lines.select("conv_id", "turn", "row", "p", _level(F.col("line")).alias("level"), F.regexp_replace("line", MARK, "").alias("line"))
    w = Window.partitionBy("conv_id", "turn", "row").orderBy("p")
    step = F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(1))
    lines = materialize(lines.withColumn("step", step).withColumn("passage", F.sum("step").over(w)), "quotes")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    whole = lines.groupBy("conv_id", "turn", "row", "passage", "level").agg(text.alias("t")).select("conv_id", "turn", "level", "t")
    pieces = whole.union(whole.withColumn("t", F.explode(F.split("t", BLANK)))).union(lines.select("conv_id", "turn", "level", F.col("line").alias("t")))
    return hashed(pieces)


def hashed(d: DataFrame) -> DataFrame:
    return d.withColumn("h", F.sha2(norm(F.col("t")), 256)).where(norm(F.col("t")) != "").drop("t").distinct()


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, reply_path) of the messages that answer another, by doubling: each round joins a path to
    that of its first turn, until all begin at a root."""
    paths = materialize(parents.select("conv_id", "turn", F.array("parent_turn", "turn").alias("path")), "paths")
    while True:
        up = paths.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("path").alias("_up"))
        d = paths.join(up, (F.col("conv_id") == F.col("_c")) & (F.get("path", F.lit(0)) == F.col("_t")), "left")
        longer = F.concat(F.slice("_up", 1, F.size("_up") - 1), "path")
        d = materialize(d.select("conv_id", "turn", F.when(F.col("_up").isNull(), F.col("path")).otherwise(longer).alias("path"), F.col("_up").isNotNull().alias("moved")), "paths")
        paths = d.select("conv_id", "turn", "path")
        if not d.where("moved").limit(1).count():
            return paths.select("conv_id", "turn", F.get("path", F.lit(0)).alias("root_turn"), F.col("path").alias("reply_path"))


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = None) -> DataFrame:
    """Per message: ``n_quoted`` lines, ``quote_depth``, ``n_linked`` passages, paragraphs or lines, ``parent_turn``, ``root_turn``,
    ``reply_path``, ``position``, ``role`` and ``body``."""
    m = df.select(df[conv].alias("conv_id"), df[turn].cast("long").alias("turn"), (df[role] if role else F.lit(None)).cast("string").alias("role"), df[text].cast("string").alias("text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    is_quote = lambda x: x.rlike(MARK)
    depth = F.aggregate(lines, F.lit(0), lambda a, x: F.greatest(a, _level(x)))
    own = F.filter(lines, lambda x, i: ~is_quote(x) & ~(x.rlike(ANNOUNCE) & F.coalesce(is_quote(F.get(lines, i + 1)), F.lit(False))))
    # texts without a mark need no look at their lines
    body = F.when(F.coalesce(F.col("text").contains(">"), F.lit(False)), F.array_join(own, "\n")).otherwise(F.coalesce("text", F.lit("")))
    m = m.select("conv_id", "turn", "role", "text", F.size(F.filter(lines, is_quote)).alias("n_quoted"), depth.alias("quote_depth"), F.trim(body).alias("body"))
    quoting = m.where("n_quoted > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.sha2("text", 256).alias("row"), "text").distinct()
    pieces = materialize(passages(quoting), "passages")
    quotes = pieces.where("level > 0")
    asked = quotes.select("conv_id").distinct()
    texts = m.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.col("body").alias("t"))
    split = lambda at: texts.withColumn("t", F.explode(F.split("t", at)))
    originals = hashed(texts.union(split(BLANK)).union(split("\n"))).union(pieces.where("level = 0").select("conv_id", "turn", "h"))
    originals = originals.groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    hits = quotes.join(originals, ["conv_id", "h"]).where("origin < turn")
    parent = hits.groupBy("conv_id", "turn").agg(F.count_distinct("h").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("direct"), F.max("origin").alias("any"))
    parent = materialize(parent.select("conv_id", "turn", "n_linked", F.coalesce("direct", "any").alias("parent_turn")), "parents")
    found = threads(parent)
    found = indexed(found, ["conv_id", "root_turn"], ["reply_path"], "position").withColumn("position", F.col("position") + 1)
    found = found.join(parent, ["conv_id", "turn"])
    out = m.where("n_quoted > 0").join(found, ["conv_id", "turn"], "left")
    # messages without quotes need no join
    kind = {"parent_turn": F.lit(None).cast("long"), "root_turn": F.col("turn"), "reply_path": F.array("turn"), "position": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long")}
    alone = m.where("n_quoted = 0").select("*", *[c.alias(n) for n, c in kind.items()])
    linked = out.select(*m.columns, *[F.coalesce(F.col(n), c).alias(n) for n, c in kind.items()])
    return alone.union(linked).select("conv_id", "turn", "role", "n_quoted", "quote_depth", "n_linked", "parent_turn", "root_turn", "reply_path", "position", "body")
