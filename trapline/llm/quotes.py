"""Chat formatting: quotation linking.

A message's lines carry a quote level, the number of ">" before the text (blanks
may stand between them).  Lines of one level in a row form a passage; lines that
announce a quote ("On ... wrote:") belong to none.  A passage is normalised
(markers off, lines joined, white space folded, lower case) and hashed whole, so
that a client's line breaks do not matter.  It is joined to the hashes of what
earlier messages of the conversation wrote themselves: the body, each stretch
between quotes, each paragraph; the latest holder before the quoting message is
the original.  A passage found nowhere is a partial quote: its paragraphs are
looked up in the same way, and the lines of paragraphs found nowhere as lines.
A passage then belongs to the message that holds most of its lines, a message
answers the one that holds most of its level-one lines (ties: the later message).

These links make trees.  A message's thread is the root of its tree, its depth the
number of links to it, its position the place in the order of replies: each
message before its answers, answers by turn, one answer's branch before the next.
A conversation ordered by (thread, position) reads as a discussion, without quotes
and without the lines that announce them.

The latest holder is found over rows by (conversation, hash, turn), one a turn
after grouping: inside blocks of ``SPAN`` turns by a window, and across blocks by
a window over one row a block, so that a passage that a whole table quotes is no
single group; no pairs of messages arise.  Trees are read off by ranking the list
of entries and exits of each tree, with doubled steps over written tables, so a
chain of n answers takes about log2(2 n) rounds of rows of fixed size.  Siblings
are dealt in blocks of turns as well.  DataFrame functions only.

Cases: null text is empty; null conversation, turn or role are values like any
other (null turn counts as -1 and is given back as null); messages with equal turn
are told apart by role and text and never answer one another; rows repeated whole
are one message and linked alike; passages without a letter or digit link nothing;
an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import materialize

MARKS = r"^((?:[ \t]*>)+)"
SAYS = r"(?i)^[ \t>]*on .* wrote:[ \t]*$"
WORDY = r"[\p{L}\p{N}]"
SPAN = 1024
KEY = ["conv", "at", "mid"]


def _messages(chats: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages with the key (conv, at, mid)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    at = F.coalesce(F.col(turn).cast("long"), F.lit(-1))
    r = F.coalesce(F.col(role).cast("string"), F.lit(""))
    return chats.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
                        t.alias("text"), F.coalesce(F.col(conv_id).cast("long").cast("string"), F.lit("")).alias("conv"), at.alias("at"),
                        F.xxhash64(at, r, t).alias("mid"))


def parsed(message_lines):
    """Array of (line, pos, level, said, blank) of an array of lines."""
    def one(line, i):
        level = F.length(F.translate(F.regexp_extract(line, MARKS, 1), " \t", ""))
        bare = F.regexp_replace(line, MARKS + "[ \t]?", "")
        return F.struct(bare.alias("line"), i.alias("pos"), level.cast("int").alias("level"), line.rlike(SAYS).alias("said"), (normal(bare) == "").alias("blank"))
    return F.transform(message_lines, one)


def normal(text):
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " ")))


def hashed(part, kind: str):
    """Hash of an array of lines as one normalised text; null without a letter or digit."""
    whole = normal(F.array_join(F.transform(part, lambda x: x["line"]), " "))
    return F.when(whole.rlike(WORDY), F.unhex(F.sha2(F.concat(F.lit(kind), whole), 256)))


def pieces(rows: DataFrame, part: str, starts: str) -> DataFrame:
    """One row per piece of the array ``part``; a piece starts at the first element and
    where ``starts`` (SQL over x and the element y before it) holds."""
    starts = starts.replace("y.", f"{part}[i - 1].")
    cuts = F.expr(f"filter(transform({part}, (x, i) -> if(i = 0 or {starts}, i, null)), i -> i is not null)")
    piece = F.expr(f"explode(transform(cuts, (s, j) -> slice({part}, s + 1, coalesce(get(cuts, j + 1), size({part})) - s)))")
    return rows.withColumn("cuts", cuts).select(*[c for c in rows.columns if c != part], piece.alias(part))


def _stretches(rows: DataFrame) -> DataFrame:
    """Lines of one level in a row, without those that announce a quote."""
    found = pieces(rows.select(*KEY, F.col("lines").alias("part")), "part", "x.level <> y.level or y.said or x.said")
    return found.select(*KEY, F.filter("part", lambda x: ~x["said"]).alias("part")).where("size(part) > 0").withColumn("level", F.col("part")[0]["level"])


def _paragraphs(rows: DataFrame) -> DataFrame:
    return pieces(rows, "part", "y.blank and not x.blank")


def latest_before(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv, h, at, origin) of all ``asked`` (conv, h, at): the latest (at, mid) in
    ``held`` (conv, h, at, mid) of a lower turn, null where there is none."""
    none = F.lit(None).cast("long")
    rows = (held.select("conv", "h", "at", "mid", F.lit(False).alias("asks")).union(asked.select("conv", "h", "at", none, F.lit(True)))
            .groupBy("conv", "h", "at").agg(F.max("mid").alias("mid"), F.max("asks").alias("asks"))
            .withColumn("span", F.expr(f"at div {SPAN}")))
    rows = materialize(rows.withColumn("origin", F.when(F.col("mid").isNotNull(), F.struct("at", "mid"))).drop("mid"), "holders")

    def last(w):
        return F.last("origin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumn("near", last(Window.partitionBy("conv", "h", "span").orderBy("at"))).where("asks")
    spans = rows.groupBy("conv", "h", "span").agg(F.max("origin").alias("origin"))
    across = spans.select("conv", "h", "span", last(Window.partitionBy("conv", "h").orderBy("span")).alias("far")).where("far is not null")
    return (inside.join(across, ["conv", "h", "span"], "left").select("conv", "h", "at", F.coalesce("near", "far").alias("origin")))


def _voted(rows: DataFrame, by: list[str]) -> DataFrame:
    return (rows.where("origin is not null").groupBy(*by, "origin").agg(F.count("*").alias("votes"))
            .groupBy(*by).agg(F.max(F.struct("votes", "origin")).alias("v")).select(*by, F.col("v.origin").alias("origin")))


def ranked(parent: DataFrame) -> DataFrame:
    """Each message of a tree of two or more, with its root's turn, depth and place in
    the order of replies, from ``parent`` (conv, at, mid, p_at, p_mid)."""
    up = ["conv", "p_at", "p_mid"]
    kids = parent.withColumn("span", F.expr(f"at div {SPAN}")).withColumn("me", F.struct("at", "mid"))
    left = F.lag("me").over(Window.partitionBy(*up, "span").orderBy("me"))
    spans = kids.groupBy(*up, "span").agg(F.max("me").alias("me"))
    before = spans.select(*up, "span", F.lag("me").over(Window.partitionBy(*up).orderBy("span")).alias("far"))
    kids = materialize(kids.withColumn("near", left).join(before, [*up, "span"], "left")
                       .select(*KEY, "p_at", "p_mid", F.coalesce("near", "far").alias("left")), "siblings")
    last = kids.groupBy(F.col("conv"), F.col("p_at").alias("at"), F.col("p_mid").alias("mid")).agg(F.max(F.struct("at", "mid")).alias("last"))
    nodes = kids.select(*KEY).union(kids.select("conv", "p_at", "p_mid")).distinct()

    def place(at, mid, out):
        return F.struct(F.col(at).alias("at"), F.col(mid).alias("mid"), F.lit(out).alias("out"))
    # what stands before an entry: the exit of the sibling before, or the parent's entry;
    # before an exit: the exit of the last child, or the entry of the message itself
    enters = nodes.join(kids, KEY, "left").select("conv", place("at", "mid", False).alias("me"), F.when(F.col("left").isNotNull(), place("left.at", "left.mid", True))
                                                   .when(F.col("p_mid").isNotNull(), place("p_at", "p_mid", False)).alias("prev"))
    leaves = nodes.join(last, KEY, "left").select("conv", place("at", "mid", True).alias("me"),
                                                  F.when(F.col("last").isNotNull(), place("last.at", "last.mid", True)).otherwise(place("at", "mid", False)).alias("prev"))
    entry, exit_ = F.col("prev.out") == F.lit(False), F.col("prev.out")
    rows = materialize(enters.union(leaves).select("conv", "me", "prev", F.when(entry, 1).otherwise(0).cast("long").alias("place"),
                                                   F.when(entry, 1).when(exit_, -1).otherwise(0).cast("long").alias("depth"),
                                                   F.when(F.col("prev").isNull(), F.col("me.at")).alias("root")), "list")
    while not rows.where("prev is not null").isEmpty():
        ahead = rows.select("conv", F.col("me").alias("prev"), F.col("prev").alias("to"), F.col("place").alias("more"), F.col("depth").alias("deeper"), F.col("root").alias("top"))
        steps = (rows.where("prev is not null").drop("root").join(ahead, ["conv", "prev"])
                 .select("conv", "me", F.col("to").alias("prev"), F.col("place") + F.col("more"), F.col("depth") + F.col("deeper"), F.col("top")))
        rows = materialize(rows.where("prev is null").union(steps), "list")
    return rows.where("not me.out").select("conv", "me.at", "me.mid", "root", "depth", "place")


def linked(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (its own), n_quoted (quoted lines),
    n_linked (of them found), n_passages, reply_to (turn), thread (turn), depth, position
    (in its thread, from 0), quoted (passages with their original's turn)."""
    source = _messages(chats, conv_id, turn, role, text).withColumn("lines", parsed(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")))
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    asked = source.where(quoting).select("conv").distinct()

    # what messages wrote themselves, in conversations where somebody quotes
    own_lines = F.filter("lines", lambda x: (x["level"] == 0) & ~x["said"])
    writers = source.join(asked, "conv", "left_semi")
    written = _stretches(writers).where("level = 0")
    parts = _paragraphs(written)
    lines = parts.select(*KEY, F.explode("part").alias("line"))
    held = (writers.select(*KEY, hashed(own_lines, "passage").alias("h"))
            .union(written.select(*KEY, hashed(F.col("part"), "passage"))).union(parts.select(*KEY, hashed(F.col("part"), "passage")))
            .union(lines.select(*KEY, hashed(F.array("line"), "line"))).where("h is not null"))

    # quoted lines, each with the hash of its passage, its paragraph and itself
    passages = _stretches(source.where(quoting).dropDuplicates(KEY)).where("level > 0").withColumn("passage", F.col("part")[0]["pos"])
    quoted = _paragraphs(passages.withColumn("whole", hashed(F.col("part"), "passage"))).withColumn("paragraph", hashed(F.col("part"), "passage"))
    quoted = quoted.select(*KEY, "level", "passage", "whole", "paragraph", F.explode("part").alias("l"))
    quoted = materialize(quoted.select(*KEY, "level", "passage", "l.pos", "whole", "paragraph", hashed(F.array("l"), "line").alias("own")), "quoted")
    wants = quoted.where("own is not null").select(*KEY, "level", "passage", "pos", F.posexplode(F.array("own", "paragraph", "whole")).alias("tier", "h"))
    found = latest_before(held, wants.select("conv", "h", "at"))
    hits = materialize(wants.join(found.where("origin is not null"), ["conv", "h", "at"]).groupBy(*KEY, "level", "passage", "pos")
                       .agg(F.max(F.struct("tier", "origin")).alias("m")).select(*KEY, "level", "passage", "pos", F.col("m.origin").alias("origin")), "hits")

    passage = (quoted.groupBy(*KEY, "passage", "level").agg(F.count("*").alias("lines"))
               .join(_voted(hits, [*KEY, "passage"]), [*KEY, "passage"], "left"))
    per = passage.groupBy(*KEY).agg(F.sum("lines").alias("n_quoted"), F.count("*").alias("n_passages"), F.sort_array(F.collect_list(
        F.struct("passage", "level", "lines", F.col("origin.at").alias("from_turn")))).alias("quoted"))
    n_linked = hits.groupBy(*KEY).agg(F.count("*").alias("n_linked"))
    parent = materialize(_voted(hits.where("level = 1"), KEY).select(*KEY, F.col("origin.at").alias("p_at"), F.col("origin.mid").alias("p_mid")), "parents")
    links = per.join(n_linked, KEY, "left").join(parent, KEY, "left").join(ranked(parent), KEY, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    body = F.when(quoting, F.trim(F.array_join(F.transform(own_lines, lambda x: x["line"]), "\n"))).otherwise(F.col("text"))
    return (source.join(links, KEY, "left")
            .select("conv_id", "turn", "role", body.alias("text"), zero("n_quoted").alias("n_quoted"), zero("n_linked").alias("n_linked"),
                    zero("n_passages").alias("n_passages"), F.col("p_at").alias("reply_to"), F.coalesce("root", "at").alias("thread"),
                    zero("depth").alias("depth"), zero("place").alias("position"),
                    F.coalesce("quoted", F.array().cast("array<struct<passage:int,level:int,lines:bigint,from_turn:bigint>>")).alias("quoted")))


def op4(spark, sf_dir: str) -> DataFrame:
    """Messages by digest of their own text, with links and the place in the order of replies."""
    out = linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "n_quoted", "n_linked", "n_passages", "reply_to", "thread", "depth", "position")
