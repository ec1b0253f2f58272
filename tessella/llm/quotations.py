"""Chat formatting: link quotations to the messages they come from, and put conversations in reply order.

Native: all steps are DataFrame expressions.  A message's lines are parsed into
quote levels; runs of lines of one level are passages, and blank lines, quoted or
not, end them.  Normalised passages and lines are hashed (128 bits of SHA-256)
and joined to the first message that has them as its own text, in the same
conversation or else in any.  Only hashes move; those that a large share of all
rows have are met by broadcast (``split_join``).

Replies make a forest in each conversation.  Its order (a message, then what
replies to it, branch after branch) comes from pointers that are followed by
doubling: to the top of a thread, to the next branch, and along the whole list.
Each round is a join whose result is staged, so neither a conversation nor a
thread is ever collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import STRIPPED, line_hash
from .support import discard, numbered, split_join, staged, staged_alone, table

#: Quote marks at the start of a line (nothing is tried twice, so any number of them needs no stack), and lines that introduce a quotation.
MARKS = r"^(?:[ \t]{0,3}+>)++"
INTRODUCES = r"(?i)^[ \t>]{0,20}(?:on .{0,200} wrote|.{0,100} (?:wrote|writes|schrieb|escribió|a écrit)|le .{0,200} a écrit|am .{0,200} schrieb.{0,80}|el .{0,200} escribió) ?:[ \t]*$|^-{2,} ?original message ?-{2,}$"
#: Code points of a normalised passage that is linked to another conversation, at least; within a conversation any will do.
LEAST = 8
#: Kinds of lines that belong to no passage: what introduces a quotation, blank lines, and blank lines of a quotation.
INTRODUCTION, BLANK, BLANK_QUOTED = -1, -2, -3


def _parsed(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Each message with its lines as (kind, level, body); the kind is the level, or one of those above, and runs of one kind are passages."""
    blank = lambda body: F.btrim(body, F.lit(STRIPPED)) == ""
    line = lambda x: F.struct(
        F.char_length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS + " ?", "").alias("body"),
        x.rlike(INTRODUCES).alias("introduces"),
    )
    rows = messages.select(
        F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"),
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("raw", F.transform(F.split("text", "\n", -1), line))
    quoted = lambda i: F.coalesce(F.get(F.col("raw"), i)["level"] > 0, F.lit(False))
    empty = lambda i: F.coalesce(blank(F.get(F.col("raw"), i)["body"]), F.lit(False))
    # an introduction counts only if a quotation follows, after one blank line at most
    follows = lambda i: quoted(i + 1) | (empty(i + 1) & quoted(i + 2))
    kind = lambda x, i: F.when(x["introduces"] & ((x["level"] > 0) | follows(i)), INTRODUCTION).when(blank(x["body"]), F.when(x["level"] > 0, BLANK_QUOTED).otherwise(BLANK)).otherwise(x["level"])
    rows = rows.withColumn("lines", F.transform("raw", lambda x, i: F.struct(kind(x, i).alias("kind"), x["level"].alias("level"), x["body"].alias("body"))))
    n = F.size("lines")
    rows = rows.withColumn("bounds", F.concat(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(F.col("lines"), i)["kind"] != F.get(F.col("lines"), i - 1)["kind"])), F.array(n)))
    passage = lambda s, j: F.struct(
        F.get(F.col("lines"), s)["kind"].alias("kind"),
        F.array_join(F.transform(F.slice(F.col("lines"), s + 1, F.get(F.col("bounds"), j + 1) - s), lambda x: x["body"]), " ").alias("body"),
    )
    return rows.withColumn("passages", F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), passage))


def normalised(body: Column) -> Column:
    """Lower-cased, with white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(body, r"\s+", " ")))


def _keys(parsed: DataFrame) -> DataFrame:
    """A row for each distinct passage or line of a message: level, size and hash."""
    every = F.concat("passages", F.transform("lines", lambda x: F.struct(x["kind"].alias("kind"), x["body"].alias("body"))))
    rows = parsed.where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).select("conv", "turn", F.explode(every).alias("p")).where("p.kind >= 0")
    rows = rows.select("conv", "turn", F.col("p.kind").alias("level"), normalised(F.col("p.body")).alias("key")).where(F.col("key") != "")
    return rows.select("conv", "turn", "level", F.char_length("key").alias("size"), line_hash(F.col("key")).alias("hash")).distinct()


def _ranked(found: DataFrame) -> DataFrame:
    """The best original of each message: of the outermost level, with most text in common, and of these the last."""
    pooled = found.groupBy("conv", "turn", "level", "from_conv", "from_turn").agg(F.sum("size").alias("common"))
    best = F.struct(-F.col("level"), "common", F.col("from_turn"), F.col("from_conv"))
    return pooled.groupBy("conv", "turn").agg(F.max_by(F.struct("from_conv", "from_turn"), best).alias("from")).select("conv", "turn", "from.*")


def _links(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What messages reply to (conv, turn, parent), and what others quote from elsewhere (conv, turn, source_conv, source_turn)."""
    quoted, own = keys.where("level > 0"), keys.where("level = 0")
    wanted = staged(quoted.select("hash").distinct(), "quoted")
    origins = staged(split_join(own, wanted, ["hash"], "left_semi").groupBy("conv", "hash").agg(F.min("turn").alias("from_turn")), "origins")
    inside = split_join(quoted, origins, ["conv", "hash"]).where(F.col("from_turn") < F.col("turn")).withColumn("from_conv", F.col("conv"))
    inside = staged(_ranked(inside).select("conv", "turn", F.col("from_turn").alias("parent")), "replies")
    first = origins.groupBy("hash").agg(F.min(F.struct(F.col("conv"), F.col("from_turn"))).alias("f")).select("hash", F.col("f.conv").alias("from_conv"), F.col("f.from_turn").alias("from_turn"))
    open_ = staged(quoted.where(F.col("size") >= LEAST).join(inside, ["conv", "turn"], "left_anti"), "open")
    outside = _ranked(split_join(open_, first, ["hash"]).where(F.col("from_conv") != F.col("conv")))
    return inside, outside.select("conv", "turn", F.col("from_conv").alias("source_conv"), F.col("from_turn").alias("source_turn"))


def _followed(start: DataFrame, merged: Column, hot: bool = False) -> DataFrame:
    """Follow ``ptr`` (a turn of the same conversation) to its end by doubling.

    ``start`` has conv, turn, ptr and ``value``; ``merged`` makes the new value
    of ``value`` and ``value2``, that of the message pointed to.  ``hot`` if many
    messages may point to one.
    """
    now = staged(start, "followed")
    while now.where(F.col("ptr").isNotNull()).limit(1).count():
        to = now.select("conv", F.col("turn").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("value").alias("value2"))
        going = now.where(F.col("ptr").isNotNull())
        moved = split_join(going, to, ["conv", "ptr"]) if hot else going.join(to, ["conv", "ptr"])
        before, now = now, staged(now.where(F.col("ptr").isNull()).unionByName(moved.select("conv", "turn", F.col("ptr2").alias("ptr"), merged.alias("value"))), "followed")
        discard(before)
    return now


def _ordered(nodes: DataFrame, replies: DataFrame) -> DataFrame:
    """``thread``, ``depth`` and ``position`` of each message (conv, turn), from what messages reply to."""
    rows = staged(nodes.join(replies, ["conv", "turn"], "left"), "nodes")
    order = staged(numbered(rows, "conv", "parent", "turn"), "order")
    starts = order.groupBy("conv").agg(F.min("number").alias("start"))
    # without replies a conversation's order is that of its turns
    plain = split_join(order, starts, ["conv"]).select("conv", "turn", F.col("turn").alias("thread"), F.lit(0).cast("long").alias("depth"), (F.col("number") - F.col("start")).alias("position"))
    if not replies.limit(1).count():
        return plain
    threaded = replies.select("conv").distinct()
    order = staged(split_join(order, threaded, ["conv"], "left_semi"), "threaded")
    value = F.struct(F.coalesce("parent", "turn").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    merged = F.struct(F.col("value2.top").alias("top"), (F.col("value.depth") + F.col("value2.depth")).alias("depth"))
    tops = _followed(order.select("conv", "turn", F.col("parent").alias("ptr"), value.alias("value")), merged, hot=True).select("conv", "turn", "value.top", "value.depth")
    beside = order.select((F.col("number") - 1).alias("number"), F.col("conv").alias("conv2"), F.col("parent").alias("parent2"), F.col("turn").alias("next"))
    sibling = F.when((F.col("conv") == F.col("conv2")) & F.col("parent").eqNullSafe(F.col("parent2")), F.col("next"))
    siblings = order.join(beside, "number", "left").select("conv", "turn", F.when(sibling.isNull(), F.col("parent")).alias("ptr"), sibling.alias("value"))
    after = _followed(siblings, F.col("value2"))
    child = replies.groupBy("conv", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    lists = after.join(child, ["conv", "turn"], "left").select("conv", "turn", F.coalesce("child", "value").alias("ptr")).withColumn("value", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long"))
    places = _followed(lists, F.col("value") + F.col("value2"))
    ends = places.groupBy("conv").agg(F.max("value").alias("end"))
    found = split_join(places, ends, ["conv"]).select("conv", "turn", (F.col("end") - F.col("value")).alias("place")).join(tops, ["conv", "turn"])
    out = plain.join(found, ["conv", "turn"], "left")
    return out.select("conv", "turn", F.coalesce("top", "thread").alias("thread"), F.coalesce(found["depth"], plain["depth"]).alias("depth"), F.coalesce("place", "position").alias("position"))


def link_quotations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Each message without its quotations, what it replies to, and its place in its conversation.

    Returns ``row`` (a struct of all columns), ``body``, ``n_quoted`` (quoted
    lines), ``max_level``, ``reply_to`` (the turn of the same conversation that
    the outermost quotation comes from), ``source_conv`` and ``source_turn`` (the
    first message of another conversation, if none of the same has it),
    ``thread`` (the turn that its chain of replies begins with, its own if it
    replies to none), ``depth`` (replies from there) and ``position``: numbers
    from 0 in the conversation's reply order, in which each message is followed
    by its replies in the order of their turns, and a branch ends before the next
    begins.

    Defined cases: a null text is empty; a message without quotations keeps its
    text as it is; rows that repeat conversation and turn count as one message
    for links and positions, each keeps its own text; with a null conversation
    or turn a message has no links and no position, and starts a thread at its
    own turn; of messages that share a passage, the first is its original; other
    columns may have any names; an empty table gives an empty result.
    """
    parsed = _parsed(messages, conv_col, turn_col, text_col)

    def found() -> DataFrame:
        replies, sources = _links(staged(_keys(parsed), "passages"))
        nodes = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn")).where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).distinct()
        linked = _ordered(nodes, replies).join(replies.withColumnRenamed("parent", "reply_to"), ["conv", "turn"], "left")
        return linked.join(sources, ["conv", "turn"], "left")

    n_quoted = F.size(F.filter("lines", lambda x: (x["kind"] > 0) | (x["kind"] == BLANK_QUOTED)))
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x["kind"].isin(0, BLANK)), lambda x: x["body"]), "\n")
    levels = F.transform(F.filter("lines", lambda x: x["kind"] != INTRODUCTION), lambda x: x["level"])
    rows = parsed.select(
        "row", "conv", "turn",
        F.when(n_quoted > 0, F.btrim(kept, F.lit(STRIPPED))).otherwise(F.col("text")).alias("body"),
        n_quoted.cast("long").alias("n_quoted"),
        F.greatest(F.lit(0), F.array_max(levels)).cast("long").alias("max_level"),
    )
    joined = rows.join(staged_alone(found, "links"), ["conv", "turn"], "left")
    return joined.select("row", "body", "n_quoted", "max_level", "reply_to", "source_conv", "source_turn", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position")


def conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Reply-ordered conversations without quotations: the messages with the columns they came with, their text bare, and ``thread``, ``depth`` and ``position``, in ranges sorted by conversation and position.

    Defined cases are those of ``link_quotations``; messages without a position
    come first.  The messages' own columns stay as they are: where one has the
    name of a new column, in whatever case, the new one gets ``reply_`` before
    its name, as often as that takes.
    """
    found = link_quotations(messages, conv_col=conv_col, turn_col=turn_col, text_col=text_col)
    columns = [(F.col("body") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in messages.columns]
    taken, names = {c.lower() for c in messages.columns}, {}
    for new in ("thread", "depth", "position"):
        name = new
        while name in taken:
            name = f"reply_{name}"
        names[new] = name
    order = [f"`{conv_col}`", names["position"]]
    return found.select(*columns, *[F.col(c).alias(n) for c, n in names.items()]).repartitionByRange(*order).sortWithinPartitions(*order)


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotations, with what it replies to and its place in its thread."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = link_quotations(messages)
    return found.select("row.conv_id", "row.turn", "row.role", F.col("body").alias("text"), *[c for c in found.columns if c not in ("row", "body")])


OP1_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id AS conv, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l0 AS (SELECT r, conv, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m),
l1 AS (SELECT r, conv, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS raw, regexp_replace(line, '^(?:[ \t]{0,3}>)+ ?', '') AS body,
       regexp_matches(line, '(?i)^[ \t>]{0,20}(?:on .{0,200} wrote|.{0,100} (?:wrote|writes|schrieb|escribió|a écrit)|le .{0,200} a écrit|am .{0,200} schrieb.{0,80}|el .{0,200} escribió) ?:[ \t]*$|^-{2,} ?original message ?-{2,}$') AS introduces FROM l0),
l2 AS (SELECT *, lead(raw) OVER w AS raw1, lead(raw, 2) OVER w AS raw2, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank, lead(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '') OVER w AS blank1 FROM l1 WINDOW w AS (PARTITION BY r ORDER BY i)),
l AS (SELECT r, conv, turn, i, body, raw, CASE WHEN introduces AND (raw > 0 OR coalesce(raw1 > 0, false) OR (coalesce(blank1, false) AND coalesce(raw2 > 0, false))) THEN -1 WHEN blank THEN CASE WHEN raw > 0 THEN -3 ELSE -2 END ELSE raw END AS level FROM l2),
b AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY i) = level THEN 0 ELSE 1 END AS starts FROM l),
p0 AS (SELECT *, sum(starts) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
p AS (SELECT r, conv, turn, level, string_agg(body, ' ' ORDER BY i) AS body FROM p0 GROUP BY r, conv, turn, level, run),
k0 AS (SELECT conv, turn, level, body FROM (SELECT conv, turn, level, body FROM p UNION ALL SELECT conv, turn, level, body FROM l) WHERE level >= 0 AND conv IS NOT NULL AND turn IS NOT NULL),
keys AS (SELECT DISTINCT conv, turn, level, key, length(key) AS size FROM (SELECT conv, turn, level, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS key FROM k0) WHERE key <> ''),
origins AS (SELECT conv, key, min(turn) AS from_turn FROM keys WHERE level = 0 GROUP BY conv, key),
i0 AS (SELECT q.conv, q.turn, q.level, o.from_turn, sum(q.size) AS common FROM keys q JOIN origins o ON q.conv = o.conv AND q.key = o.key WHERE q.level > 0 AND o.from_turn < q.turn GROUP BY ALL),
inside AS (SELECT conv, turn, from_turn FROM i0 QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY level, common DESC, from_turn DESC) = 1),
firsts AS (SELECT key, conv AS from_conv, from_turn FROM origins QUALIFY row_number() OVER (PARTITION BY key ORDER BY conv, from_turn) = 1),
o0 AS (SELECT q.conv, q.turn, q.level, f.from_conv, f.from_turn, sum(q.size) AS common FROM keys q ANTI JOIN inside i ON q.conv = i.conv AND q.turn = i.turn JOIN firsts f ON q.key = f.key WHERE q.level > 0 AND q.size >= 8 AND f.from_conv <> q.conv GROUP BY ALL),
outside AS (SELECT conv, turn, from_conv, from_turn FROM o0 QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY level, common DESC, from_turn DESC, from_conv DESC) = 1),
nodes AS (SELECT DISTINCT m.conv, m.turn, i.from_turn AS parent FROM m LEFT JOIN inside i ON m.conv = i.conv AND m.turn = i.turn WHERE m.conv IS NOT NULL AND m.turn IS NOT NULL),
walk AS (SELECT conv, turn, [turn] AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.conv, n.turn, list_append(w.path, n.turn) FROM nodes n JOIN walk w ON n.conv = w.conv AND n.parent = w.turn),
threads AS (SELECT conv, turn, path[1] AS top, len(path) - 1 AS depth, row_number() OVER (PARTITION BY conv ORDER BY path) - 1 AS position FROM walk),
s AS (SELECT r, count(*) FILTER (WHERE level > 0 OR level = -3) AS n_quoted, greatest(0, max(raw) FILTER (WHERE level <> -1)) AS max_level, string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level IN (0, -2)) AS kept FROM l GROUP BY r)
SELECT m.conv AS conv_id, m.turn, m.role, CASE WHEN s.n_quoted > 0 THEN trim(coalesce(s.kept, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE m.text END AS text,
       CAST(s.n_quoted AS BIGINT) AS n_quoted, CAST(s.max_level AS BIGINT) AS max_level, i.from_turn AS reply_to, o.from_conv AS source_conv, o.from_turn AS source_turn,
       coalesce(t.top, m.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, CAST(t.position AS BIGINT) AS position
FROM m JOIN s ON m.r = s.r LEFT JOIN inside i ON m.conv = i.conv AND m.turn = i.turn LEFT JOIN outside o ON m.conv = o.conv AND m.turn = o.turn LEFT JOIN threads t ON m.conv = t.conv AND m.turn = t.turn
"""
