"""Chat formatting by quotation linking.

Messages quote earlier ones with leading `>` marks, one for each level. A run of
equally deep quoted lines is a passage, whatever its line breaks. Passages are
normalised and looked up by hashes of word windows in the messages' own words,
with an exact test after the join, which links a passage to the latest earlier
message of its conversation that is the passage, or has it as a line; else to the
latest that holds it. A passage that nobody said as a whole (some of it was left
out) is looked up line by line. The message quoted at the shallowest level is the
parent; a message's thread is what pointer jumping over the parents finds.
Conversations come back in reply order, each message without its quotes: after a
message come its replies, each with all that follows from it, before the next
message that answers nothing or something above.

Ranks, and what was said last before a quote, are found over range partitions, and
reply order by list ranking of a tour of the replies, so a conversation of any size
or shape never has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import discard, partitions, stash
from panelspark.operators.ranks import placed

QUOTED = r"^[ \t]{0,3}>"
#: Lines that announce a quote ("On Monday, Ann wrote:"), if a quote follows.
ATTRIBUTION = r"(?i)^.{0,120}(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"
#: Words in the longest window that is hashed; what follows it is compared as text.
WINDOW = 64


def normal(text: Column) -> Column:
    """Lower case, letters and digits with single spaces: what a quoted passage is compared by."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _depth(line: Column) -> Column:
    marks = F.regexp_extract(line, r"^((?:[ \t]{0,3}>)+)", 1)
    return F.length(F.translate(marks, " \t", ""))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:[ \t]{0,3}>)+ ?", "")


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """`__body` (the text without quotes and attributions) and `__quotes`, an array of (level, text, lines): the passages, normalised, as a whole and line by line."""
    lines = F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\n")
    parsed = F.transform(lines, lambda x: F.struct(_depth(x).alias("level"), _bare(x).alias("text")))
    out = messages.withColumn("__lines", F.when(F.col(f"`{text_col}`").rlike(r"(?m)" + QUOTED), parsed).otherwise(F.transform(lines, lambda x: F.struct(F.lit(0).alias("level"), x.alias("text")))))
    n = F.size("__lines")
    level = lambda i: F.element_at("__lines", i + 1)["level"]
    following = lambda i: F.when(i + 1 < n, level(i + 1)).otherwise(F.lit(0))
    announces = lambda x, i: (following(i) > x["level"]) & x["text"].rlike(ATTRIBUTION)
    body = F.filter("__lines", lambda x, i: (x["level"] == 0) & ~announces(x, i))
    body = F.regexp_replace(F.array_join(F.transform(body, lambda x: x["text"]), "\n"), r"\A\s+|\s+\z", "")
    starts = F.filter(F.transform("__lines", lambda x, i: i), lambda i: F.when(i == 0, F.lit(True)).otherwise(level(i) != level(i - 1)))
    out = out.withColumn("__starts", F.when(F.exists("__lines", lambda x: x["level"] > 0), starts))
    ends = lambda j: F.when(j + 1 < F.size("__starts"), F.element_at("__starts", j + 2)).otherwise(n)
    said = lambda i: lambda x, j: F.when(announces(x, i + j), F.lit("")).otherwise(x["text"])
    runs = F.transform("__starts", lambda i, j: F.struct(level(i).alias("level"), F.transform(F.slice("__lines", i + 1, ends(j) - i), said(i)).alias("lines")))
    passages = F.transform(F.filter(runs, lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), normal(F.array_join(x["lines"], "\n")).alias("text"), F.filter(F.transform(x["lines"], normal), lambda y: y != "").alias("lines")))
    quotes = F.coalesce(F.filter(passages, lambda x: x["text"] != ""), F.array().cast("array<struct<level:int,text:string,lines:array<string>>>"))
    return out.select(*[F.col(f"`{c}`") for c in messages.columns], body.alias("__body"), quotes.alias("__quotes"))


def _said(pieces: DataFrame, messages: DataFrame) -> DataFrame:
    """`conv`, `key`, `turn` and `equal` for each turn of `messages` (conv, turn, mid, body) whose words hold the piece (conv, key, piece): whether it, or one of its lines, is the piece.

    A piece begins with a window of as many words as the largest power of two that
    it holds, WINDOW at most. Windows of these sizes are hashed at every word of the
    messages; where a hash agrees, the words from there on are compared.
    """
    of = pieces.withColumn("n", F.size(F.split("piece", " ")))
    of = of.withColumn("k", F.greatest(*[F.when(F.col("n") >= k, k).otherwise(1) for k in (1 << i for i in range(WINDOW.bit_length()))]))
    of = of.withColumn("hash", F.xxhash64(F.array_join(F.slice(F.split("piece", " "), F.lit(1), F.col("k")), " ")))
    sizes = [r.k for r in of.select("k").distinct().collect()]  # seven powers of two at most
    words = stash(messages.join(pieces.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", "mid", F.split(normal(F.col("body")), " ").alias("words"), F.transform(F.split("body", "\n"), normal).alias("lines")), "words")
    n = F.size("words")
    starts = lambda k: F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
    window = lambda k: lambda p: F.struct(F.lit(k).alias("k"), p.alias("p"), F.xxhash64(F.array_join(F.slice("words", p, F.lit(k)), " ")).alias("hash"))
    at = F.flatten(F.array(*[F.transform(starts(k), window(k)) for k in sizes]))
    windows = words.select("conv", "mid", F.explode(at).alias("w")).select("conv", "mid", "w.k", "w.p", "w.hash")
    hits = windows.join(of, ["conv", "k", "hash"]).select("conv", "mid", "p", "n", "key", "piece")
    found = hits.join(words, ["conv", "mid"]).filter(F.array_join(F.slice("words", F.col("p"), F.col("n")), " ") == F.col("piece"))
    equal = (F.size("words") == F.col("n")) | F.array_contains("lines", F.col("piece"))
    return found.groupBy("conv", "key", "turn").agg(F.max(equal).alias("equal"))


def _latest(pieces: DataFrame, said: DataFrame) -> DataFrame:
    """`pieces` (conv, key, turn, ...) with `said`: the latest turn before theirs in `said` (conv, key, turn, equal), an equal one first; those without one go.

    Both are range partitioned by key and turn; each partition looks back within itself,
    and a small table (a row for each key and partition) holds what the ones before it end with.
    """
    width, keys = partitions(pieces.sparkSession), ["conv", "key"]
    own = pieces.select(*keys, "turn", F.lit(0).alias("kind"), F.lit(None).cast("boolean").alias("equal"), F.struct(*pieces.columns).alias("piece"))
    theirs = said.select(*keys, "turn", F.lit(1).alias("kind"), "equal", F.lit(None).cast(own.schema["piece"].dataType).alias("piece"))
    order = ["turn", "kind"]
    dealt = stash(own.union(theirs).repartitionByRange(width, *keys, *order).withColumn("part", F.spark_partition_id()), "sayings")
    hits = [F.when((F.col("kind") == 1) & F.col("equal"), F.col("turn")), F.when(F.col("kind") == 1, F.col("turn"))]
    ends = dealt.groupBy("part", *keys).agg(*[F.max(h).alias(f"m{i}") for i, h in enumerate(hits)])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", *keys, *[F.max(f"m{i}").over(before).alias(f"before{i}") for i in (0, 1)])
    back = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", *[F.max(h).over(back).alias(f"here{i}") for i, h in enumerate(hits)]).filter("kind = 0")
    found = local.join(ends, ["part", *keys]).select("piece.*", F.coalesce("here0", "before0", "here1", "before1").alias("said"))
    return found.filter("said IS NOT NULL")


def _ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`, the rank (from 0) in `group` by `order`, without a task that holds a whole group.

    Rows are range partitioned by group, order and a tie-breaker; each partition
    ranks its own part, and a small table (a row for each group and partition)
    holds how many rows came before.
    """
    width = partitions(rows.sparkSession)
    dealt = rows.withColumn("__tie", F.xxhash64(*[F.col(c) for c in rows.columns if not c.startswith("__quotes")], F.monotonically_increasing_id()))
    dealt = stash(dealt.repartitionByRange(width, *group, *order, "__tie").withColumn("__part", F.spark_partition_id()), "ranked")
    parts = dealt.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.coalesce(before, F.lit(0)).alias("__before"))
    local = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order, "__tie")) - 1)
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = local.join(parts.withColumnRenamed("__part", "__p"), same, "left")
    return out.select(*rows.columns, (F.col("__rank") + F.col("__before")).cast("long").alias(name))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each message: conv_id, turn, role, `body`, `n_quotes`, `n_linked`, `reply_to`, `thread` and `position`.

    `body` is the text without quotes and their attributions, trimmed; `n_quotes`
    counts quoted passages with a letter or digit, `n_linked` those that an earlier
    turn of the conversation said, as a whole or else in one of their lines (the
    longest found). `reply_to` is the turn quoted at the shallowest level that has a
    link (ties: whole passages first, then the latest turn), else null. `thread` is
    the turn its chain of replies starts at (itself without one), and `position`
    (from 0) the place in the conversation in reply order: depth first, by turn among
    messages that answer the same one, or none.

    A null text gives an empty body; a null role stays. Messages without conv_id
    form one conversation of their own, those without a turn link to nothing and come first.
    Repeated messages each keep a row; ties of turn are placed in any order.
    """
    own = messages.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parsed = stash(parse(own).select("conv_id", "turn", "role", "__body", "__quotes", F.monotonically_increasing_id().alias("mid")), "messages")
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    quoting = parsed.filter((F.size("__quotes") > 0) & F.col("turn").isNotNull())
    if quoting.isEmpty():
        rows = parsed.select("conv_id", "turn", "role", F.col("__body").alias("body"), F.size("__quotes").cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("thread"))
        return _ranked(rows, ["conv_id"], ["thread", "turn"], "position")
    passages = quoting.select(conv.alias("conv"), "turn", "mid", F.posexplode("__quotes").alias("at", "q"))
    parts = F.array_union(F.array(F.struct(F.lit(True).alias("whole"), F.col("q.text").alias("piece"))), F.transform("q.lines", lambda x: F.struct((x == F.col("q.text")).alias("whole"), x.alias("piece"))))
    pieces = stash(passages.select("conv", "turn", "mid", "at", "q.level", F.explode(parts).alias("x")).select("conv", "turn", "mid", "at", "level", "x.whole", "x.piece", F.md5("x.piece").alias("key")), "pieces")
    said = _said(pieces.select("conv", "key", "piece").distinct(), parsed.filter(F.col("turn").isNotNull()).select(conv.alias("conv"), "turn", "mid", F.col("__body").alias("body")))
    links = _latest(pieces, said)
    best = F.max(F.struct("whole", F.length("piece").alias("length"), "said"))
    links = stash(links.groupBy("conv", "turn", "mid", "at", "level").agg(best.alias("best")).select("conv", "turn", "mid", "level", "best.whole", "best.said"), "links")
    parents = stash(links.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "whole", "said"))["said"].alias("reply_to")), "parents")
    linked = links.groupBy("mid").agg(F.count(F.lit(1)).alias("n_linked"))
    places = reply_order(parsed.filter(F.col("turn").isNotNull()).select(conv.alias("conv"), "turn").distinct(), parents)
    rows = parsed.withColumn("conv", conv).join(_threads(parents), ["conv", "turn"], "left").join(linked, "mid", "left").join(places, ["conv", "turn"], "left")
    rows = rows.select(
        "conv_id", "turn", "role", F.col("__body").alias("body"), F.size("__quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("place", "turn").alias("place"),
    )
    return _ranked(rows, ["conv_id"], ["place", "turn"], "position").drop("place")


def reply_order(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """`conv`, `turn`, `place` (from 0) of the nodes of conversations with a reply: depth first, siblings by turn.

    A tour of a conversation enters and leaves each message: from entering to entering its
    first reply or leaving it, from leaving to entering the next sibling or leaving the parent.
    Doubling the steps along the tour counts the messages entered from each on, in as many
    rounds as the log of the longest tour.
    """
    told = nodes.join(parents.select("conv").distinct(), "conv", "left_semi").join(parents, ["conv", "turn"], "left")
    # Messages without a parent are siblings too; the next sibling is the next in a global order.
    numbered = stash(placed(told, ["conv", F.col("reply_to").isNotNull(), "reply_to", "turn"], "at"), "siblings")
    following = numbered.select((F.col("at") - 1).alias("at"), F.col("conv").alias("c"), F.col("reply_to").alias("p"), F.col("turn").alias("sibling"))
    following = numbered.join(following, "at", "left").withColumn("sibling", F.when((F.col("c") == F.col("conv")) & F.col("p").eqNullSafe(F.col("reply_to")), F.col("sibling"))).select("conv", "turn", "reply_to", "sibling")
    children = told.filter("reply_to IS NOT NULL").groupBy("conv", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    step = lambda turn, out: F.struct(turn.alias("turn"), F.lit(out).alias("out"))
    enter = following.join(children, ["conv", "turn"], "left").select("conv", step(F.col("turn"), False).alias("x"), F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(F.col("turn"), True)).alias("next"), F.lit(1).cast("long").alias("n"))
    leave = following.select("conv", step(F.col("turn"), True).alias("x"), F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), False)).when(F.col("reply_to").isNotNull(), step(F.col("reply_to"), True)).alias("next"), F.lit(0).cast("long").alias("n"))
    tour = stash(enter.union(leave), "tour")
    while not tour.filter("next IS NOT NULL").isEmpty():
        ahead = tour.select("conv", F.col("x").alias("next"), F.col("next").alias("further"), F.col("n").alias("more"))
        before, tour = tour, stash(tour.join(ahead, ["conv", "next"], "left").select("conv", "x", F.col("further").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "tour")
        discard(before)
    totals = told.groupBy("conv").agg(F.count(F.lit(1)).alias("total"))
    return tour.filter("NOT x.out").join(totals, "conv").select("conv", F.col("x.turn").alias("turn"), (F.col("total") - F.col("n")).alias("place"))


def _threads(parents: DataFrame) -> DataFrame:
    """`thread` of each message with a parent: pointer jumping, as many rounds as the log of the longest chain."""
    up = parents.select("conv", "turn", "reply_to", F.col("reply_to").alias("thread"))
    while True:
        above = up.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("further"))
        step = up.join(above, (F.col("conv") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        up = stash(step.select("conv", "turn", "reply_to", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")), "threads")
        if up.filter("moved").isEmpty():
            return up.drop("moved")
        up = up.drop("moved")


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

SQL = rf"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, role, i, length(translate(regexp_extract(ln, '^((?:[ \t]{{{{0,3}}}}>)+)', 1), ' ' || chr(9), '')) AS level, regexp_replace(ln, '^(?:[ \t]{{{{0,3}}}}>)+ ?', '') AS bare
  FROM (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS ln, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations)
), a AS (
  SELECT *, (coalesce(lead(level) OVER w, 0) > level AND regexp_matches(bare, '{ATTRIBUTION}')) AS announces, coalesce(lag(level) OVER w <> level, true) AS starts FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), m AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run, CASE WHEN announces THEN '' ELSE bare END AS said FROM a),
b AS (
  SELECT conv_id, turn, any_value(role) AS role, regexp_replace(coalesce(string_agg(CASE WHEN level = 0 AND NOT announces THEN bare END, chr(10) ORDER BY i), ''), '\A\s+|\s+\z', '', 'g') AS body FROM m GROUP BY conv_id, turn
), w AS (SELECT *, {_NORMAL.format("body")} AS words, list_transform(string_split(body, chr(10)), lambda x: {_NORMAL.format("x")}) AS lines FROM b),
q AS (SELECT conv_id, turn, run, level, {_NORMAL.format("string_agg(said, chr(10) ORDER BY i)")} AS text, list({_NORMAL.format("said")}) AS lines FROM m WHERE level > 0 GROUP BY ALL),
p AS (
  SELECT conv_id, turn, run, level, piece, bool_or(piece = text) AS whole FROM (SELECT *, unnest(list_append(lines, text)) AS piece FROM q WHERE text <> '') WHERE piece <> '' GROUP BY ALL
), s AS (
  SELECT p.conv_id, p.turn, run, level, piece, whole, arg_max(w.turn, (w.words = piece OR list_contains(w.lines, piece), w.turn)) AS said
  FROM p JOIN w ON w.conv_id = p.conv_id AND w.turn < p.turn AND contains(' ' || w.words || ' ', ' ' || piece || ' ') GROUP BY ALL
), k AS (SELECT conv_id, turn, run, level, max({{{{'w': whole, 'n': length(piece), 'said': said}}}}) AS best FROM s GROUP BY ALL),
r AS (SELECT conv_id, turn, max({{{{'d': -level, 'w': best.w, 'said': best.said}}}}).said AS reply_to, count(*)::BIGINT AS n_linked FROM k GROUP BY conv_id, turn),
t AS (
  SELECT b.conv_id, b.turn, [b.turn] AS path FROM b ANTI JOIN r USING (conv_id, turn)
  UNION ALL SELECT r.conv_id, r.turn, list_append(t.path, r.turn) FROM t JOIN r ON r.conv_id = t.conv_id AND r.reply_to = t.turn
)
SELECT b.conv_id, b.turn, b.role, b.body, (SELECT count(*) FROM q WHERE q.conv_id = b.conv_id AND q.turn = b.turn AND q.text <> '')::BIGINT AS n_quotes, coalesce(r.n_linked, 0)::BIGINT AS n_linked, r.reply_to, t.path[1] AS thread,
  (row_number() OVER (PARTITION BY b.conv_id ORDER BY t.path) - 1)::BIGINT AS position
FROM b LEFT JOIN r USING (conv_id, turn) JOIN t USING (conv_id, turn)
""".replace("{{", "{").replace("}}", "}")
