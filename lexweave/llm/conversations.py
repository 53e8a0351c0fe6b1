"""Problem 3: conversations from message rows.

Method: fragments of an export that overlap are assembled by suffix-prefix matches of message hashes; fragments are the
nodes and matches the edges of an overlap graph; unambiguous paths are merged; conversations with gaps are dropped.

Message rows have no fragments of their own. :func:`fragments` exports them: rows are put in order by range partitioning on
(conversation, time, id), so that even one conversation with a third of all rows spreads over many tasks, and cut into runs
of at most ``size`` messages that share ``lap`` messages with the next run. A fragment has no place: its id is a hash of
what it holds. Everything after the export (which fragments follow on each other, the order and number of the turns, and
whether there is a gap) comes from the overlaps alone, so fragments of any other export can be given to :func:`paths`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import materialize


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "") == ""


def clean(messages: DataFrame) -> DataFrame:
    """One row per message id of the messages that count: with a conversation, with content, not of the system.

    Of repeated ids the row earliest by time, conversation, role and content stands, nulls last. A null id can't be told
    from another: such rows are one message if they are alike in all. Roles are trimmed and lower-cased.
    """
    cols = ["conversation_id", "id", "role", "content", "created_at"]
    m = messages.select(*cols)
    first = F.min(F.struct(*[x for c in ("created_at", "conversation_id", "role", "content") for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c))])).alias("r")
    named = m.where("id is not null").groupBy("id").agg(first).select("id", "r.conversation_id", "r.role", "r.content", "r.created_at")
    m = named.select(*cols).unionByName(m.where("id is null").distinct())
    role = F.lower(F.regexp_replace("role", r"^\s+|\s+$", ""))
    m = m.where(F.col("conversation_id").isNotNull() & F.col("content").isNotNull() & ~_blank(F.col("content"))).withColumn("role", F.coalesce(role, F.lit("")))
    return m.where("role <> 'system'")


def numbered(clean_messages: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with ``h``, a hash of the message, and ``pos``, their place from 0 in the conversation by (created_at, id);
    ``keep``: the columns besides those of the order that are carried on.

    A sort over all rows by range, never of a conversation in one task: places inside a partition plus the rows of the
    same conversation in earlier partitions. Those sums have a row per partition and conversation at most.
    """
    h = F.xxhash64("id", "role", "content", "created_at")
    order = ["conversation_id", "created_at", "id", "h"]
    rows = clean_messages.withColumn("h", h)
    rows = rows if keep is None else rows.select(*order, *keep)
    placed = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).withColumn("part", F.spark_partition_id())
    placed = materialize(placed)  # the partition of a row stays what it was when a task is run again
    w = Window.partitionBy("part", "conversation_id").orderBy(*[F.asc_nulls_first(c) for c in order])
    runs = placed.groupBy("conversation_id", "part").agg(F.count("*").alias("n"))
    many = runs.groupBy("conversation_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conversation_id")
    # Only conversations that cross a partition's border, at most one per partition, need an offset.
    before = Window.partitionBy("conversation_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = runs.join(F.broadcast(many), "conversation_id").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conversation_id", "part", "before")
    out = placed.withColumn("k", F.row_number().over(w) - 1).join(F.broadcast(offset), ["conversation_id", "part"], "left")
    return out.withColumn("pos", F.col("k") + F.coalesce("before", F.lit(0))).drop("k", "before", "part")


def fragments(placed: DataFrame, size: int = 64, lap: int = 2, payload: tuple[str, ...] = ("id", "content", "created_at")) -> DataFrame:
    """(conversation_id, fragment_id, messages): runs of ``size`` messages and the ``lap`` messages that follow them.
    ``messages`` is an array in order of (h, role and the columns of ``payload``), without places; fragment_id is a hash of
    the messages' hashes."""
    if not 1 <= lap < size:
        raise ValueError("the overlap is at least one message and less than a run")
    step = F.floor(F.col("pos") / size)
    at = F.when((F.col("pos") % size < lap) & (step > 0), F.array(step, step - 1)).otherwise(F.array(step))
    one = F.struct("pos", "h", "role", *payload)
    runs = placed.withColumn("run", F.explode(at)).groupBy("conversation_id", "run").agg(F.sort_array(F.collect_list(one)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["h"].alias("h"), x["role"].alias("role"), *[x[c].alias(c) for c in payload]))
    return runs.select("conversation_id", F.xxhash64("conversation_id", F.transform("m", lambda x: x["h"])).alias("fragment_id"), messages.alias("messages"))


def overlap_edges(frags: DataFrame, most: int = 8) -> DataFrame:
    """(conversation_id, a, b, lap, n_a): the last ``lap`` hashes of fragment a, of n_a messages, are the first of fragment b;
    the longest match per pair, of at most ``most`` messages. An equality join on the hash of the run."""
    hashes = F.transform("messages", lambda m: m["h"])
    f = frags.select("conversation_id", "fragment_id", F.size("messages").alias("n_a"), F.slice(hashes, 1, most).alias("head"), F.reverse(F.slice(F.reverse(hashes), 1, most)).alias("tail"))
    lens = F.explode(F.sequence(F.lit(1), F.size("head")))
    pre = f.withColumn("lap", lens).select("conversation_id", F.col("fragment_id").alias("b"), "lap", F.xxhash64(F.expr("slice(head, 1, lap)")).alias("key"))
    suf = f.withColumn("lap", F.explode(F.sequence(F.lit(1), F.size("tail")))).select("conversation_id", F.col("fragment_id").alias("a"), "n_a", "lap", F.xxhash64(F.expr("slice(tail, size(tail) - lap + 1, lap)")).alias("key"))
    return suf.join(pre, ["conversation_id", "lap", "key"]).where("a <> b").groupBy("conversation_id", "a", "b").agg(F.max("lap").alias("lap"), F.max("n_a").alias("n_a"))


def paths(frags: DataFrame, most: int = 8) -> DataFrame:
    """The fragments with lap_in (messages shared with the fragment before, null for a path's first), has_next, start (place
    of the first message on the path) and looped (the fragment lies on no path with a first one).

    A match is unambiguous if it is the only longest one out of its first fragment and into its second; those are merged.
    Places come by pointer doubling along the path, from overlaps only: log2 of the longest path rounds, and the fragments
    of a conversation never gather in a task. Conversations of one fragment take no part in it.
    """
    many = frags.groupBy("conversation_id").agg(F.count("*").alias("k")).where("k > 1").select("conversation_id")
    multi = materialize(frags.join(many, "conversation_id", "left_semi").select("conversation_id", "fragment_id", F.transform("messages", lambda m: F.struct(m["h"].alias("h"))).alias("messages")))
    e = overlap_edges(multi, most)
    out_of, into = Window.partitionBy("conversation_id", "a"), Window.partitionBy("conversation_id", "b")
    e = e.withColumn("top_a", F.max("lap").over(out_of)).withColumn("top_b", F.max("lap").over(into)).where("lap = top_a and lap = top_b")
    e = materialize(e.withColumn("na", F.count("*").over(out_of)).withColumn("nb", F.count("*").over(into)).where("na = 1 and nb = 1").select("conversation_id", "a", "b", "lap", "n_a"))
    state = multi.select("conversation_id", F.col("fragment_id").alias("f"))
    state = state.join(e.select("conversation_id", F.col("b").alias("f"), F.col("a").alias("ptr"), F.col("lap").alias("lap_in"), (F.col("n_a") - F.col("lap")).cast("bigint").alias("start")), ["conversation_id", "f"], "left")
    state = state.join(e.select("conversation_id", F.col("a").alias("f"), F.lit(True).alias("has_next")), ["conversation_id", "f"], "left")
    state = materialize(state.withColumn("start", F.coalesce("start", F.lit(0).cast("bigint"))))
    reach, n = 1, multi.count()
    while reach < 2 * n and not state.where("ptr is not null").isEmpty():
        q = state.select("conversation_id", F.col("f").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("start").alias("start2"))
        state = materialize(state.join(q, ["conversation_id", "ptr"], "left").select("conversation_id", "f", F.col("ptr2").alias("ptr"), "lap_in", "has_next", (F.col("start") + F.coalesce("start2", F.lit(0))).alias("start")))
        reach *= 2
    done = state.select("conversation_id", F.col("f").alias("fragment_id"), "lap_in", "has_next", "start", F.col("ptr").isNotNull().alias("looped"))
    out = frags.join(done, ["conversation_id", "fragment_id"], "left")
    return out.withColumn("start", F.coalesce("start", F.lit(0))).withColumn("looped", F.coalesce("looped", F.lit(False)))


def assemble(frags: DataFrame, most: int = 8) -> DataFrame:
    """One row per conversation: n_fragments, n_paths (paths left after merging unambiguous matches, loops as one more),
    n_looped, n_messages, first_role, last_role, alternates (every message's role differs from the one before, all user or
    assistant). A conversation whose fragments merge into one path has no gap."""
    return summed(paths(frags, most))


def summed(chained: DataFrame) -> DataFrame:
    """The rows of :func:`assemble` from those of :func:`paths`; what is summed up are the ends of fragments."""
    roles = F.transform("messages", lambda m: m["role"])
    known = F.forall(roles, lambda r: r.isin("user", "assistant"))
    turns = F.forall(F.zip_with(F.slice(roles, 1, F.size(roles) - 1), F.slice(roles, 2, F.size(roles)), lambda x, y: x != y), lambda t: t)
    f = chained.select("conversation_id", "lap_in", "has_next", "looped", F.size("messages").alias("n"), (known & turns).alias("alt"), F.element_at(roles, 1).alias("r1"), F.element_at(roles, -1).alias("r2"))
    return f.groupBy("conversation_id").agg(
        F.count("*").alias("n_fragments"),
        (F.count("*") - F.count("lap_in") + F.max(F.col("looped").cast("int"))).cast("bigint").alias("n_paths"),
        F.sum(F.col("looped").cast("int")).alias("n_looped"),
        (F.sum("n") - F.coalesce(F.sum("lap_in"), F.lit(0))).alias("n_messages"),
        F.max(F.when(F.col("lap_in").isNull(), F.col("r1"))).alias("first_role"),
        F.max(F.when(F.col("has_next").isNull(), F.col("r2"))).alias("last_role"),
        F.min("alt").alias("alternates"),
    )


def _judged(one: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    known = conversations.select(F.col("id").alias("conversation_id")).where("conversation_id is not null").distinct().withColumn("known", F.lit(True))
    said = messages.select("conversation_id").where("conversation_id is not null").distinct()
    every = known.join(said, "conversation_id", "full").join(one, "conversation_id", "left")
    fault = (
        F.when(F.col("known").isNull(), "unknown")
        .when(F.col("n_messages").isNull(), "empty")
        .when((F.col("n_paths") != 1) | (F.col("n_looped") > 0), "gap")
        .when(~F.col("alternates") | (F.col("first_role") != "user"), "broken")
        .when(F.col("last_role") != "assistant", "unanswered")
    )
    return every.select("conversation_id", fault.alias("fault"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def verdicts(messages: DataFrame, conversations: DataFrame, size: int = 64, lap: int = 2) -> DataFrame:
    """(conversation_id, fault, n_messages) for every id of either table; fault is null for a whole conversation, else
    unknown (no row in conversations), empty (no message left), gap (fragments don't merge into one path), broken (roles
    don't alternate from user to assistant) or unanswered (the last message is the user's)."""
    exported = materialize(fragments(numbered(clean(messages), ("role",)), size, lap, ()))
    return _judged(assemble(exported, max(8, lap)), messages, conversations)


def rebuild(messages: DataFrame, conversations: DataFrame, size: int = 64, lap: int = 2) -> DataFrame:
    """Whole conversations as rows (conversation_id, turn, role, content, created_at), turn from 0, in the order of the
    assembled path. Rows, not arrays, so that no conversation need fit into a cell."""
    exported = materialize(fragments(numbered(clean(messages)), size, lap, ("content", "created_at")))
    chained = materialize(paths(exported, max(8, lap)))
    good = _judged(summed(chained), messages, conversations).where("fault is null").select("conversation_id")
    rows = chained.join(good, "conversation_id").select("conversation_id", "start", F.coalesce("lap_in", F.lit(0)).alias("lap_in"), F.posexplode("messages").alias("i", "m"))
    return rows.where("i >= lap_in").select("conversation_id", (F.col("start") + F.col("i")).alias("turn"), "m.role", "m.content", "m.created_at")
