"""Message stores: order, context windows, follow-up questions, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text

# Words that make a question lean on the one before it.
REFERENCES = ("điều đó", "việc đó", "trường hợp này", "trường hợp đó", "như trên", "nói trên", "that case", "this case", "the above")
OPENINGS = ("còn ", "vậy ", "thế ", "nếu vậy", "and ", "then ", "what about")
# Endings that make a question lean on the one before it unless it names a topic of its own.
ENDINGS = ("thì sao", "được không", "áp dụng cho ai")
TOPICS = (
    "bảo hiểm xã hội", "bảo hiểm y tế", "bị phạt", "bồi thường", "cấp thẻ", "đất đai", "điều kiện", "hợp đồng", "khởi kiện", "kết hôn", "ly hôn", "nghỉ hằng năm", "nghỉ phép", "nghĩa vụ", "người lao động", "quyền", "thời hiệu", "thuế", "trẻ em", "trợ cấp", "xử phạt",
)


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, title, updated_at, created_at, n_messages), repeated rows once. A list is shown by updated_at, created_at and id,
    newest first; the rows have no place of their own, so that a page of them is an ordinary top-k."""
    c = conversations.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "created_at", "title")).alias("r")).select("id", "r.*")
    n = messages.where("id is not null").select("conversation_id", "id").distinct().groupBy("conversation_id").agg(F.count("*").alias("n")).withColumnRenamed("conversation_id", "id")
    return c.join(n, "id", "left").select("id", "title", "updated_at", "created_at", F.coalesce("n", F.lit(0)).alias("n_messages"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row per message id; of repeated ones the earliest."""
    m = messages.where("id is not null and conversation_id is not null")
    return m.groupBy("id").agg(F.min(F.struct("created_at", "conversation_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))).alias("r")).select("id", "r.*").withColumn("role", F.lower(F.trim("role")))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` messages of every conversation, then without blank ones: (conversation_id, id, role, content, age).
    The ranking is limited before the shuffle, so a hot conversation sends n rows per partition."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    m = distinct_messages(messages).withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
    return m.where(text.blank_to_null("content").isNotNull()).select("conversation_id", "id", "role", "content", "age")


def is_follow_up(c: Column | str) -> Column:
    """Whether a question refers to what was said before it."""
    q = text.fold(text.collapse(c))
    refers = F.lit(False)
    for p in REFERENCES:
        refers = refers | F.contains(q, F.lit(p))
    for p in OPENINGS:
        refers = refers | F.startswith(q, F.lit(p))
    ends, topic = F.lit(False), F.lit(False)
    for p in ENDINGS:
        ends = ends | F.endswith(q, F.lit(p))
    for p in TOPICS:
        topic = topic | F.contains(q, F.lit(p))
    return F.coalesce(refers | (ends & ~topic), F.lit(False))


def rewritten_questions(messages: DataFrame, most: int = 4000) -> DataFrame:
    """(conversation_id, id, follow_up, question): each user message whole, a follow-up with the user message before it in
    front, of which as much is kept as fits into ``most`` characters beside the question."""
    w = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    m = distinct_messages(messages).where("role = 'user'").withColumn("prior", F.lag("content").over(w)).withColumn("follow_up", is_follow_up("content"))
    room = F.lit(most) - F.length("content") - 1
    cut = F.nullif(F.regexp_replace(F.substring(F.col("prior"), F.lit(1), room), r"\s+$", ""), F.lit(""))
    anchor = F.when(F.col("follow_up") & (room > 0), F.when(F.length("prior") <= room, F.col("prior")).otherwise(cut))
    return m.select("conversation_id", "id", "follow_up", F.concat_ws("\n", anchor, "content").alias("question"))


def apply_updates(table: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: the row with the largest version per key from either frame; of equals the update."""
    cols = table.columns
    both = table.withColumn("_new", F.lit(0)).unionByName(updates.select(*cols).withColumn("_new", F.lit(1)))
    rest = [c for c in cols if c != key]
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("r")).select(key, "r.*").select(*cols)


def delete_cascade(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``ids`` (column id)."""
    gone = ids.select("id").distinct()
    return conversations.join(gone, "id", "left_anti"), messages.join(gone.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def fetch(conversations: DataFrame, messages: DataFrame, conversation_id: str, owner_id: str | None = None) -> DataFrame:
    """The messages of one conversation in order; none if it isn't there or another owner's. The filters reach the scans."""
    c = conversations.where(F.col("id") == F.lit(conversation_id))
    if owner_id is not None:
        c = c.where(F.col("owner_id") == F.lit(owner_id))
    m = distinct_messages(messages.where(F.col("conversation_id") == F.lit(conversation_id)))
    return m.join(c.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi").orderBy("created_at", "id")


def appended(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after new messages: known message ids and unknown conversations are refused, updated_at moves on."""
    fresh = new.join(messages.select("id"), "id", "left_anti").join(conversations.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi").select(*messages.columns)
    last = fresh.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("_last"))
    c = conversations.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).select(*conversations.columns)
    return c, messages.unionByName(fresh)


def retitled(conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """Conversations with new titles (id, owner_id, title) where the owner agrees."""
    t = titles.groupBy("id", "owner_id").agg(F.max("title").alias("_title"))
    return conversations.join(t, ["id", "owner_id"], "left").withColumn("title", F.coalesce("_title", "title")).select(*conversations.columns)
