"""Problem 9: mixing sources to target shares of the tokens.

Method: Sainte-Laguë apportionment. The budget is divided into equal-token blocks; sources get blocks by highest
quotients, each up to what its capped repetition can fill; a source's blocks go to its shards by the same rule; in a
shard, documents in seeded order fill the blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import materialize, spread


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients w / (2 s + 1), none above its cap. Ties go to the earlier. Stops when all caps are full."""
    caps = [seats] * len(weights) if caps is None else caps
    got = [0] * len(weights)
    # All quotients above a threshold low enough in number are taken at once: w / x rounded, with x so large that the
    # rounded claims can't exceed the seats. They are a prefix of the order by quotients. What full caps leave over is
    # taken at once among the others in the same way; the heap gives out the rest, about half a seat for each weight.
    open_ = [i for i, w in enumerate(weights) if w > 0]
    while open_:
        total, spare = sum(weights[i] for i in open_), seats - sum(got) + sum(got[i] for i in open_) - len(open_) / 2
        if spare <= 0:
            break
        claims = {i: int(weights[i] / total * spare + 0.5) for i in open_}
        full = {i for i in open_ if claims[i] >= caps[i]}
        for i in open_:
            got[i] = caps[i] if i in full else max(got[i], claims[i])
        open_ = [i for i in open_ if i not in full]
        if not full:
            break
    heap = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, got)) if w > 0 and g < caps[i]]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def token_counter(tokenizer_path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens by a public vocabulary file: .tiktoken ranks, a tokenizers .json or a sentencepiece .model."""
    if tokenizer_path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # The public pattern that splits text before the merges of rank files.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if tokenizer_path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.encode_special_tokens = True
        return lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


_counters: dict[str, Callable] = {}


def count_tokens(tokenizer_path: str):
    """Pandas UDF: tokens of a text; null counts 0."""

    @F.pandas_udf("bigint")
    def f(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counters.get(tokenizer_path) or _counters.setdefault(tokenizer_path, token_counter(tokenizer_path))
        for s in it:
            yield pd.Series(count(["" if x is None else x for x in s.tolist()]), dtype="int64")

    return f


def source_key(c: str):
    """Source names compare trimmed and lower-cased."""
    return F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))


def sized(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", source: str = "source", n_shards: int = 256, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tokens, shard, draw) of every document: shard and draw are seeded hashes of the key, so a hot
    source spreads over all shards and the order inside a shard does not depend on the files' layout."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return spread(docs.select(F.col(key).alias(key), F.col(text).alias(text), F.col(source).alias(source))).select(
        F.col(key).alias("doc_id"), source_key(source).alias("source"), count_tokens(tokenizer_path)(F.col(text)).alias("tokens"), F.pmod(h, F.lit(n_shards)).cast("int").alias("shard"), F.xxhash64(F.lit(seed), F.lit("draw"), F.col(key)).alias("draw")
    )


#: Sources that a mixture may have: as many rows come to the driver.
MOST_SOURCES = 10_000


def wanted_shares(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source to (share, repeats). Of repeated rows of a source the largest share stands, with its largest repeats. Names
    are made distinct before they are counted, so repeated rows never push a source out."""
    own = targets.select(source_key("source").alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("m")).where("s is not null")
    rows = own.groupBy("s").agg(F.max(F.struct("w", "m")).alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    return {r["s"]: (float(r["t"]["w"]), int(r["t"]["m"])) for r in sorted(rows, key=lambda r: r["s"])}


def shard_quotas(sums: DataFrame, quotas: DataFrame, block_tokens: int) -> DataFrame:
    """(source, shard, budget, shard_tokens, most): each source's blocks among its shards by highest quotients, token by
    token, so that a shard smaller than a block is neither given more than it holds nor left out. A group is the shards of
    one source, as many rows as there are shards."""

    def share_out(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("shard")
        most = int(df["most"].iloc[0])
        budget = sainte_lague(df["t"].tolist(), int(df["blocks"].iloc[0]) * block_tokens, [most * int(t) for t in df["t"]])
        return pd.DataFrame({"source": df["source"], "shard": df["shard"], "budget": budget, "shard_tokens": df["t"], "most": most})

    own = sums.where("t > 0").join(F.broadcast(quotas), "source")  # at most MOST_SOURCES rows
    return own.groupBy("source").applyInPandas(share_out, "source string, shard int, budget bigint, shard_tokens bigint, most int")


def mix(docs: DataFrame, targets: DataFrame, tokenizer_path: str, block_tokens: int = 64, n_shards: int = 256, seed: str = "mix", **columns: str) -> tuple[DataFrame, DataFrame]:
    """(picked documents with their copies, report).

    The mixture is as large as all documents together. ``picked``: doc_id, source, tokens, copies (1 .. max_repeats).
    ``report``: source, size_tokens, target_share, max_repeats, reachable_tokens, wanted_blocks, quota_blocks, short,
    got_tokens, got_share. wanted_blocks are the blocks by highest quotients without caps, quota_blocks with them; a source
    is ``short`` if its cap cut its quota below what was wanted and what was picked stays below it too. Documents whose
    source is no target count towards the size of all only. A null text has no tokens; repeated rows are used as often as
    they stand; an empty table gives a report of zeros. Of repeated target rows the largest share counts.

    ``n_shards`` is a parameter and does not follow the data, so the same documents are picked whatever else the tables
    hold; a task sorts one shard of one source. Only totals per source (MOST_SOURCES at most) come to the driver.
    """
    spark = docs.sparkSession
    want = wanted_shares(targets)
    names = list(want)
    d = materialize(sized(docs, tokenizer_path, n_shards=n_shards, seed=seed, **columns))
    own = F.when(F.col("source").isin(names), F.col("source"))
    sums = materialize(d.groupBy(own.alias("source"), "shard").agg(F.sum("tokens").alias("t")))
    all_of = {r["source"]: int(r["t"] or 0) for r in sums.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    seats = sum(all_of.values()) // block_tokens
    size = [all_of.get(s, 0) for s in names]
    shares, most = [want[s][0] for s in names], [want[s][1] for s in names]
    caps = [m * n // block_tokens for m, n in zip(most, size)]
    wanted, quota = sainte_lague(shares, seats), sainte_lague(shares, seats, caps)
    head = spark.createDataFrame(
        [(s, n, w, m, m * n, a, q) for s, n, w, m, a, q in zip(names, size, shares, most, wanted, quota)],
        "source string, size_tokens long, target_share double, max_repeats int, reachable_tokens long, wanted_blocks long, quota_blocks long",
    )
    plan = shard_quotas(sums, head.select("source", F.col("quota_blocks").alias("blocks"), F.col("max_repeats").alias("most")), block_tokens)
    # The window is a source's shard, ordered by the seeded draw: bounded by the choice of n_shards, not by a source.
    w = Window.partitionBy("source", "shard").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = d.where("tokens > 0").join(plan, ["source", "shard"]).withColumn("upto", F.sum("tokens").over(w))
    rounds = F.floor(F.col("budget") / F.col("shard_tokens"))
    rest = F.col("budget") - rounds * F.col("shard_tokens")
    # In the last, partial round the document at the end of the budget is taken with the chance of its part inside, so
    # that shards of few documents neither gain nor lose on the whole. The draw gives the chance.
    chance = F.pmod(F.xxhash64("draw", F.lit("end")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.least(rounds + (F.col("upto") - F.col("tokens") * chance <= rest).cast("long"), F.col("most")).cast("int")
    picked = ran.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")
    got = picked.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got_tokens"))
    report = head.join(got, "source", "left").withColumn("got_tokens", F.coalesce("got_tokens", F.lit(0)))
    short = (F.col("quota_blocks") < F.col("wanted_blocks")) & (F.col("got_tokens") < F.col("wanted_blocks") * F.lit(block_tokens))
    whole = F.sum("got_tokens").over(Window.partitionBy(F.lit(0)))  # over at most MOST_SOURCES rows
    return picked, report.withColumn("short", short).withColumn("got_share", F.coalesce(F.round(F.try_divide(F.col("got_tokens"), whole), 6), F.lit(0.0)))
