"""Rows to embed, encoders as pandas UDFs, filters on payloads, and index runs that resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.session import materialize

TEMPLATES = {"text_only": ("text",), "citation_text": ("citation", "text"), "law_citation_text": ("law_name", "citation", "text")}


def embedding_input(template: str = "text_only") -> Column:
    """The text to embed; null if a part is blank."""
    parts = [text.blank_to_null(c) for c in TEMPLATES[template]]
    return F.when(F.forall(F.array(*parts), lambda x: x.isNotNull()), F.array_join(F.array(*parts), "\n"))


def indexable_text() -> Column:
    """What sparse retrieval searches of a chunk; nulls are left out."""
    return F.concat_ws("\n", "law_id", "law_name", "citation", "hierarchy_path", "article_title", "text")


def payload_filter(exclude_repealed: bool = False, **equal: str) -> Column:
    """Equality on columns that are given; ``exclude_repealed`` keeps rows whose flags are false, so null flags go."""
    cond = F.lit(True)
    for c, v in equal.items():
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    if exclude_repealed:
        cond = cond & (F.col("metadata.is_empty_or_repealed") == F.lit(False)) & (F.col("metadata.is_source_unit_repealed") == F.lit(False))
    return cond


#: The columns of a chunk that a vector's payload holds, those of a hit, and what a hit must not lack.
PAYLOAD = (
    "chunk_id", "law_id", "law_name", "level", "chunk_kind", "article_number", "article_title", "clause_number", "point_label", "citation", "hierarchy_path", "source_node_id",
    "parent_article_node_id", "parent_chunk_id", "text", "parent_text", "text_hash", "parent_text_hash", "source_url", "source_domain", "source_type", "source_file",
)
CRITICAL = ("chunk_id", "law_id", "citation", "text")


def vector_payload(chunks: DataFrame, model: str, run_id: str, revision: str | None = None, schema_version: str = "0.1.0") -> DataFrame:
    """The chunks' columns as they stand, metadata and warnings, where the vectors came from, and what is never inferred:
    dates and status are null, tags are empty. Blank provenance raises."""
    for name, x in (("model", model), ("run_id", run_id), ("schema_version", schema_version), *([("revision", revision)] if revision is not None else [])):
        if not x or not x.strip():
            raise ValueError(f"{name} must not be blank")
    lit = lambda x: F.lit(x).cast("string")
    return chunks.select(
        lit(schema_version).alias("schema_version"), *PAYLOAD, "metadata", "warnings", lit(model).alias("embedding_model"), lit(revision).alias("embedding_revision"), lit(run_id).alias("indexing_run_id"),
        lit(None).alias("effective_date"), lit(None).alias("expiry_date"), lit(None).alias("status"), F.array().cast("array<string>").alias("domain_tags"),
    )


def hits_of(payloads: DataFrame, point_id: str | None = None) -> DataFrame:
    """Payload rows as hits: text columns trimmed, blank ones null; ``issues`` names the critical fields that are missing
    in the payload. With ``point_id`` (dense search) a missing chunk_id is that id, and is an issue still."""
    clean = {c: text.blank_to_null(c) for c in PAYLOAD}
    missing = F.array_compact(F.array(*[F.when(clean[c].isNull(), F.lit(c)) for c in CRITICAL]))
    shown = {c: F.trim(v) for c, v in clean.items()}
    if point_id:
        shown["chunk_id"] = F.coalesce(shown["chunk_id"], F.trim(text.blank_to_null(point_id)))
    rest = [c for c in payloads.columns if c not in PAYLOAD]
    return payloads.select(*rest, *[v.alias(c) for c, v in shown.items()], missing.alias("issues"))


def schema_differences(actual: DataFrame, wanted: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, wanted type, actual type) where a table differs from what an index needs; '' where a column is missing."""
    have = dict(actual.dtypes)
    return [(c, t, have.get(c, "")) for c, t in wanted.items() if have.get(c, "") != t]


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model, for tests and dry runs: signed feature hashing of words, unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x8000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return encode


def embed(df: DataFrame, content: Column, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """The frame with vectors of ``content``; the encoder is made once per Python worker. Null content gives null."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for s in it:
            have = s.notna()
            v: list = [None] * len(s)
            if have.any():
                rows = np.asarray(encode(s[have].tolist()), np.float32)
                if rows.shape[0] != have.sum() or not np.isfinite(rows).all():
                    raise ValueError("the encoder must return one finite vector per text")
                for k, row in zip(np.nonzero(have.to_numpy())[0], rows):
                    v[k] = row
            yield pd.Series(v, index=s.index, dtype=object)

    return df.withColumn(out, run(content))


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier run has finished."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def index_run(chunks: DataFrame, path: str, key: str, content: Column, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batches: int = 1) -> dict[str, int]:
    """Embeds what the index at ``path`` lacks and puts it there, in ``batches`` commits by hash of the key; a run that
    broke off goes on where it was, and a finished one changes nothing. Returns counts before and after."""
    from lexweave.sources.files import upsert_parquet

    spark = chunks.sparkSession

    def stored() -> DataFrame | None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return spark.read.parquet(path) if there else None  # what is there and can't be read is an error

    before = stored()
    n_before = 0 if before is None else before.count()
    todo = chunks.where(F.col(key).isNotNull()).dropDuplicates([key])
    for b in range(batches):
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
        now = stored()
        if now is not None:
            part = remaining(part, now, key)
        # Written once: what follows looks at the rows several times, and the encoder runs once.
        rows = materialize(embed(part, content, make_encoder).where("embedding is not null"))
        if not rows.isEmpty():
            upsert_parquet(spark, path, rows, key)
    after = stored()
    return {"before": n_before, "after": 0 if after is None else after.count()}
