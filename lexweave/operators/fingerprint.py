"""Fingerprints of tables and deterministic ids."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values as a JSON array, nulls included."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows and a fingerprint that doesn't depend on the order of rows. Row hashes are combined by sums in
    four 60-bit lanes, so nothing is sorted or gathered; repeated rows count as often as they stand."""
    cols = sorted(columns or df.columns)
    h = df.select(row_hash(cols).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"l{i}") for i in range(4)]
    s = h.agg(F.count("*").alias("n_rows"), *lanes)
    return s.select("n_rows", F.sha2(F.concat_ws("|", F.lit(",".join(cols)), "n_rows", *[F.coalesce(F.col(f"l{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, position: str, columns: list[str] | None = None) -> DataFrame:
    """One row as of :func:`table_fingerprint`, in which the place of every row counts: ``position`` is part of its hash."""
    return table_fingerprint(df, [*(columns or [c for c in df.columns if c != position]), position])


def manifest_hash(manifest: dict, own: str) -> str:
    """SHA-256 of a manifest's canonical JSON, in which the field ``own``, where the hash itself is kept, counts as zeros."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({**manifest, own: "0" * 64}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def point_id(name: Column | str, namespace: str) -> Column:
    """UUID version 5 of a name under the version-5 UUID of ``namespace`` in the URL space: SHA-1 in the JVM, with version
    and variant bits set."""
    ns = uuid.uuid5(uuid.NAMESPACE_URL, namespace).hex
    c = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(c, "utf-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.when(c.isNotNull(), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def canonical_json(c: str):
    """A JSON text with sorted keys and no spaces; what isn't JSON gives null."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        import json

        def one(x):
            try:
                return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return f(F.col(c))
