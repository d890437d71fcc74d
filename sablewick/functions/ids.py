"""Names and ids, as expressions that any engine with SHA-256 and MD5 gives alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HYBRID_PREFIX, DENSE_PREFIX, REPO_PREFIX = "hybrid_code_chunks_", "code_chunks_", "chrome_repo_"


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    """``chunk_`` and 16 hex digits of the SHA-256 of path:start:end:content."""
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), content), 256), 1, 16))


def collection_name(path: Column, hybrid: bool = True) -> Column:
    return F.concat(F.lit(HYBRID_PREFIX if hybrid else DENSE_PREFIX), F.substring(F.md5(path), 1, 8))


def repo_collection(repo: Column) -> Column:
    return F.concat(F.lit(REPO_PREFIX), F.regexp_replace(repo, "[^a-zA-Z0-9]", "_"))


def repo_chunk_id(path: Column, position: Column) -> Column:
    return F.concat(path, F.lit("_chunk_"), position.cast("string"))


def snapshot_key(path: Column) -> Column:
    return F.md5(path)


def file_hash(content: Column) -> Column:
    """SHA-256 of the decoded text."""
    return F.sha2(content, 256)
