"""Byte-level token ids as columns, and file and JSON identities."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Byte tokens are 0-255, followed by three controls.
BOS, PAD, EOS, BYTE_VOCABULARY = 256, 257, 258, 259


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of the text as an array of ints (for short texts; operators/score.py has
    an Arrow stage for whole documents)."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes, computed where the file is read."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def canonical_hash(value: Any) -> str:
    """SHA-256 of compact JSON with sorted keys, characters kept."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def identity_hash(value: Any) -> str:
    """SHA-256 of JSON with sorted keys, default separators and ASCII escapes; another
    identity than canonical_hash, kept apart on purpose."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()
