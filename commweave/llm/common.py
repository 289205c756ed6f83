"""What several operators share: reading a table, words, and cutting lineage through the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commweave.functions.storage import Snapshot as Cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than ASCII space and the controls 9 to 13.
SPACES, WORDS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_digests(text: bytes | None, shingle: int, seed: int, piece: int = 1 << 20) -> Iterator[bytes]:
    """XXH64 (8 bytes each) of all word shingles of a text in lower case (A-Z), space-joined, some megabytes of text at a time.

    Fewer words than a shingle are one; no words give nothing.
    """
    text, carry, at, found = (text or b"").lower(), [], 0, False
    digest = xxhash.xxh64_digest
    while at < len(text):
        end = at + piece
        cut_at = _SPACE.search(text, end) if end < len(text) else None
        end = cut_at.start() if cut_at else len(text)
        words, at = carry + text[at:end].split(), end
        if len(words) >= shingle:
            line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
            yield b"".join([digest(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :])])
            words, found = words[len(words) - shingle + 1 :], True
        carry = words
    if carry and not found:
        yield digest(b" ".join(carry), seed)


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work(), after which a worker that is used again gives its free memory back, so that stages don't add up."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def batch_udf(work: Callable[[pa.Array], pa.Array], kind):
    """An Arrow UDF of one column, trimmed."""
    every = trimmed(lambda batches: map(work, batches))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from every(batches)

    return F.arrow_udf(run, kind)


def word_count(text: Column) -> Column:
    """Words of a text, in the JVM: no task holds batches of texts for it; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    return Cut(df).df


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int"), F.lit(-1))
