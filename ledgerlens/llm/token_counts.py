"""Token counts by a map-side two-tier lookup.

A text is normalised and cut into pre-tokens as the tokenizer does it; its count is the sum of its pre-tokens'
lengths in tokens. Tier one is a broadcast table of the lengths of frequent pre-tokens, at most ``frequent`` of
them. Tier two is a cache in each Python worker: a miss is encoded once by the tokenizer's own model and kept until
the cache holds ``cache_size`` entries, when it is emptied. No pre-token of the documents is shuffled, and the table
only saves time: counts don't depend on it, so it is taken from one text in ``every``, by a hash of the row. Tasks
count their pre-tokens in summaries of at most ``SUMMARY`` entries (halved when full, rarest first), which one
aggregation adds up; the ``frequent`` most frequent reach the driver.

The split is that of the normaliser (NFC, white space, lower case) and pre-tokenizer of ``word_bpe_49k.json``; a
tokenizer that declares another one, and a text with letters newer than its Unicode tables, go through its library
as a whole. Special strings inside texts are
single tokens, as is the library's default; no begin or end tokens are added.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts are counted whole; repeated rows are counted each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.arrow import bound_batches
from ledgerlens.session import table

LIMIT = 2048
EVERY = 64
FREQUENT = 20_000
CACHE_SIZE = 500_000
#: Pre-tokens in a task's summary.
SUMMARY = 1 << 16

#: The declaration for which the split below is right.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Fixed value: the tokenizer's own pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White_Space in Unicode, as the tokenizer's regex engine reads \s.
WHITE = r"\t-\r \x85\xa0  -     　"
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    """Letters and numbers of later Unicode versions than the tokenizer's regex engine, for which they are symbols."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


class PreTokenCounter:
    """Counts the tokens of texts for one tokenizer file, with the two tiers of lengths."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_size: int = CACHE_SIZE) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        said = json.loads(self.tokenizer.to_str())
        added = [x for x in said["added_tokens"] or [] if x["special"]]
        first, *rest = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.split_known = (
            [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS
            and (first.get("pattern"), first.get("behavior"), first.get("invert")) == ({"Regex": PATTERN}, "Removed", True)
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)]
            and len(added) == len(said["added_tokens"] or [])
            and not any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        )
        self.specials = re.compile("|".join(re.escape(x["content"]) for x in added)) if added else None
        self.split = regex.compile(PATTERN.replace(r"\s", WHITE))
        self.newer = newer_letters()
        self.letters = byte_letters()
        self.frequent, self.cache, self.cache_size = frequent or {}, {}, cache_size

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if text.isascii():
            return ASCII_SPLIT.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.split.findall(text.replace("Σ", "σ").lower())  # each letter alone: no final sigma

    def length(self, pre_token: str) -> int:
        """Tokens of one pre-token, by the tokenizer's model."""
        return len(self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))

    def pieces(self, text: str) -> list[str]:
        return self.specials.split(text) if self.specials else [text]

    def count(self, text: str) -> int:
        if not self.split_known or not (text.isascii() or self.newer.isdisjoint(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = self.pieces(text)
        total, get, cache = len(pieces) - 1, self.frequent.get, self.cache
        for piece in pieces:
            for word in self.pre_tokens(piece):
                n = get(word)
                if n is None:
                    n = cache.get(word)
                    if n is None:
                        if len(cache) >= self.cache_size:
                            cache.clear()
                        cache[word] = n = self.length(word)
                total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str, packed: bytes) -> PreTokenCounter:
    """The worker's counter; kept between tasks. ``packed``: lines of a length byte and a pre-token."""
    lines = packed.decode().split("\n") if packed else []
    return PreTokenCounter(path, {x[1:]: ord(x[0]) for x in lines})


def frequent_table(docs: DataFrame, id_col: str, text_col: str, path: str, every: int, frequent: int) -> bytes:
    """The packed table: the most frequent pre-tokens of the sample with their lengths; one job, however many partitions."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = counter(path, b""), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in own.pieces(text):
                    seen.update(own.pre_tokens(piece))
                if len(seen) > SUMMARY:
                    seen = Counter(dict(seen.most_common(SUMMARY // 2)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys())), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    text = F.col(text_col)
    chosen = docs.select(text.alias("text")).filter(text.isNotNull() & (F.pmod(F.xxhash64(F.col(id_col), text), F.lit(every)) == 0))
    counts = chosen.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    own = counter(path, b"")
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    return "\n".join(chr(n) + r.word for r in top if 0 < (n := own.length(r.word)) < 10).encode()


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, every: int = EVERY, frequent: int = FREQUENT
) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit for every row of ``docs``; ``path`` is the tokenizer's file."""
    spark = docs.sparkSession
    bound_batches(spark)
    packed = spark.sparkContext.broadcast(frequent_table(docs, id_col, text_col, path, every, frequent))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, packed.value)
        for batch in batches:
            texts = batch.column(1)
            size = pa.compute.binary_length(texts.cast(pa.large_string())).cast(pa.int64())
            n = pa.array([own.count(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], ["id", "n_bytes", "n_tokens"])

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(lengths, out)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Tokens of every text of ``documents``."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path(tokenizer)))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
