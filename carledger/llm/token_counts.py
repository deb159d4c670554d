"""Token counts from a digest cache.

A text's content is normalised, digested (SHA-256, cut to 128 bits) and
looked up in a cache of counts under the digest of the tokenizer's version.
Only distinct texts that the cache has not are encoded, each once; their
counts are appended to it. Ids, digests and lengths go through shuffles;
texts are joined to the list of misses where they lie, unless that list is
too long to broadcast.

The cache is a folder of Parquet files partitioned by version. An append that
is repeated after a crash may write a digest twice with the same count, so
readers take one of them. A tokenizer file, library or setting that changes
is another version, whose counts are never mixed with these.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carledger.llm.common import WORKER_CACHES, batches, bounded, only_caches_of, ship, stage
from carledger.session import forget_at_exit, shared_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters that are encoded at once: a longer text is cut where the
#: tokenizer cuts anyway, so memory does not grow with it.
PIECE, BATCH = 100_000, 1_000_000
#: A blank between two letters: byte-level pre-tokenisation always begins a
#: new word there, whatever stands around.
_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _file(name: str) -> str:
    import public_tokenizers
    return name if os.path.sep in name else public_tokenizers.path(name)


def version(name: str = TOKENIZER) -> str:
    """Digest of all that a count depends on besides the text."""
    h = hashlib.sha256()
    with open(_file(name), "rb") as f:
        h.update(f.read())
    if name.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    h.update(json.dumps([library.__name__, library.__version__, "no special tokens added", "null is empty"]).encode())
    return h.hexdigest()[:32]


class Counter:
    """Numbers of tokens of texts, as the tokenizer's own library has them."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = _file(name)
        self.cuts = False
        if name.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._sizes = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._sizes = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        pre = plan["pre_tokenizer"] or {}
        self.cuts = (plan["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"]
                     and not pre["add_prefix_space"] and not any(_BREAK.search(t["content"]) for t in plan["added_tokens"]))

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > PIECE:
            found = _BREAK.search(text, at + PIECE)
            if found is None:
                break
            yield text[at:found.start()]
            at = found.start()
        yield text[at:]

    def sizes(self, texts: list[str]) -> list[int]:
        out, owner, held, chars = [0] * len(texts), [], [], 0

        def flush():
            for i, n in zip(owner, self._sizes(held)):
                out[i] += n
            owner.clear()
            held.clear()
        for i, t in enumerate(texts):
            for p in self._pieces(t):
                owner.append(i)
                held.append(p)
                chars += len(p)
                if chars > BATCH:
                    flush()
                    chars = 0
        if held:
            flush()
        return out


_COUNTERS: dict[str, Counter] = {}
WORKER_CACHES["token_counts"] = _COUNTERS.clear


def _counter(name: str) -> Counter:
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(name)
    return _COUNTERS[name]


def encode(texts: DataFrame, name: str) -> DataFrame:
    """(digest, n_tokens) from (digest, text)."""
    ship(texts.sparkSession)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("token_counts")
        c = _counter(name)
        for b in batches(it, 500):
            yield pa.record_batch([b.column(0), pa.array(c.sizes(b.column(1).to_pylist()), pa.int64())],
                                  names=["digest", "n_tokens"])
    return texts.select("digest", "text").mapInArrow(counted, "digest binary, n_tokens long")


def content(text: Column) -> Column:
    """The normalised content that digests and counts are of. Counts depend
    on every character, so only a null is made an empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


CACHE = "digest binary, n_tokens long, version string"


def stored(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """(digest, n_tokens) of a version, a digest once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == of)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count(docs: DataFrame, cache: str, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others are ignored):
    doc_id, n_bytes, n_tokens, over_limit. ``cache``: the cache's folder,
    made if it is not there; what it lacks is appended.

    Null and empty texts have no bytes and no tokens. Rows with equal texts
    are encoded once, whatever their ids, null ids included; repeated rows
    are repeated in the result; an empty table gives an empty one and leaves
    the cache as it is. Very long texts are encoded in pieces where the
    tokenizer allows it."""
    spark = docs.sparkSession
    of = version(name)
    rows = docs.select(F.col("doc_id").cast("long"), content(F.col("text")).alias("text"))
    rows = rows.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    keyed = stage(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    # One id of each text that is not stored, and how many rows have both.
    same = keyed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    one = same.groupBy("digest").agg(F.min(F.struct("doc_id", "k")).alias("one"))
    misses = stage(one.join(stored(spark, cache, of).select("digest"), "digest", "left_anti")
                   .select("digest", F.col("one.doc_id").alias("_id"), F.col("one.k").alias("k")), "misses")
    most = misses.agg(F.max("k")).first()[0]
    if most:
        wanted = bounded(misses.select(F.col("digest").alias("_digest"), "_id"))
        texts = rows.join(wanted, (rows["digest"] == wanted["_digest"]) & rows["doc_id"].eqNullSafe(wanted["_id"])).select("digest", "text")
        if most > 1:
            texts = texts.dropDuplicates(["digest"])
        (encode(texts, name).withColumn("version", F.lit(of)).write.mode("append").partitionBy("version")
         .option("compression", "zstd").parquet(cache))
    known = stored(spark, cache, of)
    return (keyed.join(known.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def counted(docs: DataFrame) -> DataFrame:
    """The counts of all ``docs`` from a cache that is empty at first, so
    that every distinct text is encoded; it goes with the application."""
    cache = shared_path(docs.sparkSession, "token-cache")
    forget_at_exit(docs.sparkSession, cache)
    return count(docs, cache)
