"""Language by compression.

Each language has a zstandard dictionary of raw content: its frequent words
of a bounded sample, the most frequent last, where references are cheapest.
A text is reduced to lower-case words of letters, cut into pieces, and every
piece is compressed with each dictionary. The language whose sizes sum to
the least is chosen; where the runner-up comes within ``MIN_MARGIN`` of it,
the text is rejected. Every piece of a text counts, however long it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carledger.llm.common import batches, id_remainder, least_rows, only_caches_of, ship

#: Sample for the dictionaries: rows of a language, each with its whole text.
SAMPLE_ROWS = 400
#: Bytes of a dictionary and of a piece. A piece under SHORT bytes is repeated,
#: at least four times and to SHORT bytes: zstandard stores tiny ones as they are.
DICT_BYTES, PIECE, SHORT = 65536, 512, 96
LEVEL = 6
#: Least lead of the best size over the second, as a share of the best.
MIN_MARGIN = 0.004
UNDETERMINED = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def normalised(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def pieces(text: str) -> list[bytes]:
    b = text.encode("utf-8", "replace")
    cut = [b[i:i + PIECE] for i in range(0, len(b), PIECE)]
    return [p if len(p) >= SHORT else b" ".join([p] * max(4, -(-SHORT // len(p)))) for p in cut]


@dataclass(frozen=True)
class Model:
    """(language, dictionary) pairs; on equal sizes an earlier one wins."""
    dictionaries: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[zstd.ZstdCompressor]:
        out = []
        for _, content in self.dictionaries:
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                           write_content_size=False, write_dict_id=False))
        return out


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, how often) of whole texts."""
    for b in batches(it, 100):
        n: dict[str, Counter] = {}
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n.setdefault(lang, Counter()).update(normalised(t).split())
        rows = [(k, w, c) for k, own in n.items() for w, c in own.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                              names=["lang", "word", "n"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from the whole texts of at most SAMPLE_ROWS rows of each
    language. Rows without text or language are left out; copies of a text
    count once; without rows there is no language. The sample is the rows
    with the least hash of their text, so reruns learn the same. Words are
    counted and ranked in Spark; only those of the dictionaries, DICT_BYTES
    for each language, come to the driver."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("text is not null")
    sample = least_rows(rows.select("lang", "text", F.xxhash64("text").alias("h")), "lang", F.col("h"), SAMPLE_ROWS)
    counts = (sample.select("lang", "text").mapInArrow(_words, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    # The most frequent words of a language, as many as fit.
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    size = F.sum(F.octet_length("word") + 1).over(often.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by: dict[str, list] = {}
    for r in counts.withColumn("size", size).filter(F.col("size") <= DICT_BYTES).collect():
        by.setdefault(r["lang"], []).append((-r["n"], r["word"]))
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect() if r["lang"] in by}
    # References are cheapest to what comes last.
    return Model(tuple((k, " ".join(w for _, w in sorted(by[k], reverse=True)).encode()) for k in sorted(by, key=lambda k: (-many[k], k))))


def classify(text: str | None, langs: list[str], compressors: list) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one text."""
    words = normalised(text) if text else ""
    if not langs or not any(map(str.isalpha, words)):
        return UNDETERMINED, 0.0, 0.0, True
    cut = pieces(words)
    sizes = [sum(len(z.compress(p)) for p in cut) for z in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    lead = [(s - sizes[best]) / sizes[best] for i, s in enumerate(sizes) if i != best]
    margin = min(lead, default=1.0)
    # Odds of each language fall with its excess size; 3 % is one factor of e.
    score = 1.0 / (1.0 + sum(math.exp(-x / 0.03) for x in lead))
    return langs[best], score, margin, margin < MIN_MARGIN


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``lang_id``: struct(lang, score, margin,
    rejected); it replaces a column of that name. A text that is null, empty
    or has no letter is ``und``, score 0 and rejected; ties of size go to
    the language with more labelled rows and are rejected. Repeated rows are
    each classified; an empty table gives an empty one. One task reads
    some rows at a time; nothing is shuffled; the broadcast dictionaries
    take DICT_BYTES for each language."""
    ship(docs.sparkSession)
    langs = [k for k, _ in model.dictionaries]

    @F.pandas_udf("lang string, score double, margin double, rejected boolean")
    def found(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only_caches_of("langid")
        compressors = model.compressors()
        for texts in it:
            yield pd.DataFrame([classify(t, langs, compressors) for t in texts],
                               columns=["lang", "score", "margin", "rejected"])
    return docs.withColumn("lang_id", found(F.col(text)))


HELD_OUT = 5


def predictions(docs: DataFrame) -> DataFrame:
    """Per document: held out or not, predicted language, score, margin,
    rejected; learned from the rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", id_remainder(F.col("doc_id"), HELD_OUT) == 0)
    model = train(rows.filter(~F.col("held_out")))
    found = identify(rows.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", F.col("lang_id.lang").alias("lang_pred"),
                        F.col("lang_id.score").alias("score"), F.col("lang_id.margin").alias("margin"),
                        F.col("lang_id.rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is found with a sufficient margin; columns
    and values as they were."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    model = train(docs.filter(id_remainder(F.col("doc_id"), HELD_OUT) != 0))
    return identify(rows, model).filter(~F.col("lang_id.rejected")).select("row.*")
