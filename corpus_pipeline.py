"""From documents to packed sequences, in five stages.

Each stage takes all that the one before has kept and its decisions take
effect: documents without a certain language go, repeated passages are cut
out, one of each group of near-duplicates stays, sources are repeated or
thinned to their target weights in the order of training, and what is left
is packed in that order, the shares of sources following the curriculum over
the sequences. All stages but the last return the columns of ``documents``.

The curriculum is one of the corpus's own sources: a source that a stage
empties does not move the weights of others, so mixing and packing agree.

Null and empty texts have no language and go in the first stage. Rows with a
null id are documents like others; rows equal in id and text count once from
the third stage on; further columns pass through whatever their names, but
for the last stage, whose rows are pieces. An empty table gives an empty
result. Very long texts are read whole in every stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carledger.llm import langid, linededup, mixing, ngram_join, packing
from carledger.llm.common import release, stage, staged_in, table

#: Tables that each stage has written for itself; the next one lets them go.
_OWN: dict[int, list] = {}


def _in_place(place: int):
    """A stage: its result is written before the next stage begins, so what
    the stage before wrote on the way is not needed any more."""
    def of(apply):
        @wraps(apply)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(*_OWN.pop(place - 1, []))
            with staged_in([]) as own:
                out = apply(spark, docs, sf_dir)
            _OWN[place] = own
            return out
        return run_stage
    return of


@_in_place(0)
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


@_in_place(1)
def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_repeats(docs, length="n_chars")


@_in_place(2)
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def curriculum(spark: SparkSession, sf_dir: str) -> mixing.Schedules:
    return mixing.schedules_of(table(spark, sf_dir, "documents").select("source"), mixing.curriculum)


@_in_place(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, schedules=curriculum(spark, sf_dir))


@_in_place(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The order of the mixing stage's queues, found again from its rows.
    return packing.packed(docs, schedules=curriculum(spark, sf_dir), order=F.xxhash64("doc_id", "text"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression classes and a tokenizer's ids are beyond SQL; the tests hold
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
