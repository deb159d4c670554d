"""Registered queries of the training-data operators."""

from __future__ import annotations

from carledger.llm import (
    collocations, langid, linededup, mixing, ngram_join, packing, pii, pq_dedup, quality_net, quality_rules, token_counts, warc, whitening,
)
from carledger.llm.common import table
from carledger.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_language_id": lambda s, d: langid.predictions(table(s, d, "documents")),
    "op10_ngram_join": lambda s, d: ngram_join.groups(table(s, d, "documents")),
    "op11_whitening": lambda s, d: whitening.whiten(table(s, d, "embeddings")),
    "op12_token_counts": lambda s, d: token_counts.counted(table(s, d, "documents")),
    "op13_collocations": lambda s, d: collocations.mine(table(s, d, "documents")),
    "op2_line_dedup": lambda s, d: linededup.cleaned(table(s, d, "documents")),
    "op3_packing": lambda s, d: packing.packed(table(s, d, "documents")),
    "op4_quality_rules": lambda s, d: quality_rules.verdicts(table(s, d, "documents"), table(s, d, "labels")),
    "op5_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
    "op6_pq_near_dedup": lambda s, d: pq_dedup.links(table(s, d, "embeddings")),
    "op7_mixing": lambda s, d: mixing.allocation(table(s, d, "documents")),
    "op8_pii": lambda s, d: pii.report(table(s, d, "documents")),
    "op9_quality_net": lambda s, d: quality_net.scores(table(s, d, "documents"), table(s, d, "labels")),
}
