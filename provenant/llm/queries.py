"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from provenant.llm.flac import op1_flac
from provenant.llm.language import op4_language_id
from provenant.llm.linededup import op8_line_dedup
from provenant.llm.mixing import OP10_SQL, op10_mixing
from provenant.llm.pieces import op2_sentencepiece
from provenant.llm.quality import op3_quality
from provenant.llm.repeats import op11_periodic_runs
from provenant.llm.setjoin import op9_ngram_jaccard
from provenant.llm.sharding import OP12_SQL, op12_rendezvous_sharding
from provenant.llm.spelling import OP13_SQL, op13_spelling_variants
from provenant.llm.spotsigs import op6_spotsigs
from provenant.llm.toxicity import op5_toxicity
from provenant.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_flac": op1_flac,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_spotsigs": op6_spotsigs,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_rendezvous_sharding": op12_rendezvous_sharding,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op10_mixing": OP10_SQL,
    "op12_rendezvous_sharding": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
