"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from graphloom.llm import lines, ngrams
from graphloom.llm.binary import op7_binary_ids
from graphloom.llm.fingerprints import op3_fingerprints
from graphloom.llm.language import op2_language
from graphloom.llm.lines import op10_line_dedup
from graphloom.llm.media import op9_media
from graphloom.llm.mixing import op4_mixing
from graphloom.llm.ngrams import op6_ngram_join
from graphloom.llm.packing import op8_packing
from graphloom.llm.private import op5_personal_data
from graphloom.llm.quality import op1_quality

_ALL = (op1_quality, op2_language, op3_fingerprints, op4_mixing, op5_personal_data, op6_ngram_join, op7_binary_ids, op8_packing, op9_media, op10_line_dedup)
QUERIES = {q.__name__: q for q in _ALL}
ORACLE = {"op6_ngram_join": ngrams.ORACLE, "op10_line_dedup": lines.ORACLE}
