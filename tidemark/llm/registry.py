"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import common, lexical_search, mixing
from .byte_bpe import op11_prefix_bpe
from .decontaminate import op9_decontaminate
from .jaccard_join import op2_ngram_jaccard_join
from .language_id import op5_language_crf
from .license_scan import op10_license_scan
from .nearest import op8_nearest
from .periodic_runs import op12_periodic_runs
from .quality import op4_quality
from .token_planes import op7_token_planes
from .toxicity import op1_toxicity
from .warc import op6_warc_derivatives



def in_small_batches(f):
    def run(spark, sf_dir):
        common.small_batches(spark)
        return f(spark, sf_dir)

    run.__name__ = f.__name__
    return run


QUERIES = {
    f.__name__: in_small_batches(f)
    for f in (op1_toxicity, op2_ngram_jaccard_join, mixing.op3_mix_sources, op4_quality, op5_language_crf, op6_warc_derivatives, op7_token_planes, op8_nearest, op9_decontaminate, op10_license_scan, op11_prefix_bpe, op12_periodic_runs, lexical_search.op13_lexical_search)
}

ORACLE_SQL: dict[str, str] = {"op3_mix_sources": mixing.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
