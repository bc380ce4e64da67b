"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import OP4_SQL, op4_decontamination
from .jaccard import OP6_SQL, op6_ngram_jaccard
from .language import op9_language_ppm
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import op10_mixing
from .neighbours import op5_kmeans_tree
from .quality import op7_quality_resampling
from .toxicity import op3_toxicity_crf
from .url_filter import OP2_SQL, op2_url_filter
from .warc import OP8_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_url_filter, op3_toxicity_crf, op4_decontamination, op5_kmeans_tree, op6_ngram_jaccard, op7_quality_resampling, op8_warc, op9_language_ppm, op10_mixing)
}
SQL = {"op1_line_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op4_decontamination": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_warc": OP8_SQL}
