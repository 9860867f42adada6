"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .exact_dedup import OP2_SQL, op2_exact_dedup
from .flac import op10_media
from .license_scan import OP9_SQL, op9_license_scan
from .minhash_dedup import op5_minhash_dedup
from .packing import op8_packing
from .sentencepiece_codec import op6_sentencepiece
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_counts import op7_token_counts
from .toxicity import op3_toxicity
from .url_filter import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_exact_dedup, op3_toxicity, op4_substring_dedup, op5_minhash_dedup, op6_sentencepiece, op7_token_counts, op8_packing, op9_license_scan, op10_media)
}
SQL = {"op2_exact_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op9_license_scan": OP9_SQL}
