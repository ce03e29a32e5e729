"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op9_inverted_multi_index
from .decontam import OP7_SQL, op7_benchmark_containment
from .langid import op2_ppm_language
from .licenses import OP5_SQL, op5_license_digest
from .linededup import OP4_SQL, op4_line_runs
from .packing import op6_vector_packing
from .repair import OP12_SQL, op12_conversation_repair
from .resample import OP13_SQL, op13_importance_resampling
from .setsketch import OP11_SQL, op11_setsketch
from .sharding import op3_two_pass_shuffle
from .simhash import op1_simhash
from .suffixdedup import op8_suffix_dedup
from .urlfilter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_ppm_language": op2_ppm_language,
    "op3_two_pass_shuffle": op3_two_pass_shuffle,
    "op5_license_digest": op5_license_digest,
    "op6_vector_packing": op6_vector_packing,
    "op4_line_runs": op4_line_runs,
    "op7_benchmark_containment": op7_benchmark_containment,
    "op9_inverted_multi_index": op9_inverted_multi_index,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_setsketch": op11_setsketch,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL = {"op4_line_runs": OP4_SQL, "op7_benchmark_containment": OP7_SQL, "op5_license_digest": OP5_SQL, "op10_url_filter": OP10_SQL, "op11_setsketch": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_importance_resampling": OP13_SQL}
