"""Queries of this subpackage and, where SQL expresses them, their DuckDB SQL."""

from regionfx.llm.archive import op5_web_archive
from regionfx.llm.byte_pairs import op1_byte_pairs
from regionfx.llm.chat import op13_chat_windows
from regionfx.llm.licences import op7_licence_scan
from regionfx.llm.negatives import OP11_SQL, op11_hard_negatives
from regionfx.llm.packing import op8_best_fit_packing
from regionfx.llm.personal_data import op9_personal_data
from regionfx.llm.quality import OP10_SQL, op10_quality_rules
from regionfx.llm.repair import op12_conversation_repair
from regionfx.llm.search import op4_exact_search
from regionfx.llm.secrets import op3_secret_scan
from regionfx.llm.simhash import op6_simhash
from regionfx.llm.token_files import op2_token_files

QUERIES = {
    "op1_byte_pairs": op1_byte_pairs,
    "op2_token_files": op2_token_files,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_search": op4_exact_search,
    "op5_web_archive": op5_web_archive,
    "op6_simhash": op6_simhash,
    "op7_licence_scan": op7_licence_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_personal_data": op9_personal_data,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_chat_windows": op13_chat_windows,
}

SQL: dict[str, str] = {"op10_quality_rules": OP10_SQL, "op11_hard_negatives": OP11_SQL}
