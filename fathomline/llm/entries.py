"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from fathomline.llm import chat, exact_dedup, language, leaks, licenses, minhash, packing, pages, phrases, runs, simhash, token_counts, token_files

_RUN = {
    "op1_simhash": simhash.op1_simhash,
    "op2_pages": pages.op2_pages,
    "op3_token_files": token_files.op3_token_files,
    "op4_licenses": licenses.op4_licenses,
    "op5_packing": packing.op5_packing,
    "op6_chat": chat.op6_chat,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_leaks": leaks.op8_leaks,
    "op9_language": language.op9_language,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_minhash": minhash.op11_minhash,
    "op12_runs": runs.op12_runs,
    "op13_phrases": phrases.op13_phrases,
}
_SQL = {
    "op4_licenses": licenses.OP4_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_leaks": leaks.OP8_SQL,
    "op11_minhash": minhash.OP11_SQL,
    "op12_runs": runs.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}


def queries():
    return dict(_RUN)


def oracle_sql():
    return dict(_SQL)
