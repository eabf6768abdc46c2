"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat
from .filters import OP11_SQL, op11_audit
from .middle import OP13_SQL, op13_middle
from .mixing import OP4_SQL, op4_mix
from .privacy import op12_pii
from .quality import op3_quality
from .secrets import op10_secrets
from .simhash import op8_simhash
from .tokens import op5_pieces, op7_token_counts
from .vectors import OP1_SQL, op1_exact_top_k, op2_nearest
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_mix": op4_mix,
    "op5_pieces": op5_pieces,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
    "op11_audit": op11_audit,
    "op12_pii": op12_pii,
    "op13_middle": op13_middle,
}
ORACLE_SQL = {"op1_exact_top_k": OP1_SQL, "op4_mix": OP4_SQL, "op6_warc": OP6_SQL, "op9_chat": OP9_SQL, "op11_audit": OP11_SQL, "op13_middle": OP13_SQL}
