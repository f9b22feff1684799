"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .language import op7_language
from .licenses import op2_licenses
from .lines import op6_line_dedup
from .near import op9_near_duplicates
from .pieces import op8_sentencepiece
from .pii import op4_personal_data
from .repeats import op5_repetition
from .secrets import op1_secret_scan
from .toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_licenses, op3_toxicity, op4_personal_data, op5_repetition, op6_line_dedup, op7_language, op8_sentencepiece, op9_near_duplicates, op10_decontaminate)}
ORACLES: dict[str, str] = {}
