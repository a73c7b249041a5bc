"""The training-data queries and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from octolith.llm import exactdedup, mixing, urlfilter, warc
from octolith.llm.exactdedup import op10_exact_dedup
from octolith.llm.fingerprint import op4_fingerprint
from octolith.llm.langid import op2_langid
from octolith.llm.linededup import op3_line_dedup
from octolith.llm.mixing import op1_mixing
from octolith.llm.packing import op6_packing
from octolith.llm.pii import op5_pii
from octolith.llm.simhash import op7_simhash
from octolith.llm.urlfilter import op8_url_filter
from octolith.llm.warc import op9_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_langid": op2_langid,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprint": op4_fingerprint,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
}
#: Models, shingle hashes, packing and prefix hashes are beyond SQL; tests/llm holds those against brute force.
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_exact_dedup": exactdedup.ORACLE,
}
