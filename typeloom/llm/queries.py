"""The operators' queries, by name."""

from . import collocations
from .collocations import op13_collocations
from .fingerprints import op1_fingerprints
from .hnsw import op6_nearest
from .importance import op12_importance
from .licenses import op4_licenses
from .mixing import op9_mix_sources
from .neardup import op5_near_duplicates
from .packing import op2_pack_sequences
from .quality import op3_quality
from .secrets import op7_secrets
from .sentences import op11_sentencepiece
from .toxicity import op8_toxicity
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_pack_sequences, op3_quality, op4_licenses, op5_near_duplicates, op6_nearest, op7_secrets, op8_toxicity, op9_mix_sources, op10_warc, op11_sentencepiece, op12_importance, op13_collocations)}
#: Trained, tokenised, hashed and sampled results have no SQL form; those operators are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op13_collocations": collocations.ORACLE_SQL}
