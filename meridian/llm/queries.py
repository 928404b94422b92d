"""The registered queries of this subpackage and their SQL."""

from .bpe import op3_bpe
from .collocations import OP12_SQL, op12_collocations
from .counts import op13_tokencounts
from .divergence import OP11_SQL, op11_divergence
from .licenses import op8_licenses
from .linededup import OP4_SQL, op4_linededup
from .neardup import op6_neardup
from .packing import op1_packing
from .pii import op10_pii
from .quality import OP9_SQL, op9_quality
from .toxicity import op5_toxicity
from .vectors import OP2_SQL, op2_embeddings
from .warc import OP7_SQL, op7_warc

QUERIES = {"op1_packing": op1_packing, "op2_embeddings": op2_embeddings, "op3_bpe": op3_bpe, "op4_linededup": op4_linededup, "op5_toxicity": op5_toxicity, "op6_neardup": op6_neardup, "op7_warc": op7_warc, "op8_licenses": op8_licenses, "op9_quality": op9_quality, "op10_pii": op10_pii, "op11_divergence": op11_divergence, "op12_collocations": op12_collocations, "op13_tokencounts": op13_tokencounts}
ORACLE_SQL = {"op2_embeddings": OP2_SQL, "op4_linededup": OP4_SQL, "op7_warc": OP7_SQL, "op9_quality": OP9_SQL, "op11_divergence": OP11_SQL, "op12_collocations": OP12_SQL}
