"""The queries of this subpackage by name."""

from __future__ import annotations

from brolga.llm.bloomlm import op4_bloomlm
from brolga.llm.curves import op6_curves
from brolga.llm.decontaminate import OP10_SQL, op10_decontaminate
from brolga.llm.language import op2_language
from brolga.llm.lexical import OP11_SQL, op11_lexical
from brolga.llm.licences import op8_licences
from brolga.llm.packing import op7_pack
from brolga.llm.quality import op12_quality
from brolga.llm.recompress import OP9_SQL, op9_recompress
from brolga.llm.resample import OP13_SQL, op13_resample
from brolga.llm.simhash import op3_simhash
from brolga.llm.warc import OP1_SQL, op1_revisits
from brolga.llm.wavelet import op5_wavelet

QUERIES = {
    "op1_revisits": op1_revisits,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_bloomlm": op4_bloomlm,
    "op5_wavelet": op5_wavelet,
    "op6_curves": op6_curves,
    "op7_pack": op7_pack,
    "op8_licences": op8_licences,
    "op9_recompress": op9_recompress,
    "op10_decontaminate": op10_decontaminate,
    "op11_lexical": op11_lexical,
    "op12_quality": op12_quality,
    "op13_resample": op13_resample,
}
ORACLES = {
    "op1_revisits": OP1_SQL,
    "op9_recompress": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_lexical": OP11_SQL,
    "op13_resample": OP13_SQL,
}
