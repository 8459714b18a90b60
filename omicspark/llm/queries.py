"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from omicspark.llm import collocations, decontaminate, embeddings, licenses, linededup, lmscore, mixing, packing, quality, search, secrets, simhash, toxicity

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_lmscore": lmscore.op3_lmscore,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secrets": secrets.op6_secrets,
    "op7_simhash": simhash.op7_simhash,
    "op8_linededup": linededup.op8_linededup,
    "op9_licenses": licenses.op9_licenses,
    "op10_mixing": mixing.op10_mixing,
    "op11_search": search.op11_search,
    "op12_packing": packing.op12_packing,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_embeddings": embeddings.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op6_secrets": secrets.ORACLE,
    "op8_linededup": linededup.ORACLE,
    "op11_search": search.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
