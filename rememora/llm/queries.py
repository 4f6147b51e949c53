"""The operators' queries and the SQL of those that SQL can express."""

from rememora.llm import (
    op01_fingerprint, op02_toxicity, op03_packing, op04_embedding_dedup, op05_bpe, op06_licenses, op07_simhash, op08_warc,
    op09_html, op10_langid, op11_filter_audit, op12_prefix_trie, op13_graph_search,
)

QUERIES = {
    "op1_fingerprint": op01_fingerprint.query,
    "op2_toxicity": op02_toxicity.query,
    "op3_packing": op03_packing.query,
    "op4_embedding_dedup": op04_embedding_dedup.query,
    "op5_bpe": op05_bpe.query,
    "op6_licenses": op06_licenses.query,
    "op7_simhash": op07_simhash.query,
    "op8_warc": op08_warc.query,
    "op9_html": op09_html.query,
    "op10_langid": op10_langid.query,
    "op11_filter_audit": op11_filter_audit.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_graph_search": op13_graph_search.query,
}

SQL = {
    "op4_embedding_dedup": op04_embedding_dedup.SQL,
    "op8_warc": op08_warc.SQL,
    "op11_filter_audit": op11_filter_audit.SQL,
    "op12_prefix_trie": op12_prefix_trie.SQL,
}
