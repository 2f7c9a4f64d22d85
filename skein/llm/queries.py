"""The queries of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from skein.llm import elkan, fill_middle, flat_graph, imatch, jaccard_join, language, mixing, multi_index, packing, sharding, token_files, toxicity, url_filter


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixture_language": language.op1,
    "op2_url_filter": url_filter.op2,
    "op3_sum_of_squares_packing": packing.op3,
    "op4_inverted_multi_index": multi_index.op4,
    "op5_poisson_mixture": mixing.op5,
    "op6_toxic_spans": toxicity.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_imatch": imatch.op8,
    "op9_token_files": token_files.op9,
    "op10_hypergeometric_shards": sharding.op10,
    "op11_fill_in_middle": fill_middle.op11,
    "op12_elkan_clusters": elkan.op12,
    "op13_flat_graph": flat_graph.op13,
    "pipeline": pipeline,
}
ORACLES = {
    "op5_poisson_mixture": mixing.ORACLE,
    "op11_fill_in_middle": fill_middle.ORACLE,
    "op12_elkan_clusters": elkan.ORACLE,
    "op13_flat_graph": flat_graph.ORACLE,
}
