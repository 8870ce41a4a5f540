"""Registered queries of this subpackage and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from mendery.llm import bitplanes, collocations, fingerprints
from mendery.llm.decontamination import op9_template_leaks
from mendery.llm.licenses import op10_compressed_licenses
from mendery.llm.mixing import op1_raked_mixture
from mendery.llm.near_duplicates import op5_chosen_path_join
from mendery.llm.private import op8_skip_chain_private
from mendery.llm.quality import op7_line_field
from mendery.llm.repeats import op3_prefix_suffix_trees
from mendery.llm.secrets import op2_layered_secrets
from mendery.llm.sharding import op6_hash_tree_sharding
from mendery.llm.urls import op4_segmented_hosts

QUERIES = {
    f.__name__: f
    for f in (
        op1_raked_mixture,
        op2_layered_secrets,
        op3_prefix_suffix_trees,
        op4_segmented_hosts,
        op5_chosen_path_join,
        op7_line_field,
        op8_skip_chain_private,
        op9_template_leaks,
        op10_compressed_licenses,
        op6_hash_tree_sharding,
        bitplanes.op11_bit_plane_clusters,
        fingerprints.op12_lookup_fingerprints,
        collocations.op13_shard_mined_phrases,
    )
}

ORACLE: dict[str, str] = {
    "op11_bit_plane_clusters": bitplanes.ORACLE,
    "op12_lookup_fingerprints": fingerprints.ORACLE,
    "op13_shard_mined_phrases": collocations.ORACLE,
}
