"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from . import ball_tree, bpe, html_text, lattice, line_dedup, merkle, minhash, mixing, quality, sharding, spotsigs, token_counts, token_files

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe, minhash.op2_minhash, token_counts.op3_token_counts, mixing.op4_mixing, sharding.op5_sharding,
        html_text.op6_html, token_files.op7_token_files, lattice.op8_lattice, spotsigs.op9_spotsigs, quality.op10_quality,
        merkle.op11_merkle, ball_tree.op12_clusters, line_dedup.op13_lines,
        spotsigs.spotsigs_groups,
    )
}

ORACLES = {"op4_mixing": mixing.ORACLE, "op11_merkle": merkle.ORACLE, "op12_clusters": ball_tree.ORACLE, "op13_lines": line_dedup.ORACLE}
