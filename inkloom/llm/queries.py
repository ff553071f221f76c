"""The queries of the training-data operators, by name."""

from __future__ import annotations

from inkloom.llm import conversations, cutoff, lookalike, names, packing, pairs, spans, splits, splitting, tokens

QUERIES = {
    "p1_found": pairs.p1_found,
    "p1_defects": pairs.p1_defects,
    "p2_found": splits.p2_found,
    "p2_splits": splits.p2_splits,
    "p2_balance": splits.p2_balance,
    "p2_members": splits.p2_members,
    "p3_found": cutoff.p3_found,
    "p3_evidence": cutoff.p3_evidence,
    "p3_rates": cutoff.p3_rates,
    "p3_limits": cutoff.p3_limits,
    "p4_found": conversations.p4_found,
    "p4_conversations": conversations.p4_conversations,
    "p5_found": lookalike.p5_found,
    "p5_canonical": lookalike.p5_canonical,
    "p6_found": names.p6_found,
    "p6_entities": names.p6_entities,
    "p7_found": splitting.p7_found,
    "p7_pieces": splitting.p7_pieces,
    "p7_cover": splitting.p7_cover,
    "p8_ids": tokens.p8_ids,
    "p9_containers": packing.p9_containers,
    "p9_fill": packing.p9_fill,
    "p9_placed": packing.p9_placed,
    "p10_found": spans.p10_found,
    "p10_shared": spans.p10_shared,
}
