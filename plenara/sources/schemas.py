"""Explicit, closed schemas as Spark DDL."""

SNAPSHOT = (
    "session_id STRING, statements ARRAY<STRUCT<index: INT, text: STRING>>, participants ARRAY<STRING>, votes ARRAY<ARRAY<INT>>, masked_cells ARRAY<ARRAY<INT>>,"
    " held_out MAP<STRING, INT>, clusters ARRAY<INT>, meta STRUCT<k_anonymity: INT, source: STRING, generator_family: STRING, synthetic: BOOLEAN>"
)
CLUSTERS = "ARRAY<STRUCT<id: INT, members: ARRAY<STRING>, member_indices: ARRAY<INT>, center: ARRAY<DOUBLE>>>"
STATS = "STRUCT<comment: ARRAY<STRUCT<commentIndex: INT, agrees: INT, disagrees: INT, unsure: INT, total: INT, responded: INT, extremity: DOUBLE, divisiveness: DOUBLE>>>"
HUMAN_META = (
    "STRUCT<synthetic: BOOLEAN, k_anonymity: INT, source: STRING, seed: INT, consent_scope: STRING, redistribution_rights_approved: BOOLEAN, schema_version: STRING,"
    " exporter_version: STRING, source_commit: STRING, privacy_review: STRUCT<attested: BOOLEAN, reviewed_at: STRING, checks: ARRAY<STRING>>>"
)
HUMAN_SNAPSHOT = (
    "session_id STRING, statements ARRAY<STRUCT<index: INT, text: STRING>>, participants ARRAY<STRING>, votes ARRAY<ARRAY<INT>>, masked_cells ARRAY<ARRAY<INT>>,"
    f" held_out MAP<STRING, INT>, clusters {CLUSTERS}, stats {STATS}, meta {HUMAN_META}"
)
VECTOR = "STRUCT<access: DOUBLE, adaptability: DOUBLE, continuity: DOUBLE, oversight: DOUBLE, safety: DOUBLE>"
EVIDENCE = "STRUCT<doc_id: STRING, quote: STRING>"
DECISION = "STRUCT<actor: STRING, action: STRING, condition: STRING, anchor_outcome: STRING, alternative_outcome: STRING>"
SCENARIO = (
    "scenario_id STRING, organization STRUCT<name: STRING, sector: STRING, fictional: BOOLEAN>,"
    f" factions ARRAY<STRUCT<faction_id: STRING, name: STRING, summary: STRING, values: {VECTOR}>>,"
    " documents ARRAY<STRUCT<doc_id: STRING, title: STRING, style: STRING, text: STRING>>,"
    f" planted_items ARRAY<STRUCT<plant_id: STRING, doc_id: STRING, anchor_quote: STRING, type: STRING, canonical_question: STRING, decision: {DECISION}, value_weights: {VECTOR},"
    f" alternative_stances: MAP<STRING, STRING>, canonical_yes_choice: STRING, target_stances: MAP<STRING, STRING>, decision_value: DOUBLE, related_evidence: {EVIDENCE}>>,"
    " distractors ARRAY<STRUCT<doc_id: STRING, anchor_quote: STRING, reason: STRING>>,"
    " persona_panel STRUCT<vote_rule: STRING, pass_threshold: DOUBLE, faction_ids: ARRAY<STRING>>, human_feedback STRING,"
    " provenance STRUCT<seed: BIGINT, template_id: STRING, template_set: STRING, generated_at: STRING, synthetic: BOOLEAN, generation_mode: STRING, generator_family: STRING>"
)
