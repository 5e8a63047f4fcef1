"""Extracted claims bound to evidence: checking, correcting, pruning, recording.

A claim is a row (doc_id, field, value, evidence_bbox, evidence_text,
evidence_kind); fields of the free part carry the prefix ``type_specific.``.
"""
