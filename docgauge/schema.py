"""Explicit schemas of what is read from files: nothing is inferred."""

from __future__ import annotations

MANIFEST_EXAMPLE = (
    "index int, question_id long, doc_id long, ucsf_document_id string, ucsf_document_page_no string, question string, "
    "image_relpath string, image_sha256_png string, source_image_sha256 string, n_answers int, rgb_hash string, "
    "target_answer string, target_selection_rule string, group_key_type string, source_shard string"
)
MANIFEST = f"name string, role string, n_examples int, seed long, question_ids array<long>, manifest_sha256 string, examples array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in MANIFEST_EXAMPLE.split(','))}>>"
_ANSWER = "struct<question_id:long, answers:array<string>, target_answer:string, target_selection_rule:string>"
ANSWERS = f"answers array<{_ANSWER}>, records array<{_ANSWER}>, question_id long, target_answer string"
ANSWER_ROW = "question_id long, answers array<string>, target_answer string, target_selection_rule string"
METRICS = (
    "struct<primary:string, anls:double, anls_normalized_strict_v2:double, anls_normalized_inclusive_v1:double, "
    "anls_vlmevalkit:double, exact_match:double, scored:boolean, failure:boolean, invalid_references:boolean>"
)
PREDICTION = (
    "question_id long, doc_id long, ucsf_document_id string, ucsf_document_page_no string, question string, status string, error string, "
    "prediction string, prediction_raw string, generated_token_length int, generation_cap_reached boolean, max_new_tokens int, "
    "generation_seconds double, wall_seconds double, "
    "image_info struct<tile_count:int, visual_token_count:int, max_num:int, thumbnail_appended:boolean>, "
    "gpu_memory struct<peak_allocated_bytes:long, peak_reserved_bytes:long>, hardware struct<gpu_name:string, gpu_total_memory_bytes:long>, "
    f"software map<string,string>, metrics {METRICS}, run_fingerprint struct<run_fingerprint_sha256:string>, seed int"
)
TRAINING_LOG = (
    "update int, loss double, lr double, grad_norm double, samples_seen int, unique_examples_seen int, elapsed_seconds double, "
    "peak_allocated_bytes long, last_question_id long"
)
