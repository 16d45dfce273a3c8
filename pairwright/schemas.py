"""The record schemas, as Spark types. ``metadata`` and ``bias_params`` are JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "b": T.BooleanType()}


def _struct(text: str) -> T.StructType:
    """name:kind pairs; a trailing ! makes a field required."""
    fields = []
    for word in text.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _KINDS[kind[0]], not kind.endswith("!")))
    return T.StructType(fields)


SAMPLES = _struct("sample_id:s! source_dataset:s! edit_type:s! content_category:s! original_image_path:s! instruction:s! edit_model:s! edited_image_path:s! reference_image_path:s human_score:d auto_score:d metadata:s")
PAIRS = _struct("pair_id:s! sample_id_a:s! sample_id_b:s! original_image_path:s! instruction:s! edited_image_a_path:s! edited_image_b_path:s! edit_model_a:s! edit_model_b:s! ground_truth_preference:s pair_quality_gap:d source_dataset:s! edit_type:s!")
BIASED = _struct("biased_id:s! base_sample_id:s! bias_type:s! bias_strength:d! biased_image_path:s! bias_applied_to:s! bias_params:s")
VERDICTS = _struct(
    "result_id:s! judge_model:s! task_type:s! prompt_type:s! raw_response_path:s! parse_success:b! bias_type:s biased_id:s bias_params:s sample_id:s overall_score:i instruction_adherence:i editing_quality:i detail_preservation:i fine_score:i score_scale:i pair_id:s biased_side:s winner:s reason:s parse_error:s created_at:s"
)
VALIDATIONS = _struct("instruction_adherence_changed:b editing_quality_changed:b detail_preservation_changed:b major_semantic_shift:b passed:b reason:s biased_id:s base_sample_id:s validator_model:s raw_response_path:s parse_success:b! parse_error:s ssim:d")

# The vocabularies of the record fields.
EDIT_TYPES = ("add", "remove", "replace", "color", "background", "low-level")
CONTENT_CATEGORIES = ("human", "animal", "object", "scenery", "global")
DIMENSIONS = ("instruction_adherence", "editing_quality", "detail_preservation")
CONTROL = "sham"
