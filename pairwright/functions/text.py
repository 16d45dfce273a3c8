"""Text columns: normalisation, keys, keywords, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keyword of an instruction.
STOPWORDS = "the a an to of in on at with and or this that it its image photo picture from into for please by as".split()
EDIT_VERBS = "remove add make change turn replace delete put set transform alter adjust modify convert give increase decrease fill".split()
# Editor names that are written in another way.
FAMILY_ALIASES = {"cycklediffusion": "cyclediffusion"}


def normalize_instruction(text: Column) -> Column:
    """Lower case, all but a-z, 0-9 and white space to a space, white space folded, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    """A name that any file system takes."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def editor_family(name: Column) -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")
    alias = F.create_map(*[F.lit(x) for pair in FAMILY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(alias, key), key)


def keyword(instruction: Column) -> Column:
    """The last word that is neither stopword nor edit verb, else the last word; empty without words."""
    words = F.regexp_extract_all(F.coalesce(instruction, F.lit("")), F.lit(r"([A-Za-z][A-Za-z'-]*)"), F.lit(1))
    content = F.filter(words, lambda w: ~F.lower(w).isin(STOPWORDS + EDIT_VERBS))
    return F.coalesce(F.try_element_at(content, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit(""))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, n), " ")


def word_wrap(text: Column, width: int) -> Column:
    """Greedy wrap by characters; a word longer than the width stands alone. An array of lines."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        longer = F.concat_ws(" ", last, w)
        return F.when((F.size(lines) > 0) & (F.length(longer) <= width), F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(longer))).otherwise(F.concat(lines, F.array(w)))

    head = F.when(F.size(words) > 0, F.slice(words, 1, 1)).otherwise(F.array().cast("array<string>"))
    return F.aggregate(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), head, step)


def seeded_key(seed: int, *parts: Column) -> Column:
    """The place of a row in a seeded order that does not depend on other rows: md5 of seed and parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_side(seed: int, key: Column) -> Column:
    """A seeded coin for each key."""
    return F.when(F.conv(F.substring(seeded_key(seed, F.lit("bandwagon"), key), 1, 8), 16, 10).cast("bigint") % 2 == 0, "A").otherwise("B")


def relative_path(path: Column, root: str) -> Column:
    """Forward slashes, without the root where it leads."""
    straight = F.regexp_replace(path, r"\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(straight.startswith(base), F.substring(straight, len(base) + 1, 1 << 30)).otherwise(straight)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def parse_uid(uid: Column) -> Column:
    """sample_<image>_<turn>[.ext] as struct<img_id, turn>; any other shape is an error."""
    image, turn = (F.regexp_extract(uid, r"^sample_(\d+)_(\d+)(?:\.[A-Za-z0-9]+)?$", k) for k in (1, 2))
    return F.when(image == "", F.raise_error(F.concat(F.lit("no sample uid: "), uid)).cast("struct<img_id:string,turn:int>")).otherwise(F.struct(image.alias("img_id"), turn.cast("int").alias("turn")))


def map_vote(vote: Column, vote_map: dict[str, str | None]) -> Column:
    """a, b or tie; null for what is no preference."""
    known = F.create_map(*[x for k, v in vote_map.items() if v for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(known, F.trim(vote.cast("string")))


# ---- Prompts. The wording of the templates. ----

SCORING_HEAD = """You are an impartial judge for instruction-based image editing.

You will receive:
1. The original image before editing.
2. The editing instruction.
3. The edited image.

Editing instruction: "%s"

Your task is to evaluate the edited image according to three criteria:
- Instruction adherence: whether the edited image follows the instruction.
- Editing quality: whether the edited region is realistic and visually coherent.
- Detail preservation: whether irrelevant regions are preserved.

Give an overall score from 1 to {scale}:
{anchors}"""
ANCHORS = {5: "1 = very poor\n2 = poor\n3 = acceptable\n4 = good\n5 = excellent", 10: "1 = very poor\n3 = poor\n5 = acceptable\n8 = good\n10 = excellent"}
SCORING_TAIL = """Return only valid JSON:
{{
  "instruction_adherence": <1-{scale}>,
  "editing_quality": <1-{scale}>,
  "detail_preservation": <1-{scale}>,
  "overall_score": <1-{scale}>,
  "reason": "<short reason>"
}}"""
PAIRWISE_HEAD = """You are an impartial judge for instruction-based image editing.

You will receive:
1. The original image before editing.
2. The editing instruction.
3. Edited image A.
4. Edited image B.

Editing instruction: "%s"

Choose which edited image better satisfies the instruction while preserving irrelevant details and maintaining visual quality.

You may choose:
- "A"
- "B"
- "Tie\""""
PAIRWISE_TAIL = """Return only valid JSON:
{
  "winner": "A" | "B" | "Tie",
  "reason": "<short reason>"
}"""
STYLE_LINES = {
    ("scoring", "bias_aware"): "Do not reward superficial marks, watermarks, borders, text overlays, brightness changes, or stylistic changes unless they are required by the instruction.",
    ("scoring", "rubric_first"): "First assess each of the three criteria independently, then derive the overall score from them.",
    ("scoring", "viescore"): "Use a VIEScore-style rubric with two axes. Semantic Consistency (SC): map it to instruction_adherence (does B realize the instruction?) and detail_preservation (are instruction-irrelevant regions kept?). Perceptual Quality (PQ): map it to editing_quality (naturalness, artifacts, coherence). Score SC and PQ on the same 1-{scale} scale, then set overall_score to their lower value (a bottleneck, as in VIEScore).",
    ("pairwise", "bias_aware"): "Do not prefer an image because of its position, watermark, border, brightness, image size, text overlay, or model name.",
    ("pairwise", "rubric_first"): "Compare the two images on instruction adherence, editing quality, and detail preservation before deciding.",
}
BANDWAGON_SCORING = "Note: previous reviewers rated this edit very highly."
BANDWAGON_PAIRWISE = "Note: 90% of human evaluators preferred Image {side}."
NAMED_SCORING = "This edited image was produced by the {model} model."
NAMED_PAIRWISE = "Image A was produced by {a}. Image B was produced by {b}."
UNNAMED = "an unnamed model"
# ---- End of fixed values. ----


def _filled(template: str, **columns: Column) -> Column:
    """A template with columns in place of {name}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def scoring_prompt(instruction: Column, style: str = "vanilla", bandwagon: bool = False, model: Column | None = None, scale: int = 10) -> Column:
    head = SCORING_HEAD.format(scale=scale, anchors=ANCHORS.get(scale, f"1 = very poor\n{scale} = excellent"))
    before, after = head.split("%s")
    parts = [F.concat(F.lit(before), instruction, F.lit(after))]
    if bandwagon:
        parts.append(F.lit(BANDWAGON_SCORING))
    if model is not None:
        parts.append(F.when(model != "", _filled(NAMED_SCORING, model=model)))
    if style != "vanilla":
        parts.append(F.lit(STYLE_LINES["scoring", style].replace("{scale}", str(scale))))
    return F.concat_ws("\n\n", *parts, F.lit(SCORING_TAIL.format(scale=scale)))


def pairwise_prompt(instruction: Column, style: str = "vanilla", side: Column | None = None, model_a: Column | None = None, model_b: Column | None = None) -> Column:
    before, after = PAIRWISE_HEAD.split("%s")
    parts = [F.concat(F.lit(before), instruction, F.lit(after))]
    if side is not None:
        parts.append(F.when(side.isin("A", "B"), _filled(BANDWAGON_PAIRWISE, side=side)))
    if model_a is not None or model_b is not None:
        a, b = (F.coalesce(F.when(m != "", m), F.lit(UNNAMED)) if m is not None else F.lit(UNNAMED) for m in (model_a, model_b))
        parts.append(_filled(NAMED_PAIRWISE, a=a, b=b))
    if style in ("bias_aware", "rubric_first"):
        parts.append(F.lit(STYLE_LINES["pairwise", style]))
    return F.concat_ws("\n\n", *parts, F.lit(PAIRWISE_TAIL))
