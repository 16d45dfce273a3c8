"""Rule classification of instructions: ordered patterns, first match wins, as chained Catalyst conditions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: word lists and patterns that decide the class of an instruction, in the order in which they are tried. ----

COLOR = "red|orange|yellow|green|blue|purple|pink|brown|black|white|gray|grey|golden|silver|beige|teal|turquoise|magenta|cyan|violet|maroon|blonde|blond|dark|multi.?colo(?:u)?red"
SCENE = "forest|desert|city|beach|ocean|sea|mountains?|park|snow|jungle|countryside|space|street|woods|field|garden|kitchen|library|museum|zoo|farm"
MATERIAL = "wooden|wood|metal|metallic|cement|concrete|plastic|glass|stone|brick|marble|leather|wool|steel|golden|silk|paper"

#: <COLOR>, <SCENE> and <MATERIAL> stand for the lists above.
EDIT_TYPE_PATTERNS = r"""
background  \bbackground\b
background  \bbackdrop\b
background  \bscenery behind\b
background  \b(?:change|replace|make|set|swap)\b[^.]{0,30}\b(?:scene|setting|location|environment)\b
background  \b(?:be|move|put|place|stand|sit)\b[^.]{0,20}\b(?:in|at|on) the (?:<SCENE>)\b
low-level   \bblur|\bdeblur|\bsharpen|\bdenois|\bnoise\b|\bgrain\b
low-level   \bhaze|\bfog(?:gy)?\b|\bdehaze
low-level   \brain(?:y|drops)?\b|\bsnow(?:y|flakes)?\b
low-level   \bshadow\b|\breflection\b
low-level   \bbright(?:er|ness)?\b|\bdark(?:er|en)\b|\bdim(?:mer)?\b|\bexposure\b|\bcontrast\b
low-level   \bblack and white\b|\bgrayscale\b|\bgreyscale\b|\bsepia\b|\bmonochrome\b
low-level   \bstyle\b|\bpainting\b|\bsketch\b|\bcartoon\b|\banime\b|\bwatercolor\b|\boil painting\b|\bvan gogh\b|\bpicasso\b|\bpixel art\b|\bvintage\b|\bretro\b
low-level   \bmake (?:it|the (?:image|photo|picture)) look like\b
low-level   \bwatermark\b
low-level   \blow.?light\b|\bnight time\b|\bsunset\b(?= lighting)
color       \brecolo(?:u)?r\b
color       \bchange (?:the )?colo(?:u)?r\b
color       \bcolo(?:u)?r (?:of|the)\b
color       \bpaint\b(?!ing)
color       \bmake (?:it|the|his|her|their|its)\b[^.]{0,30}\b(?:<COLOR>)\b
color       \bturn\b[^.]{0,30}\b(?:<COLOR>)\b
color       \b(?:<COLOR>)\b[^.]{0,15}\b(?:instead|colo(?:u)?r)\b
remove      \bremove\b
remove      \bdelete\b
remove      \berase\b
remove      \btake\b[^.]{0,25}\b(?:out|away|off)\b
remove      \bget rid of\b
remove      \bleave nothing\b
remove      \bwithout the\b
remove      \bmake\b[^.]{0,20}\bdisappear\b
remove      \bclear (?:away|out)\b
remove      \bmake\b[^.]{0,20}\bempty\b
replace     \breplace\b
replace     \bswap\b
replace     \bsubstitute\b
replace     \bchange\b[^.]{0,40}\b(?:into|to|for|with)\b
replace     \bturn\b[^.]{0,40}\binto\b
replace     \bmake\b[^.]{0,20}\b(?:a|an|the)\b[^.]{0,30}\binstead\b
replace     \binstead of\b
add         \badd\b
add         \bput\b
add         \bplace\b
add         \binsert\b
add         \binclude\b
add         \bgive (?:him|her|it|them|the)\b
add         \blet there be\b
add         \bthere should be\b
add         \bmake (?:him|her|it|them)\b[^.]{0,20}\b(?:wear|hold|carry)\b
add         \b(?:wear|wears|wearing)\b
add         \b(?:hold|holds|holding|carry|carries|carrying)\b
add         \b(?:eat|eats|eating|drink|drinks|drinking)\b
add         \btopped with\b
add         \b(?:contain|contains|containing)\b
add         \bthere (?:be|is|was|were|should be)\b
add         \b(?:has|have|had|having)\s+(?:a|an)\s+(?!(?:<COLOR>)\b)
add         \bshould (?:have|contain|include)\b
add         \blet\s+(?:a|an)\s
add         \blet\s+(?:the|it|this|that|him|her|them)\b[^.]{0,25}\bhave\s+(?!(?:<COLOR>)\b)
add         \bcover\b[^.]{0,30}\bwith\b
add         \b(?:should|could|would|might)\s+be\b[^.]{0,40}\b(?:near|next to|beside|nearby|on|in|behind|above|under)\b
add         \blet water\b
add         \b(?:drawing|picture|print|logo|pattern) of\b
color       \bmake\s+(?:all\s+)?(?:the|it|this|that|his|her|their|its|one of the|a|an)\b[^.]{0,30}\b(?:<COLOR>)\b
color       \b(?:should be|be|have|has|had)\b[^.]{0,15}\b(?:<COLOR>)\b
replace     \blet\s+(?:it|the|this|that|him|her|them)\b[^.]{0,30}\b(?:be|become)\b(?!\s+(?:turned|opened|closed|standing|sitting|lying|open|closed))
replace     \bmake\s+(?:it|the|this|that|him|her|them|one of the)\b[^.]{0,30}\b(?:a|an)\b
replace     \bmake\s+(?:it|the|this|that)\b[^.]{0,25}\b(?:<MATERIAL>)\b
replace     \bturn\b[^.]{0,40}\bin\s+(?:a|an)\b
replace     \bnot a\b
"""

CONTENT_PATTERNS = r"""
human    \b(?:man|men|woman|women|person|people|boy|girl|child|children|kid|baby|guy|lady|human|player|rider|worker|chef|doctor|crowd|couple|he|she|his|her)\b
human    \b(?:face|hair|hand|arm|leg|shirt|dress|jacket|hat|glasses|shoes)\b
animal   \b(?:dog|puppy|cat|kitten|bird|horse|cow|sheep|goat|pig|bear|elephant|giraffe|zebra|lion|tiger|monkey|rabbit|fish|shark|duck|chicken|animal|pet|deer|fox|wolf|butterfly|insect)\b
scenery  \b(?:sky|cloud|mountain|beach|ocean|sea|lake|river|forest|tree|field|grass|sunset|sunrise|landscape|street|city|building|road|garden|park|desert|snowfield|waterfall)\b
object   \b(?:car|truck|bus|bike|bicycle|motorcycle|train|boat|plane|table|chair|cup|bottle|plate|bowl|book|phone|laptop|computer|ball|frisbee|umbrella|clock|lamp|flower|plant|food|pizza|cake|fruit|apple|banana|box|bag|toy)\b
"""
# ---- End of fixed values. ----


def rules(patterns: str) -> list[tuple[str, str]]:
    """(class, one alternation) for each run of lines of the same class, in order."""
    out: list[tuple[str, list[str]]] = []
    for line in patterns.strip().splitlines():
        name, _, pattern = line.partition(" ")
        pattern = pattern.strip().replace("<COLOR>", COLOR).replace("<SCENE>", SCENE).replace("<MATERIAL>", MATERIAL)
        if not out or out[-1][0] != name:
            out.append((name, []))
        out[-1][1].append(pattern)
    return [(name, "|".join(parts)) for name, parts in out]


def alternatives(pattern: str) -> list[str]:
    """A pattern cut at the bars outside of brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


def at_words(pattern: str) -> str:
    """The same pattern, which asks once at each place whether a word begins there, if all its alternatives do."""
    parts = alternatives(pattern)
    if not all(re.match(r"\\b(?:\(\?:)?[a-z]", p) for p in parts):
        return pattern
    return r"\b(?=\w)(?:" + "|".join(p[2:] for p in parts) + ")"


def first_match(text: Column, patterns: str, default: Column) -> Column:
    """The class of the first rule found in the text."""
    found = [(text.rlike(f"(?i){at_words(p)}"), name) for name, p in rules(patterns)]
    head, *rest = found
    return reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rest, F.when(head[0], F.lit(head[1]))).otherwise(default)


def edit_type(instruction: Column) -> Column:
    """One of the six edit types, null if no rule matches or the text is blank."""
    text = F.trim(F.coalesce(instruction, F.lit("")))
    return F.when(text != "", first_match(text, EDIT_TYPE_PATTERNS, F.lit(None).cast("string")))


def content_category(*texts: Column) -> Column:
    """The content class of the texts together; ``global`` if no rule matches."""
    whole = F.concat_ws(" ", *[F.when(t != "", t) for t in texts])
    return first_match(whole, CONTENT_PATTERNS, F.lit("global"))
