"""Vocabularies, score tables and limits of frame triage."""

from __future__ import annotations

from itertools import product

TOOL = "FrameSift"
OWN_PREFIXES = tuple(f"{TOOL}{x}:" for x in ("", "Confidence", "Issues", "Rating", "Burst", "Duplicate"))

# Which suffix is what decides which files are photographs, originals, renders or sidecars, and must be as users know it.
RAW_EXTENSIONS = (".arw", ".cr2", ".cr3", ".nef", ".orf", ".raf", ".dng", ".rw2")
HEIF_EXTENSIONS = (".heic", ".heif")
AMBIGUOUS_EXTENSIONS = (".jpg", ".jpeg")
RENDER_EXTENSIONS = (".tif", ".tiff", ".psd", ".psb", ".png")
SIDECAR_EXTENSIONS = (".on1", ".xmp", ".aae")
PHOTO_EXTENSIONS = RAW_EXTENSIONS + AMBIGUOUS_EXTENSIONS + HEIF_EXTENSIONS

# The model's categories and their points in hundredths, whole numbers so that they can be keys; a decision depends on each of them.
SHARPNESS = {"sharp": 90, "acceptable": 70, "soft": 40, "unusable": 10}
EXPOSURE = {"good": 90, "slightly_off": 65, "badly_under": 20, "badly_over": 20}
FRAMING = {"strong": 90, "fine": 65, "weak": 40, "broken": 15}
UNKNOWN = 50


def overall(sharp: int, exposed: int, framed: int) -> float:
    """Weighted quality, rounded as Python rounds the double."""
    return round(0.55 * (sharp / 100) + 0.30 * (exposed / 100) + 0.15 * (framed / 100), 3)


#: "sharpness|exposure|framing" scores in hundredths to overall quality: rounding ties differ between engines, a table does not.
OVERALL = {f"{a}|{b}|{c}": overall(a, b, c) for a, b, c in product(sorted({*SHARPNESS.values(), UNKNOWN}), sorted({*EXPOSURE.values(), UNKNOWN}), sorted({*FRAMING.values(), UNKNOWN}))}

# Orders of decisions and of sharpness, phrases that condemn a frame, and the limits of measurements; all of them change decisions or which frame is best.
VERDICT_RANK = {"Keep": 0, "Review": 1, "Delete": 2, "Failed": 3}
SHARPNESS_RANK = {"sharp": 0, "acceptable": 1, "soft": 2, "unusable": 3, "": 2}
FATAL = ("lens cap", "finger over lens", "accidental", "pocket shot", "completely black", "completely white")
SHARP_EVIDENCE = 0.55
NO_DETAIL = 0.20
FAST_SOFT = 0.35
SEVERE_CLIP = 0.15
MILD_CLIP = 0.05
VERY_DARK = 0.10
VERY_BRIGHT = 0.92
HIGHLIGHT = 250
SHADOW = 5
SHARP_EDGE = 1536
EXPOSURE_EDGE = 1024
TILES = 8
TOP_TILES = 3
VARIANCE_FLOOR = 10.0
VARIANCE_CEILING = 2000.0
BURST_GAP_SECONDS = 3.0
NEAR_IDENTICAL = 4
SIMILAR = 12
DEMOTED_CONFIDENCE = 0.6
KEYWORD_LIMIT = 10
SIDECAR_KEYWORDS = 8
# Part of the cache's key, the failures in a row that end a run, the models in the order in which they are preferred, the kinds of the evaluation set, and the record's columns.
RULE_VERSION = "1"
FAILURE_LIMIT = 10
MODEL_FAMILIES = ("qwen3-vl", "qwen2.5vl", "gemma4", "gemma3", "minicpm-v", "llava", "llama3.2-vision", "moondream", "mistral-small3")
VARIANTS = ("original", "defocus", "underexposed", "overexposed")

CSV_COLUMNS = ("timestamp", "filepath", "filename", "decision", "confidence", "issues", "subject", "subject_sharpness", "exposure", "framing", "blur_score",
               "exposure_score", "composition_score", "overall_score", "measured_sharpness", "burst_size", "best_of_burst", "duplicate_of", "description", "keywords", "processing_ms")
