"""Scalar rules as Column expressions."""

from __future__ import annotations

import math

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    value = _col(c).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def sanitize(c: Column | str) -> Column:
    """Float score with NaN, +Inf, −Inf and NULL mapped to 0."""
    value = _col(c).cast("float")
    return F.when(is_finite(value), value).otherwise(F.lit(0.0).cast("float"))


def above(score: Column | str, threshold: float | Column) -> Column:
    """Strict comparison in float32, the precision scores are stored in."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return sanitize(score) > cut.cast("float")


def mask_label(value: Column | str, threshold: float = 0.0) -> Column:
    return _col(value) > F.lit(threshold)


def ratio(numerator: Column, denominator: Column, floor: float = 1) -> Column:
    """numerator / max(denominator, floor)."""
    return numerator / F.greatest(denominator, F.lit(floor))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def fail_unless(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds, an error otherwise."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


# Accepted spellings of the two classes, and words read as yes / no.
LABEL_ALIASES = {
    "0": 0, "healthy": 0, "control": 0, "source": 0, "a": 0,
    "1": 1, "brats": 1, "brats21": 1, "target": 1, "lesion": 1, "b": 1,
}
TRUTHY = ("1", "true", "yes", "y")
PASS_WORDS = ("pass", "passed", "true", "yes", "ok", "success", "complete")
FAIL_WORDS = ("fail", "failed", "false", "no", "error")
CANONICAL_MODALITIES = ("FLAIR", "T1", "T2")


def lookup(mapping: Mapping, key: Column) -> Column:
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def label_or_null(c: Column | str) -> Column:
    """0 / 1 for a boolean or number by its type, or for a text that is an alias; NULL when it is none of them."""
    kind, text = F.typeof(_col(c)), F.lower(F.trim(_col(c).cast("string")))
    number = text.try_cast("double")
    by_number = F.when(number.isin(0.0, 1.0), number.cast("int"))
    return F.when(kind == "boolean", (text == "true").cast("int")).when(kind == "string", lookup(LABEL_ALIASES, text)).otherwise(by_number)


def label_strict(c: Column | str) -> Column:
    value = label_or_null(c)
    return F.coalesce(value, F.raise_error(F.concat(F.lit("not a binary label: "), _col(c).cast("string"))))


def z_norm(z: Column | str, depth: Column | str) -> Column:
    return _col(z) / F.greatest(F.lit(1), _col(depth) - 1)


def z_bin(norm: Column | str, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(_col(norm) * F.lit(bins))).cast("int")


def namespaced_id(dataset: Column | str, participant: Column | str) -> Column:
    name = F.translate(F.lower(F.trim(_col(dataset).cast("string"))), "/", "_")
    return F.concat_ws(":", name, F.trim(_col(participant).cast("string")))


def safe_id(c: Column | str, default: str = "subject") -> Column:
    cleaned = F.regexp_replace(_col(c).cast("string"), r"[^\p{L}\p{N}\-_.]", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def first_present(*columns: Column | str) -> Column:
    """First value that is neither NULL nor blank."""
    return F.coalesce(*[F.nullif(F.trim(_col(c).cast("string")), F.lit("")) for c in columns])


def truthy(c: Column | str, default: bool = True) -> Column:
    """Metadata flag; only a missing value takes the default."""
    text = F.lower(F.trim(_col(c).cast("string")))
    return F.coalesce(text.isin(*TRUTHY), F.lit(default))


def tri_state(c: Column | str) -> Column:
    """TRUE / FALSE for recognised words, NULL otherwise."""
    text = F.lower(F.trim(_col(c).cast("string")))
    return F.when(text.isin(*PASS_WORDS), F.lit(True)).when(text.isin(*FAIL_WORDS), F.lit(False))


def modality_set(c: Column | str) -> Column:
    """Canonical ``FLAIR+T1+T2`` text from a list in any order, case and separator; unknown names follow, sorted."""
    parts = F.array_distinct(
        F.filter(F.transform(F.split(_col(c), "[+,/;_ ]+"), lambda x: F.upper(F.trim(x))), lambda x: x != F.lit(""))
    )
    known = F.array(*[F.lit(m) for m in CANONICAL_MODALITIES])
    return F.array_join(F.concat(F.array_intersect(known, parts), F.array_sort(F.array_except(parts, known))), "+")


def strip_volume_suffix(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"(?i)\.nii(\.gz)?$", "")


def folder_stem(folder: Column | str, suffix: str = "_nifti") -> Column:
    """Name of a case folder without its suffix, follow-up part included; null where the suffix or the name is missing."""
    c = _col(folder)
    return F.when(F.endswith(c, F.lit(suffix)) & (F.length(c) > len(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix)))


def file_subject(path: Column | str) -> Column:
    """Subject of a volume file: its name up to the first underscore, without directory and volume suffix."""
    return F.split_part(strip_volume_suffix(F.substring_index(_col(path), "/", -1)), F.lit("_"), F.lit(1))


# Parts of a file name that rule it out, and the tokens of the sequences.
EXCLUDED_PARTS = ("mask", "seg", "label", "n4", "mni", "sri24", "registered", "warped")
CONTRAST_TOKENS = ("t1ce", "t1c", "t1gd", "t1post")
CONTRAST_HINTS = ("post", "gd", "contrast")
T1_TOKENS = ("t1", "t1w", "t1n")
T2_TOKENS = ("t2", "t2w")


def modality_from_name(name: Column | str) -> Column:
    """flair / t1 / t2 from a file name, NULL for derived files; a contrast-enhanced T1 is never T1."""
    stem = F.lower(strip_volume_suffix(name))
    tokens = F.split(stem, "[^a-z0-9]+")

    def has(*words: str) -> Column:
        return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))

    return (
        F.when(stem.rlike("|".join(EXCLUDED_PARTS)), None)
        .when(stem.contains("flair") | has("t2f"), "flair")
        .when(has(*CONTRAST_TOKENS), None)
        .when(has(*CONTRAST_HINTS) & stem.contains("t1"), None)
        .when(has(*T1_TOKENS), "t1")
        .when(has(*T2_TOKENS), "t2")
    )


def path_part(path: Column | str, index: int) -> Column:
    return F.try_element_at(F.split(_col(path), "/"), F.lit(index))


def stable_pair_id(comparison: Column | str, split: Column, left: Column, right: Column) -> Column:
    name = F.lit(comparison) if isinstance(comparison, str) else comparison
    text = F.concat_ws("|", name, split, left.cast("string"), right.cast("string"))
    return F.concat_ws(":", name, split, F.substring(F.sha2(text, 256), 1, 12))


def json_safe(c: Column | str) -> Column:
    """Non-finite numbers become NULL before they are written as JSON."""
    return F.when(is_finite(c), _col(c))


def shape_array(c: Column | str) -> Column:
    return F.transform(F.split(_col(c), r"\s*,\s*"), lambda x: F.trim(x).cast("int"))


def duration_text(seconds: Column | str) -> Column:
    total = F.floor(_col(seconds)).cast("long")
    return F.format_string(
        "%02d:%02d:%02d", (total / 3600).cast("long"), ((total % 3600) / 60).cast("long"), total % 60
    )


def status_of(fails: Column, passes: Column) -> Column:
    """Aggregate rule: any FAIL → FAIL, all PASS → PASS, otherwise INCONCLUSIVE."""
    return (
        F.when(F.coalesce(F.bool_or(fails), F.lit(False)), "FAIL")
        .when(F.coalesce(F.bool_and(F.coalesce(passes, F.lit(False))), F.lit(False)), "PASS")
        .otherwise("INCONCLUSIVE")
    )


def interpolate(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear interpolation between two knots; a degenerate bracket returns its left value."""
    return F.when(x1 > x0, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(y0)


def dice(tp: Column, predicted: Column, actual: Column, both_empty: float = 0.0) -> Column:
    """2·tp / (predicted + actual); the value for two empty masks is a parameter because reports disagree on it."""
    total = predicted + actual
    return F.when(total == 0, F.lit(float(both_empty))).otherwise(2.0 * tp / total)


def sorted_map_json(c: Column | str) -> Column:
    """Canonical text of a map: entries in key order (set operations reject map columns)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(c)))))


def log_gamma(z: Column) -> Column:
    """ln Γ(z) for z > 0: Stirling's series at z + 8, and the eight factors in between. Good to about 13 digits."""
    w = z + 8
    series = (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi))
    # Coefficients of the series (Bernoulli numbers).
    for power, c in ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188)):
        series = series + F.lit(c) / F.pow(w, F.lit(float(power)))
    for k in range(8):
        series = series - F.log(z + k)
    return series


def _beta_fraction(x: Column, a: Column, b: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, built up from its first term on."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    start = F.struct(F.lit(1.0).alias("c"), (1 / tiny(1 - (a + b) * x / (a + 1))).alias("d"), (1 / tiny(1 - (a + b) * x / (a + 1))).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / tiny(1 + even * s["d"]), tiny(1 + even / s["c"])
        d2, c2 = 1 / tiny(1 + odd * d1), tiny(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["h"])


def regularized_beta(x: Column, a: Column, b: Column, terms: int = 600) -> Column:
    """I_x(a, b) for 0 ≤ x ≤ 1 and a, b > 0; ``terms`` of the fraction do for parameters up to some hundred thousand."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _beta_fraction(x, a, b, terms) / a
    high = 1 - front * _beta_fraction(1 - x, b, a, terms) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(x < (a + 1) / (a + b + 2), low).otherwise(high))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n points by Student's distribution with n - 2 degrees; NULL for fewer than three."""
    return F.when((n > 2) & r.isNotNull(), regularized_beta(1 - r * r, (n - 2) / F.lit(2.0), F.lit(0.5)))


# Words that name a control, columns that flag one, neutral values of a flag, names of a diagnostic fit and of a main result.
CONTROL_WORDS = ("control", "controls", "tiny", "overfit", "positive", "negative", "registered", "permutation", "permutations", "shuffle", "shuffled", "null")
CONTROL_FLAGS = ("is_control", "control", "shuffle", "shuffled_labels")
NEUTRAL_FLAGS = ("", "none", "null", "main", "formal", "final", "no", "false", "0")
DIAGNOSTIC_KINDS = ("diagnostic_formalfit", "diagnostic_formal_fit", "diagnostic_fit")
MAIN_KINDS = ("formal_final", "formal", "final", "main")


def _bare(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def names_control(c: Column | str) -> Column:
    """Whether a path or text has a word that names a control: words are runs of letters and digits, so no part of a word counts."""
    return F.arrays_overlap(F.split(_bare(_col(c)), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in CONTROL_WORDS]))


def result_kind(kind: Column, stage: Column, markers: dict[str, Column], paths: list[Column]) -> Column:
    """``diagnostic_formalfit``, ``intermediate`` (any stage but final; none counts as final), ``control`` or ``formal_final``.

    A marker column speaks by its name: flags by truth, ``permutation_index`` by being there, all others and the stated kind
    by the words that name a control.
    """
    marks = [F.when(~_bare(kind).isin(*MAIN_KINDS), names_control(kind)).otherwise(False)]
    for name, value in markers.items():
        if name in CONTROL_FLAGS:
            marks.append(F.coalesce(tri_state(value), ~_bare(value).isin(*NEUTRAL_FLAGS)))
        else:
            marks.append(_bare(value) != "" if name == "permutation_index" else names_control(value))
    marks += [names_control(p) for p in paths]
    found = marks[0]
    for m in marks[1:]:
        found = found | m
    final = _bare(stage).isin("", "final")
    return F.when(_bare(kind).isin(*DIAGNOSTIC_KINDS), "diagnostic_formalfit").when(~final, "intermediate").when(found, "control").otherwise("formal_final")


def is_primary(stage: Column, modalities: Column, classifier: Column, seed: Column, selector: dict) -> Column:
    """Whether a row is that of the selector: stage, set of modalities, classifier and seed. A missing value is not."""
    return (
        (_bare(stage) == selector["stage"]) & (modality_set(F.coalesce(modalities, F.lit(""))) == selector["modalities"])
        & (_bare(classifier) == selector["classifier"]) & F.coalesce(seed.try_cast("int") == selector["seed"], F.lit(False))
    )
