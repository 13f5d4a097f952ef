"""Keys, chords and tempo as Column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch names in semitone order and the probe-tone key profiles.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
KEY_PROFILES = {
    "major": [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
    "minor": [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17],
}


def pitch_name(pc: Column) -> Column:
    return F.element_at(F.lit(PITCHES), F.pmod(pc, F.lit(12)).cast("int") + 1)


def tonic(key: Column) -> Column:
    """Pitch class of a key such as ``'A minor'``."""
    return F.array_position(F.lit(PITCHES), F.split(key, " ")[0]).cast("int") - 1


def mode(key: Column) -> Column:
    return F.get(F.split(key, " "), F.lit(1))


def relative_key(tonic_: Column, mode_: Column) -> Column:
    """The key of the other mode with the same pitch classes."""
    major = mode_ == "major"
    return F.concat(pitch_name(F.when(major, tonic_ + 9).otherwise(tonic_ + 3)), F.when(major, " minor").otherwise(" major"))


def circle_distance(a: Column, b: Column) -> Column:
    """Steps between two tonics on the circle of fifths, 0 to 6. Seven semitones are one step."""
    d = F.pmod((a - b) * 7, F.lit(12))
    return F.least(d, 12 - d)


def semitones(a: Column, b: Column) -> Column:
    """Shift from a to b in [-6, 5]."""
    return F.pmod(b - a + 6, F.lit(12)) - 6


def pitch_distance(ta: Column, ma: Column, tb: Column, mb: Column) -> tuple[Column, Column]:
    """(semitones, relation) from tonics and modes; identical and relative keys need no shift."""
    same = (ta == tb) & (ma == mb)
    rel = (ma != mb) & (F.pmod(F.when(ma == "major", ta + 9).otherwise(ta + 3), F.lit(12)) == tb)
    far = F.concat(F.when(ma == mb, "same mode").otherwise("other mode"), F.lit(", fifths distance "), circle_distance(ta, tb).cast("string"))
    return F.when(same | rel, 0).otherwise(semitones(ta, tb)), F.when(same, "same key").when(rel, "relative key").otherwise(far)


def key_distance(key_a: Column, key_b: Column) -> tuple[Column, Column]:
    """The same for key names such as ``'A minor'``."""
    return pitch_distance(tonic(key_a), mode(key_a), tonic(key_b), mode(key_b))


def to_eval_label(label: Column) -> Column:
    """Player notation to evaluation notation: Am -> A:min, F -> F:maj, empty/N/X -> N."""
    none = label.isNull() | label.isin("", "N", "X")
    minor = F.concat(F.regexp_replace(label, "m$", ""), F.lit(":min"))
    return F.when(none, "N").when(label.endswith("m"), minor).otherwise(F.concat(label, F.lit(":maj")))


def tempo_candidates(bpm: Column) -> Column:
    """Half, same and double tempo, rounded, distinct, ascending."""
    return F.array_sort(F.array_distinct(F.array(F.round(bpm / 2, 2), F.round(bpm, 2), F.round(bpm * 2, 2))))


def unit_profiles() -> list[tuple[int, str, list[float]]]:
    """The 24 rotated key profiles, centred and scaled to unit length."""
    out = []
    for t in range(12):
        for m, profile in KEY_PROFILES.items():
            mean = sum(profile) / 12
            centred = [profile[(i - t) % 12] - mean for i in range(12)]
            norm = sqrt(sum(x * x for x in centred))
            out.append((t, m, [x / norm for x in centred]))
    return out


def triads() -> list[tuple[str, list[float]]]:
    """The 24 unit-length major and minor triads, minor after major for each root."""
    out = []
    for root in range(12):
        for third, suffix in ((4, ""), (3, "m")):
            on = {root, (root + third) % 12, (root + 7) % 12}
            out.append((PITCHES[root] + suffix, [1 / sqrt(3) if i in on else 0.0 for i in range(12)]))
    return out


def dot(a: Column | str, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
