"""Scalar functions on strings, numbers and pixel values, as SQL expression text."""
from __future__ import annotations


def as_pair(value):
    """One size for both directions, or the pair itself."""
    if isinstance(value, tuple):
        if len(value) != 2:
            raise ValueError(f"expected two values, got {value!r}")
        return value
    return value, value


def file_safe(name: str) -> str:
    """Blanks and slashes become underscores, brackets and quotes go, '&' is spelled out."""
    return f"""replace(translate({name}, " /[]()'", '__'), '&', 'and')"""


def spaced_name(name: str) -> str:
    """Put a blank before an inner capital letter."""
    return rf"regexp_replace({name}, r'(\w)([A-Z])', '$1 $2')"


def city_country(city: str, country: str) -> str:
    return f"concat_ws(', ', {city}, {country})"


def image_name(country: str, city: str, end_date: str) -> str:
    return f"concat_ws('_', {country}, {file_safe(city)}, substring({end_date}, 1, 4))"


def basename(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def stem(path: str) -> str:
    return rf"regexp_replace({basename(path)}, r'\.[^.]*$', '')"


def path_part(path: str, from_end: int) -> str:
    """Directory name counted from the end of a path (1 = file name)."""
    return f"element_at(split({path}, '/'), {-from_end})"


def class_file(class_id: str, class_name: str | None = None) -> str:
    parts = f"CAST({class_id} AS STRING)" + (f", {class_name}" if class_name else "")
    return f"concat(concat_ws('-', 'class', {parts}), '.json')"


def clamp(value: str, low: float, high: float) -> str:
    return f"least(greatest({value}, {low}D), {high}D)"


def clamp_lonlat(lon: str, lat: str) -> tuple[str, str]:
    return clamp(lon, -180.0, 180.0), clamp(lat, -90.0, 90.0)


def guarded_ratio(part: str, total: str) -> str:
    """part / total, 0 where the total is not positive."""
    return f"CASE WHEN {total} > 0 THEN {part} / {total} ELSE 0D END"


def percent_label(ratio: str) -> str:
    return f"format_string('%.1f%%', ({ratio}) * 100)"


def millions_label(value: str) -> str:
    return f"format_string('%.1fM', ({value}) / 1e6D)"


def sigmoid(z: str) -> str:
    return f"1 / (1 + exp(-({z})))"


def over_threshold(score: str, threshold: float = 0.5, inclusive: bool = False) -> str:
    return f"CAST({score} {'>=' if inclusive else '>'} {threshold}D AS INT)"


def nan_to_zero(value: str) -> str:
    return f"nanvl(coalesce({value}, 0D), 0D)"


def class_weight(class_id: str) -> str:
    """Burn value of a feature class: 1 -> 1.0, 2 -> 0.5, else 0."""
    return f"CASE {class_id} WHEN 1 THEN 1D WHEN 2 THEN 0.5D ELSE 0D END"


def math_azimuth(solar_azimuth: str) -> str:
    """Compass angle to mathematical angle."""
    return f"90 - {solar_azimuth}"


def min_max(value: str, low: str, high: str) -> str:
    """Scale to [0, 1]; a constant column gives 0."""
    return f"CASE WHEN {high} > {low} THEN ({value} - {low}) / ({high} - {low}) WHEN {value} IS NOT NULL THEN 0D END"
