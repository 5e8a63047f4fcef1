"""Functions on evidence boxes, physical sizes, languages and scale statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom._columns import strip, to_number

# Language names and their two-letter codes.
LANGUAGE_CODES = {
    "english": "en", "french": "fr", "german": "de", "spanish": "es",
    "italian": "it", "portuguese": "pt", "russian": "ru", "chinese": "zh",
    "japanese": "ja", "arabic": "ar", "dutch": "nl", "latin": "la",
}
# A size inside a file name, e.g. "71.5cm X 106.6cm".
SIZE_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*cm\s*[x×]\s*(\d+(?:\.\d+)?)\s*cm"
# Words that show a scale was measured on a bar.
BAR_WORDS = ("bar", "graphical", "mile", "km", "inch")


def size_from_name(name: Column) -> tuple[Column, Column]:
    """Width and height in cm from a file name, 0.0 when not stated."""

    def side(group: int) -> Column:
        found = F.regexp_extract(name, SIZE_PATTERN, group).try_cast("double")
        return F.coalesce(found, F.lit(0.0))

    return side(1), side(2)


def physical_size(pixels: Column, dpi: Column) -> Column:
    """Centimetres of a scan side, 0.0 when the resolution is unknown."""
    inches = F.try_divide(pixels.cast("double"), F.when(dpi > 0, dpi.cast("double")))
    return F.coalesce(F.round(inches * 2.54, 2), F.lit(0.0))


def iso_language(c: Column) -> Column:
    """Comma list of languages with known names replaced by their codes."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])

    def code(part: Column) -> Column:
        key = F.lower(part)
        return F.when(F.length(key) == 2, key).otherwise(
            F.coalesce(F.try_element_at(codes, key), part)
        )

    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), code), ", ")


def edge_number(c: Column) -> Column:
    """Number of a box edge given as text or number; blank and N/A are null."""
    return to_number(strip(c.cast("string")))


def dcmi_box(west: Column, east: Column, south: Column, north: Column) -> Column:
    """DCMI box text, empty when an edge is missing. Edges are doubles."""
    edges = [("northlimit", north), ("southlimit", south), ("westlimit", west), ("eastlimit", east)]
    parts = [F.concat(F.lit(f"{key}="), value.cast("string")) for key, value in edges]
    whole = F.concat(
        F.lit("name=Bounding Box; "),
        *[x for part in parts for x in (part, F.lit("; "))],
        F.lit("projection=WGS84"),
    )
    return F.coalesce(whole, F.lit(""))


def scale_source(evidence_text: Column, evidence_kind: Column) -> Column:
    """How a scale was obtained: printed, quoted, from a bar, from text, unknown."""
    low = F.lower(evidence_text)
    bar = F.lit(False)
    for word in BAR_WORDS:
        bar = bar | low.contains(word)
    printed = evidence_text.rlike(r"\d[\d,]{2,}\s*$") | evidence_text.contains("1:")
    return (
        F.when(F.coalesce(evidence_text, F.lit("")) == "", F.lit("unknown"))
        .when((evidence_kind == "direct_quote") & printed, F.lit("printed_ratio"))
        .when(evidence_kind == "direct_quote", F.lit("direct_quote_other"))
        .when((evidence_kind == "computed") & bar, F.lit("computed_from_bar"))
        .when(evidence_kind == "computed", F.lit("computed_from_text"))
        .otherwise(F.lit("unknown"))
    )


def _clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(high if isinstance(high, Column) else F.lit(high), value))


def sanitize_box(box: Column) -> Column:
    """[x, y, w, h] in percent, clamped to the page; an invalid box is the whole page."""
    part = [F.try_element_at(box, F.lit(i)).cast("double") for i in (1, 2, 3, 4)]
    w, h = _clamp(part[2], 1.0, 100.0), _clamp(part[3], 1.0, 100.0)
    x = _clamp(part[0], 0.0, F.lit(100.0) - w)
    y = _clamp(part[1], 0.0, F.lit(100.0) - h)
    valid = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull())
    whole_page = F.array(*[F.lit(v) for v in (0.0, 0.0, 100.0, 100.0)])
    clean = F.array(*[F.round(v, 2) for v in (x, y, w, h)])
    return F.when(F.coalesce(valid, F.lit(False)), clean).otherwise(whole_page)


def pad_box(box: Column, margin: float = 6.0) -> Column:
    """Grow a box on all sides without leaving the page."""
    x, y, w, h = (F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4))
    left, top = F.greatest(F.lit(0.0), x - margin), F.greatest(F.lit(0.0), y - margin)
    width = F.least(F.lit(100.0) - left, w + 2 * margin)
    height = F.least(F.lit(100.0) - top, h + 2 * margin)
    return F.array(left, top, width, height)
