"""Fixed field lists of the claim record."""

# Claim fields and their output columns, in output order.
RECORD_FIELDS = {
    "title": "map_title",
    "date_text": "map_date",
    "date_year": "map_date_year",
    "publisher": "map_publisher",
    "scale_text": "map_scale",
    "scale_ratio": "map_scale_ratio",
    "projection": "map_projection",
    "edition": "map_edition",
    "coordinates_text": "map_coordinates",
    "bbox_west": "map_bbox_west",
    "bbox_east": "map_bbox_east",
    "bbox_south": "map_bbox_south",
    "bbox_north": "map_bbox_north",
    "place_names": "map_place_names",
    "legend_content": "map_legend_content",
    "notes": "map_notes",
    "map_type": "map_type",
    "subject": "map_subject",
    "coverage": "map_coverage",
    "country": "map_country",
    "province": "map_province",
    "city": "map_city",
    "district": "map_district",
    "medium": "map_medium",
    "language": "map_language",
    "condition": "map_condition",
    "has_insets": "map_has_insets",
    "description": "map_description",
}
# Numeric fields; the first group holds whole numbers.
WHOLE_NUMBERS = ("date_year", "scale_ratio")
EDGES = ("bbox_west", "bbox_east", "bbox_south", "bbox_north")
NUMERIC_FIELDS = WHOLE_NUMBERS + EDGES

# Which reviewer checks a field; every other field is "visual".
GEO_FIELDS = ("country", "province", "city", "district", "coordinates_text") + EDGES
OCR_FIELDS = (
    "title", "date_text", "date_year", "publisher", "scale_text", "scale_ratio",
    "projection", "edition", "legend_content", "notes", "place_names",
)
# Fields that a second reading can repair.
REREAD_FIELDS = OCR_FIELDS + ("coordinates_text",) + EDGES
# Fields whose names must be printed on the page.
PRESENCE_FIELDS = ("country", "province", "city", "district")

TYPE_SPECIFIC = "type_specific."

# Dublin Core columns in output order.
DUBLIN_CORE = (
    "dc:identifier", "dc:title", "dc:creator", "dc:publisher", "dc:date", "dcterms:created",
    "dcterms:hasVersion", "dc:type", "dc:format", "dcterms:medium", "dcterms:extent",
    "dc:language", "dc:subject", "dc:coverage", "dcterms:spatial", "dc:description",
    "dcterms:conformsTo",
)
