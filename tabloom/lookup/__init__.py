"""Dictionary, place, classification and subject-heading lookups."""
