"""Column helpers: native expressions applied to whole tables."""
