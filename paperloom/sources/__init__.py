"""sources of the document desk."""
