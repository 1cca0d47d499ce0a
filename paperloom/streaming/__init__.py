"""streaming of the document desk."""
