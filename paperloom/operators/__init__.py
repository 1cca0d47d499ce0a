"""operators of the document desk."""
