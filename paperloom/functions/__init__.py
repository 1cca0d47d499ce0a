"""functions of the document desk."""
