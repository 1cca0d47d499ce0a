"""plans of the document desk."""
