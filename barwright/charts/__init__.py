"""Chart geometry as tables, and SVG and PNG sinks."""
