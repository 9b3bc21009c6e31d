"""The same bars and indicators over streams."""
