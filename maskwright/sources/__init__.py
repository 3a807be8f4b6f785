"""Where pages, items and model replies come from."""
