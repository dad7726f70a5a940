"""streaming of fernglass."""
