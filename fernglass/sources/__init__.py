"""sources of fernglass."""
