"""operators of fernglass."""
