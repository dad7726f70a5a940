"""functions of fernglass."""
