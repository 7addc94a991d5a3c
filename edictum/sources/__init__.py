"""Sources: legacy programs, job control, record layouts."""
