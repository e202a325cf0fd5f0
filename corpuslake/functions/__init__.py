"""Part of corpuslake."""
