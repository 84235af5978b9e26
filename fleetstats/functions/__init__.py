"""Column builders: coercion, ages, bins, versions."""
