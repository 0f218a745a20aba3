"""Composed plans: the feature pipeline and the checked query catalogue."""
