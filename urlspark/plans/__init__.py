"""Compositions of operators: training frames, end-to-end fit, scoring."""
