"""Iterative plans: training loops and graph components."""
