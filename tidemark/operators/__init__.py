"""Operators: observations, ladders, outcomes, star schema, metrics, flags."""
