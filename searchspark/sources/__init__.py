"""Inputs of the engine."""
