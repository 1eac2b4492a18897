"""Transformations of counts and models."""
