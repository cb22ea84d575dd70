"""Stages: which operators build which published tables."""
