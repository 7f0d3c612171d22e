"""Pipelines, and the catalogues of registered queries."""
