"""Canonical inputs and registered queries."""
