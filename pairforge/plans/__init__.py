"""Shared plan pieces: scratch tables, salted joins, components and registered queries."""
