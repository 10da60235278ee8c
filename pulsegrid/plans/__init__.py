"""Registered queries over the shared tables, each with its SQL oracle."""
