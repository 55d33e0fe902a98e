"""Registered queries: operators on the fixture views, each with its SQL where SQL can express it."""
