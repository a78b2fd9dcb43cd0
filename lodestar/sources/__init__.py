"""Readers, writers, generated calendars and staged tables."""
