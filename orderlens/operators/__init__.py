"""Relational operators of the order pipeline (all lazy ``DataFrame -> DataFrame``)."""
