"""Operators from files to the tables of what they hold."""
