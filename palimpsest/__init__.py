"""Digging through old scripting files, and the tables made from them, with Spark."""
