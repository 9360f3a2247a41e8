"""Decoders from bytes to Python rows, without Spark. A damaged file gives what can be read of it."""
