"""Files as they arrive, decoded by the same operators."""
