"""Part of docketry."""
