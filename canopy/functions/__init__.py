"""Part of the canopy engine."""
