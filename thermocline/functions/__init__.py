"""Part of thermocline."""
