"""thermocline: climate-driven energy-demand analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
