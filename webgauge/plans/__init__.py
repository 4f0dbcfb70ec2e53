"""Part of webgauge: plans."""
