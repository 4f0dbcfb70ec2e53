"""Part of webgauge: operators."""
