"""Part of webgauge: streaming."""
