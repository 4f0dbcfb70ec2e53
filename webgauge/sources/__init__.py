"""Part of webgauge: sources."""
