"""Part of webgauge: functions."""
