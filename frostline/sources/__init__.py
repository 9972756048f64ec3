"""Readers and writers for telemetry, posture and saved results."""
