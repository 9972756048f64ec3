"""The time-binned series on a live stream."""
