"""Readers and writers, and the frames/points/depth views over the driver's tables."""
