"""Streams: sliding buffers and live viewports."""
