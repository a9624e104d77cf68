"""Frame streams: admission, throttling, windows and incremental maps."""
