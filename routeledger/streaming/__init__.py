"""The same column functions and the scan over streams."""
