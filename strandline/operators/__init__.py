"""DataFrame operators of the analytics engine; each takes frames and parameters and returns a frame."""
