"""DataFrame-to-DataFrame operators, used unchanged on batch and streaming input."""
