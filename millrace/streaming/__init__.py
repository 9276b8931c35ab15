"""Streaming flavours of batch operators; an extension of our own."""
